"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart from data bytes.

A file holds blocks. A block lists its ids by falling frequency; a token is its place in that
list, in as few whole bytes as hold it. Two bits of a control byte give the number of data
bytes of each of four tokens. Readers look a control byte up in a table of four lengths,
add the lengths up and pick the bytes with numpy, with no loop over tokens. Blocks are rows
of Parquet files, which carry the bytes to any store that Spark writes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulage.llm.bpe import checked_encoder
from haulage.llm.chunks import crc
from haulage.llm.text import slices

BLOCK_TOKENS = 1 << 20
FILE_GROUP_BYTES = 16 << 20

#: Lengths of the four tokens of each control byte, and what is kept of four bytes for each length.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids by falling count, ties by id, and each id's place among them."""
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.empty(len(counts), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return order.astype("<u4"), place[ids]


def to_bytes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit values."""
    codes = codes.astype("<u4")
    lengths = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[: len(codes)] = lengths - 1
    control = (padded.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1).astype(np.uint8)
    raw = codes.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < lengths[:, None]].tobytes()


def from_bytes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that to_bytes wrote."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    found = raw[starts]
    for k in range(1, int(lengths.max(initial=1))):
        found = found | raw[starts + k] << np.uint32(8 * k)
    return found & MASKS[lengths]


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text: str = "text", end: int = 0
) -> None:
    """Encode every text, append `end`, and write the ids to files in ascending order of the id column.

    Null ids come first; a null or empty text is the end id alone. Rows with the same id are all
    written, ordered by a hash of their text; a frequent id still spreads over files. Other columns are not carried. A table
    without rows writes a folder without blocks.
    """
    id_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = checked_encoder(tokenizer), TaskContext.get().partitionId()
        keys: list = []
        held: list[np.ndarray] = []
        tokens, block, before = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, tokens, block, before
            table, codes = ranked(np.concatenate(held))
            control, data = to_bytes(codes)
            row = [part, block, before, tokens, keys, [len(x) for x in held], table.tobytes(), control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64())]
            kinds += [pa.binary()] * 3
            before, block = before + tokens, block + 1
            keys, held, tokens = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=NAMES)

        for batch in batches:
            for cut, texts in slices(batch, "_text"):
                for key, ids in zip(cut.column(0).to_pylist(), encoder.batch(texts), strict=True):
                    held.append(np.append(ids, np.uint32(end)))
                    keys.append(key)
                    tokens += len(ids) + 1
                    if tokens >= BLOCK_TOKENS:
                        yield flush()
        if held:
            yield flush()

    rows = df.select(df[id_column].cast("long").alias("_id"), df[text].alias("_text"))
    tie = F.xxhash64("_text")
    blocks = rows.repartitionByRange("_id", tie).sortWithinPartitions("_id", tie).mapInArrow(run, BLOCK)
    blocks.write.option("compression", "none").option("parquet.block.size", FILE_GROUP_BYTES).parquet(path)


NAMES = ["part", "block", "before", "tokens", "ids", "counts", "ranked", "control", "data"]
BLOCK = (
    "part int, block int, before long, tokens long, ids array<long>, counts array<long>,"
    " ranked binary, control binary, data binary"
)


def read_tokens(spark: SparkSession, path: str, id_column: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document from the files: its id, start, n_tokens, ids_crc32, ids (null unless `with_ids`).

    start counts the ids of all documents before it, over all files. Only one row per file passes
    the one task that adds files up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                table = np.frombuffer(row["ranked"], dtype="<u4")
                ids = table[from_bytes(row["control"], row["data"], row["tokens"])]
                counts = np.array(row["counts"], dtype=np.int64)
                texts = np.split(ids, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(row["start"] + np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array([crc(x) for x in texts], pa.int64()),
                        pa.array([x.tobytes() if with_ids else None for x in texts], pa.binary()),
                    ],
                    names=[id_column, "start", "n_tokens", "ids_crc32", "ids"],
                )

    blocks = spark.read.schema(BLOCK).parquet(path)
    whole = blocks.groupBy("part").agg(F.sum("tokens").alias("all"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.select("part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    # Two numbers for each file.
    placed = blocks.join(F.broadcast(ahead), "part").withColumn("start", F.col("ahead") + F.col("before"))
    return placed.drop("ahead", "before", "part", "block").mapInArrow(
        run, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
