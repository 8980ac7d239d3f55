"""Language-model scores from a Bloom filter that holds quantised counts of word pairs.

Pairs of words are counted over all training texts. A pair seen c times is put into the filter once
for each level up to the logarithm of c; a reader probes level after level until one is missing,
and takes the least count of the last level found. Each hash bucket of pairs owns its stretch of the
filter, so the task that counts a bucket also makes that stretch. The filter grows with the pairs and is nowhere
held whole: buckets grow in number, blocks of texts send each bucket their own distinct pairs and get back
the levels. Single words keep exact counts, which blocks ask for by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from haulage.llm.links import checkpointed
from haulage.llm.text import END, Words, find_words, hash_words, lowered, mixed, slices
from haulage.llm.training import held_out

BLOCK_BYTES = 16 << 20
BUCKET_PAIRS = 1 << 21
CHUNK_PAIRS = 1 << 20
MOST_BITS = 1 << 28  # more than a bucket of BUCKET_PAIRS takes
BITS_PER_ITEM = 14
PROBES = 6
LEAST_COUNT = 1
PAIR = np.uint64(0xD1342543DE82EF95)
LEVEL = 0xA24BAED4963EE407


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text with one end behind each, and the bounds of the texts."""
    words: Words = find_words(texts)
    hashes = hash_words(words, lowered(words.buffer))
    bounds = words.first + np.arange(len(texts) + 1)
    found = np.empty(len(hashes) + len(texts), dtype=np.uint64)
    ends = np.zeros(len(found), dtype=bool)
    ends[bounds[1:] - 1] = True
    found[ends], found[~ends] = END, hashes
    return found, bounds


def pairs(found: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; the first of a text follows an end."""
    before = np.concatenate([[END], found[:-1]]).astype(np.uint64)
    return mixed(before * PAIR + found)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def by_bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """An order of pairs: by bucket, then by the 32 bits that tell them apart in it."""
    return np.argsort((bucket_of(values, buckets) << np.uint64(32)) | (values & np.uint64(0xFFFFFFFF)), kind="stable")


def gaps(values: np.ndarray) -> bytes:
    """32-bit values in order as the gaps between them, byte by byte of all, since their high bytes are mostly zero."""
    found = np.diff(values.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return found.view(np.uint8).reshape(-1, 4).T.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64)


def counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


@dataclass
class Filter:
    """The bits of one bucket; level k stands for counts of LEAST_COUNT * 2 ** (k - 1) or more."""

    bits: np.ndarray
    size: int
    levels: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The highest level at which each pair is found without a gap, 0 for none."""
        found = np.zeros(len(hashes), dtype=np.uint8)
        left = np.arange(len(hashes))
        for level in range(1, self.levels + 1):
            here = np.ones(len(left), dtype=bool)
            for at in places(hashes[left], level, self.size):
                here &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[here]
            if not len(left):
                break
            found[left] = level
        return found


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The least count of each level."""
    return np.where(levels > 0, LEAST_COUNT << np.maximum(levels.astype(np.int64) - 1, 0), 0)


def places(hashes: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """Where a pair's bits for a level are in its bucket's stretch."""
    spread = mixed((hashes & np.uint64(0xFFFFFFFF)) + np.uint64(level * LEVEL % (1 << 64)))
    first, step = spread & np.uint64(0xFFFFFFFF), spread >> np.uint64(32) | np.uint64(1)
    for k in range(PROBES):
        yield ((first + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)


def levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    """1 + the whole logarithm to base 2 of count / least; 0 under least."""
    return np.where(counts >= least, np.frexp(np.maximum(counts, 1) // least)[1], 0)


def stretch(hashes: np.ndarray, levels: np.ndarray, size: int) -> np.ndarray:
    """The `size` bits of a bucket, packed, with each pair set once for each level up to its own."""
    bits = np.zeros(size, dtype=np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in places(hashes[levels >= level], level, size):
            bits[place] = 1
    return np.packbits(bits, bitorder="little")


def pair_filter(training: DataFrame, buckets: int) -> DataFrame:
    """(bucket, size, levels, bits): the filter over all pairs, one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values = np.concatenate(held)
            values, counts = counted(values, np.ones(len(values), dtype=np.uint32))
            order = by_bucket(values, buckets)
            values, counts = values[order], counts[order].astype("<u4")
            cuts = np.searchsorted(bucket_of(values, buckets), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            short = (values & np.uint64(0xFFFFFFFF)).astype("<u4")
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([gaps(short[cuts[b] : cuts[b + 1]]) for b in some], pa.binary()),
                    pa.array([counts[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()),
                ],
                names=["bucket", "hashes", "counts"],
            )

        for batch in batches:
            for _, texts in slices(batch, "_text"):
                held.append(pairs(tokens(texts)[0]))
                if sum(map(len, held)) >= CHUNK_PAIRS:
                    yield flush()
        if held:
            yield flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, counts = None, [], []

        def flush() -> pa.RecordBatch:
            v, c = counted(np.concatenate(values), np.concatenate(counts).astype(np.int64))
            levels = levels_of(c, LEAST_COUNT)
            size = max(64, -(-int(levels.sum()) * BITS_PER_ITEM // 64) * 64)
            row = [now], [size], [int(levels.max())], [stretch(v.astype(np.uint64), levels, size).tobytes()]
            values.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                names=["bucket", "size", "levels", "bits"],
            )

        for batch in batches:
            for bucket, v, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now:
                    if values:
                        yield flush()
                    now = bucket
                values.append(from_gaps(v).astype("<u4"))
                counts.append(np.frombuffer(c, dtype="<u4"))
                if sum(map(len, values)) > 4 * BUCKET_PAIRS:
                    merged = counted(np.concatenate(values), np.concatenate(counts).astype(np.int64))
                    values, counts = [merged[0]], [merged[1]]
        if values:
            yield flush()

    parts = training.select("_text").mapInArrow(count, "bucket int, hashes binary, counts binary")
    ordered = parts.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(add_up, "bucket int, size long, levels int, bits binary")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): distinct token hashes and how often they occur, added up as far as one task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            value, number = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(number)], names=["word", "n"])

        for batch in batches:
            for _, texts in slices(batch, "_text"):
                held.append(tokens(texts)[0])
                if sum(map(len, held)) >= 2 * CHUNK_PAIRS:
                    yield flush()
        if held:
            yield flush()

    return rows.select("_text").mapInArrow(run, "word long, n long")


def words_asked(rows: DataFrame) -> DataFrame:
    """(_block, word): the distinct token hashes of each block."""

    def run(texts: pa.Table) -> pa.Table:
        found = [tokens(cut)[0] for batch in texts.to_batches() for _, cut in slices(batch, "_text")]
        values = np.unique(np.concatenate(found))
        block = np.full(len(values), texts.column("_block")[0].as_py(), dtype=np.int64)
        return pa.table([pa.array(block), pa.array(values.view(np.int64))], names=["_block", "word"])

    return rows.groupBy("_block").applyInArrow(run, "_block long, word long")


def pairs_asked(rows: DataFrame, buckets: int) -> DataFrame:
    """(_block, bucket, hashes): the distinct pairs of each block, one row a bucket, in the order of `by_bucket`."""

    def run(texts: pa.Table) -> pa.Table:
        found = [pairs(tokens(cut)[0]) for batch in texts.to_batches() for _, cut in slices(batch, "_text")]
        values = np.unique(np.concatenate(found))
        values = values[by_bucket(values, buckets)]
        cuts = np.searchsorted(bucket_of(values, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        short = (values & np.uint64(0xFFFFFFFF)).astype("<u4")
        block = np.full(len(some), texts.column("_block")[0].as_py(), dtype=np.int64)
        blobs = [gaps(short[cuts[b] : cuts[b + 1]]) for b in some]
        return pa.table(
            [pa.array(block), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())],
            names=["_block", "bucket", "hashes"],
        )

    return rows.groupBy("_block").applyInArrow(run, "_block long, bucket int, hashes binary")


def pair_levels(asked: DataFrame, filters: DataFrame) -> DataFrame:
    """(_block, bucket, levels): a byte for each pair asked for, in the same order; 0 where no filter holds it."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = Filter(np.empty(0, dtype=np.uint8), 0, 0)
        for row in held.to_pylist():
            found = Filter(np.frombuffer(row["bits"], dtype=np.uint8), row["size"], row["levels"])
        blobs = (from_gaps(blob.as_py()) for blob in asked.column("hashes"))
        levels = pa.array([found.find(hashes).tobytes() for hashes in blobs], pa.binary())
        return pa.table([asked.column("_block"), asked.column("bucket"), levels], names=["_block", "bucket", "levels"])

    both = asked.groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return both.applyInArrow(run, "_block long, bucket int, levels binary")


def log_scores(
    found: np.ndarray, bounds: np.ndarray, known: np.ndarray, seen: np.ndarray, whole: int, distinct: int, weight: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and score of each text, from the training counts of its tokens and of their pairs.

    A pair that the filter holds oftener than either of its words was seen is found there by mistake.
    """
    single = (known + 1) / (whole + distinct + 1)
    before = np.concatenate([[0], known[:-1]])
    starts = bounds[:-1]
    before[starts] = known[bounds[1:] - 1]
    seen = np.where(seen > np.minimum(before, known), 0, seen)
    chance = np.where(before > 0, np.minimum(1, seen / np.maximum(1, before)), single)
    both = np.where(before > 0, (1 - weight) * single + weight * chance, single)
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
    return add((known > 0).astype(np.int64)), add(np.log10(single)), add(np.log10(both))


def score(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    parts: int = 7,
    remainder: int = 2,
    weight: float = 0.2,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """Per row its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Training texts are all whose crc32 of the id as text, modulo `parts`, is not `remainder`; a null id
    trains. Tokens are the words with A-Z lower-cased and one end, which also stands before the first.
    base_score adds log10((c + 1) / (N + V + 1)) with exact counts. score mixes that chance with the share of
    the pair among what follows the word before, `weight` for the latter; behind an untrained word only
    the former. All pairs are held, those seen once too; there are as many buckets as it takes for one to fill
    `most_bits` bits or fewer, and scores do not depend on it but for pairs found by mistake. Words are
    told apart by 64-bit hashes. A null text is an empty one: one token, the end. Repeated rows are counted and
    returned one by one; other columns are not carried; a table without rows gives none.
    """
    rows = df.select(
        df[id_column].alias("_id"), df[text].alias("_text"), held_out(id_column, parts, remainder).alias("_held")
    )
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bucket_pairs = max(1, min(BUCKET_PAIRS, most_bits // BITS_PER_ITEM))
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // (6 * bucket_pairs)))
    training = rows.where("not _held")
    counts = word_counts(training).groupBy("word").agg(F.sum("n").alias("c"))
    counts = checkpointed(counts)
    whole, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    blocked = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)))
    words = words_asked(blocked).join(counts, "word").select("_block", "word", "c", F.lit(None).cast("binary").alias("levels"))
    levels = pair_levels(pairs_asked(blocked, buckets), pair_filter(training, buckets))
    answers = words.union(levels.select("_block", F.col("bucket").cast("long"), F.lit(None).cast("long"), "levels"))

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        of_pair = known.column("levels").is_valid()
        levels = known.filter(of_pair).sort_by("word").column("levels")
        counts = counts_of(np.frombuffer(b"".join(levels.to_pylist()), dtype=np.uint8))
        known = known.filter(pc.invert(of_pair))
        words = known.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, numbers = words[order], known.column("c").to_numpy()[order]
        held = [
            (part, *tokens(cut)) for batch in texts.to_batches() for part, cut in slices(batch, "_text")
        ]
        asked = np.unique(np.concatenate([pairs(found) for _, found, _ in held])) if held else counts
        if len(asked) != len(counts):
            raise ValueError(f"{len(asked)} pairs asked for, {len(counts)} answered")
        answered, counts = counts, np.empty_like(counts)
        counts[by_bucket(asked, buckets)] = answered
        out = []
        for part, found, bounds in held:
            single = np.zeros(len(found), dtype=np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, found), len(words) - 1)
                single = np.where(words[at] == found, numbers[at], 0)
            both = counts[np.searchsorted(asked, pairs(found))]
            n_known, base, model = log_scores(found, bounds, single, both, whole, distinct, weight)
            out.append(
                pa.table(
                    [
                        part.column("_id"),
                        part.column("_held"),
                        pa.array(np.diff(bounds)),
                        pa.array(n_known),
                        pa.array(np.full(part.num_rows, whole, dtype=np.int64)),
                        pa.array(base),
                        pa.array(model),
                    ],
                    schema=result,
                )
            )
        return pa.concat_tables(out) if out else result.empty_table()

    id_type = df.schema[id_column].dataType
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = ["boolean", "long", "long", "long", "double", "double"]
    schema = f"`{id_column}` {id_type.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    arrow = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    result = pa.schema([(id_column, to_arrow_type(id_type)), *zip(names, arrow, strict=True)])
    return blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, schema)
