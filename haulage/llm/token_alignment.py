"""How two tokenizers cut the same text: tokens that overlap, tokens of a shared group, and their counts over a corpus.

Tokens by bytes are a sparse matrix. The product of one tokenizer's matrix with the other's, transposed, has the
bytes that each pair of tokens shares. Where both change at once the text falls into groups, and the product of the two
tokens-by-groups matrices links all tokens of a group. Products go row by row (Gustavson, 1978) over hand-built CSR arrays.

Neither tokenizer lets a token cross from a word into the blank behind it, so a text is cut there, each distinct
piece is aligned once and texts are put together from pieces. Texts go into blocks, rows of Parquet that hold
a documents-by-pairs matrix, and each block asks for the counts of its own distinct pairs once.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from haulage.llm.bpe import byte_letters, checked_encoder
from haulage.llm.chunks import PieceEncoder, odd_blanks
from haulage.llm.text import SPACE, Words, ragged, slices
from haulage.session import shared_folder

#: Pieces kept by a worker, bytes of text in a block, and links that are expanded at a time.
KEPT_PIECES = 500_000
BLOCK_BYTES = 8 << 20
EXPANDED = 1 << 21
PIECE_SPACE = "▁".encode()
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: A pair of ids as one number.
PAIR_BITS = 31


@dataclass(frozen=True)
class Csr:
    """Rows of a sparse matrix one after another."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, where tokens of these lengths follow one another."""
    n = int(lengths.sum())
    return Csr(np.concatenate([[0], np.cumsum(lengths)]), np.arange(n), np.ones(n, dtype=np.int64), n)


def membership(group: np.ndarray, groups: int) -> Csr:
    """Tokens by groups, one group a token."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), dtype=np.int64), groups)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return Csr(starts, m.rows[order], m.values[order], len(m.starts) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """a times b: each row is the sum of the rows of b that its entries name, by their values."""
    lengths = np.diff(b.starts)[a.columns]
    at = ragged(b.starts[a.columns], lengths)
    key = np.repeat(a.rows, lengths) * b.width + b.columns[at]
    values = np.repeat(a.values, lengths) * b.values[at]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    head = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(key) else np.empty(0, dtype=np.int64)
    row, column = np.divmod(key[head], max(1, b.width))
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(a.starts) - 1))])
    return Csr(starts, column, np.add.reduceat(values, head) if len(head) else values, b.width)


def groups_of(overlaps: Csr, tokens_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side: a group ends where the next overlap is of other tokens on both sides."""
    row, column = overlaps.rows, overlaps.columns
    group = np.concatenate([[0], np.cumsum((np.diff(row) != 0) & (np.diff(column) != 0))])[: len(row)]
    a = group[overlaps.starts[:-1]]
    b = np.empty(tokens_b, dtype=np.int64)
    b[column] = group
    return a, b


def grouped_sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
    return key[head], np.add.reduceat(value[order], head)


class Strings:
    """Byte strings one after another, copied by number."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.array(list(map(len, strings)), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buffer = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.buffer[ragged(self.starts[numbers], self.sizes[numbers])]


def byte_table(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; a token that is not written in its letters stands for itself."""
    byte = {letter: k for k, letter in enumerate(byte_letters())}
    found = [b""] * tokenizer.get_vocab_size()
    for token, k in tokenizer.get_vocab().items():
        found[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return found


class Grown:
    """An array that rows are appended to."""

    def __init__(self, like: np.ndarray) -> None:
        self.held, self.size = np.empty_like(like[:0]), 0

    def add(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self.held):
            more = np.empty((2 * len(rows) + self.size // 2, *self.held.shape[1:]), dtype=self.held.dtype)
            self.held = np.concatenate([self.held[: self.size], more])
        self.held[self.size : self.size + len(rows)] = rows
        self.size += len(rows)


@dataclass(frozen=True)
class Measured:
    """Of some pieces: whether both sides give a piece's bytes, its counts, its groups as text with `;` behind each, its pairs with
    their links; and the overlaps of all tokens. Bounds say where a piece's share of shown and pairs begins."""

    valid: np.ndarray
    counts: np.ndarray
    shown_bounds: np.ndarray
    shown: np.ndarray
    pair_bounds: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    overlaps: Csr


class Aligner(PieceEncoder):
    """Aligns pieces, each distinct one once, and puts texts together from them."""

    def __init__(self, path_a: str, path_b: str, kept: int = KEPT_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.common = checked_encoder(path_a).encode
        self.special = [token.content for token in self.a.get_added_tokens_decoder().values()]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = Strings(byte_table(self.a))
        self.bytes_b = Strings(
            [
                bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.encode().replace(PIECE_SPACE, b" ")
                for k, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
            ]
        )
        self.decimals = Strings([b"%d" % k for k in range(max(len(self.bytes_a.sizes), len(self.bytes_b.sizes)))])
        self.blank = self.b.piece_to_id("▁")
        super().__init__(None, True, kept)

    def _forget(self) -> None:
        super()._forget()
        self.valid = Grown(np.empty(0, dtype=bool))
        self.counts = Grown(np.empty((0, len(COUNTS)), dtype=np.int64))
        self.shown_starts, self.shown_sizes = Grown(np.empty(0, dtype=np.int64)), Grown(np.empty(0, dtype=np.int64))
        self.shown = Grown(np.empty(0, dtype=np.uint8))
        self.pair_starts, self.pair_sizes = Grown(np.empty(0, dtype=np.int64)), Grown(np.empty(0, dtype=np.int64))
        self.pairs, self.times = Grown(np.empty(0, dtype=np.int32)), Grown(np.empty(0, dtype=np.int32))

    def spans(self, texts: list[bytes]) -> Words:
        """Pieces that begin with a blank behind a character that is none; each text begins with one."""
        joined = b"\n".join([*texts, b""])
        buffer = np.frombuffer(joined, dtype=np.uint8)
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
        cut = buffer == 0x20
        cut[1:] &= ~SPACE[buffer[:-1]]
        cut[bounds[:-1][np.diff(bounds) > 1]] = True
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, bounds)
        ends = np.concatenate([starts[1:], [len(buffer)]])[: len(starts)]
        last = first[1:][np.diff(first) > 0] - 1
        ends[last] = bounds[1:][np.diff(first) > 0] - 1
        return Words(buffer, starts, ends, first, bounds)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces that begin with a blank, which the second tokenizer puts in front by itself, and how many each has."""
        a, n_a = self.common(texts)
        # The strings of special tokens are ordinary text here, which is a setting of the library.
        marked = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if marked:
            each = np.split(a, np.cumsum(n_a)[:-1])
            for k in marked:
                each[k] = np.array(self.a.encode(texts[k], add_special_tokens=False).ids, dtype=a.dtype)
                n_a[k] = len(each[k])
            a = np.concatenate(each)
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        b = [[self.blank] if t == " " else ids for t, ids in zip(texts, b, strict=True)]
        n_b = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
        return a.astype(np.int64), n_a, np.fromiter(chain.from_iterable(b), dtype=np.int64, count=int(n_b.sum())), n_b

    @staticmethod
    def faithful(pieces: Strings, table: Strings, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the bytes of each piece's ids are the piece."""
        of = np.repeat(np.arange(len(n)), n)
        size = np.bincount(of, table.sizes[ids], len(n)).astype(np.int64)
        same = size == pieces.sizes
        unlike = table.joined(ids[same[of]]) != pieces.joined(np.flatnonzero(same))
        bounds = np.concatenate([[0], np.cumsum(size[same])])
        same[same] = np.diff(np.concatenate([[0], np.cumsum(unlike)])[bounds]) == 0
        return same

    def measure(self, pieces: list[str]) -> Measured:
        a, n_a, b, n_b = self.ids(pieces)
        held = Strings([p.encode() for p in pieces])
        valid = self.faithful(held, self.bytes_a, a, n_a) & self.faithful(held, self.bytes_b, b, n_b)
        a, b = a[np.repeat(valid, n_a)], b[np.repeat(valid, n_b)]
        n_a, n_b = n_a * valid, n_b * valid
        of = np.repeat(np.arange(len(pieces)), n_a)
        overlaps = product(incidence(self.bytes_a.sizes[a]), transposed(incidence(self.bytes_b.sizes[b])))
        group_a, group_b = groups_of(overlaps, len(b))
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        of_group = np.zeros(n_groups, dtype=np.int64)
        of_group[group_a] = of
        to_b = transposed(membership(group_b, n_groups))
        size_b = np.diff(to_b.starts)

        keys, times = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        cost = np.cumsum(size_b[group_a]) if len(a) else np.empty(0, dtype=np.int64)
        at = 0
        while at < len(a):
            before = cost[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cost, before + EXPANDED, side="right")))
            shared = product(membership(group_a[at:to], n_groups), to_b)
            row = shared.rows + at
            key = (of[row] << PAIR_BITS) | (a[row] << 15) | b[shared.columns]
            own = grouped_sums(key, np.ones(len(key), dtype=np.int64))
            keys.append(own[0])
            times.append(own[1])
            at = to
        key, time = grouped_sums(np.concatenate(keys), np.concatenate(times))
        links = np.bincount(of, size_b[group_a], len(pieces)).astype(np.int64) if len(a) else np.zeros(len(pieces), dtype=np.int64)
        counts = np.stack([n_a, n_b, np.bincount(of_group, minlength=len(pieces)), links], axis=1)
        shown, size = self.show(a, b, group_a, group_b)
        token_of = np.concatenate([of, np.repeat(np.arange(len(pieces)), n_b)])
        shown_bounds = np.concatenate([[0], np.cumsum(np.bincount(token_of, size, len(pieces)).astype(np.int64))])
        bounds = np.searchsorted(key >> PAIR_BITS, np.arange(len(pieces) + 1))
        return Measured(valid, counts, shown_bounds, shown, bounds, key & ((1 << PAIR_BITS) - 1), time, overlaps)

    def show(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups as `a1,a2|b1;a3|b2,b3;`, and how many bytes each token takes, the separator behind it included."""
        ids = np.concatenate([a, b])
        last_a = np.append(np.diff(group_a) != 0, True)[: len(a)]
        last_b = np.append(np.diff(group_b) != 0, True)[: len(b)]
        marks = np.concatenate([np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))]).astype(np.uint8)
        size = self.decimals.sizes[ids] + 1
        # By group, the first side's tokens before the second's.
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ends = np.cumsum(size[order])
        shown = np.empty(int(size.sum()), dtype=np.uint8)
        shown[ends - 1] = marks[order]
        digits = ragged(ends - size[order], size[order] - 1)
        shown[digits] = self.decimals.joined(ids[order])
        return shown, size

    def learn(self, pieces: list[str]) -> np.ndarray:
        first, m = self.valid.size, self.measure(pieces)
        self.valid.add(m.valid)
        self.counts.add(m.counts)
        self.shown_starts.add(self.shown.size + m.shown_bounds[:-1])
        self.shown_sizes.add(np.diff(m.shown_bounds))
        self.shown.add(m.shown)
        self.pair_starts.add(self.pairs.size + m.pair_bounds[:-1])
        self.pair_sizes.add(np.diff(m.pair_bounds))
        self.pairs.add(m.pairs)
        self.times.add(m.times)
        return np.arange(first, first + len(pieces))

    def align(self, texts: list[bytes]) -> list[Aligned]:
        """Each text, none of them empty, as its pieces make it."""
        spaced = [b" " + t for t in texts]
        odd = {k for k, t in enumerate(spaced) if odd_blanks(t)}
        pieces = self.spans([b"" if k in odd else t for k, t in enumerate(spaced)])
        numbers = self.places(pieces) if len(pieces.starts) else np.empty(0, dtype=np.int64)
        of = pieces.text_of()
        # A piece's pairs once for each text that has it, by how often.
        kinds, often = grouped_sums((of << 32) | numbers, np.ones(len(numbers), dtype=np.int64))
        text, kind = kinds >> 32, kinds & 0xFFFFFFFF
        sizes = self.pair_sizes.held[kind]
        at = ragged(self.pair_starts.held[kind], sizes)
        key, time = grouped_sums(
            (np.repeat(text, sizes) << PAIR_BITS) | self.pairs.held[at], self.times.held[at] * np.repeat(often, sizes)
        )
        every = np.arange(len(texts) + 1)
        bounds = np.searchsorted(key >> PAIR_BITS, every)
        counts = np.diff(np.concatenate([np.zeros((1, len(COUNTS)), np.int64), np.cumsum(self.counts.held[numbers], axis=0)])[pieces.first], axis=0)
        broken = np.bincount(of, ~self.valid.held[numbers], len(texts)) > 0
        sizes = self.shown_sizes.held[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])[pieces.first]
        shown = self.shown.held[ragged(self.shown_starts.held[numbers], sizes)]
        found = []
        for k, whole in enumerate(spaced):
            if k in odd:
                m = self.measure([whole.decode()])
                found.append(aligned(m.counts[0], m.shown, m.pairs, m.times) if m.valid[0] else NOTHING)
            elif broken[k]:
                found.append(NOTHING)
            else:
                own = slice(bounds[k], bounds[k + 1])
                found.append(aligned(counts[k], shown[ends[k] : ends[k + 1]], key[own] & ((1 << PAIR_BITS) - 1), time[own]))
        return found


@dataclass(frozen=True)
class Aligned:
    """A text's counts, the digest of its groups, its pairs in order, and the links of each."""

    counts: list[int]
    digest: str
    pairs: np.ndarray
    times: np.ndarray


NOTHING = Aligned([0] * len(COUNTS), "", np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))


def aligned(counts: np.ndarray, shown: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> Aligned:
    return Aligned(counts.tolist(), hashlib.sha256(shown[:-1]).hexdigest(), pairs, times)


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def packed(*arrays: np.ndarray) -> bytes:
    held = np.concatenate([x.astype("<i4") for x in arrays]) if arrays else np.empty(0, dtype="<i4")
    return zstandard.ZstdCompressor(level=1).compress(held.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<i4").astype(np.int64)


def blocks_of(df: DataFrame, path_a: str, path_b: str, id_column: str, text: str) -> DataFrame:
    """Blocks of some `BLOCK_BYTES` of text, or one longer text: the rows' ids and counts, the block's pairs, in how many of its
    rows each is, and the rows-by-pairs matrix with the number of links."""
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    shape = StructType.fromDDL(
        f"block bigint, ids array<bigint>, counts array<struct<{fields}, groups_sha256: string>>,"
        " pairs array<bigint>, documents array<int>, matrix binary"
    )
    shape["ids"].dataType.elementType = rows.schema["_id"].dataType
    names = [*COUNTS, "groups_sha256"]
    struct = pa.struct([*((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        held: list[Aligned] = []
        size = 0

        def block() -> pa.RecordBatch:
            pairs = np.concatenate([h.pairs for h in held])
            kinds, at, documents = np.unique(pairs, return_inverse=True, return_counts=True)
            matrix = packed(np.array([len(h.pairs) for h in held]), at, np.concatenate([h.times for h in held]))
            counts = [dict(zip(names, [*h.counts, h.digest], strict=True)) for h in held]
            one = pa.concat_arrays(ids)
            columns = [
                pa.array([(part << 32) | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one),
                pa.array([counts], pa.list_(struct)),
                pa.array([kinds], pa.list_(pa.int64())),
                pa.array([documents.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([matrix], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in shape.fields])

        for batch in batches:
            for cut, texts in slices(batch, "_text"):
                full = iter(own.align([t for t in texts if t]))
                held += [next(full) if t else NOTHING for t in texts]
                ids.append(cut.column(0))
                size += sum(map(len, texts)) + 64 * len(texts)
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, held, size, number = [], [], 0, number + 1
        if held:
            yield block()

    return rows.mapInArrow(run, shape)


def pair_table(blocks: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many rows each pair of ids is linked, and whether no pair of its first id is in more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("_")).select("_.*")
    counted = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("documents"))
    counted = counted.withColumn("_a", F.shiftright("pair", 15))
    # One row for each id of a vocabulary.
    most = counted.groupBy("_a").agg(F.max("documents").alias("_most"))
    return counted.join(most, "_a").select("pair", "documents", (F.col("documents") == F.col("_most")).alias("best"))


def align_tokenizers(
    df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """How a byte-level vocabulary (a) and a piece model (b) cut the texts of `df`: one row a row, and the table of linked ids.

    Rows: the id, n_a and n_b tokens of the text behind a blank, n_groups that end where tokens of both end, n_links
    pairs of tokens in a shared group, n_best of them whose ids are linked in as many rows as any with the same first id,
    count_sum over the links of the rows that their ids are linked in, and groups_sha256. A null or empty text, and one that
    either side does not give back byte for byte, has zeros and an empty digest. Rows that share an id are
    rows of their own, here and in the counts; other columns are left out. Table: a, b, documents, best.
    Tables without rows give none. What a worker keeps is one block, some 500,000 pieces and the links of `EXPANDED` pairs; a
    block's pairs are counted before they are shuffled, and it is sent each one's count once.
    """
    path = f"{shared_folder(df.sparkSession)}/aligned-{uuid.uuid4().hex}"
    made = blocks_of(df, path_a, path_b, id_column, text)
    made.write.parquet(path)
    blocks, again = (df.sparkSession.read.schema(made.schema).parquet(path) for _ in range(2))
    table = pair_table(blocks)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    known = asked.join(table, "pair").select("block", "pair", "documents", "best")
    names = [id_column, *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair, kind="stable")
        documents, best = known.column("documents").to_numpy()[order], known.column("best").to_numpy()[order]
        parts = []
        for row in range(blocks.num_rows):
            ids = blocks.column("ids")[row].values
            counts = blocks.column("counts")[row].values
            n = len(ids)
            matrix = unpacked(blocks.column("matrix")[row].as_py())
            starts = np.concatenate([[0], np.cumsum(matrix[:n])])
            at, times = matrix[n : n + starts[-1]], matrix[n + starts[-1] :]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * documents[at])]
            n_best, count_sum = (pa.array(x[starts[1:]] - x[starts[:-1]], pa.int64()) for x in sums)
            *own, digest = (counts.field(k) for k in range(len(COUNTS) + 1))
            parts.append(pa.table([ids, *own, n_best, count_sum, digest], names=names))
        return pa.concat_tables(parts)

    shape = StructType([StructField(id_column, df.schema[id_column].dataType)])
    shape = StructType([*shape.fields, *StructType.fromDDL(", ".join(f"{c} bigint" for c in names[1:-1]) + f", {names[-1]} string").fields])
    grouped = again.select("block", "ids", "counts", "matrix").groupBy("block").cogroup(known.groupBy("block"))
    second = F.col("pair").bitwiseAND(F.lit((1 << 15) - 1))
    shown = table.select(F.shiftright("pair", 15).alias("a"), second.alias("b"), "documents", "best")
    return grouped.applyInArrow(run, shape), shown
