"""SimHash near-duplicates through the anchors of a covering code.

A fingerprint's 64 bits are cut into three blocks. Of four bits that differ, some block has one at
most. Anchors of a block are the words of a covering code: a Hamming code over its first 15 bits,
and all values of the rest, so every block value has an anchor within distance 1. It is at home
there, and goes as a visitor to every anchor within 1 + 1: two values at distance 1 or less
meet where either is at home. At each anchor the homes are compared with all
visitors on all 64 bits; what is passed on is a star for each connected set, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.links import checkpointed, components, roots
from haulage.llm.text import slices

BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
SEED = 42
DIRECT_PAIRS = 1 << 20
TILE = 1 << 11
VISITORS = 1 << 20


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits: each is 1 where it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    one = xxhash.xxh64_intdigest
    hashes = np.array(
        [one(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=">u8"
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Per row its id and `fingerprint`, 64 bits as a long. A null or wordless text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found.view(np.int64))], names=[id_column, "fingerprint"]
                )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column], df[text].alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, fingerprint long")


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value its code word within 1, and all code words at 2 (-1: fewer)."""
    values = np.arange(1 << CODE_BITS)
    syndrome = np.zeros(len(values), dtype=np.int64)
    for bit in range(CODE_BITS):
        syndrome ^= ((values >> bit) & 1) * (bit + 1)
    near = np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)
    pairs = np.full((CODE_BITS + 1, CODE_BITS // 2), -1, dtype=np.int64)
    for s in range(1, CODE_BITS + 1):
        flips = [(1 << i - 1) ^ (1 << (i ^ s) - 1) for i in range(1, CODE_BITS + 1) if i < i ^ s <= CODE_BITS]
        pairs[s] = flips
    flips = pairs[syndrome]
    return near, np.where(flips >= 0, values[:, None] ^ flips, -1)


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor that fingerprints go to: place in `values`, the anchor, whether at home there."""
    near, far = code_tables()
    every = np.arange(len(values))
    rows: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for number, (low, bits) in enumerate(BLOCKS):
        block = (values >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
        code, rest = block & ((1 << CODE_BITS) - 1), block >> CODE_BITS
        head = number << 32
        place = lambda r, c: head | r << CODE_BITS | c  # noqa: B023, E731
        rows.append((every, place(rest, near[code]), True))
        for k in range(far.shape[1]):
            there = np.flatnonzero(far[code, k] >= 0)
            rows.append((there, place(rest[there], far[code[there], k]), False))
        exact = np.flatnonzero(near[code] == code)
        for i in range(bits - CODE_BITS):
            rows.append((every, place(rest ^ (1 << i), near[code]), False))
            for j in range(i):
                rows.append((exact, place(rest[exact] ^ (1 << i) ^ (1 << j), code[exact]), False))
    at = np.concatenate([r[0] for r in rows])
    home = np.concatenate([np.full(len(r[0]), r[2]) for r in rows])
    return at, np.concatenate([r[1] for r in rows]), home


def near_pairs(homes: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of homes and others at `most` differing bits or fewer, for bounded numbers of each."""
    differ = np.bitwise_count(homes[:, None] ^ others)
    return np.nonzero(differ <= most)


def large_group(homes: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the pairs homes x others within `most` bits connect.

    First a few pivots take in all that is near them; then only values not yet connected to each other are
    compared, in tiles, so a tight group costs about its size.
    """
    values, inverse = np.unique(np.concatenate([homes, others]), return_inverse=True)
    at_home = np.zeros(len(values), dtype=bool)
    at_home[inverse[: len(homes)]] = True
    root = np.arange(len(values))
    for _ in range(64):
        alone = np.flatnonzero(at_home & (np.bincount(root, minlength=len(root))[root] == 1))
        if not len(alone):
            break
        pivot = alone[len(alone) // 2]
        near = np.flatnonzero(np.bitwise_count(values ^ values[pivot]) <= most)
        joined = np.concatenate([root, np.full(len(near), pivot)])
        root = roots(len(values), np.concatenate([np.arange(len(root)), near]), joined)
        if len(near) == 1:
            break
    order = np.argsort(root, kind="stable")
    mine = order[at_home[order]]
    for i in range(0, len(mine), TILE):
        for j in range(0, len(order), TILE):
            a, b = mine[i : i + TILE], order[j : j + TILE]
            if root[a].min() == root[b].max() == root[a].max() == root[b].min():
                continue
            x, y = near_pairs(values[a], values[b], most)
            apart = root[a[x]] != root[b[y]]
            if apart.any():
                x, y = a[x[apart]], b[y[apart]]
                root = roots(len(values), np.concatenate([np.arange(len(root)), x]), np.concatenate([root, y]))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return values[moved], values[root[moved]]


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect the same values."""
    values, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(values), places[: len(a)], places[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return values[moved], values[root[moved]]


def compare(anchor: np.ndarray, home: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole anchors; rows are sorted by anchor, homes first."""
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    starts, sizes = cut[:-1], np.diff(cut)
    n_homes = np.add.reduceat(home.astype(np.int64), starts) if len(starts) else np.empty(0, dtype=np.int64)
    pairs = n_homes * sizes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for g in np.flatnonzero(pairs > DIRECT_PAIRS):
        own = values[starts[g] : starts[g] + sizes[g]]
        found.append(large_group(own[: n_homes[g]], own, most))
    small = np.flatnonzero((pairs > 0) & (sizes > 1) & (pairs <= DIRECT_PAIRS))
    ends = np.cumsum(pairs[small])
    at = 0
    while at < len(small):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + 2 * DIRECT_PAIRS, side="right")))
        some = small[at:to]
        count = pairs[some]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        width = np.repeat(sizes[some], count)
        base = np.repeat(starts[some], count)
        a, b = values[base + within // width], values[base + within % width]
        hit = (a != b) & (np.bitwise_count(a ^ b) <= most)
        found.append(star(a[hit], b[hit]))
        at = to
    if not found:
        none = np.empty(0, dtype=np.uint64)
        return none, none
    return star(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def link_fingerprints(distinct: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at `most` differing bits or fewer; most is 0 to 5.

    One block of three must have a differing bit at most, so `most` is 5 or less.
    """
    if not 0 <= most <= 5:
        raise ValueError("three blocks with one differing bit each cover at most 5 bits")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), 4096):
                at, anchor, home = anchors(values[k : k + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(~home), pa.array(values[k : k + 4096][at].view(np.int64))],
                    names=["anchor", "visitor", "value"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size
            anchor, visitor, values = (np.concatenate([h[k] for h in held]) for k in range(3))
            keep = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            if not last and not keep:
                # One anchor fills the buffer: its homes stay, the visitors so far are compared.
                homes = int((~visitor).sum())
                a, b = large_group(values[:homes], values, most)
                rest = slice(0, homes)
            else:
                a, b = compare(anchor[:keep], ~visitor[:keep], values[:keep], most)
                rest = slice(keep, len(anchor))
            held = [(anchor[rest], visitor[rest], values[rest])]
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            anchor, visitor, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            held.append((anchor, visitor, value.view(np.uint64)))
            size += len(anchor)
            if size >= VISITORS:
                yield flush(last=False)
        if held:
            yield flush(last=True)

    visits = distinct.select("fingerprint").mapInArrow(visit, "anchor long, visitor boolean, value long")
    met = visits.repartition("anchor").sortWithinPartitions("anchor", "visitor")
    return met.mapInArrow(meet, "a long, b long")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4
) -> DataFrame:
    """Per row its id, the `fingerprint` as 16 hexadecimal digits, and component_id.

    component_id is the least id reachable over fingerprints at `most` differing bits or fewer. Null and
    wordless texts have fingerprint zero and link like any other. Rows with the same text or id are
    returned one by one; a null id never names a component unless all its ids are null. Other
    columns are not carried. A table without rows gives none.
    """
    prints = checkpointed(fingerprints(df, id_column, text, shingle).withColumnRenamed(id_column, "_id"))
    distinct = prints.groupBy("fingerprint").agg(F.min("_id").alias("_least"))
    whole = components(link_fingerprints(distinct, most)).withColumnRenamed("id", "fingerprint")
    placed = distinct.join(whole, "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    least = placed.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = placed.join(least, "component").select("fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(named, "fingerprint").select(
        F.col("_id").alias(id_column), digits.alias("fingerprint"), "component_id"
    )
