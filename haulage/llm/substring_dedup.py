"""Removing passages that occur earlier, by suffix automata of reference shards.

Of every window of words the least hash of its word runs is its anchor: equal windows have equal
anchors at the same place. Neighbouring windows with one anchor make a piece of text. Only
anchors seen twice matter. Equal pieces are found by hash and the earliest keeps its place in the order;
so copies and boilerplate shrink before anything is compared. All different pieces at one anchor are
a shard: they go, earliest first, through the suffix automaton of those before, word for word,
and a matching statistic of a window's length or more marks a window that starts earlier
elsewhere. A shard with too many pieces for one automaton is dealt by window instead: equal windows
are counted and all but the earliest are marked.

Texts are dealt into blocks once. A block sends its distinct anchors and pieces, never one row for each
copy it holds, and gets back which of them to act on: no key has more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from haulage.llm.text import Words, find_words, found_in, hash_runs, hash_words, mixed, ragged, slices
from haulage.session import shared_folder

RUN = 5
MOST_PIECES = 2000
BLOCK_BYTES = 8 << 20
BASE = 0x2545F4914F6CDD1D
NO_ID = -(1 << 63)
RESULT = "n_words long, n_removed long, kept_sha256 string"


@dataclass
class Pieces:
    """Pieces of text: where the anchor is, first and last window, the anchor's and the piece's hash."""

    anchor_at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    code: np.ndarray


def powers(n: int, base: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from each start to its end."""
    n = len(hashes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(n, BASE), out=sums[1:])
    back = powers(n + 1, pow(BASE, -1, 1 << 64))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def find_pieces(words: Words, hashes: np.ndarray, window: int) -> Pieces:
    """The pieces of some texts, by places among all their words."""
    runs = hash_runs(hashes, RUN)
    reach = window - RUN + 1
    none = np.empty(0, dtype=np.int64)
    if len(runs) < reach:
        return Pieces(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    starts = np.arange(len(runs) - reach + 1)
    least = np.empty(len(starts), dtype=np.int64)
    for k in range(0, len(starts), 1 << 16):
        part = runs[k : k + (1 << 16) + reach - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, reach)
        least[k : k + len(view)] = view.argmin(axis=1) + np.arange(k, k + len(view))
    counts = np.maximum(words.counts - window + 1, 0)
    inside = ragged(words.first[:-1], counts)
    least = least[inside]
    text = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(inside), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(inside)) - 1 if len(begin) else begin
    first, last, at = inside[begin], inside[end], least[begin]
    code = span_hashes(hashes, first, last + window) if len(first) else none.astype(np.uint64)
    code = mixed(code + (at - first).astype(np.uint64))
    return Pieces(at, first, last, runs[at], code)


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: bytes) -> int:
        follow, link, length = self.next, self.link, self.length
        there = follow[last].get(word)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._clone(last, there, word)
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at != -1:
            there = follow[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._clone(at, there, word)
        return new

    def _clone(self, at: int, there: int, word: bytes) -> int:
        follow, link, length = self.next, self.link, self.length
        copy = len(follow)
        follow.append(dict(follow[there]))
        length.append(length[at] + 1)
        link.append(link[there])
        link[there] = copy
        while at != -1 and follow[at].get(word) == there:
            follow[at][word] = copy
            at = link[at]
        return copy

    def matches(self, words: list[bytes]) -> list[int]:
        """For each place, how many words up to it also end somewhere in the automaton."""
        follow, link, length = self.next, self.link, self.length
        at = size = 0
        found = []
        for word in words:
            while at and word not in follow[at]:
                at = link[at]
                size = length[at]
            there = follow[at].get(word)
            if there is None:
                size = 0
            else:
                at, size = there, size + 1
            found.append(size)
        return found


def shard_marks(pieces: list[list[bytes]], window: int) -> list[int]:
    """For pieces in order, a bit for each window that also occurs in a piece before."""
    automaton, marks = Automaton(), []
    for words in pieces:
        sizes = automaton.matches(words)
        marks.append(sum(1 << k for k, size in enumerate(sizes[window - 1 :]) if size >= window))
        automaton.add(words)
    return marks


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def scan(texts: list[bytes], window: int) -> tuple[Words, np.ndarray, Pieces, np.ndarray]:
    """Words, their hashes and pieces of some texts, and the text of each piece."""
    words = find_words(texts)
    hashes = hash_words(words)
    pieces = find_pieces(words, hashes, window)
    return words, hashes, pieces, np.searchsorted(words.first, pieces.first, side="right") - 1


def cuts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in table.to_batches():
        yield from slices(batch, "_text")


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def anchors_of(documents: DataFrame, window: int) -> DataFrame:
    """(_block, anchor, n): the distinct anchors of each block and how often it has them."""

    def run(texts: pa.Table) -> pa.Table:
        found = [scan(cut, window)[2].anchor for _, cut in cuts(texts)]
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        block = np.full(len(values), texts.column("_block")[0].as_py(), dtype=np.int64)
        return pa.table([pa.array(block), signed(values), pa.array(counts)], names=["_block", "anchor", "n"])

    return documents.groupBy("_block").applyInArrow(run, "_block long, anchor long, n long")


def pieces_of(documents: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """The distinct pieces at the given anchors of each block: their first place in it, and how many there are."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["_block", "anchor", "code", "id", "pos", "n"]
        known = np.sort(column(wanted, "anchor").view(np.uint64))
        held: list[list[np.ndarray]] = [[np.empty(0, dtype=t)] for t in (np.uint64, np.uint64, np.int64, np.int64)]
        for part, cut in cuts(texts):
            words, _, pieces, own = scan(cut, window)
            hit, _ = found_in(pieces.anchor, known)
            ids = part.column("_id").to_numpy(zero_copy_only=False)[own[hit]]
            place = pieces.anchor_at[hit] - words.first[own[hit]]
            for kept, values in zip(held, (pieces.anchor[hit], pieces.code[hit], ids, place), strict=True):
                kept.append(values)
        anchor, code, ids, place = map(np.concatenate, held)
        order = np.lexsort((place, ids, anchor, code))
        anchor, code, ids, place = anchor[order], code[order], ids[order], place[order]
        fresh = np.ones(len(code), dtype=bool)
        fresh[1:] = (code[1:] != code[:-1]) | (anchor[1:] != anchor[:-1])
        starts = np.flatnonzero(fresh)
        block = np.full(len(starts), texts.column("_block")[0].as_py() if len(texts) else 0, dtype=np.int64)
        counts = np.diff(np.append(starts, len(code)))
        return pa.table(
            [
                pa.array(block),
                signed(anchor[starts]),
                signed(code[starts]),
                pa.array(ids[starts].astype(np.int64)),
                pa.array(place[starts].astype(np.int32)),
                pa.array(counts.astype(np.int32)),
            ],
            names=names,
        )

    both = documents.groupBy("_block").cogroup(anchors.groupBy("_block"))
    return both.applyInArrow(run, "_block long, anchor long, code long, id long, pos int, n int")


def automaton_marks(shards: DataFrame, window: int) -> DataFrame:
    """(anchor, code, mask) for pieces with windows that start earlier, of shards that fit one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held = None, []
        found: list[tuple[int, int, int]] = []

        def flush() -> None:
            marks = shard_marks([words.split(b" ") for _, words in held], window)
            found.extend((anchor, code, mark) for (code, _), mark in zip(held, marks, strict=True) if mark)

        def out() -> pa.RecordBatch:
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["anchor", "code", "mask"])

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("anchor", "code", "piece")), strict=True)
            for own, code, piece in rows:
                if own != anchor:
                    if held:
                        flush()
                    anchor, held = own, []
                held.append((code, piece))
            yield out()
        if held:
            flush()
        yield out()

    whole = shards.where("piece is not null").select("anchor", "code", "id", "pos", "piece")
    ordered = whole.repartition("anchor").sortWithinPartitions("anchor", "id", "pos", "code")
    return ordered.mapInArrow(run, "anchor long, code long, mask long")


def window_marks(shards: DataFrame) -> DataFrame:
    """The same of shards that do not: a bit for each window that is not the earliest of its kind."""
    single = shards.where("piece is null")
    earliest = single.groupBy("window_a", "window_b").agg(F.min(F.struct("id", "start")).alias("least"))
    later = single.join(earliest, ["window_a", "window_b"]).where(F.struct("id", "start") > F.col("least"))
    return later.groupBy("anchor", "code").agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("mask"))


def shard_pieces(documents: DataFrame, wanted: DataFrame, window: int, most_pieces: int) -> DataFrame:
    """The words of the wanted pieces, or their windows one by one where a shard has too many."""
    names = ["anchor", "code", "id", "pos", "piece", "window_a", "window_b", "bit", "start"]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        order = np.lexsort((column(wanted, "anchor"), column(wanted, "code").view(np.uint64)))
        anchor, code, ids, place, pieces_at = (
            column(wanted, k)[order] for k in ("anchor", "code", "id", "pos", "pieces")
        )
        rows: list[tuple] = []
        done = np.zeros(len(code), dtype=bool)
        for part, cut in cuts(texts) if len(wanted) else ():
            words, hashes, pieces, own = scan(cut, window)
            hit, at = found_in(pieces.code, code.view(np.uint64))
            own_ids = part.column("_id").to_numpy(zero_copy_only=False)[own]
            here = pieces.anchor_at - words.first[own]
            hit &= (ids[at] == own_ids) & (place[at] == here) & (anchor[at] == pieces.anchor.view(np.int64))
            for k in np.flatnonzero(hit):
                if done[at[k]]:
                    continue
                done[at[k]] = True
                w, low, high = at[k], int(pieces.first[k]), int(pieces.last[k])
                head = (int(anchor[w]), int(code[w]), int(ids[w]), int(place[w]))
                if pieces_at[w] <= most_pieces:
                    held = words.buffer[words.starts[low] : words.ends[high + window - 1]].tobytes()
                    rows.append((*head, b" ".join(held.split()), None, None, None, None))
                    continue
                for bit, start in enumerate(range(low, high + 1)):
                    one = hashes[start : start + window]
                    both = [int(hash_runs(x, window)[0].view(np.int64)) for x in (one, mixed(one + np.uint64(1)))]
                    rows.append((*head, None, *both, bit, start - int(words.first[own[k]])))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = (
        "anchor long, code long, id long, pos int, piece binary, window_a long, window_b long, bit int, start int"
    )
    return documents.groupBy("_block").cogroup(wanted.groupBy("_block")).applyInArrow(run, schema)


def remove_repeats(
    df: DataFrame,
    window: int = 20,
    id_column: str = "doc_id",
    text: str = "text",
    with_text: bool = True,
    most_pieces: int = MOST_PIECES,
) -> DataFrame:
    """The rows of `df`, passages that start earlier taken out of the text, and a column `repeats`.

    A word goes if a window of `window` words over it has a word sequence that also starts at a smaller id, or
    earlier in the same text; windows are judged on the input. Where a word goes, the kept ones are
    joined by one blank (the text is left as it was unless `with_text`); `repeats` holds n_words,
    n_removed and the SHA-256 of the kept words so joined. A null text has no word and stays null. Ids are whole
    numbers; a null id comes before all others, and rows that share an id share its place in the
    order, so their equal windows at one start leave each other alone. A column named `repeats` is replaced,
    all other columns are carried. A table without rows gives none. window: RUN to 48 +
    RUN words. most_pieces: different pieces that one automaton takes; the result does not depend on it.
    """
    if not RUN <= window <= 48 + RUN:
        raise ValueError(f"a window is {RUN} to {48 + RUN} words")
    others = [c for c in df.columns if c not in (text, "repeats")]
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    block = F.pmod(F.xxhash64(key, F.col(text)), F.lit(max(1, -(-total // BLOCK_BYTES)))).alias("_block")
    documents = df.select(block, key.alias("_id"), F.col(text).alias("_text"), F.struct(*others).alias("_rest"))

    anchors = anchors_of(documents, window)
    anchors = anchors.withColumn("all", F.sum("n").over(Window.partitionBy("anchor"))).where("all > 1")
    pieces = pieces_of(documents, anchors.select("_block", "anchor"), window)
    least = F.min(F.struct("id", "pos")).over(Window.partitionBy("anchor", "code"))
    pieces = pieces.withColumn("_first", F.struct("id", "pos") == least)
    # Rows that share an id may hold a piece at the same place in several blocks; one of them sends it.
    unlike = pieces.where("_first").groupBy("anchor", "code", "id", "pos").agg(F.min("_block").alias("_block"))
    crowded = unlike.groupBy("anchor").agg(F.count("*").alias("pieces")).where("pieces > 1")
    wanted = unlike.join(crowded, "anchor").select("_block", "anchor", "code", "id", "pos", "pieces")
    # Two readers, one pass over the texts; as Parquet, since a checkpoint is not compressed.
    made = shard_pieces(documents, wanted, window, most_pieces)
    path = f"{shared_folder(df.sparkSession)}/shards-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(path)
    shards = df.sparkSession.read.schema(made.schema).parquet(path)
    marks = automaton_marks(shards, window).union(window_marks(shards))
    acted = pieces.join(marks, ["anchor", "code"], "left")
    gone = acted.where("not _first or n > 1 or mask is not null").select(
        "_block",
        "code",
        F.when(F.col("_first"), F.col("id")).alias("id"),
        F.when(F.col("_first"), F.col("pos")).alias("pos"),
        F.when(F.col("_first"), F.coalesce("mask", F.lit(0))).alias("mask"),
    )
    fields = pa.schema(
        [
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("kept_sha256", pa.string()),
        ]
    )

    def run(texts: pa.Table, gone: pa.Table) -> pa.Table:
        code = column(gone, "code").view(np.uint64)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = gone.column("id").is_valid().to_numpy()[order]
        first_id, first_pos, first_mask = (
            gone.column(k).fill_null(0).to_numpy()[order] for k in ("id", "pos", "mask")
        )
        out = []
        for part, cut in cuts(texts):
            words, _, pieces, own = scan(cut, window)
            hit, at = found_in(pieces.code, code)
            chosen, at = np.flatnonzero(hit), at[hit]
            edges = np.zeros(len(words.starts) + 1, dtype=np.int64)
            if len(chosen):
                ids = part.column("_id").to_numpy(zero_copy_only=False)[own[chosen]]
                place = pieces.anchor_at[chosen] - words.first[own[chosen]]
                is_first = first[at] & (first_id[at] == ids) & (first_pos[at] == place)
                mask = np.where(is_first, first_mask[at], -1)
                length = pieces.last[chosen] - pieces.first[chosen] + 1
                start = ragged(pieces.first[chosen], length)
                bit = ragged(np.zeros(len(chosen), dtype=np.int64), length)
                start = start[(np.repeat(mask, length) >> bit) & 1 == 1]
                np.add.at(edges, start, 1)
                np.add.at(edges, start + window, -1)
            flags = np.split(np.cumsum(edges[:-1]) == 0, words.first[1:-1])
            kept, whole, left = [], [], []
            for t, flag in zip(cut, flags, strict=True):
                every = t.split()
                left.append(int(flag.sum()))
                whole.append(left[-1] == len(every))
                kept.append(b" ".join(every if whole[-1] else [w for w, f in zip(every, flag, strict=True) if f]))
            result = pa.StructArray.from_arrays(
                [
                    pa.array(words.counts),
                    pa.array(words.counts - np.array(left, dtype=np.int64)),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                fields=list(fields),
            )
            shown = part.column("_text")
            if with_text:
                known = shown.is_valid().to_pylist()
                rows = zip(cut, kept, known, whole, strict=True)
                changed = [None if not v else t.decode() if w else k.decode() for t, k, v, w in rows]
                shown = pa.array(changed, pa.string())
            out.append(pa.table([shown, part.column("_rest"), result], names=["_text", "_rest", "repeats"]))
        if out:
            return pa.concat_tables(out)
        kinds = [texts.schema.field("_text").type, texts.schema.field("_rest").type, pa.struct(list(fields))]
        return pa.table([pa.array([], k) for k in kinds], names=["_text", "_rest", "repeats"])

    shape = [StructField("_text", StringType()), documents.schema["_rest"], StructField("repeats", StructType.fromDDL(RESULT))]
    done = documents.groupBy("_block").cogroup(gone.groupBy("_block"))
    done = done.applyInArrow(run, StructType(shape))
    order = [F.col("_text").alias(c) if c == text else F.col(f"_rest.`{c}`") for c in df.columns if c != "repeats"]
    return done.select(*order, "repeats")
