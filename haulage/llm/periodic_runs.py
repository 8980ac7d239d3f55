"""Stretches of words that repeat with a period: recursive frequency splitting, then a scan by lags.

In a run of `least_exponent` periods every word occurs that often. So a word that occurs less often in
its segment cannot lie in one, and cuts the segment; the parts are counted anew until no part changes.
In what survives, a run of period q holds three equal neighbouring blocks among the blocks at
multiples of q, so a lag costs one hash for each block, and all lags together n log n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from haulage.llm.text import find_words, hash_words, mixed, slices

RUN = "array<struct<start:long,length:long,period:long>>"
FOUND = f"struct<n_words:long,runs:{RUN},collapsed_sha256:string>"
BASE = 0x5851F42D4C957F2D
#: Neighbouring blocks that a run of least length is sure to hold.
BLOCKS = 3


@dataclass(frozen=True)
class Limits:
    """What counts as a run: so many words and so many periods at least."""

    length: int = 6
    exponent: int = 4

    def __post_init__(self) -> None:
        if self.exponent < BLOCKS + 1 or self.length < 1:
            raise ValueError(f"a run needs {BLOCKS + 1} periods or more and one word or more")

    def least(self, period: int) -> int:
        return max(self.length, self.exponent * period)


def surviving(symbols: np.ndarray, first: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the segments that no word is too rare in.

    first: where each text begins among the symbols. A segment that a round leaves as it was is done; only the
    parts of the others are counted again.
    """
    least = limits.least(1)
    place = np.arange(len(symbols))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts, lengths = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    while len(place):
        _, kind, times = np.unique(
            segment * (int(symbols.max()) + 1) + symbols[place], return_inverse=True, return_counts=True
        )
        stays = times[kind] >= limits.exponent
        size = np.bincount(segment)
        whole = np.bincount(segment[stays], minlength=len(size)) == size
        # The parts: neighbours of one segment that are both left.
        place, segment = place[stays], segment[stays]
        if not len(place):
            break
        head = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(segment) != 0)])
        part = np.cumsum(head) - 1
        of, long = segment[head], np.bincount(part)
        begin = place[head]
        done = whole[of] & (long >= least)
        starts.append(begin[done])
        lengths.append(long[done])
        again = ~whole[of] & (long >= least)
        keep = again[part]
        place, segment = place[keep], (np.cumsum(again) - 1)[part[keep]]
    return np.concatenate(starts), np.concatenate(lengths)


class Covered:
    """Runs found so far, by period; lags are scanned from the smallest on."""

    def __init__(self) -> None:
        self.runs: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, period: int, start: int, end: int) -> None:
        starts, ends = self.runs.setdefault(period, ([], []))
        starts.append(start)
        ends.append(end)

    def inside(self, period: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether stretches lie in runs of a period that divides this one, which then is not their smallest."""
        found = np.zeros(len(start), dtype=bool)
        for other, (starts, ends) in self.runs.items():
            if period % other == 0:
                at = np.searchsorted(starts, start, side="right") - 1
                found |= (at >= 0) & (np.asarray(ends)[at] >= end)
        return found


def stretch(x: np.ndarray, low: int, high: int, lag: int) -> Iterator[tuple[int, int]]:
    """The stretches of period `lag` that meet [low, high), each as far as it goes."""
    while low > 0 and x[low - 1] == x[low - 1 + lag]:
        to = max(0, low - lag)
        unlike = np.flatnonzero(x[to:low] != x[to + lag : low + lag])
        low = int(unlike[-1]) + to + 1 if len(unlike) else to
    while high < len(x) and x[high - lag] == x[high]:
        to = min(len(x), high + lag)
        unlike = np.flatnonzero(x[high - lag : to - lag] != x[high:to])
        high = high + int(unlike[0]) if len(unlike) else to
    alike = np.concatenate([[False], x[low : high - lag] == x[low + lag : high], [False]])
    edges = np.flatnonzero(alike[1:] != alike[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield low + a, low + b + lag


def lag_scan(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limits: Limits) -> list[tuple[int, int, int]]:
    """All runs in the segments as (start, end, period), periods their smallest ones."""
    if not len(starts):
        return []
    # Longest segments first, so that a lag reads only those that have room for it; a value of its own ends each.
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    x = np.empty(begins[-1], dtype=np.int64)
    x[begins[1:] - 1] = -1 - np.arange(len(starts))
    where = np.repeat(starts - begins[:-1], lengths)
    inner = np.repeat(begins[:-1], lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x[inner] = symbols[inner + where]

    base = np.uint64(BASE)
    powers = np.full(len(x), base, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(mixed(x.view(np.uint64) + np.uint64(1)) * powers, out=sums[1:])

    found, covered = [], Covered()
    longest = int(lengths[0])
    needed = -lengths
    for lag in range(1, longest // limits.exponent + 1):
        room = int(np.searchsorted(needed, -limits.least(lag), side="right"))
        if not room:
            break
        blocks = np.diff(sums[: begins[room] + 1 : lag])
        # A block times base^lag, as the next one's hash starts so many places later.
        same = blocks[:-1] * powers[lag] == blocks[1:]
        at = np.flatnonzero(same[:-1] & same[1:])
        if not len(at):
            continue
        head = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        tail = np.concatenate([head[1:], [len(at)]]) - 1
        low, high = at[head] * lag, (at[tail] + BLOCKS) * lag
        new = ~covered.inside(lag, low, high)
        to = -1
        for a, b in zip(low[new].tolist(), high[new].tolist(), strict=True):
            if b <= to:
                continue
            for s, e in stretch(x, a, b, lag):
                one = np.array([s]), np.array([e])
                if e > to and e - s >= limits.least(lag) and not covered.inside(lag, *one)[0]:
                    covered.add(lag, s, e)
                    k = int(np.searchsorted(begins, s, side="right")) - 1
                    shift = int(starts[k] - begins[k])
                    found.append((s + shift, e + shift, lag))
                    to = e
    return found


def runs_of(symbols: np.ndarray, first: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Per text its runs as (start, length, period), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    for start, end, period in lag_scan(symbols, *surviving(symbols, first, limits), limits):
        text = int(np.searchsorted(first, start, side="right")) - 1
        found[text].append((start - int(first[text]), end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def without_repeats(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one blank."""
    words = text.split()
    if runs:
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [w for w, depth in zip(words, np.cumsum(edges).tolist()) if not depth]
    return b" ".join(words)


def collapse_runs(
    df: DataFrame, limits: Limits = Limits(), text: str = "text", with_text: bool = True
) -> DataFrame:
    """The rows of `df`, texts without what repeats in a run, and a column `periodic`.

    A run is a stretch of words that equal the words a period later, of the smallest period it has, of `limits.length` words and
    `limits.exponent` periods at least, that no neighbouring word extends. All its words behind its first
    period go; a text that loses any has its kept words joined by one blank, others stay as they are, and
    without `with_text` all do. `periodic` holds n_words, the runs (start counts words from 0; by start, then
    period) and the SHA-256 of the kept words so joined. A null text has no word and stays null. Rows are read by
    themselves: repeated ids and rows stay, nothing is shuffled. Words are told apart by a 64-bit hash within about a
    megabyte of text, or one text if it is longer. A column named `periodic` is replaced, all others are carried. A table without rows
    gives none.
    """
    others = [c for c in df.columns if c not in (text, "periodic")]
    rows = df.select(F.col(text).alias("_text"), F.struct(*others).alias("_rest"))
    shape = StructType([StructField("_text", StringType()), rows.schema["_rest"], StructField("periodic", _type(FOUND))])
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
            ("collapsed_sha256", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                words = find_words(texts)
                _, symbols = np.unique(hash_words(words), return_inverse=True)
                runs = runs_of(symbols, words.first, limits)
                kept = [without_repeats(t, r) for t, r in zip(texts, runs, strict=True)]
                done = [
                    {
                        "n_words": n,
                        "runs": [dict(zip(("start", "length", "period"), one, strict=True)) for one in r],
                        "collapsed_sha256": hashlib.sha256(k).hexdigest(),
                    }
                    for n, r, k in zip(words.counts.tolist(), runs, kept, strict=True)
                ]
                shown = part.column(0)
                if with_text and any(runs):
                    known = shown.is_valid().to_pylist()
                    shown = [(k if r else t).decode() if v else None for t, r, k, v in zip(texts, runs, kept, known, strict=True)]
                    shown = pa.array(shown, part.schema[0].type)
                yield pa.RecordBatch.from_arrays(
                    [shown, part.column(1), pa.array(done, kind)], names=["_text", "_rest", "periodic"]
                )

    done = rows.mapInArrow(run, shape)
    order = [F.col("_text").alias(c) if c == text else F.col(f"_rest.`{c}`") for c in df.columns if c != "periodic"]
    return done.select(*order, "periodic")


def _type(ddl: str) -> StructType:
    return StructType.fromDDL(f"x {ddl}")["x"].dataType
