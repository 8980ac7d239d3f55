"""Quality rules from the suffix array of a text's words.

The words of many texts make one sequence; a suffix ends with its text. Suffixes are put in
order by doubling: ranks by the first 1, 2, 4, ... words, each round sorting only suffixes
that still share a rank. The longest common prefix of neighbours is read off the ranks of
the rounds, from the longest down. A suffix and its neighbours in order bound its
deepest longest-common-prefix interval, so the longest repeat that begins at a word is the larger
of two prefixes; the spans of all of them together are the spans of the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulage.llm.text import SPACE, Words, find_words, hash_words, slices

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Limits on a text.

    window: words of a repeat that the base rule counts. min_words and max_repeat_percent: the base
    rule fails fewer words, or more repeated ones. repeat: words of a repeat that the method
    counts; max_covered_percent: the most words that such repeats may cover; max_longest: the most words of
    the longest repeat, in a text of any length.
    """

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    repeat: int = 4
    max_covered_percent: int = 20
    max_longest: int = 50


def suffix_ranks(symbols: np.ndarray, text_of: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until no two share one.

    A rank is the number of suffixes below it; it orders suffixes of one text only.
    """
    n = len(symbols)
    order = np.lexsort((symbols, text_of))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rounds, step = [rank], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        shared = np.flatnonzero(sizes[rank] > 1)
        if not len(shared):
            return rounds
        after = shared + step
        inside = after < n
        inside[inside] = text_of[after[inside]] == text_of[shared[inside]]
        second = np.full(len(shared), -1, dtype=np.int64)
        second[inside] = rank[after[inside]]
        by = np.lexsort((second, rank[shared]))
        first, second, shared = rank[shared[by]], second[by], shared[by]
        group = np.ones(len(shared), dtype=bool)
        group[1:] = first[1:] != first[:-1]
        fresh = group.copy()
        fresh[1:] |= second[1:] != second[:-1]
        place = np.arange(len(shared))
        base = np.maximum.accumulate(np.where(group, place, 0))
        new = rank.copy()
        new[shared] = first + np.maximum.accumulate(np.where(fresh, place, 0)) - base
        rank, step = new, step * 2
        rounds.append(rank)


def longest_repeats(symbols: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest run from it that begins elsewhere in its text too."""
    n = len(symbols)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    rounds = suffix_ranks(symbols, text_of)
    order = np.empty(n, dtype=np.int64)
    order[rounds[-1]] = np.arange(n)
    first = rounds[0][order]
    pair = np.flatnonzero(first[1:] == first[:-1])
    a, b = order[pair].copy(), order[pair + 1].copy()
    common = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        alike = (a < n) & (b < n)
        alike[alike] = rounds[k][a[alike]] == rounds[k][b[alike]]
        common[alike] += 1 << k
        a[alike] += 1 << k
        b[alike] += 1 << k
    np.maximum.at(longest, order[pair], common)
    np.maximum.at(longest, order[pair + 1], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a repeat of `least` or more."""
    n = len(longest)
    long = longest >= least
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(long), 1)
    np.add.at(edges, np.flatnonzero(long) + longest[long], -1)
    return np.cumsum(edges[:-1]) > 0


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], rules: Rules) -> list[np.ndarray]:
    """The columns of SCHEMA for some texts."""
    words: Words = find_words(texts)
    text_of = words.text_of()
    _, symbols = np.unique(hash_words(words), return_inverse=True)
    longest = longest_repeats(symbols, text_of)
    n = words.counts
    letters = ((words.buffer & 0xC0) != 0x80) & ~SPACE[words.buffer]
    chars = per_text(letters, words.text_starts)
    marks = per_text(SYMBOLS[words.buffer], words.text_starts)
    lines = np.array([repeated_lines(t) for t in texts], dtype=np.int64)
    repeated = per_text(covered(longest, rules.window), words.first)
    spans = per_text(covered(longest, rules.repeat), words.first)
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, text_of, longest)
    failed = (n < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n)
    over = (100 * spans > rules.max_covered_percent * n) | (most > rules.max_longest)
    return [n, chars, marks, lines, repeated, spans, most, failed, ~failed & ~over]


def apply_rules(
    df: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """Per row of `df`: its id, the counts and the verdict `kept`; with `carry`, all its columns in `_row`.

    A null or empty text has no word and fails. A word is hashed to 64 bits; the rest is exact.
    Every row is judged by itself, so repeated ids and rows stay as they are. A table without rows gives
    none.
    """
    # A text goes to Python once, by itself or in its row.
    rest = [F.struct(*(df[c] for c in df.columns)).alias("_row")] if carry else []
    source, row, sent = (text, "_row", []) if carry and text in df.columns else ("_text", None, [df[text].alias("_text")])
    rows, behind = df.select(df[id_column], *sent, *rest), 1 + len(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_column, *(x.split()[0] for x in SCHEMA.split(", ")), *["_row"] * carry]
        for batch in batches:
            for part, texts in slices(batch, source, row=row):
                columns = [part.column(0), *map(pa.array, measure(texts, rules))]
                yield pa.RecordBatch.from_arrays(columns + part.columns[behind:], names=names)

    own = StructType([rows.schema[0], *StructType.fromDDL(SCHEMA).fields, *rows.schema.fields[behind:]])
    return rows.mapInArrow(run, own)
