"""BPE encoding and decoding over a contiguous array of ranks, and the query over documents.

A word is a row of part ids with the ranks of its adjacent pairs beside it. Each step
finds the least rank of a row, deletes that boundary and looks up the two ranks next to
it. Words of one length are rows of one matrix; a step takes one part from each, so the
matrix loses a column a step and the rows without a rank drop out.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from haulage.llm.chunks import PieceEncoder, library_encode
from haulage.llm.text import ragged, slices

NONE = np.int32(2**31 - 1)
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
ROWS = 20_000
COMMON = "\u0250"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Bpe:
    """Encoder for a byte-level vocabulary file.

    Two kinds of files are read: with words lower-cased, blanks dropped and a mark at a word's end, or
    with all bytes kept and the blank before a word its first byte.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.blanks = spec["pre_tokenizer"]["type"] == "ByteLevel"
        split = PATTERN if self.blanks else spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # The same for text of lower-case ASCII, as bytes.
        plain = split.replace(r"[^\s\p{L}\p{N}]", r"[^\x20\x09-\x0Da-z0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.split_ascii = None if self.blanks else re.compile(plain.encode())
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        self.tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, number in chain(vocab.items(), special.items()):
            self.tokens[number] = token.encode()
        self.decimals = [b"%d" % k for k in range(len(self.tokens))]
        self._table([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]])

    def _table(self, merges: list[tuple[int, int, int]]) -> None:
        """Open addressing over pairs of ids: a slot holds the pair, its rank and the id it becomes."""
        first, second, made = np.array(merges, dtype=np.int64).T
        keys = first << 32 | second
        self.bits = (len(keys) * 16 - 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.made = made.astype(np.int64)
        left, self.probes = np.arange(len(keys)), 0
        slot = self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            chosen = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[chosen]] = keys[chosen]
            self.ranks[slot[chosen]] = chosen
            left = np.setdiff1d(left, chosen, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for a pair that is not merged."""
        keys = first << 32 | second
        slot = self._slot(keys)
        here = self.keys[slot]
        found = np.where(here == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((here != keys) & (here != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found

    def merge(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge rows of equal length: (row numbers, their ids) by length reached."""
        done, rows = [], np.arange(len(parts))
        ranks = (
            self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), -1)
            if parts.shape[1] > 1
            else np.empty((len(parts), 0), dtype=np.int32)
        )
        while len(rows):
            if parts.shape[1] == 1:
                done.append((rows, parts))
                break
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            on = least != NONE
            if not on.all():
                done.append((rows[~on], parts[~on]))
                rows, parts, ranks, at, least = rows[on], parts[on], ranks[on], at[on], least[on]
                if not len(rows):
                    break
            every, width = np.arange(len(rows)), parts.shape[1]
            parts[every, at] = self.made[least]
            column = np.arange(width - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
            column = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            before, behind = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[before, at[before] - 1] = self.rank(parts[before, at[before] - 1], parts[before, at[before]])
            ranks[behind, at[behind]] = self.rank(parts[behind, at[behind]], parts[behind, at[behind] + 1])
        return done

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (no word empty), and how many each has."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        buffer = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        lengths = np.empty(len(words), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            same = np.flatnonzero(sizes == size)
            step = max(1, ROWS * 8 // int(size))
            for k in range(0, len(same), step):
                rows = same[k : k + step]
                raw = buffer[starts[rows][:, None] + np.arange(size)]
                parts = self.inner[raw]
                parts[:, -1] = self.last[raw[:, -1]]
                for which, ids in self.merge(parts):
                    lengths[rows[which]] = ids.shape[1]
                    found.append((rows[which], ids))
        places = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), dtype=np.uint32)
        for rows, ids in found:
            flat[places[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, lengths

    def cut(self, text: str) -> list[bytes]:
        """The words of a text without special tokens."""
        if self.blanks:
            return [w.encode() for w in self.split.findall(text)]
        if text.isascii():
            return [text.lower().encode()] if text.isalpha() else self.split_ascii.findall(text.lower().encode())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [w.encode() for w in self.split.findall(text.lower())]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, and how many each has. Special tokens in a text count as such."""
        words: list[bytes] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        marked: list[tuple[int, int]] = []
        for k, text in enumerate(texts):
            before = len(words)
            for part in self.special_split.split(text) if "<|" in text else [text]:
                if part in self.special:
                    marked.append((len(words), self.special[part]))
                    words.append(b"!")
                else:
                    words += self.cut(part)
            counts[k] = len(words) - before
        flat, lengths = self.words(words)
        for at, number in marked:
            flat[lengths[:at].sum()] = number
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return flat, np.diff(ends, prepend=0)

    def decode(self, ids: list[int]) -> bytes:
        """The tokens with a blank between, as the file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids))


@cache
def codec(path: str) -> Bpe:
    return Bpe(path)


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(codec(path).encode, codec(path).blanks)


@cache
def checked_encoder(path: str) -> PieceEncoder:
    """The same for pieces of common letters; the tokenizers library takes all others.

    Code points that one Unicode version has and another has not are then the library's to judge.
    """
    own, library = codec(path), library_encode(path)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        common = np.array([t.isascii() or max(t) < COMMON for t in texts], dtype=bool)
        if common.all():
            return own.encode(texts)
        parts = [own.encode([t for t, c in zip(texts, common, strict=True) if c])]
        parts.append(library([t for t, c in zip(texts, common, strict=True) if not c]))
        lengths = np.empty(len(texts), dtype=np.int64)
        lengths[common], lengths[~common] = parts[0][1], parts[1][1]
        starts, flat = np.cumsum(lengths) - lengths, np.empty(int(lengths.sum()), dtype=np.uint32)
        for which, (ids, counts) in zip((common, ~common), parts, strict=True):
            flat[ragged(starts[which], counts)] = ids
        return flat, lengths

    return PieceEncoder(encode, own.blanks)


def encode_texts(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `df`: its id, n_tokens, and SHA-256 of the ids and of the text they decode to.

    path: the vocabulary file, at the same place on every executor. A null or empty text has no
    token and decodes to an empty text. Other columns are not carried; rows are never joined
    or moved, so repeated ids and rows stay as they are, and a table without rows gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bpe = encoder(path), codec(path)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = [x.tolist() for x in pieces.batch(texts)]
                spelled = (b" ".join(map(bpe.decimals.__getitem__, ids)) for ids in found)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(map(len, found), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in spelled], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found], pa.string()),
                    ],
                    names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column], df[text].alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, {SCHEMA}")
