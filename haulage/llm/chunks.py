"""Token ids of whole texts, with each distinct stretch of text encoded once.

Both tokenizers used here never let a token cross from one non-blank run into the blanks
behind it, so a text is cut there and the ids of the pieces are put together. Pieces are
told apart by a 64-bit hash, kept up to a number, and forgotten all at once. Texts with blanks
beyond ASCII go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np

from haulage.llm.text import Words, find_words, found_in, hash_words, ragged

OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0  -‏ -  -⁠　﻿]")
KEPT_PIECES = 1_000_000


class PieceEncoder:
    """Puts together what `encode` gives for each piece: all ids, and how many each piece has.

    blanks: whether the blanks before a run are part of its piece.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        blanks: bool,
        kept: int = KEPT_PIECES,
    ) -> None:
        self.encode, self.blanks, self.kept = encode, blanks, kept
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.numbers = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def learn(self, pieces: list[str]) -> np.ndarray:
        ids, lengths = self.encode(pieces)
        first, used = len(self.keys), int(self.bounds[len(self.keys)])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(used + 2 * len(ids), dtype=np.uint32)])
        if first + len(pieces) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.empty(first + 2 * len(pieces), dtype=np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.bounds[first + 1 : first + 1 + len(pieces)] = used + np.cumsum(lengths)
        return np.arange(first, first + len(pieces))

    def spans(self, texts: list[bytes]) -> Words:
        """The pieces of texts: their words, or words with the blanks before them and the blanks at an end."""
        words = find_words(texts)
        if not self.blanks:
            return words
        begin, end = words.text_starts[:-1], words.text_starts[1:] - 1
        full = words.counts > 0
        starts = np.concatenate([[0], words.ends[:-1]])[: len(words.ends)]
        starts[words.first[:-1][full]] = begin[full]
        last = begin.copy()
        last[full] = words.ends[words.first[1:][full] - 1]
        rest = np.flatnonzero(last < end)
        places = words.first[1:][rest]
        first = words.first + np.concatenate([[0], np.cumsum(last < end)])
        starts, ends = np.insert(starts, places, last[rest]), np.insert(words.ends, places, end[rest])
        return Words(words.buffer, starts, ends, first, words.text_starts)

    def places(self, pieces: Words) -> np.ndarray:
        """The number of each piece, new ones learnt. Numbers hold until the next call."""
        keys, first, inverse = np.unique(hash_words(pieces), return_index=True, return_inverse=True)
        known, at = found_in(keys, self.keys)
        if len(self.keys) + np.count_nonzero(~known) > self.kept:
            self._forget()
            known, at = found_in(keys, self.keys)
        numbers = np.empty(len(keys), dtype=np.int64)
        numbers[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = pieces.buffer.tobytes()
            starts, ends = pieces.starts[first[new]].tolist(), pieces.ends[first[new]].tolist()
            numbers[new] = self.learn([raw[s:e].decode() for s, e in zip(starts, ends, strict=True)])
            places = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, places, keys[new])
            self.numbers = np.insert(self.numbers, places, numbers[new])
        return numbers[inverse]

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. The texts should be a bounded slice, as one call keeps all their pieces."""
        if not texts:
            return []
        odd = [k for k, t in enumerate(texts) if odd_blanks(t)]
        plain = list(texts)
        for k in odd:
            plain[k] = b""
        pieces = self.spans(plain)
        found = self.places(pieces) if len(pieces.starts) else np.empty(0, dtype=np.int64)
        lengths = self.bounds[found + 1] - self.bounds[found]
        ids = self.flat[ragged(self.bounds[found], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[pieces.first[1:]]
        result = np.split(ids, ends[:-1])
        if odd:
            whole, counts = self.encode([texts[k].decode() for k in odd])
            for k, own in zip(odd, np.split(whole, np.cumsum(counts)[:-1]), strict=True):
                result[k] = own
        return result


def odd_blanks(text: bytes) -> bool:
    """Whether a tokenizer may see a blank where the pieces do not, or the other way round."""
    return bool(_CONTROL.search(text) if text.isascii() else OTHER_BLANKS.search(text.decode()))


_CONTROL = re.compile(rb"[\x1c-\x1f]")


def library_encode(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """The tokenizers library itself, without special tokens, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for k in range(0, len(texts), 1024):
            found += [e.ids for e in tokenizer.encode_batch_fast(texts[k : k + 1024], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lengths.sum())), lengths

    return encode


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
