"""Packing examples into sequences under limits on tokens, segments and loss-bearing tokens.

Vector bin packing by the dot product: a sequence is filled one piece at a time with the
piece whose share of the three limits points most the way of what is still free, the
limits weighted by how much of each the waiting pieces ask for. Examples longer than a
sequence are cut. A gap that no piece fits is filled with the head of one.

Each task packs what it reads, some thousand pieces at a time; what is left open goes on
to the next thousand. At the end of a task open sequences are cut to powers of two,
lengths that need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.llm.bpe import checked_encoder
from haulage.llm.chunks import crc
from haulage.llm.text import binary, slices

SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " loss_tokens long, ids binary"
)


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. shortest: the least piece cut only to fill a gap."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096
    shortest: int = 16

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss, self.shortest) < 1:
            raise ValueError("every limit must be at least 1")


@dataclass
class Example:
    """An example's ids; the first `silent` of them bear no loss."""

    key: object
    ids: np.ndarray
    silent: int


@dataclass
class Piece:
    example: Example
    start: int
    length: int

    @property
    def loss(self) -> int:
        return self.start + self.length - max(self.start, min(self.example.silent, self.start + self.length))

    def head(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.example, self.start, length),
            Piece(self.example, self.start + length, self.length - length),
        )


def longest_head(piece: Piece, tokens: int, loss: int) -> int:
    """How many leading ids of a piece fit into so many tokens and loss-bearing tokens."""
    silent = max(0, piece.example.silent - piece.start)
    return min(piece.length, tokens, silent + loss)


def cut_example(example: Example, limits: Limits) -> list[Piece]:
    """An example as pieces that each fit an empty sequence."""
    rest, found = Piece(example, 0, len(example.ids)), []
    while rest.length:
        piece, rest = rest.head(longest_head(rest, limits.tokens, limits.loss))
        found.append(piece)
    return found


def fill(pieces: list[Piece], limits: Limits, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences made of the pieces, and the pieces left for the next call (none if `last`)."""
    most = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    waiting = list(pieces)
    size = np.array([[p.length, 1, p.loss] for p in waiting], dtype=np.int64).reshape(-1, 3)
    free = np.ones(len(waiting), dtype=bool)
    sequences = []
    while free.any():
        room = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
        weight = size[free].sum(axis=0) / most
        chosen: list[int] = []
        parts: list[Piece] = []
        while room.min() > 0:
            fits = np.flatnonzero(free & (size <= room).all(axis=1))
            if len(fits):
                k = int(fits[((size[fits] / most) @ (weight * room / most)).argmax()])
                parts.append(waiting[k])
                room -= size[k]
                free[k] = False
                chosen.append(k)
                continue
            rest = np.flatnonzero(free)
            if not len(rest):
                break
            k = int(rest[size[rest, 0].argmax()])
            length = longest_head(waiting[k], int(room[0]), int(room[2]))
            if length < min(limits.shortest, waiting[k].length):
                break
            piece, waiting[k] = waiting[k].head(length)
            size[k] = waiting[k].length, 1, waiting[k].loss
            parts.append(piece)
            room -= [piece.length, 1, piece.loss]
        if not last and room.min() > 0 and not free.any():
            return sequences, parts
        sequences.append(parts)
    return sequences, []


def cut_to_powers(parts: list[Piece]) -> list[list[Piece]]:
    """One sequence as several, each of a power of two of tokens."""
    found, rest = [], list(parts)
    while rest:
        room = 1 << (sum(p.length for p in rest).bit_length() - 1)
        now: list[Piece] = []
        while room:
            piece = rest.pop(0)
            if piece.length > room:
                piece, behind = piece.head(room)
                rest.insert(0, behind)
            now.append(piece)
            room -= piece.length
        found.append(now)
    return found


def without_padding(sequences: list[list[Piece]], limits: Limits) -> list[list[Piece]]:
    """The sequences, those short of full by `limits.shortest` or more cut to powers of two."""
    found = []
    for parts in sequences:
        short = sum(p.length for p in parts) + limits.shortest <= limits.tokens
        found += cut_to_powers(parts) if short else [parts]
    return found


def pack(
    df: DataFrame,
    tokenizer: str,
    limits: Limits = Limits(),
    id_column: str = "doc_id",
    text: str = "text",
    prompt: str | Column | None = None,
    end: int = 2,
    waiting: int = 2048,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids.

    tokenizer: a vocabulary of whole words, at the same place on every executor. prompt: a text
    before the other whose ids bear no loss; none by default. ids: little-endian 32-bit, null
    unless `with_ids`. A null or empty text is one piece that holds the end id alone. Repeated
    ids and rows are packed one by one; columns not named here are not carried; a table
    without rows gives none. A sequence that is short of full by `limits.shortest` or more, as the limit on
    segments or loss held first or the task ended, is cut to several of a power of two each, which need no padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = checked_encoder(tokenizer)
        number = TaskContext.get().partitionId() << 33

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in range(9)]
            for parts in sequences:
                offset = 0
                for p in parts:
                    ids = np.ascontiguousarray(p.example.ids[p.start : p.start + p.length], dtype="<u4")
                    row = (
                        p.example.key, p.start, p.length, crc(ids), len(p.example.ids),
                        number, offset, p.loss, ids.tobytes() if with_ids else None,
                    )
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += p.length
                number += 1
            kinds = [key_type, *[pa.int64()] * 7, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=[id_column, *(x.split()[0] for x in SCHEMA.split(", "))],
            )

        open_: list[Piece] = []
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part, texts in slices(batch, "_text"):
                keys = part.column(0).to_pylist()
                prompts = binary(part.column(2)).to_pylist()
                done = []
                spoken, silent = encoder.batch(texts), encoder.batch(prompts) if prompt is not None else None
                for k, key in enumerate(keys):
                    before = silent[k] if silent is not None else np.empty(0, dtype=np.uint32)
                    ids = np.concatenate([before, spoken[k], np.array([end], dtype=np.uint32)])
                    for piece in cut_example(Example(key, ids, len(before)), limits):
                        (done if piece.length == limits.tokens else open_).append(piece)
                if done:
                    yield rows([[p] for p in done])
                if len(open_) >= waiting:
                    found, open_ = fill(open_, limits, last=False)
                    yield rows(without_padding(found, limits))
        if open_:
            yield rows(without_padding(fill(open_, limits, last=True)[0], limits))

    if prompt is None:
        before = F.lit("")
    else:
        before = F.col(prompt) if isinstance(prompt, str) else prompt
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column], df[text].alias("_text"), before.alias("_prompt")).mapInArrow(
        run, f"`{id_column}` {kind}, {SCHEMA}"
    )
