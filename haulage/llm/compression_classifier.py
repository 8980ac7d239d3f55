"""A quality classifier from compressed sizes under two zstandard dictionaries.

One dictionary is trained on texts labelled good, one on texts labelled bad. A text like those a
dictionary was made of gets smaller under it. The difference of the two sizes over the text's
length, with how far the text compresses at all, its length and the products of these, is calibrated to the
probability of label 1 on labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.text import slices
from haulage.llm.training import Calibration, class_weights, held_out, labelled_sample

LEVEL = 3
DICTIONARY_BYTES = 110 << 10
PIECE_BYTES = 512


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from all pieces of the texts; from few pieces, their last bytes as they are."""
    pieces = [t[k : k + PIECE_BYTES] for t in texts for k in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


class Sizes:
    """Features of a text from its sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.both = []
        for held in (good, bad):
            shared = zstandard.ZstdCompressionDict(held) if held else None
            if shared:
                shared.precompute_compress(level=LEVEL)
            self.both.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False
                )
            )

    def features(self, texts: list[bytes]) -> np.ndarray:
        found = np.empty((len(texts), 3))
        for k, text in enumerate(texts):
            good, bad = (len(c.compress(text)) for c in self.both)
            found[k] = (bad - good) / (len(text) + 20), min(good, bad) / (len(text) + 1), np.log1p(len(text))
        pairs = [found[:, i] * found[:, j] for i in range(3) for j in range(i + 1)]
        return np.column_stack([found, *pairs])


class Model:
    """What scores a text: two dictionaries and the calibration, or one score where a class is missing."""

    def __init__(self, found: dict[int, list[bytes]], totals: dict[int, int]) -> None:
        every = sum(totals.values())
        self.prior = totals.get(1, 0) / every if every else 0.5
        self.calibration = None
        halves = {k: (t[: len(t) // 3 + 1], t[len(t) // 3 + 1 :]) for k, t in found.items()}
        if min(len(x) for pair in halves.values() for x in pair) == 0:
            return
        self.good, self.bad = dictionary(halves[1][0]), dictionary(halves[0][0])
        rest = halves[0][1] + halves[1][1]
        labels = np.repeat([0, 1], [len(halves[0][1]), len(halves[1][1])])
        features = Sizes(self.good, self.bad).features(rest)
        self.calibration = Calibration(features, labels, class_weights(labels, totals))

    def scorer(self):
        if self.calibration is None:
            return lambda texts: np.full(len(texts), self.prior)
        sizes = Sizes(self.good, self.bad)
        return lambda texts: self.calibration.score(sizes.features(texts))


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, longest: int = 1 << 16, **names
) -> Model:
    """A model from at most `per_class` labelled texts of each label, each of `longest` bytes or less."""
    return Model(*labelled_sample(documents, labels, label, per_class, longest, **names))


def score(
    df: DataFrame, model: Model, threshold: float = 0.3, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row its id, held_out, score (0 to 1, higher: label 1 likelier) and predicted.

    A null or empty text is scored as one of length 0. Without labelled rows of both kinds every
    score is the share of label 1, 0.5 without any. The model is two dictionaries of 110 KB and a
    few numbers, whatever the input. Other columns are not carried; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = scorer(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    names=[id_column, "held_out", "score", "predicted"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column], df[text].alias("_text"))
    rows = rows.select(id_column, held_out(id_column, 5, 0).alias("_held"), F.col("_text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, score double, predicted int")
