"""Toxicity from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a learnt vector of the word beside the mean of learnt vectors of its letter
runs, both found by hash. Two recurrent passes read a window of words, attention weighs the words, and
a logistic unit scores the window. Windows overlap by half; a text's score is that of
its highest window, calibrated on texts kept out of training. Only texts are labelled, so a
round of training takes each toxic text's highest window as toxic and the highest and
some other windows of each clean text as clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulage.llm.text import Words, find_words, hash_words, lowered, mixed, ragged, slices
from haulage.llm.training import Calibration, class_weights, held_out, labelled_sample

RUNS = (3, 4, 5)
EMPTY = -30.0
CHUNK_TEXTS = 100
CHUNK_WORDS = 1 << 14


@dataclass(frozen=True)
class Shape:
    """Words a window and from one to the next, sizes of the network, and how it is trained.

    A round takes the chosen windows once, or as often as makes about `steps` steps.
    """

    window: int = 32
    stride: int = 16
    buckets: int = 1 << 14
    vector: int = 8
    state: int = 8
    attention: int = 8
    rounds: int = 5
    batch: int = 64
    steps: int = 60
    rate: float = 0.01
    sparse_rate: float = 0.002


@dataclass
class Inputs:
    """Distinct words as buckets, and the windows of texts over them (-1 past a text's end)."""

    word: np.ndarray
    run: np.ndarray
    run_counts: np.ndarray
    windows: np.ndarray
    text_of: np.ndarray


def letter_runs(words: Words, which: np.ndarray, buffer: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of RUNS bytes of some words, a mark at either end, and how many each word has."""
    sizes = (words.ends - words.starts)[which]
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    marked = np.full(int((sizes + 2).sum()), 1, dtype=np.uint64)
    marked[starts + sizes + 1] = 2
    marked[ragged(starts + 1, sizes)] = buffer[ragged(words.starts[which], sizes)]
    owner = np.repeat(np.arange(len(which)), sizes + 2)
    found, owners = [], []
    for n in RUNS:
        if len(marked) < n:
            continue
        last = len(marked) - n + 1
        code = np.full(last, n, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + marked[k : k + last]
        inside = owner[:last] == owner[n - 1 :]
        found.append((mixed(code[inside]) % np.uint64(buckets)).astype(np.int32))
        owners.append(owner[:last][inside])
    if not found:
        return np.empty(0, dtype=np.int32), np.zeros(len(which), dtype=np.int64)
    runs, owners = np.concatenate(found), np.concatenate(owners)
    return runs[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(which))


def inputs(texts: list[bytes], shape: Shape) -> Inputs:
    words = find_words(texts)
    buffer = lowered(words.buffer)
    hashes = hash_words(words, buffer)
    values, which, places = np.unique(hashes, return_index=True, return_inverse=True)
    run, counts = letter_runs(words, which, buffer, shape.buckets)
    n = words.counts
    extra = np.maximum(0, -(-(n - shape.window) // shape.stride))
    number = np.where(n > 0, 1 + extra, 0)
    text_of = np.repeat(np.arange(len(texts)), number)
    start = ragged(np.zeros(len(texts), dtype=np.int64), number) * shape.stride + words.first[:-1][text_of]
    at = start[:, None] + np.arange(shape.window)
    there = places[np.minimum(at, len(places) - 1)] if len(places) else np.full(at.shape, -1)
    windows = np.where(at < words.first[1:][text_of][:, None], there, -1)
    word = (values % np.uint64(shape.buckets)).astype(np.int32)
    return Inputs(word, run, counts, windows.astype(np.int32), text_of)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters, and passes over windows given as numbers of distinct words."""

    def __init__(self, shape: Shape, seed: int = 7) -> None:
        self.shape, rng = shape, np.random.default_rng(seed)
        v, s, a = shape.vector, shape.state, shape.attention
        spread = lambda *size: (rng.standard_normal(size) * (0.5 / np.sqrt(size[0]))).astype(np.float32)
        self.p = {
            "word": (rng.standard_normal((shape.buckets, v)) * 0.05).astype(np.float32),
            "run": (rng.standard_normal((shape.buckets, v)) * 0.05).astype(np.float32),
            "in": spread(2 * v, 6 * s),
            "bias": np.zeros(6 * s, dtype=np.float32),
            "ahead": spread(s, 3 * s),
            "back": spread(s, 3 * s),
            "look": spread(2 * s, a),
            "weigh": spread(a, 1)[:, 0],
            "out": spread(2 * s, 1)[:, 0],
            "base": np.zeros(1, dtype=np.float32),
        }
        self.squares = {k: np.full_like(x, 1e-6) for k, x in self.p.items()}

    def vectors(self, x: Inputs) -> np.ndarray:
        """An input vector for each distinct word."""
        found = np.empty((len(x.word), 2 * self.shape.vector), dtype=np.float32)
        found[:, : self.shape.vector] = self.p["word"][x.word]
        bounds = np.concatenate([[0], np.cumsum(x.run_counts)])
        for k in range(0, len(x.word), CHUNK_WORDS):
            low, high = k, min(k + CHUNK_WORDS, len(x.word))
            runs = self.p["run"][x.run[bounds[low] : bounds[high]]]
            sums = np.add.reduceat(runs, bounds[low:high] - bounds[low], axis=0)
            found[low:high, self.shape.vector :] = sums / x.run_counts[low:high, None]
        return found

    def _pass(self, given: np.ndarray, weights: np.ndarray, windows: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each word, read from left to right; a missing word leaves the state as it is."""
        n, length = windows.shape
        s = self.shape.state
        state = np.zeros((n, s), dtype=np.float32)
        states = np.empty((length, n, s), dtype=np.float32)
        for t in range(length):
            g = given[windows[:, t]]
            h = state @ weights
            gates = sigmoid(g[:, : 2 * s] + h[:, : 2 * s])
            reset, update = gates[:, :s], gates[:, s:]
            new = np.tanh(g[:, 2 * s :] + reset * h[:, 2 * s :])
            there = (windows[:, t] >= 0)[:, None]
            after = np.where(there, update * state + (1 - update) * new, state)
            if keep is not None:
                keep.append((state, h, reset, update, new, there))
            states[t] = state = after
        return states

    def forward(self, vectors: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for each window."""
        p, s = self.p, self.shape.state
        given = np.concatenate([vectors @ p["in"] + p["bias"], np.zeros((1, 6 * s), dtype=np.float32)])
        ahead, back = ([], []) if keep is not None else (None, None)
        left = self._pass(given[:, : 3 * s], p["ahead"], windows, ahead)
        right = self._pass(given[:, 3 * s :], p["back"], windows[:, ::-1], back)[::-1]
        both = np.concatenate([left, right], axis=2)
        looked = np.tanh(both @ p["look"])
        weight = looked @ p["weigh"]
        weight = np.where(windows.T >= 0, weight, -np.inf)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (both * weight[:, :, None]).sum(axis=0)
        if keep is not None:
            keep.update(ahead=ahead, back=back, both=both, looked=looked, weight=weight, pooled=pooled)
        return pooled @ p["out"] + p["base"][0]

    def _unroll(self, kept: list, weights: np.ndarray, grads: np.ndarray, windows: np.ndarray, size: int):
        """Gradients of a pass: of its weights and of the inputs given to each distinct word."""
        s = self.shape.state
        d_weights, d_given = np.zeros_like(weights), np.zeros((size, 3 * s), dtype=np.float32)
        flow = np.zeros_like(kept[0][0])
        for t in range(len(kept) - 1, -1, -1):
            state, h, reset, update, new, there = kept[t]
            flow = flow + grads[t]
            d = np.where(there, flow, 0)
            d_new = d * (1 - update) * (1 - new**2)
            d_update = d * (state - new) * update * (1 - update)
            d_reset = d_new * h[:, 2 * s :] * reset * (1 - reset)
            d_h = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
            np.add.at(d_given, windows[:, t], np.concatenate([d_reset, d_update, d_new], axis=1))
            d_weights += state.T @ d_h
            flow = np.where(there, d * update, flow) + d_h @ weights.T
        return d_weights, d_given[:-1]

    def learn(self, x: Inputs, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
        """One step down the weighted log loss of some windows."""
        p, s, v, keep = self.p, self.shape.state, self.shape.vector, {}
        used, places = np.unique(windows, return_inverse=True)
        windows = places.reshape(windows.shape).astype(np.int32) - (used[0] < 0)
        used = used[used >= 0]
        ends = np.cumsum(x.run_counts)
        counts = x.run_counts[used]
        small = Inputs(x.word[used], x.run[ragged((ends - x.run_counts)[used], counts)], counts, windows, x.text_of)
        vectors = self.vectors(small)
        guess = sigmoid(self.forward(vectors, windows, keep))
        d = (weights * (guess - labels) / len(labels)).astype(np.float32)
        both, looked, weight = keep["both"], keep["looked"], keep["weight"]
        d_pooled = d[:, None] * p["out"]
        d_both = weight[:, :, None] * d_pooled
        along = (both * d_pooled).sum(axis=2)
        d_weight = weight * (along - (weight * along).sum(axis=0))
        d_looked = d_weight[:, :, None] * p["weigh"] * (1 - looked**2)
        d_both += d_looked @ p["look"].T
        size = len(used) + 1
        g_ahead, given_left = self._unroll(keep["ahead"], p["ahead"], d_both[:, :, :s], windows, size)
        g_back, given_right = self._unroll(keep["back"], p["back"], d_both[::-1, :, s:], windows[:, ::-1], size)
        given = np.concatenate([given_left, given_right], axis=1)
        d_vectors = given @ p["in"].T
        flat = lambda y: y.reshape(-1, y.shape[-1])
        grads = {
            "in": vectors.T @ given,
            "bias": given.sum(axis=0),
            "ahead": g_ahead,
            "back": g_back,
            "look": flat(both).T @ flat(d_looked),
            "weigh": (d_weight[:, :, None] * looked).sum(axis=(0, 1)),
            "out": keep["pooled"].T @ d,
            "base": np.array([d.sum()]),
        }
        for name, grad in grads.items():
            self._step(name, slice(None), grad)
        self._sparse("word", small.word, d_vectors[:, :v])
        self._sparse("run", small.run, np.repeat(d_vectors[:, v:] / counts[:, None], counts, axis=0))
        return float(-(weights * np.log(np.where(labels > 0, guess, 1 - guess) + 1e-9)).mean())

    def _sparse(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        own, places = np.unique(rows, return_inverse=True)
        sums = np.zeros((len(own), grad.shape[1]), dtype=np.float32)
        np.add.at(sums, places, grad)
        self._step(name, own, sums, self.shape.sparse_rate)

    def _step(self, name: str, rows, grad: np.ndarray, rate: float | None = None) -> None:
        """Against the gradient, each value by its own recent size."""
        self.squares[name][rows] = 0.99 * self.squares[name][rows] + 0.01 * grad**2
        self.p[name][rows] -= (rate or self.shape.rate) * grad / (np.sqrt(self.squares[name][rows]) + 1e-6)

    def logits(self, x: Inputs, most: int = 2048) -> np.ndarray:
        vectors = self.vectors(x)
        parts = [self.forward(vectors, x.windows[k : k + most]) for k in range(0, len(x.windows), most)]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.float32)


def highest(logits: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Each text's highest window logit, EMPTY without a window."""
    found = np.full(n, EMPTY)
    np.maximum.at(found, text_of, logits)
    return found


class Evidence:
    """How much oftener buckets occur in toxic texts than in clean ones."""

    def __init__(self, labels: np.ndarray, buckets: int) -> None:
        self.labels, self.buckets = labels, buckets
        self.seen = [np.zeros(buckets, dtype=np.int64) for _ in range(2)]

    def add(self, owner: np.ndarray, bucket: np.ndarray) -> None:
        """Count each bucket once for each text that owns it; a text comes whole."""
        pairs = np.unique(owner.astype(np.int64) * self.buckets + bucket)
        for k in (0, 1):
            own = pairs[self.labels[pairs // self.buckets] == k] % self.buckets
            self.seen[k] += np.bincount(own, minlength=self.buckets)

    def ratio(self) -> np.ndarray:
        """A smoothed log ratio, shrunk for buckets of few texts."""
        share, both = self.labels.mean(), self.seen[0] + self.seen[1]
        odds = (self.seen[1] + 4 * share) / (self.seen[0] + 4 * (1 - share)) * (1 - share) / share
        return both / (both + 4) * np.log(odds).clip(-4, 4)


def train(found: dict[int, list[bytes]], shape: Shape, seed: int = 7) -> Network:
    network, rng = Network(shape, seed), np.random.default_rng(seed)
    texts = found[0] + found[1]
    labels = np.repeat([0, 1], [len(found[0]), len(found[1])])
    x = inputs(texts, shape)
    inside = x.windows >= 0
    owner = np.broadcast_to(x.text_of[:, None], x.windows.shape)[inside]
    word = x.windows[inside]
    pair = np.unique(owner.astype(np.int64) * len(x.word) + word)
    owner, word = pair // len(x.word), pair % len(x.word)
    ends = np.cumsum(x.run_counts)
    of_words, of_runs = (Evidence(labels, shape.buckets) for _ in range(2))
    starts = np.searchsorted(owner, np.arange(0, len(texts) + CHUNK_TEXTS, CHUNK_TEXTS))
    for low, high in zip(starts[:-1], starts[1:], strict=True):
        some, counts = word[low:high], x.run_counts[word[low:high]]
        of_words.add(owner[low:high], x.word[some])
        of_runs.add(np.repeat(owner[low:high], counts), x.run[ragged((ends - x.run_counts)[some], counts)])
    network.p["word"][:, 0] += of_words.ratio() / 2
    network.p["run"][:, 0] += of_runs.ratio() / 2
    first = np.searchsorted(x.text_of, np.arange(len(texts)))
    number = np.bincount(x.text_of, minlength=len(texts))
    logits = None
    for _ in range(shape.rounds):
        if logits is None:
            vectors = network.vectors(x)[:, [0, shape.vector]].sum(axis=1)
            logits = np.where(inside, vectors[x.windows], -9).max(axis=1)
        else:
            logits = network.logits(x)
        order = np.lexsort((-logits, x.text_of))
        ranked = np.arange(len(order)) - np.repeat(first, number)
        top = order[ranked == 0]
        toxic = top[labels[x.text_of[top]] == 1]
        clean = order[(ranked < 2) & (labels[x.text_of[order]] == 0)]
        others = np.flatnonzero(labels[x.text_of] == 0)
        clean = np.concatenate([clean, rng.choice(others, min(len(others), len(clean)), replace=False)])
        chosen = np.concatenate([toxic, clean])
        marks = np.repeat([1.0, 0.0], [len(toxic), len(clean)])
        weights = np.where(marks > 0, len(marks) / (2 * max(1, len(toxic))), len(marks) / (2 * max(1, len(clean))))
        parts = max(1, len(chosen) // shape.batch)
        for _ in range(max(1, shape.steps // parts)):
            for k in np.array_split(rng.permutation(len(chosen)), parts):
                network.learn(x, x.windows[chosen[k]], marks[k], weights[k])
    return network


class Model:
    """A trained network and its calibration, or one score where a class is missing."""

    def __init__(self, found: dict[int, list[bytes]], totals: dict[int, int], shape: Shape = Shape()) -> None:
        every = sum(totals.values())
        self.prior, self.network = (totals.get(1, 0) / every if every else 0.0), None
        spoken = {k: [t for t in texts if t.split()] for k, texts in found.items()}
        cut = {k: max(1, len(t) * 3 // 4) for k, t in spoken.items()}
        if min(len(t) for t in spoken.values()) < 2:
            return
        network = train({k: t[: cut[k]] for k, t in spoken.items()}, shape)
        rest = [t for k in (0, 1) for t in spoken[k][cut[k] :]]
        labels = np.repeat([0, 1], [len(spoken[k]) - cut[k] for k in (0, 1)])
        x = inputs(rest, shape)
        tops = highest(network.logits(x), x.text_of, len(rest))
        self.calibration = Calibration(tops[:, None], labels, class_weights(labels, totals))
        self.network = network

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        x = inputs(texts, self.network.shape)
        return self.calibration.score(highest(self.network.logits(x), x.text_of, len(texts))[:, None])


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, longest: int = 1 << 14,
    shape: Shape = Shape(), **names,
) -> Model:
    """A model from at most `per_class` labelled texts of each label, each of `longest` bytes or less."""
    model = Model(*labelled_sample(documents, labels, label, per_class, longest, **names), shape)
    if model.network is not None:
        model.network.squares = {}
    return model


def score(
    df: DataFrame,
    model: Model,
    threshold: float = 0.5,
    id_column: str = "doc_id",
    text: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Per row its id, held_out, score (0 to 1, higher: label 1 likelier) and predicted; with `carry`, all in `_row`.

    Every window of the whole text is scored. A null or wordless text has no window and gets the
    calibrated score of a very clean one. Without labelled texts of both kinds every score is the
    share of label 1, 0 without any. The model's size depends on `Shape` alone. Repeated rows stay;
    a table without rows gives none.
    """
    # A text goes to Python once, by itself or in its row.
    rest = [F.struct(*(df[c] for c in df.columns)).alias("_row")] if carry else []
    source, row, sent = (text, "_row", []) if carry and text in df.columns else ("_text", None, [df[text].alias("_text")])
    rows = df.select(df[id_column], held_out(id_column, 5, 0).alias("held_out"), *sent, *rest)
    behind = 2 + len(sent)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for part, texts in slices(batch, source, 1 << 18, row):
                found = held.score(texts)
                marks = [part.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
                names = [id_column, "held_out", "score", "predicted", *["_row"] * carry]
                yield pa.RecordBatch.from_arrays([part.column(0), *marks, *part.columns[behind:]], names=names)

    verdict = StructType.fromDDL("score double, predicted int").fields
    return rows.mapInArrow(run, StructType([rows.schema[0], rows.schema[1], *verdict, *rows.schema.fields[behind:]]))
