"""Near-duplicate vectors of one label, compared tile by tile in the order of their principal axes.

Unit vectors are turned so that their first dimensions carry most of their length. Two of them at the
threshold differ by a bounded step in any dimension, so cells of that width along the first
one only meet their neighbours. Cells are dealt into blocks of bounded size and blocks compared in
pairs: products of the leading dimensions are summed first, what the rest can add is bounded by the
product of the lengths left, and a pair is dropped once it cannot reach the threshold.
Equal vectors are compared once. A pair of blocks passes on counts and one star for each
connected set, never its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.links import checkpointed, components, roots

BLOCK = 4096
TILE = 512
STAGES = (8, 16, 32)
SLACK = 1e-9
KEY = ("_label", "_dim", "_low_cell", "_low", "_high_cell", "_high")


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return np.split(flat, ends[:-1]) if len(ends) else []


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of a and b whose cosine reaches the threshold; leading dimensions come first."""
    dim, done = a.shape[1], 0
    x = y = None
    product: np.ndarray = np.zeros((len(a), len(b)))
    for stage in (*[s for s in STAGES if s < dim], dim):
        rest_a = np.sqrt((a[:, stage:] ** 2).sum(axis=1))
        rest_b = np.sqrt((b[:, stage:] ** 2).sum(axis=1))
        if x is None:
            product = product + a[:, done:stage] @ b[:, done:stage].T
            open_ = product + rest_a[:, None] * rest_b >= threshold - SLACK
            if stage < dim and np.count_nonzero(open_) * 8 < open_.size:
                x, y = np.nonzero(open_)
                product = product[x, y]
        else:
            product = product + np.einsum("ij,ij->i", a[x, done:stage], b[y, done:stage])
            open_ = product + rest_a[x] * rest_b[y] >= threshold - SLACK
            x, y, product = x[open_], y[open_], product[open_]
        done = stage
    if x is None:
        x, y = np.nonzero(product >= threshold)
        return x, y
    hit = product >= threshold
    return x[hit], y[hit]


def compare(low: tuple, high: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and the copies linked to them; stars (node, node) over the links. high None: low with itself."""
    ids = low[0] if high is None else np.concatenate([low[0], high[0]])
    copies = low[1] if high is None else np.concatenate([low[1], high[1]])
    vectors = low[2] if high is None else np.concatenate([low[2], high[2]])
    edge = len(low[0])
    linked = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))
    for i in range(0, edge, TILE):
        first = np.arange(i, min(i + TILE, edge))
        for j in range(i if high is None else edge, len(ids), TILE):
            second = np.arange(j, min(j + TILE, len(ids)))
            x, y = similar(vectors[first], vectors[second], threshold)
            x, y = first[x], second[y]
            if high is None and j == i:
                x, y = x[x < y], y[x < y]
            np.add.at(linked, x, copies[y])
            np.add.at(linked, y, copies[x])
            apart = root[x] != root[y]
            if apart.any():
                every = np.arange(len(ids))
                root = roots(len(ids), np.concatenate([every, x[apart]]), np.concatenate([root, y[apart]]))
    some, moved = np.flatnonzero(linked), np.flatnonzero(root != np.arange(len(ids)))
    return ids[some], linked[some], ids[moved], ids[root[moved]]


def axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For the commonest dimension, the principal axes of all unit vectors as columns, the longest first."""
    top = distinct.groupBy(F.size("_vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return {}
    dim = top["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            rows = [v for v in rows_of(batch.column(0)) if len(v) == dim]
            if rows:
                held = unit(np.array(rows))
                total += held.T @ held
        r, c = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.ravel()) for x in (r.astype(np.int32), c.astype(np.int32), total)], names=["r", "c", "v"]
        )

    sums = distinct.select("_vector").mapInArrow(run, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v"))
    moment = np.zeros((dim, dim))
    for row in sums.collect():
        moment[row["r"], row["c"]] = row["v"]
    values, vectors = np.linalg.eigh((moment + moment.T) / 2)
    return {dim: vectors[:, np.argsort(-values)]}


def block_pairs(turned: DataFrame) -> DataFrame:
    """Each vector once for every pair of blocks it takes part in, `_side` 0 or 1."""
    cell = ["_label", "_dim", "_cell"]
    sizes = turned.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    beside = [
        sizes.select("_label", "_dim", (F.col("_cell") + k).alias("_cell"), F.col("_blocks").alias(name))
        for k, name in ((-1, "_next"), (1, "_before"))
    ]
    own = turned.join(sizes, cell).join(beside[0], cell, "left").join(beside[1], cell, "left")
    own = own.withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))

    def pair(low_cell, low, high_cell, high, side):
        parts = (low_cell, low, high_cell, high, side)
        names = ("_low_cell", "_low", "_high_cell", "_high", "_side")
        return F.struct(*(x.cast("int").alias(n) for x, n in zip(parts, names, strict=True)))

    cell_, block = F.col("_cell"), F.col("_block")
    nothing = F.array().cast("array<int>")

    def upto(n):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(nothing)

    pairs = F.concat(
        F.transform(
            upto("_blocks"),
            lambda j: pair(cell_, F.least(block, j), cell_, F.greatest(block, j), F.when(block <= j, 0).otherwise(1)),
        ),
        F.transform(upto("_next"), lambda j: pair(cell_, block, cell_ + 1, j, F.lit(0))),
        F.transform(upto("_before"), lambda j: pair(cell_ - 1, j, cell_, block, F.lit(1))),
    )
    return own.select("_label", "_dim", "_node", "_copies", "_turned", F.explode(pairs).alias("_p")).select(
        "_label", "_dim", "_p.*", "_node", "_copies", "_turned"
    )


def near_duplicates(
    df: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row its id, n_links, component_id and kept, by cosine >= threshold among rows of one label.

    n_links counts the other rows linked directly, component_id is the least id reachable by links, kept
    is whether that is the row's own. A row without an id or label, or with a vector that is null, empty,
    zero or holds null or non-finite values, links with nothing: n_links 0, component_id its id (kept
    is true also for a null id). Vectors of different lengths do not link. Equal rows link with each
    other and are returned one by one; ids should be whole numbers and name one row each, as rows that share one
    share their links. Other columns are not carried. A table without rows gives none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    reach = float(np.sqrt(2 - 2 * threshold) + 1e-6)
    rows = df.select(
        df[id_column].cast("long").alias("_id"),
        df[label].cast("string").alias("_label"),
        df[vector].cast("array<double>").alias("_vector"),
    )
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_vector").isNotNull()
    fit = fit & finite & F.exists("_vector", lambda x: x != 0)
    rows = rows.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    whole = rows.where("_fit")
    distinct = whole.groupBy("_label", "_vector").agg(F.min("_id").alias("_node"), F.count("*").alias("_copies"))
    turns = axes(distinct.select("_vector"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = rows_of(batch.column("_vector"))
            dims = np.array([len(v) for v in vectors])
            out: list = [None] * len(vectors)
            first = np.zeros(len(vectors))
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                held = unit(np.array([vectors[k] for k in which]))
                held = held @ turns[dim] if dim in turns else held
                first[which] = held[:, 0]
                for k, v in zip(which, held, strict=True):
                    out[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_label"),
                    pa.array(dims, pa.int32()),
                    pa.array(np.floor(first / reach).astype(np.int32)),
                    batch.column("_node"),
                    batch.column("_copies"),
                    pa.array(out, pa.binary()),
                ],
                names=["_label", "_dim", "_cell", "_node", "_copies", "_turned"],
            )

    schema = "_label string, _dim int, _cell int, _node long, _copies long, _turned binary"
    turned = checkpointed(distinct.mapInArrow(turn, schema))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> pa.RecordBatch:
            side, ids, copies = (
                np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held])
                for k in ("_side", "_node", "_copies")
            )
            raw = b"".join(v for b in held for v in b.column("_turned").to_pylist())
            vectors = np.frombuffer(raw).reshape(len(ids), -1)
            low, high = side == 0, side == 1
            alone = now[2:4] == now[4:6]
            sides = [(ids[s], copies[s], vectors[s]) for s in (low, high)]
            a, n, b, c = compare(sides[0], None if alone else sides[1], threshold)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, b])),
                    pa.array([None] * len(a) + c.tolist(), pa.int64()),
                    pa.array(np.concatenate([n, np.zeros(len(b), dtype=np.int64)])),
                ],
                names=["a", "b", "n"],
            )

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high == low:
                    continue
                if held and keys[low] != now:
                    yield flush()
                    held = []
                now = keys[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield flush()

    pairs = block_pairs(turned).repartition(*KEY).sortWithinPartitions(*KEY, "_side")
    met = checkpointed(pairs.mapInArrow(meet, "a long, b long, n long"))
    counts = met.where("b is null").groupBy("a").agg(F.sum("n").alias("_others")).withColumnRenamed("a", "_node")
    named = components(met.where("b is not null").select("a", "b")).withColumnRenamed("id", "_node")
    found = distinct.join(counts, "_node", "left").join(named, "_node", "left")
    found = found.select(
        "_label",
        "_vector",
        (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "_node").alias("component_id"),
    )
    linked = whole.join(found, ["_label", "_vector"]).select("_id", "n_links", "component_id")
    alone = rows.where("not _fit").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.union(alone).select(
        F.col("_id").alias(id_column), "n_links", "component_id", F.expr("_id <=> component_id").alias("kept")
    )
