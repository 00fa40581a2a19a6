"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at cosine c lie sqrt(2 - 2c) apart, and any projection brings
them no further.  Vectors are projected on their leading principal axes, cut
into grid cells of that size and sorted by cell (label first, the order of
cells lexicographic).  The sorted sequence is cut into blocks; two blocks are
compared only if the boxes of their projections come near enough, and inside
a pair the sequences are halved again and again, skipping parts that are
provably distant.  What is left is verified by the cosine in double
precision.  Exact copies collapse before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.components import components
from vigilspark.session import store

MIN_COSINE = 0.98
AXES = 6
BLOCK_ROWS = 1024
LEAF_ROWS = 64
#: Rounding of projections; only ever makes the search wider.
SLACK = 1e-7


def _usable(vector):
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


# -------------------------------------------------------------- principal axes

def _unit(vectors) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _moments(batches):
    """Per dimension and row of the matrix: sums of x x^T with the sums of x as its last row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            x = np.frombuffer(b"".join(part["unit"]), dtype=np.float64).reshape(len(part), dim)
            x = np.column_stack([x, np.ones(len(x))])
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, m in sums.items():
        for i in range(dim + 1):
            yield pd.DataFrame({"dim": [dim], "i": [i], "sums": [m[i].tobytes()]})


def _add_up(key, group):
    total = np.sum([np.frombuffer(b, dtype=np.float64) for b in group["sums"]], axis=0)
    return pd.DataFrame({"dim": [key[0]], "i": [key[1]], "sums": [total.tobytes()]})


def principal_axes(vectors: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """dim -> (dim, at most ``axes``) orthonormal axes of largest variance, from all vectors."""
    schema = "dim int, i int, sums binary"
    rows = vectors.select("dim", "unit").mapInPandas(_moments, schema).groupBy("dim", "i").applyInPandas(_add_up, schema).collect()
    out = {}
    for dim in {r.dim for r in rows}:
        m = np.array([np.frombuffer(r.sums, dtype=np.float64) for r in sorted((r for r in rows if r.dim == dim), key=lambda r: r.i)])
        mean = m[dim, :dim] / m[dim, dim]
        value, vector = np.linalg.eigh(m[:dim, :dim] / m[dim, dim] - np.outer(mean, mean))
        out[dim] = vector[:, np.argsort(value)[::-1][:axes]]
    return out


# ------------------------------------------------------------------ block join

def _near(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the boxes of two sets of projections come within eps."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap) <= eps * eps


def sequence_join(x, px, y, py, eps: float, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in x, j in y) at ``min_cosine`` or more, by recursive halving of both sequences."""
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if not _near(px[a:b], py[c:d], eps):
            continue
        if b - a <= LEAF_ROWS and d - c <= LEAF_ROWS:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= min_cosine)
            found.append((i + a, j + c))
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position linked to each of n positions, by links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _blocks(axes: dict[int, np.ndarray], rows: int):
    """Consecutive runs of at most ``rows`` vectors of a label and dimension, one row each."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def emit(df):
            nonlocal number
            dim = int(df["dim"].iloc[0])
            p = np.frombuffer(b"".join(df["unit"]), dtype=np.float64).reshape(len(df), dim) @ axes[dim]
            out = pd.DataFrame({
                "block": [part << 32 | number], "label": [df["label"].iloc[0]], "dim": [dim], "low": [p.min(axis=0)], "high": [p.max(axis=0)],
                "uids": [df["uid"].to_numpy(dtype=np.int64).tobytes()], "copies": [df["copies"].to_numpy(dtype=np.int64).tobytes()],
                "units": [b"".join(df["unit"])]})
            number += 1
            return out

        for batch in batches:
            held.append(batch)
            df = pd.concat(held, ignore_index=True)
            change = (df["label"].ne(df["label"].shift()) | df["dim"].ne(df["dim"].shift())).cumsum()
            groups = [g for _, g in df.groupby(change, sort=False)]
            for g in groups[:-1]:
                for a in range(0, len(g), rows):
                    yield emit(g.iloc[a:a + rows])
            last = groups[-1]
            whole = len(last) // rows * rows
            for a in range(0, whole, rows):
                yield emit(last.iloc[a:a + rows])
            held = [last.iloc[whole:]] if whole < len(last) else []
        if held:
            yield emit(held[0])

    return run


def _pair_links(axes: dict[int, np.ndarray], min_cosine: float, eps: float):
    """For every vector of a block pair that links: how many others it links to there, and the smallest uid of its part."""
    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                side = []
                for uids, copies, units in ((r.uids_a, r.copies_a, r.units_a), (r.uids_b, r.copies_b, r.units_b)):
                    u = np.frombuffer(uids, dtype=np.int64)
                    x = np.frombuffer(units, dtype=np.float64).reshape(len(u), r.dim)
                    side.append((u, np.frombuffer(copies, dtype=np.int64), x, x @ axes[r.dim]))
                (ua, ca, x, px), (ub, cb, y, py) = side
                i, j = sequence_join(x, px, y, py, eps, min_cosine)
                if r.a == r.b:  # every pair is met twice, and each vector with itself
                    i, j = i[i != j], j[i != j]
                    links = np.bincount(i, weights=ca[j], minlength=len(ua)).astype(np.int64)
                    root = _local_roots(len(ua), i, j)
                    uid, low = ua, np.minimum.reduceat(ua[np.argsort(root, kind="stable")], np.searchsorted(np.sort(root), np.unique(root)))
                    low = low[np.searchsorted(np.unique(root), root)]
                else:
                    links = np.concatenate([np.bincount(i, weights=cb[j], minlength=len(ua)),
                                            np.bincount(j, weights=ca[i], minlength=len(ub))]).astype(np.int64)
                    uid = np.concatenate([ua, ub])
                    root = _local_roots(len(uid), i, j + len(ua))
                    kinds = np.unique(root)
                    low = np.minimum.reduceat(uid[np.argsort(root, kind="stable")], np.searchsorted(np.sort(root), kinds))
                    low = low[np.searchsorted(kinds, root)]
                hit = links > 0
                yield pd.DataFrame({"uid": uid[hit], "links": links[hit], "low": low[hit]})

    return run


# ------------------------------------------------------------------- operators

def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    min_cosine: float = MIN_COSINE, axes: int = AXES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors equally
    long and at cosine ``min_cosine`` (above 0) or more.  Vectors that are
    null, empty, zero or hold null or non-finite numbers link with nothing,
    nor do rows without an id (component null, not kept).  Repeated rows link
    with each other like any copies.  Other columns are ignored.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be above 0 and at most 1")
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"))
    usable = rows.where(fit)

    def normalise(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = batch["embedding"].map(len)
            units = [None] * len(batch)
            for dim in dims.unique():
                where = np.flatnonzero(dims == dim)
                for k, u in zip(where, _unit(batch["embedding"].iloc[where])):
                    units[k] = u.tobytes()
            yield batch.assign(uid=(part << 40) + at + np.arange(len(batch)), dim=dims.astype(np.int32), unit=units)
            at += len(batch)

    item = vectors.schema[vector_col].dataType.simpleString()
    distinct = store(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).mapInPandas(
        normalise, f"label string, embedding {item}, first_id {kind}, copies long, uid long, dim int, unit binary"))

    eps = float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) + SLACK
    basis = principal_axes(distinct, axes)
    width = max([a.shape[1] for a in basis.values()], default=1)

    def cells(batches):
        for batch in batches:
            out = np.zeros((len(batch), width), dtype=np.int32)
            for dim in batch["dim"].unique():
                at = np.flatnonzero(batch["dim"] == dim)
                x = np.frombuffer(b"".join(batch["unit"].iloc[at]), dtype=np.float64).reshape(len(at), dim)
                out[at, :basis[dim].shape[1]] = np.floor(x @ basis[dim] / eps)
            yield batch.assign(**{f"c{k}": out[:, k] for k in range(width)})

    order = ["label", "dim", *[f"c{k}" for k in range(width)], "uid"]
    sequence = distinct.select("uid", "label", "dim", "copies", "unit").mapInPandas(
        cells, "uid long, label string, dim int, copies long, unit binary, " + ", ".join(f"c{k} int" for k in range(width)))
    blocks = store(sequence.repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "label", "dim", "copies", "unit").mapInPandas(
        _blocks(basis, block_rows), "block long, label string, dim int, low array<double>, high array<double>, uids binary, copies binary, units binary"))

    # blocks whose cells on the first axis meet or touch, then those whose boxes come within eps on all axes
    first = lambda c: F.floor(F.col(c)[0] / eps)
    box = blocks.select("block", "label", "dim", "low", "high", first("low").alias("from"), first("high").alias("to"))
    left = box.select(F.col("block").alias("a"), "label", "dim", F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                      F.explode(F.sequence("from", F.col("to") + 1)).alias("cell"))
    right = box.select(F.col("block").alias("b"), "label", "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"),
                       F.explode(F.sequence("from", F.col("to") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y),
                      lambda x, y: F.greatest(x, y, F.lit(0.0)))
    pairs = left.join(right, ["label", "dim", "cell"]).where("a <= b").withColumn("gaps", gaps).where(
        F.aggregate("gaps", F.lit(0.0), lambda s, g: s + g * g) <= eps * eps).select("a", "b", "dim").distinct()
    heavy = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("uids", "copies", "units")])
    met = pairs.join(heavy("a"), "a").join(heavy("b"), "b")
    spark = vectors.sparkSession
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "16")  # a row is two whole blocks here
    try:
        hits = store(met.mapInPandas(_pair_links(basis, min_cosine, eps), "uid long, links long, low long"))
    finally:
        spark.conf.set(limit, before)

    links = hits.groupBy("uid").agg(F.sum("links").alias("links"))
    root = components(hits, "uid", "low").withColumnRenamed("node", "uid")
    placed = distinct.select("uid", "label", "embedding", "first_id", "copies").join(links, "uid", "left").join(root, "uid", "left").select(
        "label", "embedding", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "uid").alias("root"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(names, "root").select("label", "embedding", "n_links", "component_id")
    linked = usable.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
