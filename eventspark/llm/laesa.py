"""Centroid clustering with a table of pivot distances (LAESA).

Vectors become integers, floor(SCALE * x). A few pivots, vectors far apart from
each other, are fixed at the start; the distance of every vector to every pivot
is computed once and stored with the vector. In a round the distances between
centroids and pivots are computed anew (a small table), and by the triangle
inequality |d(v, p) - d(c, p)| is a lower bound of d(v, c) for every pivot. The
centroid with the smallest bound gets an exact distance first; only centroids
whose bound isn't above that one are compared as well, in exact integers. So
the result is that of comparing all; ties go to the smaller number.

Each task turns its vectors into sums per centroid, so a round shuffles a few
thousand numbers a task and the driver holds k centroids. A centroid becomes
the componentwise exact floor of the mean; an empty one stays.

Integers: components below 2**27 go through 64-bit arithmetic. Larger ones are
exact too, as Python integers a vector at a time; their sums are kept in limbs
of 30 bits. A distance that does not fit a long is null, and so are the sums of
distances with it or beyond a long.

Rows: vectors with another number of components than ``size``, or a null or
non-finite one, are left out. With fewer vectors than centroids every vector
is one. Rows that repeat an id count each; equal hashes are ordered by the
vector, a null id counts as an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.llm.common import Workspace

SIZE, SCALE = 64, 64
CENTROIDS, ROUNDS = 16, 3
#: Pivots, and the vectors they are chosen from (by hash: a bounded sample; any pivots give the same clusters).
PIVOTS, PIVOT_SAMPLE = 8, 256
#: Components below this take the 64-bit path; squares of their differences, summed, fit.
NARROW = 1 << 27
LIMB = 30
#: Vectors handled at once.
BLOCK = 4096


def whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite double."""
    return math.floor(SCALE * x) if abs(x) < 2.0**52 else SCALE * int(x)


def square(a, b) -> int:
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b))


def root(n: int) -> float:
    """The square root; far beyond doubles it is infinite."""
    return math.sqrt(n) if n < 1 << 1000 else math.inf


def _components(column) -> np.ndarray:
    """The rows of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _is_wide(x: np.ndarray) -> np.ndarray:
    return (np.abs(x) >= NARROW / SCALE).any(axis=1)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64)


class Table:
    """Centroids (lists of integers) with their distances to the pivots."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]]):
        self.exact, self.pivots = centroids, pivots
        self.wide = any(abs(x) >= NARROW for c in centroids for x in c)
        self.rows = None if self.wide else np.array(centroids, np.int64)
        self.to_pivots = np.array([[root(square(c, p)) for p in pivots] for c in centroids])

    def assign(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray, np.ndarray]:
        """For every vector: centroid, exact squared distance, and how many
        exact distances it took."""
        n, k = len(x), len(self.exact)
        with np.errstate(invalid="ignore"):
            bound = np.zeros((n, k))
            for p in range(to_pivots.shape[1]):
                gap = np.abs(to_pivots[:, p, None] - self.to_pivots[None, :, p])
                # room for the rounding of two square roots and their difference
                room = 1e-12 * (to_pivots[:, p, None] + self.to_pivots[None, :, p])
                np.maximum(bound, np.nan_to_num(gap - room, nan=0.0, posinf=0.0), out=bound)
        bound = np.maximum(bound * (1 - 1e-12), 0) ** 2
        wide = _is_wide(x) | self.wide
        narrow = np.flatnonzero(~wide)
        cluster, tried = np.zeros(n, np.int64), np.ones(n, np.int64)
        far = np.zeros(n, np.int64) if not wide.any() else np.zeros(n, object)
        if len(narrow):
            v, low = _integers(x[narrow]), bound[narrow]
            start = low.argmin(axis=1)
            best = ((v - self.rows[start]) ** 2).sum(axis=1)
            at = start.copy()
            for c in range(k):
                left = np.flatnonzero((low[:, c] <= best) & (start != c))
                d = ((v[left] - self.rows[c]) ** 2).sum(axis=1)
                tried[narrow[left]] += 1
                better = (d < best[left]) | ((d == best[left]) & (c < at[left]))
                best[left[better]], at[left[better]] = d[better], c
            cluster[narrow], far[narrow] = at, best
        for i in np.flatnonzero(wide):
            v = [whole(float(y)) for y in x[i]]
            far[i], cluster[i] = min((square(v, c), j) for j, c in enumerate(self.exact))
            tried[i] = k
        return cluster, far, tried


def _measured(pivots):
    def run(batches):
        for batch in batches:
            x = _components(batch.column("v"))
            out = np.empty((len(x), len(pivots)))
            wide, narrow = np.flatnonzero(_is_wide(x)), np.flatnonzero(~_is_wide(x))
            for p, pivot in enumerate(pivots):
                if any(abs(y) >= NARROW for y in pivot):
                    wide, narrow = np.arange(len(x)), np.empty(0, np.int64)
                for i in range(0, len(narrow), BLOCK):
                    part = narrow[i: i + BLOCK]
                    out[part, p] = np.sqrt(((_integers(x[part]) - np.array(pivot, np.int64)) ** 2).sum(axis=1))
                for i in wide:
                    out[i, p] = root(square([whole(float(y)) for y in x[i]], pivot))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float64()))], names=[*batch.schema.names, "to_pivots"])
    return run


def _blocks(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            yield part, _components(part.column("v")), _components(part.column("to_pivots"))


def _summed(table):
    """Sums per (cluster, component, limb) and counts (component -1) of a task."""
    def run(batches):
        t = table.value
        k, size = len(t.exact), len(t.exact[0])
        sums, n, large = np.zeros((k, size), np.int64), np.zeros(k, np.int64), {}
        for _, x, to_pivots in _blocks(batches):
            cluster, _, _ = t.assign(x, to_pivots)
            n += np.bincount(cluster, minlength=k)
            wide = _is_wide(x)
            v, own = _integers(x[~wide]), cluster[~wide]
            for c in np.unique(own):
                sums[c] += v[own == c].sum(axis=0)
            for i in np.flatnonzero(wide):
                for j, y in enumerate(x[i]):
                    key = int(cluster[i]), j
                    large[key] = large.get(key, 0) + whole(float(y))
        rows = [(c, -1, 0, int(n[c])) for c in range(k) if n[c]]
        rows += [(c, j, 0, int(sums[c, j])) for c in range(k) if n[c] for j in range(size)]
        for (c, j), total in large.items():
            sign, rest, limb = (1, total, 0) if total >= 0 else (-1, -total, 0)
            while rest:
                rows.append((c, j, limb, sign * (rest & ((1 << LIMB) - 1))))
                rest, limb = rest >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows) if rows else [[]] * 4, [pa.int32(), pa.int32(), pa.int32(), pa.int64()])],
                                         names=["cluster", "component", "limb", "total"])
    return run


def _assigned(table):
    def run(batches):
        t = table.value
        for part, x, to_pivots in _blocks(batches):
            cluster, far, tried = t.assign(x, to_pivots)
            far = [int(d) if d < 1 << 63 else None for d in far]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(far, pa.int64()), pa.array(tried.astype(np.int32))],
                                             names=["vec_id", "cluster", "distance", "n_exact"])
    return run


def _far_apart(sample: list[list[int]], most: int) -> list[list[int]]:
    """Vectors with large distances between them, one after the other."""
    chosen = sample[:1]
    near = [square(v, chosen[0]) for v in sample] if sample else []
    while len(chosen) < min(most, len(sample)) and max(near) > 0:
        chosen.append(sample[near.index(max(near))])
        near = [min(d, square(v, chosen[-1])) for d, v in zip(near, sample)]
    return chosen


def cluster(spark: SparkSession, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """One row per vector kept: vec_id, cluster, distance (squared) and n_exact
    (exact distances it took at last); and the final centroids."""
    ws = Workspace(spark, "laesa")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))

    def first(seed: int, most: int) -> list[list[int]]:
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
        return [[whole(x) for x in r["v"]] for r in kept.orderBy(order, "v").limit(most).select("v").collect()]

    centroids = first(1, k)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, n_exact int"), []
    pivots = _far_apart(first(2, PIVOT_SAMPLE), PIVOTS)
    stored = ws.save(kept.mapInArrow(_measured(pivots), "vec_id long, v array<double>, to_pivots array<double>"), "stored")

    for _ in range(rounds):
        table = spark.sparkContext.broadcast(Table(centroids, pivots))
        parts = stored.mapInArrow(_summed(table), "cluster int, component int, limb int, total long")
        totals: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            key = r["cluster"], r["component"]
            totals[key] = totals.get(key, 0) + (int(r["total"]) << (LIMB * r["limb"]))
        centroids = [[totals[c, j] // totals[c, -1] for j in range(size)] if (c, -1) in totals else old for c, old in enumerate(centroids)]
        table.unpersist()
    table = spark.sparkContext.broadcast(Table(centroids, pivots))
    return ws.finish(stored.mapInArrow(_assigned(table), "vec_id long, cluster int, distance long, n_exact int")), centroids


def digest(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    out, centroids = cluster(spark, vectors)
    # inertias are null if a distance is, or beyond a long
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    own = out.groupBy("cluster").agg(total.alias("own"))
    every = W.partitionBy()
    sums = own.select("cluster", "own", F.when(F.count("own").over(every) == F.count(F.lit(1)).over(every), F.sum("own").over(every)).alias("all"))
    marks = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)], "cluster int, centroid_sha256 string")
    per = F.broadcast(sums.join(marks, "cluster"))  # a row a centroid
    as_long = lambda c: F.expr(f"try_cast({c} AS long)")
    return out.join(per, "cluster").select("vec_id", "cluster", "distance", as_long("own").alias("cluster_inertia"), as_long("`all`").alias("inertia"),
                                           "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS (
  SELECT r, vec_id, v, c.cluster, list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (v[i] - c.m[i]) * (v[i] - c.m[i])))::BIGINT AS d FROM kept, c{r} c
), a{r} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, {{'d': d, 'c': cluster}}) AS cluster, min(d) AS d FROM far{r} GROUP BY r
)""")
        if r < rounds:
            steps.append(f"""sums{r} AS (
  SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, {SIZE + 1})) AS g(i) GROUP BY cluster, i
), means{r} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums{r} GROUP BY cluster
), c{r + 1} AS (
  SELECT c{r}.cluster, coalesce(means{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN means{r} USING (cluster)
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS m FROM kept ORDER BY cluster LIMIT {CENTROIDS}
), {", ".join(steps)}, own AS (
  SELECT cluster, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster
)
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM own) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN own USING (cluster) JOIN c{rounds} USING (cluster)
"""


SQL = _sql()
