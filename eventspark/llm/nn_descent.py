"""Near-duplicate embeddings by NN-descent over classes of tight copies.

1. Vectors are scaled to length 1; equal ones are one node.
2. Classes. Nodes in a bucket of hyperplane signs are compared with one centre
   of the bucket; those within ``RADIUS`` of a centre join its class. The
   radius is under half the angle of the threshold, so the members of a class
   are all linked with each other without being compared. A group of n copies
   costs n comparisons.
3. NN-descent on the classes' pivots. Neighbour lists start from hyperplane
   buckets; in every round each pivot's list and a sample of the lists it
   stands on are compared with each other, and better neighbours replace worse
   ones, until few change. A list that is full of neighbours within reach is
   saturated, and doubles, up to ``GROWN`` times; pivots whose lists are
   saturated then are compared with all pivots, by exact products of two blocks
   of at most about ``BLOCK`` pivots a task.
4. Audit. For a sample of pivots all neighbours within reach are found by exact
   blocked products over all pivots; below ``RECALL`` all lists double and the
   descent goes on. If the audit of what was found in the end is below
   ``LEAST``, all pivots are compared with all by the same exact products.
5. Links. With the angle t of the threshold, pivots p and q at angle d, and
   classes of radius a and b: if d + a + b <= t all members are linked, if
   d - a - b > t none are. Between, the same test is made for each member of the
   smaller class against the larger pivot, and only members that are still
   open are compared with the members of the larger class, a block of either
   in a task.

Angles and cosines that decide are in double precision. Links are found with
the recall of the descent, and are never below the threshold.

Rows: vectors that are null, zero, of another length than most, or with null
or non-finite components link with nothing, and so do rows with a null id
(whose component is null). Rows that repeat an id are vectors of their own.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, hash_head
from eventspark.llm.components import components

THRESHOLD = 0.9
#: Degrees; must be under half of acos(THRESHOLD).
RADIUS = 12.8
#: List length at the start, and expected number of reverse neighbours used.
LIST, REVERSE = 10, 10
#: Hyperplane tables of the start, and pivots in one of their buckets.
TABLES, BUCKET = 6, 48
ROUNDS, SETTLED = 10, 0.01
AUDIT, RECALL = 512, 0.99
#: Doublings of a list before its pivot is compared with all, and the recall below which all pivots are.
GROWN, LEAST = 6, 0.9
#: Vectors on either side of one task of exact comparison.
BLOCK = 2048
_SLACK = 1e-9


def _unit(batches):
    """Vectors scaled to length 1; null where there is none. Rows of one length
    are scaled together."""
    for batch in batches:
        column = batch.column("embedding")
        out = np.full(len(column), None, dtype=object)
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
        start = column.offsets.to_numpy()[:-1].astype(np.int64)
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
        for n in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == n)
            x = values[start[rows][:, None] + np.arange(n)]
            top = np.abs(x).max(axis=1)
            good = np.isfinite(top) & (top > 0)  # the maximum of a row with a nan is nan
            x = x[good] / top[good][:, None]
            x = np.ascontiguousarray(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None])
            for r, v in zip(rows[good], x):
                out[r] = v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of equally long binaries, one a row."""
    data, offsets = K.string_buffers(column)
    return data.view(np.float64).reshape(len(offsets) - 1, -1) if len(offsets) > 1 else np.empty((0, 0))


def _planes(dim: int, bits: int, table: int) -> np.ndarray:
    return np.random.default_rng([7, table]).standard_normal((dim, bits))


def _signs(dim: int, bits: int, tables: range):
    """(id) -> (id, bucket) for every table of hyperplanes."""
    def run(batches):
        planes = [_planes(dim, bits, t) for t in tables]
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("unit"))
            for t, p in zip(tables, planes):
                bucket = ((x @ p > 0) @ weights if len(x) else np.empty(0, np.int64)) + (t << 40)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bucket.astype(np.int64))], names=["id", "bucket"])
    return run


def _groups(batches, key: str):
    """The runs of equal keys of a stream that is sorted by it, as tables."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[-1].column(key)[0].as_py() != k[a]:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _batched(rows, schema: pa.Schema, most: int = 20_000):
    """Record batches of row groups given as lists of arrays."""
    held, n = [], 0
    for arrays in rows:
        held.append(arrays)
        n += len(arrays[0])
        if n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _by(df: DataFrame, key: str, *then: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *then)


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
_EDGES = "u long, v long, sim double"


def _start_lists(batches):
    """All pairs of a start bucket, the best ``LIST`` of each pivot."""
    def rows():
        for g in _groups(batches, "bucket"):
            ids = g.column("id").to_numpy()
            if len(ids) < 2:
                continue
            x = _matrix(g.column("unit")).astype(np.float32)
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            k = min(LIST, len(ids) - 1)
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            yield [np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel().astype(np.float64)]
    yield from _batched(rows(), _EDGE)


def _local_joins(batches):
    """Compare what stands around one pivot; keep what beats a list's worst."""
    def rows():
        for g in _groups(batches, "w"):
            ids, at = np.unique(g.column("a").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            fresh = np.zeros(len(ids), bool)
            np.logical_or.at(fresh, np.searchsorted(ids, g.column("a").to_numpy()), g.column("fresh").to_numpy(zero_copy_only=False))
            x = _matrix(g.column("unit").take(pa.array(at))).astype(np.float32)
            floor = g.column("floor").to_numpy()[at]
            sim = (x @ x.T).astype(np.float64)
            better = (sim > floor[:, None] + 1e-6) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            if len(i):
                yield [ids[i], ids[j], sim[i, j]]
    yield from _batched(rows(), _EDGE)


_LIST = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64()), ("fresh", pa.bool_()), ("floor", pa.float64()), ("size", pa.int64())])
_LISTS = "u long, v long, sim double, fresh boolean, floor double, size long"


def _merge(batches):
    """The best of each list's old (size > 0) and offered neighbours."""
    def rows():
        for g in _groups(batches, "u"):
            v, sim = g.column("v").to_numpy(), g.column("sim").to_numpy()
            size = g.column("size").to_numpy()
            fresh = g.column("fresh").to_numpy(zero_copy_only=False)
            order = np.lexsort((-size, v))  # an old entry before its offers
            order = order[np.concatenate(([True], v[order][1:] != v[order][:-1]))]
            k = int(size.max()) or LIST
            order = order[np.lexsort((v[order], -sim[order]))][:k]
            n = len(order)
            floor = sim[order[-1]] if n == k else -2.0
            yield [np.full(n, g.column("u")[0].as_py()), v[order], sim[order], fresh[order], np.full(n, floor), np.full(n, k)]
    yield from _batched(rows(), _LIST)


def _descend(ws: Workspace, nodes: DataFrame, graph: DataFrame, name: str) -> DataFrame:
    """Rounds of local joins until few lists change."""
    total = max(1, graph.count())
    for step in range(ROUNDS):
        if graph.where("fresh").count() <= SETTLED * total:
            break
        stands = graph.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        reverse = graph.join(stands, "v").where(F.pmod(F.xxhash64(F.lit(step), "u", "v"), F.lit(1 << 20)) * F.col("n") < F.lit(REVERSE << 20))
        around = graph.select(F.col("u").alias("w"), F.col("v").alias("a"), "fresh").union(
            reverse.select(F.col("v").alias("w"), F.col("u").alias("a"), "fresh"))
        floors = graph.groupBy("u").agg(F.first("floor").alias("floor")).withColumnRenamed("u", "a")
        vectors = nodes.select(F.col("id").alias("a"), "unit").join(floors, "a", "left").fillna(-2.0, ["floor"])
        offers = _by(around.join(vectors, "a").select("w", "a", "fresh", "floor", "unit"), "w").mapInArrow(_local_joins, _EDGES)
        old = graph.select("u", "v", "sim", F.lit(False).alias("fresh"), "floor", "size")
        new = offers.select("u", "v", "sim", F.lit(True).alias("fresh"), F.lit(-2.0).alias("floor"), F.lit(0).cast("long").alias("size"))
        merged = ws.save(_by(old.union(new), "u").mapInArrow(_merge, _LISTS), f"{name}-{step}")
        graph = merged
    return graph


def _audit(nodes: DataFrame, graph: DataFrame, theta: float) -> float:
    """The share of pivot pairs within reach that the lists hold, for a sample
    of pivots against all, by exact blocked products."""
    asked = hash_head(nodes, AUDIT, "id").select("id", "unit", "radius").collect()
    if not asked:
        return 1.0
    q = np.stack([np.frombuffer(r["unit"], np.float64) for r in asked])
    qid, reach = np.array([r["id"] for r in asked]), np.array([r["radius"] for r in asked]) + theta

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            angle = np.arccos(np.clip(_matrix(batch.column("unit")) @ q.T, -1, 1))
            i, j = np.nonzero((angle <= reach[None, :] + batch.column("radius").to_numpy()[:, None]) & (ids[:, None] != qid[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(qid[j]), pa.array(ids[i])], names=["u", "v"])

    true = nodes.select("id", "unit", "radius").mapInArrow(run, "u long, v long")
    both = graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().withColumn("got", F.lit(1))
    n, got = true.join(both, ["u", "v"], "left").agg(F.count(F.lit(1)), F.sum("got")).first()
    return (got or 0) / n if n else 1.0


def _within_reach(theta: float):
    """Pairs within reach of one block of asked pivots (left) and one block of
    all pivots (right); a pair of two asked pivots comes once."""
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        u, v = left.column("id").to_numpy(), right.column("id").to_numpy()
        out = []
        if len(u) and len(v):
            x, y = _matrix(left.column("unit")), _matrix(right.column("unit"))
            own, reach = left.column("radius").to_numpy(), right.column("radius").to_numpy() + theta + _SLACK
            asked = right.column("asked").to_numpy()
            for i in range(0, len(u), 512):
                angle = np.arccos(np.clip(x[i: i + 512] @ y.T, -1, 1))
                ids = u[i: i + 512, None]
                a, b = np.nonzero((angle <= own[i: i + 512, None] + reach) & (ids != v) & (~asked | (ids < v)))
                out.append((u[i + a], v[b]))
        u, v = (np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else ((), ())))
        return pa.table({"u": pa.array(u), "v": pa.array(v)})
    return run


def _settle(ws: Workspace, pivots: DataFrame, asked: DataFrame, theta: float, name: str) -> DataFrame:
    """(u, v): all pivots within reach of the asked ones (id), by exact products
    of blocks of asked pivots and blocks of all pivots."""
    marked = ws.save(pivots.select("id", "unit", "radius").join(asked.select("id", F.lit(True).alias("asked")), "id", "left").fillna(False, ["asked"]), f"{name}-asked")
    n, n_asked = marked.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    rows, columns = max(1, math.ceil(n_asked / BLOCK)), max(1, math.ceil(n / BLOCK))
    dealt = lambda k: F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = marked.where("asked").select("id", "unit", "radius", dealt(rows).alias("row")).withColumn("col", every(columns))
    right = marked.withColumn("col", dealt(columns)).withColumn("row", every(rows))
    return ws.save(left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(_within_reach(theta), "u long, v long"), name)


def _angle(a: str, b: str, out: str):
    """Adds the angle between two columns of unit vectors, dropping both."""
    def run(batches):
        for batch in batches:
            cos = np.einsum("ij,ij->i", _matrix(batch.column(a)), _matrix(batch.column(b))) if batch.num_rows else np.empty(0)
            keep = [c for c in batch.schema.names if c not in (a, b)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(cos), pa.array(np.arccos(np.clip(cos, -1, 1)))],
                                             names=[*keep, "cos", out])
    return run


def _with_angle(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    keep = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in (a, b)]
    return df.mapInArrow(_angle(a, b, out), ", ".join([*keep, "cos double", f"{out} double"]))


def _classes(ws: Workspace, nodes: DataFrame, dim: int, radius: float) -> DataFrame:
    """(id, unit, size) -> with pivot: a pivot is its own, and within
    ``radius`` of all of its nodes."""
    pivots = nodes
    member = nodes.select("id", F.col("id").alias("pivot"))
    for step, bits in enumerate((14, 8)):
        keys = pivots.select("id", "unit").mapInArrow(_signs(dim, bits, range(100 * step, 100 * step + 4)), "id long, bucket long")
        centre = keys.groupBy("bucket").agg(F.min_by("id", F.xxhash64(F.lit(3), "id")).alias("centre"))
        to = keys.join(centre, "bucket").where("id != centre").select("id", "centre").distinct()
        pairs = to.join(pivots.select("id", F.col("unit").alias("x")), "id").join(
            pivots.select(F.col("id").alias("centre"), F.col("unit").alias("y")), "centre")
        rank = lambda c: F.xxhash64(F.lit(3), c)
        near = ws.save(_with_angle(pairs.select("id", "centre", "x", "y"), "x", "y", "d").where(F.col("d") <= radius)
                       .select("id", "centre", F.when(rank("centre") < rank("id"), F.lit(True)).otherwise(F.lit(False)).alias("down")), f"near-{step}")
        # a root is near no centre that ranks before it
        roots = near.select(F.col("centre").alias("id")).distinct().join(near.where("down").select("id").distinct(), "id", "left_anti")
        joined = near.where("down").join(roots.withColumnRenamed("id", "centre"), "centre").groupBy("id").agg(F.min_by("centre", rank("centre")).alias("to"))
        # nodes follow their pivot if they are near the new one too
        moved = (member.join(joined.withColumnRenamed("id", "pivot"), "pivot").join(nodes.select("id", F.col("unit").alias("x")), "id")
                 .join(nodes.select(F.col("id").alias("to"), F.col("unit").alias("y")), "to"))
        moved = _with_angle(moved.select("id", "to", "x", "y"), "x", "y", "d").where(F.col("d") <= radius).select("id", "to")
        member = ws.save(member.join(moved, "id", "left").select("id", F.coalesce("to", "pivot").alias("pivot")), f"member-{step}")
        pivots = ws.save(nodes.join(member.select(F.col("pivot").alias("id")).distinct(), "id", "left_semi"), f"pivots-{step}")
        # a pivot that moved away from nodes of its own stays their pivot
        member = member.join(pivots.select("id", F.lit(True).alias("own")), "id", "left").select(
            "id", F.when(F.col("own"), F.col("id")).otherwise(F.col("pivot")).alias("pivot"))
    return ws.save(member, "member")


def _members_apart(theta_cos: float):
    """Counts of links between one block of open members of smaller classes
    (left) and one block of a larger class (right)."""
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        q = left.column("q").to_numpy()
        out = []
        if len(a) and len(b):
            y, size = _matrix(right.column("unit")), right.column("size").to_numpy()
            own = left.column("size").to_numpy()
            x = _matrix(left.column("unit"))
            for i in range(0, len(a), 1024):
                linked = x[i: i + 1024] @ y.T >= theta_cos
                hit = linked.any(axis=1)
                out.append((a[i: i + 1024][hit], (linked @ size)[hit], q[i: i + 1024][hit]))
                out.append((b, own[i: i + 1024] @ linked, np.full(len(b), -1)))
        ids, n, q = (np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else ((), (), ())))
        keep = n > 0
        return pa.table({"p": pa.array(np.full(int(keep.sum()), right.column("p")[0].as_py() if len(b) else 0, np.int64)), "q": pa.array(q[keep].astype(np.int64)),
                         "id": pa.array(ids[keep].astype(np.int64)), "n": pa.array(n[keep].astype(np.int64))})
    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    theta, radius = math.acos(threshold), math.radians(RADIUS)
    if 2 * radius >= theta:
        radius = theta / 2.02
    ws = Workspace(spark, "nn-descent")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    units = rows.mapInArrow(_unit, "vec_id long, unit binary").withColumn("unit", F.when(F.col("vec_id").isNotNull(), F.col("unit")))
    units = ws.save(units.withColumn("id", F.xxhash64("unit")), "units")
    common = units.where(F.col("unit").isNotNull()).groupBy(F.octet_length("unit").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if common is None:
        return ws.finish(_result(units.withColumn("id", F.lit(None).cast("long")), None, None))
    dim = common["bytes"] // 8
    usable = F.col("unit").isNotNull() & (F.octet_length("unit") == common["bytes"])
    units = units.withColumn("id", F.when(usable, F.col("id")))
    nodes = ws.save(units.where(usable).groupBy("id").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("size")), "nodes")

    member = _classes(ws, nodes, dim, radius)
    full = nodes.join(member, "id")
    away = _with_angle(full.select("id", "pivot", "size", F.col("unit").alias("x")).join(
        nodes.select(F.col("id").alias("pivot"), F.col("unit").alias("y")), "pivot"), "x", "y", "d")
    per_class = away.groupBy("pivot").agg(F.max("d").alias("radius"), F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("class_nodes"))
    pivots = ws.save(nodes.drop("size").join(per_class.withColumnRenamed("pivot", "id"), "id").withColumn(
        "radius", F.when(F.col("class_nodes") == 1, F.lit(0.0)).otherwise(F.col("radius") + F.lit(_SLACK))), "pivots")
    n_pivots, widest = pivots.agg(F.count(F.lit(1)), F.max("radius")).first()

    # neighbour lists from hyperplane buckets; large buckets are dealt out at random
    bits = max(1, min(24, round(math.log2(max(2, n_pivots / BUCKET)))))
    keys = pivots.select("id", "unit").mapInArrow(_signs(dim, bits, range(1000, 1000 + TABLES)), "id long, bucket long")
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.join(sizes, "bucket").select("id", F.xxhash64("bucket", F.pmod(F.xxhash64(F.lit(5), "id"), F.ceil(F.col("n") / (4 * BUCKET)))).alias("bucket"))
    offers = _by(keys.join(pivots.select("id", "unit"), "id").select("bucket", "id", "unit"), "bucket").mapInArrow(_start_lists, _EDGES)
    empty = F.lit(0).cast("long")
    graph = ws.save(_by(offers.select("u", "v", "sim", F.lit(True).alias("fresh"), F.lit(-2.0).alias("floor"), empty.alias("size")), "u")
                    .mapInArrow(_merge, _LISTS), "start")
    for grown in range(GROWN + 1):
        graph = _descend(ws, pivots, graph, f"lists-{grown}")
        recall = _audit(pivots, graph, theta)
        reach = pivots.select(F.col("id").alias("u"), F.cos(F.least(F.col("radius") + theta + widest, F.lit(math.pi))).alias("reach"))
        state = graph.join(reach, "u").withColumn("saturated", F.col("floor") >= F.col("reach"))
        all_grow = recall < RECALL and grown < 4
        if grown == GROWN or not all_grow and state.where("saturated").isEmpty():
            break
        grow = F.lit(all_grow) | F.col("saturated")
        graph = ws.save(state.select("u", "v", "sim", grow.alias("fresh"), F.when(grow, F.lit(-2.0)).otherwise(F.col("floor")).alias("floor"),
                                     F.when(grow, F.col("size") * 2).otherwise(F.col("size")).alias("size")), f"grown-{grown}")

    # what the lists cannot hold, or did not find
    found, saturated = graph.select("u", "v"), state.where("saturated").select(F.col("u").alias("id")).distinct()
    if not saturated.isEmpty():
        found = found.union(_settle(ws, pivots, saturated, theta, "settled"))
        recall = _audit(pivots, found, theta)
    if recall < LEAST:
        found = _settle(ws, pivots, pivots, theta, "settled-all")
        recall = _audit(pivots, found, theta)

    # pivot pairs within reach, the larger class first
    found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    cols = ("radius", "class_size", "class_nodes")
    ends = [pivots.select(F.col("id").alias(e), F.col("unit").alias(f"unit_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in cols]) for e in ("u", "v")]
    pairs = _with_angle(found.join(ends[0], "u").join(ends[1], "v"), "unit_u", "unit_v", "d")
    single = (F.col("class_nodes_u") == 1) & (F.col("class_nodes_v") == 1)
    pairs = pairs.where(F.when(single, F.col("cos") >= threshold).otherwise(F.col("d") <= theta + F.col("radius_u") + F.col("radius_v") + _SLACK))
    swap = (F.col("class_nodes_v") > F.col("class_nodes_u")) | ((F.col("class_nodes_v") == F.col("class_nodes_u")) & (F.col("v") < F.col("u")))
    pick = lambda c, first: F.when(swap == first, F.col(f"{c}_v" if c else "v")).otherwise(F.col(f"{c}_u" if c else "u"))
    pairs = ws.save(pairs.select(pick("", True).alias("p"), pick("", False).alias("q"), *[pick(c, f).alias(f"{c}_{s}") for c in cols for s, f in (("p", True), ("q", False))],
                                 (single | (F.col("d") + F.col("radius_u") + F.col("radius_v") <= theta - _SLACK)).alias("sure")), "pairs")
    sure, unsure = pairs.where("sure"), pairs.where("not sure")
    for_class = sure.select(F.col("p").alias("pivot"), F.col("class_size_q").alias("n")).union(sure.select(F.col("q").alias("pivot"), F.col("class_size_p").alias("n")))

    # open pairs: each node of the smaller class against the larger pivot
    q_nodes = nodes.join(member, "id").select("id", F.col("pivot").alias("q"), F.col("unit").alias("x"), "size")
    tested = unsure.select("p", "q", "radius_p", "class_size_p").join(q_nodes, "q").join(pivots.select(F.col("id").alias("p"), F.col("unit").alias("y")), "p")
    tested = ws.save(_with_angle(tested, "x", "y", "d"), "tested")
    all_of_p = F.col("d") + F.col("radius_p") <= theta - _SLACK
    linked = tested.where(all_of_p)
    for_class = for_class.union(linked.select(F.col("p").alias("pivot"), F.col("size").alias("n")))
    for_node = linked.select("id", F.col("class_size_p").alias("n"))
    open_nodes = tested.where(~all_of_p & (F.col("d") - F.col("radius_p") <= theta + _SLACK)).select("p", "q", "id", "size")
    # both sides of a class in blocks: its members, and the open nodes around it
    parts = open_nodes.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    blocks = ws.save(pivots.select(F.col("id").alias("p"), F.ceil(F.col("class_nodes") / BLOCK).alias("blocks")).join(parts, "p"), "block-counts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (open_nodes.join(nodes.select("id", "unit"), "id").join(blocks, "p").withColumn("block", every("blocks"))
            .select("p", "block", F.pmod(F.xxhash64(F.lit(10), "id"), F.col("parts")).alias("part"), "q", "id", "size", "unit"))
    right = (nodes.join(member, "id").withColumnRenamed("pivot", "p").join(blocks, "p").withColumn("part", every("parts"))
             .select("p", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")).alias("block"), "part", "id", "size", "unit"))
    left, right = ws.save(left, "open"), ws.save(right, "blocks")
    cell = ("p", "block", "part")
    exact = ws.save(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_members_apart(threshold), "p long, q long, id long, n long"), "exact")
    for_node = for_node.union(exact.select("id", "n"))

    links = sure.select(F.col("p").alias("a"), F.col("q").alias("b")).union(linked.select("p", "q")).union(exact.where("q != -1").select("p", "q"))
    comp = components(links, ws)
    per_class = pivots.select(F.col("id").alias("pivot"), "class_size").join(for_class.groupBy("pivot").agg(F.sum("n").alias("n_class")), "pivot", "left").join(
        comp.select(F.col("node").alias("pivot"), "component"), "pivot", "left")
    per_node = member.join(per_class, "pivot").join(for_node.groupBy("id").agg(F.sum("n").alias("n_node")), "id", "left").select(
        "id", (F.col("class_size") - 1 + F.coalesce("n_class", F.lit(0)) + F.coalesce("n_node", F.lit(0))).alias("n_links"), F.coalesce("component", "pivot").alias("component"))
    per_row = units.select("vec_id", "id").join(per_node, "id", "left")
    low = per_row.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("vec_id").alias("low"))
    return ws.finish(_result(per_row, low, recall))


def _result(rows: DataFrame, low: DataFrame | None, recall: float | None) -> DataFrame:
    if low is None:
        rows = rows.withColumns({"n_links": F.lit(0), "low": F.lit(None).cast("long")})
    else:
        rows = rows.join(low, "component", "left")
    component = F.coalesce("low", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
