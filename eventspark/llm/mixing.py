"""Mixing sources to target weights, in DataFrame operations only.

The sizes of all sources are one grouped sum. Targets share ``budget`` times
the whole size by weight; a target stops at ``cap`` times its source and the
excess is shared again by weight until none is above. That is water-filling:
with sources in order of size / weight, a source is capped exactly if its
share of what the capped sources before it leave exceeds its cap, so one pass
of running sums over the table of sources (one row each) finds all targets.

Every document is emitted floor(rate) times, and once more if a number in
[0, 1) drawn from the md5 of its id is below the fraction of the rate. Equal
ids draw alike, so reruns agree.

Rows: a null text has size 0; sources include null (last, as a source of its
own); a row with a null id draws by its text. Sources without words have rate
0. Extra columns are carried through by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.llm.common import Workspace

WEIGHTS = (5, 2, 1)
BUDGET = (3, 2)
CAP = 2
SEED = "mix-1"
#: Most rows of the table of sources that is sent to every executor (each has
#: a name and five numbers); beyond it Spark shuffles both sides.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> with target (double). Integer arithmetic
    throughout; only the last division is in floating point."""
    num, den = budget
    whole = lambda c: c.cast("decimal(38,0)")
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    common = math.lcm(*weights)
    s = sizes.withColumn("weight", whole(weight)).withColumn("size", whole(F.col("source_size")))
    order = W.orderBy((F.col("size") * (F.lit(common) / F.col("weight")).cast("int")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = (s.withColumn("total", whole(F.sum("size").over(everything)))
         .withColumn("capped_before", whole(F.coalesce(F.sum("size").over(before), F.lit(0)) * cap))
         .withColumn("weight_left", whole(F.sum("weight").over(after)))
         .withColumn("capped", (F.col("total") * num - F.col("capped_before") * den) * F.col("weight")
                     > F.col("size") * cap * den * F.col("weight_left")))
    left = F.first("total").over(everything) * num - F.coalesce(F.sum(F.when(F.col("capped"), F.col("size"))).over(everything), F.lit(0)) * cap * den
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything) * den
    share = (left * F.col("weight")).cast("double") / free.cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), (F.col("size") * cap).cast("double")).otherwise(share).alias("target"))


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from the id."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(row, size, source_size, target, copies) of every row of ``docs``
    (doc_id, text, source and any others), kept as a struct."""
    ws = Workspace(spark, "mixing")
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("source"), n_words(docs["text"]).alias("size"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = ws.save(targets(per_source, **options), "targets").withColumnRenamed("source", "of")
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    joined = sized.join(t, sized["source"].eqNullSafe(t["of"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("row.doc_id"), F.col("row.text")) < rate - F.floor(rate)).cast("int")
    return joined.select("row", "size", "source_size", "target", (F.floor(rate) + extra).cast("int").alias("copies"))


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as many times as its rate says."""
    planned = plan(spark, docs, **options).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    p = plan(spark, docs.select("doc_id", "text", "source"))
    return p.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::HUGEINT AS sz FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::HUGEINT AS w, sum(sz) OVER ()::HUGEINT AS total FROM per
), run AS (
  SELECT *, coalesce(sum(2 * sz) OVER (ORDER BY sz * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c,
         sum(w) OVER (ORDER BY sz * (10 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS wl FROM weighed
), flagged AS (
  SELECT *, (3 * total - 2 * c) * w > 4 * sz * wl AS capped FROM run
), t AS (
  SELECT source, sz, CASE WHEN capped THEN (2 * sz)::DOUBLE ELSE
    ((3 * total - 2 * coalesce(sum(CASE WHEN capped THEN 2 * sz END) OVER (), 0)) * w)::DOUBLE
    / (2 * sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target FROM flagged
), rated AS (
  SELECT doc_id, size, sz, target, CASE WHEN sz > 0 THEN target / sz::DOUBLE ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, sz::BIGINT AS source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
