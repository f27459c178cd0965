"""Exact interpolated percentiles that stay parallel under a hot group.

The built-in ``percentile_cont`` combines map-side into one value->count map
per group and task, and then merges all of a group's maps in one reducer: for
a group holding a third of the data that reducer receives
(map tasks x distinct values) entries. Here the same exact result is composed
from plain DataFrame steps over a histogram, ``count`` per (group, value),
which is combined map-side and spread over reducers by value. The percentile
of n values is interpolated between those at ranks ``floor((n-1)p)`` and
``ceil((n-1)p)`` as ``(hi - pos) * x_lo + (pos - lo) * x_hi``.

``with_percentiles`` is for many groups whose values are few (time buckets):
running counts over each group's distinct values, in one window.
``spread_percentiles`` is for few groups of any size: counts of value ranges
first, and then running counts only inside the ranges that hold a wanted rank.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plan import fence

#: Width of a value range; a range has at most so many distinct whole values.
RANGE = 1024


def spread_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float],
                       *aggs: Column) -> DataFrame:
    """``df.groupBy(keys).agg(*aggs)`` plus ``{name: percentile_cont(p)}`` of
    ``value`` (DOUBLE; NULL values ignored), for every ``name, p`` in ``wanted``.

    One scan: every row is grouped with its value and without, in one
    aggregation, which gives the histogram, spread by value, and the measures.
    Range totals, the ranges that hold a wanted rank, and the values inside them
    are read off the same shuffled rows (Spark reuses the exchange, as all three
    see all columns; an exploded pair stands for GROUPING SETS, whose plan Spark
    does not recognise as the same twice)."""
    twice = df.withColumn("_whole", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_v", F.when(~F.col("_whole"), F.col(value)))
    both = twice.groupBy(*keys, "_v", "_whole").agg(*aggs, F.count(F.lit(1)).alias("_c"))
    names = [c for c in both.columns if c not in (*keys, "_v", "_whole", "_c")]
    # whole rows behind a fence: neither a filter nor a column list gets below it, so the exchanges stay alike
    row = both.select(fence(F.struct("*")).alias("_r"))
    of = lambda *columns: [F.col(f"_r.{c}").alias(c) for c in columns]
    measures = row.where(F.col("_r._whole")).select(*of(*keys, *names))
    hist = (row.where(~F.col("_r._whole") & F.col("_r._v").isNotNull()).select(*of(*keys, "_c"), F.col("_r._v").alias(value))
            .withColumn("_range", F.floor(F.col(value) / RANGE)))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (hist.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in"))
              .withColumns({"_base": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_n": F.sum("_in").over(by_key)}))
    ranks = [f((F.col("_n") - 1).cast("double") * F.lit(float(p))) for p in wanted.values() for f in (F.floor, F.ceil)]
    holds = functools.reduce(operator.or_, [(F.col("_base") <= r) & (r < F.col("_base") + F.col("_in")) for r in ranks])
    few = ranges.where(holds).select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_range")], "_base", "_n")
    on = functools.reduce(operator.and_, [hist[k].eqNullSafe(few[f"_k_{k}"]) for k in (*keys, "_range")])
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hist.join(few, on).select(*keys, value, "_range", "_c", "_base", "_n").withColumn("_cum", F.col("_base") + F.sum("_c").over(inside))
    rows = rows.withColumn("_lo", F.col("_cum") - F.col("_c"))
    pcts, finals = _percentile_aggs(value, wanted)
    found = rows.groupBy(*keys).agg(*pcts).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *finals)
    on = functools.reduce(operator.and_, [measures[k].eqNullSafe(found[f"_k_{k}"]) for k in keys])
    return measures.join(found, on, "left").drop(*[f"_k_{k}" for k in keys])


def with_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float],
                     *aggs: Column) -> DataFrame:
    """``df.groupBy(keys).agg(*aggs)`` plus exact percentiles of ``value``.

    One scan, no join: ``GROUPING SETS ((keys), (keys, value))`` yields, in one
    aggregation, each group's measures (grouping id 1) and its histogram rows
    (grouping id 0). One window per group (its measures row plus one row per
    distinct value) adds the running counts, and a final per-group aggregate
    picks the measures and reads the percentiles off the ranks. Two exchanges:
    the grouping-sets aggregate and the window (the last step reuses its
    partitioning).
    """
    both = (df.groupingSets([list(keys), [*keys, value]], *keys, value)
            .agg(*aggs, F.count(F.lit(1)).alias("_c"), F.grouping_id().alias("_gid")))
    names = [c for c in both.columns if c not in (*keys, value, "_c", "_gid")]
    in_hist = (F.col("_gid") == 0) & F.col(value).isNotNull()
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding,
                                                                         Window.currentRow)
    h = both.withColumn("_ch", F.when(in_hist, F.col("_c")).otherwise(F.lit(0).cast("long")))
    h = h.withColumns({"_cum": F.sum("_ch").over(running), "_n": F.sum("_ch").over(by_key)})
    h = h.withColumn("_lo", F.col("_cum") - F.col("_ch"))
    picks = [F.max_by(F.col(n), F.col("_gid")).alias(n) for n in names]
    pcts, finals = _percentile_aggs(value, wanted, F.col("_ch") > 0)
    return h.groupBy(*keys).agg(*picks, *pcts).select(*keys, *names, *finals)


def _percentile_aggs(value: str, wanted: dict[str, float], row_ok: Column | None = None):
    aggs, finals = [], []
    for name, p in wanted.items():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(rank):
            cond = (F.col("_lo") <= rank) & (rank < F.col("_cum"))
            if row_ok is not None:
                cond = cond & row_ok
            return F.max(F.when(cond, F.col(value)))

        aggs += [at(lo).alias(f"_xl_{name}"), at(hi).alias(f"_xh_{name}"), F.max(pos).alias(f"_pos_{name}")]
        xl, xh, ps = (F.col(f"_xl_{name}").cast("double"), F.col(f"_xh_{name}").cast("double"),
                      F.col(f"_pos_{name}"))
        finals.append(F.when(xl == xh, xl)
                      .otherwise((F.ceil(ps) - ps) * xl + (ps - F.floor(ps)) * xh).alias(name))
    return aggs, finals
