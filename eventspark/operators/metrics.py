"""Tumbling-window metrics per (symbol, scenario) - the flagship aggregate.

In batch form one ``groupBy(window, symbol, scenario)`` with built-in
aggregates: every one of them has a map-side phase (the percentiles keep a
value->count map per group), so a hot key is combined before the single
exchange. ``session.prepare`` sets how many groups a task may hold in memory
before it sorts instead.

The streaming job keeps ``window_partials``, grouped by latency as well:
partials of several deliveries of one window simply add up, in any order, and
``metrics_of_partials`` reads all measures off them, the nearest-rank
percentiles from running counts over each group's distinct latencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import average_of_sums, average_price, exact_avg_half_up, nearest_rank, price_sums
from ..functions.timefn import interval_micros, time_bucket
from ..schema import METRIC_COLUMNS, PRICE

DEFAULT_WINDOW_SECONDS = 10
LATENCY = "ingestion_latency_ms"
KEY = ["bucket_start", "symbol", "scenario"]
#: What the metrics read of an event.
MEASURED = ["processing_time", "symbol", "scenario", LATENCY, "price", "quantity", "event_lag_ms"]

_WIDE = T.DecimalType(38, 0)
PARTIALS_SCHEMA = T.StructType([
    T.StructField("bucket_start", T.TimestampType()), T.StructField("symbol", T.StringType()),
    T.StructField("scenario", T.StringType()), T.StructField(LATENCY, T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("price_sum", PRICE), T.StructField("price_whole", _WIDE), T.StructField("price_units", _WIDE),
    T.StructField("min_price", PRICE), T.StructField("max_price", PRICE),
    T.StructField("quantity", T.LongType()), T.StructField("lag", T.LongType()),
])


def window_partials(valid: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS,
                    time_col: str = "processing_time") -> DataFrame:
    """Counts, sums and extremes per (window, symbol, scenario, latency).
    Window bounds are aligned to the Unix epoch."""
    bucket = time_bucket(F.col(time_col), window_seconds)
    return (valid.groupBy(bucket.alias("bucket_start"), "symbol", "scenario", LATENCY)
            .agg(F.count(F.lit(1)).alias("n"),
                 *[c.alias(name) for name, c in price_sums("price").items()],
                 F.min("price").alias("min_price"), F.max("price").alias("max_price"),
                 F.sum("quantity").cast("long").alias("quantity"), F.sum("event_lag_ms").cast("long").alias("lag")))


def merge_partials(partials: DataFrame, *also: str) -> DataFrame:
    """One row per (window, symbol, scenario, latency) of any number of partials
    (and per value of ``also``)."""
    add = lambda c: F.sum(c).cast(partials.schema[c].dataType).alias(c)
    return partials.groupBy(*also, *KEY, LATENCY).agg(
        add("n"), add("price_sum"), add("price_whole"), add("price_units"), F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"), add("quantity"), add("lag"))


def metrics_of_partials(partials: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS) -> DataFrame:
    """Metrics of any number of partials, merged or not: sums add up, and rows of
    one latency follow each other in the running counts. The percentile p of n
    latencies is the one at rank ceil(p * n), in integer arithmetic."""
    by_key = Window.partitionBy(*KEY)
    so_far = by_key.orderBy(LATENCY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = partials.withColumns({"_upto": F.sum("n").over(so_far), "_all": F.sum("n").over(by_key)})

    def rank(percent: int) -> Column:
        reached = F.col("_upto") * 100 >= F.col("_all") * percent
        return F.min(F.when(reached, F.col(LATENCY)))

    sums = ranked.groupBy(*KEY).agg(
        F.sum("n").alias("event_count"),
        *[F.sum(c).alias(c) for c in ("price_sum", "price_whole", "price_units", "lag")],
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.sum("quantity").cast("long").alias("total_quantity"),
        F.sum(F.col(LATENCY) * F.col("n")).alias("latency"),
        rank(50).alias("p50_ingestion_latency_ms"),
        rank(95).alias("p95_ingestion_latency_ms"),
        F.max(LATENCY).alias("max_ingestion_latency_ms"))
    n = F.col("event_count")
    return _with_end(sums.withColumns({
        "avg_price": average_of_sums(F.col("price_sum"), F.col("price_whole"), F.col("price_units"), n, 6),
        "avg_ingestion_latency_ms": exact_avg_half_up(F.col("latency"), n, 2),
        "avg_event_lag_ms": exact_avg_half_up(F.col("lag"), n, 2)}), window_seconds)


def percentiles_of_partials(partials: DataFrame, keys: list[str], wanted: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles (percent) of all latencies of any coarser groups
    than the windows': exact, since latency counts add up where percentiles
    don't. One row per group of ``keys``."""
    counts = partials.groupBy(*keys, LATENCY).agg(F.sum("n").alias("n"))
    by_key = Window.partitionBy(*keys)
    so_far = by_key.orderBy(LATENCY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_upto": F.sum("n").over(so_far), "_all": F.sum("n").over(by_key)})
    return ranked.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * percent, F.col(LATENCY))).alias(name) for name, percent in wanted.items()])


def _with_end(agg: DataFrame, window_seconds: int) -> DataFrame:
    end = F.timestamp_micros(F.unix_micros("bucket_start") + F.lit(interval_micros(window_seconds)))
    return agg.withColumn("bucket_end", end).select(*METRIC_COLUMNS)


def window_metrics(valid: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS,
                   time_col: str = "processing_time") -> DataFrame:
    """Metrics of ``valid`` events per tumbling window of ``time_col``, aligned
    to the Unix epoch. Duplicated deliveries are counted (the raw table
    de-duplicates, the metrics do not)."""
    n = F.count(F.lit(1))
    agg = (valid.groupBy(time_bucket(F.col(time_col), window_seconds).alias("bucket_start"), "symbol", "scenario")
           .agg(n.alias("event_count"),
                average_price("price", 6).alias("avg_price"),
                F.min("price").alias("min_price"),
                F.max("price").alias("max_price"),
                F.sum("quantity").cast("long").alias("total_quantity"),
                exact_avg_half_up(F.sum(LATENCY), n, 2).alias("avg_ingestion_latency_ms"),
                nearest_rank(LATENCY, 0.5).cast("long").alias("p50_ingestion_latency_ms"),
                nearest_rank(LATENCY, 0.95).cast("long").alias("p95_ingestion_latency_ms"),
                F.max(LATENCY).alias("max_ingestion_latency_ms"),
                exact_avg_half_up(F.sum("event_lag_ms"), n, 2).alias("avg_event_lag_ms")))
    return _with_end(agg, window_seconds)
