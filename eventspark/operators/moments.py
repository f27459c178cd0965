"""The 1-minute roll-up kept up to date by what each delivery adds.

For every minute, symbol and scenario the additive parts of the roll-up's
measures are kept: counts, exact sums, sums of squares, extremes. A delivery's
new rows become such moments, and the hours they touch are made anew from all
moments of these hours: no raw row is read again, however old the minute is.
All sums are integers or decimals, so averages have the same bits as when they
are computed from the rows; the standard deviation comes from the exact second
moment.

A delivery counts once. Its moments are written before its rows come into the
table, marked as whole by an empty file. If the delivery is repeated after a
failure, the marked moments stay as they are: they hold the rows that came as
well as those that are inserted only now. State is compacted by hour
(``partials``). Rows that are taken out of the raw table are not subtracted;
after that the roll-up is refreshed from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import average_of_sums, price_sums
from ..functions.timefn import time_bucket
from ..schema import PRICE, ROLLUP_1MIN_FIELDS
from .files import Folder
from .partials import MERGE_AFTER, PartialStore
from .rollups import refresh_hours_with, rollup_table
from .spans import SpanLog, Spans
from .store import HOUR_MICROS
from .tables import insert_ignore_duplicates

KEY = ["bucket", "symbol", "scenario"]
DONE = "_done"
LATENCY = "ingestion_latency_ms"
_WIDE = T.DecimalType(38, 0)
SCHEMA = T.StructType([
    T.StructField("bucket", T.TimestampType()), T.StructField("symbol", T.StringType()), T.StructField("scenario", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("price_sum", PRICE), T.StructField("price_whole", _WIDE), T.StructField("price_units", _WIDE),
    T.StructField("min_price", PRICE), T.StructField("max_price", PRICE), T.StructField("quantity", T.LongType()),
    T.StructField("latency", _WIDE), T.StructField("latency_squares", _WIDE), T.StructField("max_latency", T.LongType()),
])


def moments(raw: DataFrame) -> DataFrame:
    """The moments of raw rows per (minute, symbol, scenario)."""
    wide = F.col(LATENCY).cast("decimal(19,0)")
    return (raw.groupBy(time_bucket(F.col("event_time"), "1 minute").alias("bucket"), "symbol", "scenario")
            .agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in price_sums("price").items()],
                 F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum("quantity").cast("long").alias("quantity"),
                 F.sum(wide).cast(_WIDE).alias("latency"), F.sum(wide * wide).cast(_WIDE).alias("latency_squares"), F.max(LATENCY).alias("max_latency")))


def merge(parts: DataFrame, *also: str) -> DataFrame:
    """One row per group (and per value of ``also``) of any number of moments."""
    add = lambda c: F.sum(c).cast(SCHEMA[c].dataType).alias(c)
    return parts.groupBy(*also, *KEY).agg(
        add("n"), add("price_sum"), add("price_whole"), add("price_units"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
        add("quantity"), add("latency"), add("latency_squares"), F.max("max_latency").alias("max_latency"))


def rollup_of(merged: DataFrame) -> DataFrame:
    """Rows of the 1-minute roll-up from merged moments."""
    n, total = F.col("n").cast(_WIDE), F.col("latency")
    spread = (n * F.col("latency_squares")).cast(_WIDE) - (total * total).cast(_WIDE)   # n * (n - 1) times the variance, exactly
    return merged.select(
        *KEY, F.col("n").alias("event_count"), average_of_sums(F.col("price_sum"), F.col("price_whole"), F.col("price_units"), F.col("n"), 18).alias("avg_price"),
        "min_price", "max_price", F.col("quantity").alias("total_quantity"), (total.cast("double") / F.col("n")).alias("avg_latency_ms"),
        F.col("max_latency").alias("max_latency_ms"),
        F.when(F.col("n") > 1, F.sqrt(spread.cast("double") / (F.col("n") * (F.col("n") - 1)))).alias("stddev_latency_ms"),
        F.to_date("bucket").alias("bucket_date"))


class MinuteMoments:
    """The moments below a path, delivery by delivery."""

    def __init__(self, spark: SparkSession, path: str, merge_after: int = MERGE_AFTER):
        self.spark, self.folder = spark, Folder(spark, path)
        self.store = PartialStore(spark, path, merge_after, SCHEMA, merge, "bucket")

    def add_once(self, new: DataFrame, hours: list[int], delivery: int) -> None:
        """Keep the moments of a delivery's new rows, unless they are there."""
        if not self.folder.exists(f"{DONE}/{delivery}"):
            self.store.add(moments(new), hours, delivery)
            Folder(self.spark, f"{self.folder.path}/{DONE}").create(str(delivery))
            self.store.compact(hours, delivery)

    def rollup(self, hours: list[int]) -> DataFrame:
        return rollup_of(merge(self.store.read(hours)))


def insert_and_add(spark: SparkSession, rows: DataFrame, raw_path: str, moments_path: str, minute_path: str, delivery: int,
                   order: list[str] | None = None, rejected_path: str | None = None, merge_after: int = MERGE_AFTER) -> list[int]:
    """Insert a delivery into the raw table (``insert_ignore_duplicates``) and
    bring the minutes of its new rows up to date. ``delivery`` numbers the
    deliveries, as micro-batches are numbered. Returns the hours made anew."""
    state, touched = MinuteMoments(spark, moments_path, merge_after), []

    def keep(new: DataFrame, spans: Spans) -> None:
        touched.extend(sorted({h for lo, hi in spans for h in range(lo // HOUR_MICROS, -(-hi // HOUR_MICROS))}))
        state.add_once(new, touched, delivery)

    insert_ignore_duplicates(spark, rows, raw_path, order, rejected_path, before=keep)
    if touched:
        refresh_hours_with(rollup_table(spark, minute_path, "events_1min"), state.rollup(touched), touched)
        SpanLog(spark, minute_path).add([(h * HOUR_MICROS, (h + 1) * HOUR_MICROS) for h in touched])
    return touched
