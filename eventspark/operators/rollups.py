"""Materialised roll-ups: 1 minute over raw events, 15 minutes over the
1-minute roll-up, with range refresh.

The 15-minute roll-up averages the minute averages *unweighted* (mean of
means) and has no standard deviation - it is built from the 1-minute table,
not from raw events, so it is cheap at any scale (~1/60 of the raw rows per
symbol and scenario are read at most).

A roll-up is an ``HourTable``. A refresh recomputes the buckets lying wholly
inside its spans, reads only what these spans need, gives the hours it touches
new contents and switches the table in one step; buckets whose source rows are
gone disappear. Times are epoch microseconds (``timefn.to_micros``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import average_price
from ..functions.timefn import interval_micros, time_bucket, to_micros
from ..schema import RAW_TABLE_SCHEMA, ROLLUP_15MIN_FIELDS, ROLLUP_1MIN_FIELDS, rollup_schema
from .spans import SpanLog, Spans, at_most, common, merged, widened, without
from .store import HOUR_MICROS, HourTable
from .tables import read_days

# Fixed values of the two roll-ups: bucket widths and refresh policies
# (start offset, end offset, schedule interval).
ROLLUP_1MIN = {"name": "events_1min", "width": "1 minute",
               "policy": ("2 hours", "1 minute", "30 seconds")}
ROLLUP_15MIN = {"name": "events_15min", "width": "15 minutes",
                "policy": ("26 hours", "15 minutes", "2 minutes")}
# Manual refresh ranges used after a run: 25 h for 1 min, then 26 h for 15 min.
MANUAL_REFRESH = [("events_1min", "25 hours"), ("events_15min", "26 hours")]

#: Spans in one refresh's predicates; beyond that, the smallest gaps are recomputed as well.
MOST_SPANS = 64

_COLS_1MIN = [n for n, _ in ROLLUP_1MIN_FIELDS]
_COLS_15MIN = [n for n, _ in ROLLUP_15MIN_FIELDS]


def rollup_1min(raw: DataFrame) -> DataFrame:
    """count, avg/min/max price, sum quantity, avg/max/stddev latency per
    (minute, symbol, scenario) of ``event_time``."""
    return (raw.groupBy(time_bucket(F.col("event_time"), "1 minute").alias("bucket"), "symbol", "scenario")
            .agg(F.count(F.lit(1)).alias("event_count"),
                 average_price("price", 18).alias("avg_price"),
                 F.min("price").alias("min_price"),
                 F.max("price").alias("max_price"),
                 F.sum("quantity").cast("long").alias("total_quantity"),
                 F.avg("ingestion_latency_ms").alias("avg_latency_ms"),
                 F.max("ingestion_latency_ms").alias("max_latency_ms"),
                 F.stddev_samp("ingestion_latency_ms").alias("stddev_latency_ms"))
            .withColumn("bucket_date", F.to_date("bucket"))
            .select(*_COLS_1MIN, "bucket_date"))


def rollup_15min(minute: DataFrame) -> DataFrame:
    """Roll the 1-minute table up to 15 minutes: sums, min/max of extremes and
    unweighted means of the minute means."""
    return (minute.groupBy(time_bucket(F.col("bucket"), "15 minutes").alias("bucket"), "symbol", "scenario")
            .agg(F.sum("event_count").cast("long").alias("event_count"),
                 average_price("avg_price", 18).alias("avg_price"),
                 F.min("min_price").alias("min_price"),
                 F.max("max_price").alias("max_price"),
                 F.sum("total_quantity").cast("long").alias("total_quantity"),
                 F.avg("avg_latency_ms").alias("avg_latency_ms"),
                 F.max("max_latency_ms").alias("max_latency_ms"))
            .withColumn("bucket_date", F.to_date("bucket"))
            .select(*_COLS_15MIN, "bucket_date"))


def _fields(which: str):
    return ROLLUP_1MIN_FIELDS if which == "events_1min" else ROLLUP_15MIN_FIELDS


def rollup_table(spark: SparkSession, path: str, which: str = "events_1min") -> HourTable:
    return HourTable(spark, path, rollup_schema(_fields(which)), "bucket")


def create_empty(spark: SparkSession, path: str, which: str = "events_1min") -> None:
    """Create a roll-up table with no rows."""
    rollup_table(spark, path, which).create()


def read_rollup(spark: SparkSession, path: str, which: str = "events_1min", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """A roll-up table (no rows before its first refresh), or its time range."""
    return rollup_table(spark, path, which).read(lo, hi)


def aligned_range(start, end, width: str) -> tuple[int, int]:
    """The buckets lying wholly inside ``[start, end)``: start rounded up, end
    rounded down to the bucket width (epoch-aligned), in epoch microseconds."""
    w = interval_micros(width)
    lo = -(-to_micros(start) // w) * w
    return lo, max(to_micros(end) // w * w, lo)


def _in_spans(time_col: str, spans: Spans) -> Column:
    at, cond = F.unix_micros(time_col), F.lit(False)
    for lo, hi in spans:
        cond = cond | ((at >= F.lit(lo)) & (at < F.lit(hi)))
    return cond


def _source_rows(source: DataFrame, time_col: str, spans: Spans) -> DataFrame:
    """The source's rows in the spans; day predicates prune its partitions."""
    instant = lambda m: F.timestamp_micros(F.lit(m).cast("long"))
    day = next((c for c in ("event_date", "bucket_date") if c in source.columns), None)
    cond = F.lit(False)
    for lo, hi in spans:
        one = (F.col(time_col) >= instant(lo)) & (F.col(time_col) < instant(hi))
        if day:
            one = one & (F.col(day) >= F.to_date(instant(lo))) & (F.col(day) <= F.to_date(instant(hi)))
        cond = cond | one
    return source.where(cond)


def refresh_spans(spark: SparkSession, source: DataFrame, rollup_path: str, which: str, spans: Spans) -> None:
    """Recompute the buckets of ``which`` inside all (bucket-aligned) spans, in
    one pass over the source and one switch of the table."""
    spans = at_most(spans, MOST_SPANS)
    if not spans:
        return
    time_col, build = ("event_time", rollup_1min) if which == "events_1min" else ("bucket", rollup_15min)
    table = rollup_table(spark, rollup_path, which)
    fresh = build(_source_rows(source, time_col, spans))
    # the hours the table has in the spans, and those that new rows come to
    has = [h for h in table.hours() if any(h * HOUR_MICROS < hi and lo < (h + 1) * HOUR_MICROS for lo, hi in spans)]
    table.replace(lambda old: old.where(~_in_spans("bucket", spans)).unionByName(fresh.select(*old.columns)), has)


def refresh_hours_with(table: HourTable, rows: DataFrame, hours: list[int]) -> None:
    """Give whole hours of a roll-up these rows."""
    table.replace(lambda old: rows.select(*old.columns), hours)


def refresh(spark: SparkSession, source: DataFrame, rollup_path: str, which: str, start, end) -> tuple[int, int]:
    """Recompute the buckets of ``which`` wholly inside ``[start, end)`` from
    ``source`` (raw table for 1 min, 1-minute table for 15 min): rows of those
    buckets are replaced, buckets with no source rows any more disappear, rows
    outside the range are kept. Returns the range (epoch microseconds)."""
    cfg = ROLLUP_1MIN if which == "events_1min" else ROLLUP_15MIN
    lo, hi = aligned_range(start, end, cfg["width"])
    refresh_spans(spark, source, rollup_path, which, [(lo, hi)])
    return lo, hi


def refresh_policy_window(as_of, which: str) -> tuple[int, int]:
    """``[as_of - start_offset, as_of - end_offset)`` of a roll-up's policy."""
    cfg = ROLLUP_1MIN if which == "events_1min" else ROLLUP_15MIN
    so, eo, _ = cfg["policy"]
    return to_micros(as_of) - interval_micros(so), to_micros(as_of) - interval_micros(eo)


def raw_days(spark: SparkSession, raw_path: str, days: list[str]) -> DataFrame:
    """Some days of the raw table, without listing the others."""
    rows = read_days(spark, raw_path, "event_date", days, RAW_TABLE_SCHEMA)
    return spark.createDataFrame([], RAW_TABLE_SCHEMA) if rows is None else rows


def days_of(spark: SparkSession, spans: Spans) -> list[str]:
    """The days that spans touch, as text."""
    day = 24 * HOUR_MICROS
    numbers = [(d,) for d in sorted({d for lo, hi in spans for d in range(lo // day, -(-hi // day))})]
    return [r[0] for r in spark.createDataFrame(numbers, "d int").select(F.date_from_unix_date("d").cast("string")).collect()]


def refresh_by_policy(spark: SparkSession, raw_path: str, minute_path: str, quarter_path: str, as_of) -> None:
    """Both refresh policies at ``as_of``, in dependency order: the range
    behind the open bucket, of the last 2 hours (1 min) and 26 hours (15 min)."""
    lo, hi = refresh_policy_window(as_of, "events_1min")
    refresh(spark, raw_days(spark, raw_path, days_of(spark, [(lo, hi)])), minute_path, "events_1min", lo, hi)
    lo, hi = refresh_policy_window(as_of, "events_15min")
    refresh(spark, read_rollup(spark, minute_path, "events_1min", lo, hi), quarter_path, "events_15min", lo, hi)


def refresh_from_log(spark: SparkSession, raw_path: str, minute_path: str, quarter_path: str, as_of=None) -> dict[str, Spans]:
    """Refresh both roll-ups where rows have changed since the last time, in
    dependency order, and return the spans refreshed.

    The raw table's writes log the spans they touch. The 1-minute refresh takes
    them, and logs what it recomputed for the 15-minute refresh, which takes it
    in turn. With ``as_of`` the two policies apply: only what lies in their
    ranges at that time is refreshed; newer spans (the open bucket) stay in the
    log for a later run, and older ones are given up, as the policies say. An
    entry is removed only after its spans have been refreshed, so a run that
    dies is simply repeated."""
    done = {}
    for which, source_path, target in (("events_1min", raw_path, minute_path), ("events_15min", minute_path, quarter_path)):
        width = interval_micros((ROLLUP_1MIN if which == "events_1min" else ROLLUP_15MIN)["width"])
        log = SpanLog(spark, source_path)
        names, changed = log.take()
        changed, later = widened(changed, width), []
        if as_of is not None:
            lo, hi = refresh_policy_window(as_of, which)
            lo, hi = aligned_range(lo, hi, ROLLUP_1MIN["width"] if which == "events_1min" else ROLLUP_15MIN["width"])
            later = without(changed, [(min([lo, *[s[0] for s in changed]]), hi)])
            changed = common(changed, [(lo, hi)])
        if changed:
            if which == "events_1min":
                source = raw_days(spark, raw_path, days_of(spark, changed))
            else:
                source = rollup_table(spark, minute_path, "events_1min").read(hours={h for lo, hi in changed for h in range(lo // HOUR_MICROS, -(-hi // HOUR_MICROS))})
            refresh_spans(spark, source, target, which, changed)
            if which == "events_1min":
                SpanLog(spark, minute_path).add(changed)
        log.settle(names, later)
        done[which] = changed
    return done


def refresh_all(spark: SparkSession, raw: DataFrame, minute_path: str, quarter_path: str, as_of, ranges=None) -> None:
    """Manual refresh in dependency order: 1 minute first, then 15 minutes
    (the second reads what the first wrote)."""
    ranges, now = dict(ranges or MANUAL_REFRESH), to_micros(as_of)
    refresh(spark, raw, minute_path, "events_1min", now - interval_micros(ranges["events_1min"]), now)
    lo = now - interval_micros(ranges["events_15min"])
    refresh(spark, read_rollup(spark, minute_path, "events_1min", lo, now), quarter_path, "events_15min", lo, now)
