"""Raw event table and metrics table: layout, constraints, keyed writes.

The raw table is plain Parquet partitioned by ``event_date``, rows sorted by
time inside each file so that Parquet min/max statistics skip row groups for
time-range predicates. Beside the days it keeps Bloom filters of its files' keys
(``keyindex``), the greatest stamps of each day (``recent``) and a log of the
spans that changed (``spans``), in folders that Parquet readers skip. A write
puts its files into a folder of its own, notes them, and moves them to their
days only then: a write that dies half-way leaves no rows of unfinished files.
The metrics table is an ``HourTable``.

* ``insert_ignore_duplicates`` - insert, first copy of a key wins; keys
  already in the table are left alone (ON CONFLICT DO NOTHING).
* ``upsert_metrics`` - replace every non-key column of existing keys and add
  new keys (ON CONFLICT DO UPDATE), by giving the touched hours new contents.

Days and hours that a batch touches reach the driver as text and integers,
never as timestamps, so neither the machine's zone nor a calendar matters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, matches_symbol
from ..schema import (METRIC_COLUMNS, METRICS_KEY, METRICS_TABLE_COLUMNS, METRICS_TABLE_SCHEMA, RAW_KEY,
                      RAW_TABLE_COLUMNS, RAW_TABLE_SCHEMA)
from . import keyindex, recent
from .files import Folder
from .spans import SpanLog, Spans, merged
from .store import HOUR_MICROS, HourTable, hour_of

QUARTER_MICROS = 900_000_000


class ConstraintError(ValueError):
    """Rows break a table rule and no place was named for them."""


# ---------------------------------------------------------------- layout

def raw_table_rows(valid: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Valid processed events in raw-table shape: canonical UUID as key text,
    ``created_at`` (insert time, default now) and the ``event_date`` partition."""
    ca = created_at if created_at is not None else F.current_timestamp()
    cols = {"event_id": F.col("event_uuid"), "created_at": ca,
            "event_date": F.to_date(F.col("event_time"))}
    extra = [c for c in valid.columns if c not in RAW_TABLE_COLUMNS and c != "event_uuid"]
    return valid.withColumns(cols).select(*RAW_TABLE_COLUMNS, *extra)


def metrics_table_rows(metrics: DataFrame, created_at: Column | None = None) -> DataFrame:
    ca = created_at if created_at is not None else F.current_timestamp()
    return metrics.withColumns({"created_at": ca, "bucket_date": F.to_date("bucket_start")}) \
        .select(*METRICS_TABLE_COLUMNS)


# ----------------------------------------------------------- constraints

def raw_constraint_violation(df: DataFrame) -> Column:
    """First violated table rule of a raw-table row, or NULL (NOT NULL / CHECK)."""
    req = ["event_id", "producer_id", "symbol", "price", "quantity", "event_time", "producer_time",
           "processing_time", "source", "scenario", "sequence", "ingestion_latency_ms", "event_lag_ms"]
    c = F.when(F.lit(False), F.lit(None))
    for name in req:
        c = c.when(F.col(name).isNull(), F.lit(f"{name} is null"))
    return (c.when(is_blank(F.col("producer_id")), "producer_id is blank")
            .when(~matches_symbol(F.col("symbol")), "symbol check")
            .when(F.col("price") <= 0, "price check")
            .when(F.col("quantity") <= 0, "quantity check")
            .when(is_blank(F.col("source")), "source is blank")
            .when(is_blank(F.col("scenario")), "scenario is blank")
            .when(F.col("sequence") < 0, "sequence check"))


def metrics_constraint_violation(df: DataFrame) -> Column:
    c = F.when(F.lit(False), F.lit(None))
    for name in METRIC_COLUMNS:
        c = c.when(F.col(name).isNull(), F.lit(f"{name} is null"))
    return (c.when(~matches_symbol(F.col("symbol")), "symbol check")
            .when(is_blank(F.col("scenario")), "scenario is blank")
            .when(F.col("event_count") < 0, "event_count check")
            .when(F.col("total_quantity") < 0, "total_quantity check"))


def enforce(df: DataFrame, violation: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into (passing, rejected with ``constraint_error``)."""
    tagged = df.withColumn("constraint_error", violation)
    return (tagged.filter(F.col("constraint_error").isNull()).drop("constraint_error"),
            tagged.filter(F.col("constraint_error").isNotNull()))


@contextmanager
def rows_in_order(df: DataFrame, violation: Column, rejected_path: str | None):
    """The rows that keep the table's rules, for use inside a ``with`` block.
    The others are appended to ``rejected_path`` with their reason; without a
    path they are an error. ``df`` is computed once: its rows are kept, with
    their verdict, until the block ends (a lost part is computed again)."""
    tagged = df.withColumn("constraint_error", violation).persist()
    try:
        bad = tagged.filter(F.col("constraint_error").isNotNull())
        first = bad.agg(F.min("constraint_error")).first()[0]
        if first is not None:
            if not rejected_path:
                raise ConstraintError(first)
            bad.write.mode("append").parquet(rejected_path)
        yield tagged.filter(F.col("constraint_error").isNull()).drop("constraint_error")
    finally:
        tagged.unpersist()


# ----------------------------------------------------------- de-duplication

def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple.

    One exchange by key and one sort; ``row_number() = 1`` lets Spark keep only
    the first row of a key in each map task, so a key with a huge number of
    copies reaches the exchange as one row per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dedupe_raw(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Raw-table rows without duplicate ``(event_id, event_time)``; first wins."""
    order = order or ["processing_time"]
    return first_per_key(rows, RAW_KEY, order)


# ---------------------------------------------------------------- helpers

def distinct_days(df: DataFrame, day_col: str) -> list[str]:
    """The days of ``df`` as text. Bounded by the days a delivery touches."""
    return sorted(r[0] for r in df.select(F.col(day_col).cast("string")).distinct().collect() if r[0] is not None)


def distinct_hours(df: DataFrame, time_col: str) -> list[int]:
    """The hours (since 1970) of ``df``. Bounded by the hours a delivery touches."""
    return sorted(r[0] for r in df.select(hour_of(time_col)).distinct().collect() if r[0] is not None)


def read_days(spark: SparkSession, path: str, part_col: str, days: list[str], schema) -> DataFrame | None:
    """Only the given day partitions of a day-partitioned Parquet table, or
    None when none of them exists. The existing folders are named one by one
    with ``basePath`` - the whole table is never listed - and the declared
    schema avoids reading footers to infer one."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f for f in (f"{path.rstrip('/')}/{part_col}={d}" for d in sorted(set(days))) if fs.exists(jvm_path(f))]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else None


def time_range(df: DataFrame, time_col: str, lo: int | Column, hi: int | Column | None = None,
               date_col: str | None = None) -> DataFrame:
    """``lo <= time_col < hi`` (epoch microseconds, or Columns) plus the matching
    predicate on the day partition column, so that the scan prunes partitions
    (a predicate on the time column alone does not reach the partition column)."""
    as_column = lambda t: t if isinstance(t, Column) else F.timestamp_micros(F.lit(t).cast("long"))
    cond = F.col(time_col) >= as_column(lo)
    if date_col:
        cond = cond & (F.col(date_col) >= F.to_date(as_column(lo)))
    if hi is not None:
        cond = cond & (F.col(time_col) < as_column(hi))
        if date_col:
            cond = cond & (F.col(date_col) <= F.to_date(as_column(hi)))
    return df.filter(cond)


# ------------------------------------------------------------------ writes

def write_raw(rows: DataFrame, path: str, mode: str = "append", spread: bool = True, noted: tuple[Bounds, Spans] | None = None) -> None:
    """Append raw-table rows, time-sorted inside each file, or (``overwrite``)
    give the days they hold these rows only.

    ``spread=True`` range-partitions on (day, time): a busy day is spread over
    many tasks - never one task per day - and every file covers a narrow time
    range, so that a key of a later delivery lies within the times of few files.
    (Rows that come out of the key de-duplication are hash-spread: written as
    they are, each of their files would cover the whole delivery.)
    ``spread=False`` keeps the input partitioning.

    Files are written aside, indexed, and then moved to their days one by one;
    the days' bounds are noted before that, the spans logged at last. ``noted``
    gives both where the caller knows them (they may cover more than the rows)."""
    spark, path = rows.sparkSession, path.rstrip("/")
    table, aside = Folder(spark, path), f"_staging/{uuid.uuid4().hex}"
    out = rows.select(*RAW_TABLE_COLUMNS)
    if spread:
        out = out.repartitionByRange("event_date", "event_time")
    # an index is complete or absent: files that came before it are read now
    if not keyindex.complete(spark, path):
        before = table.glob("event_date=*/*.parquet")
        if before:
            old_days, old_spans = touched(read_days(spark, path, "event_date", [f.split("/")[0].split("=", 1)[1] for f in before], RAW_TABLE_SCHEMA))
            keyindex.add(keyindex.keys_of_files(spark, path, RAW_TABLE_SCHEMA, path, before), path, len(hours_of(old_spans)))
            recent.note(spark, path, old_days)
    out.sortWithinPartitions("event_date", "event_time").write.partitionBy("event_date").parquet(f"{path}/{aside}")
    files = table.glob(f"{aside}/event_date=*/*.parquet")
    spans: Spans = noted[1] if noted else []
    if files:
        own = [f[len(aside) + 1:] for f in files]
        if noted is None:
            noted = touched(spark.read.schema(RAW_TABLE_SCHEMA).option("basePath", f"{path}/{aside}").parquet(*[f"{path}/{f}" for f in files]))
            spans = noted[1]
        recent.note(spark, path, noted[0])
        keyindex.add(keyindex.keys_of_files(spark, path, RAW_TABLE_SCHEMA, f"{path}/{aside}", own), path, len(hours_of(noted[1])))
        if mode == "overwrite":
            for day in sorted({f.split("/")[-2] for f in files}):
                table.delete(day)
        for f, to in zip(files, own):
            table.move(f, to)
    SpanLog(spark, path).add(spans)
    table.delete(aside)


Bounds = dict[str, tuple[int, int]]


def touched(rows: DataFrame) -> tuple[Bounds, Spans]:
    """The greatest ``created_at`` and ``processing_time`` of each day, and the
    quarter hours of ``event_time``, that rows hold. Bounded by the time a
    delivery covers."""
    at, most = F.unix_micros("event_time"), lambda c: F.max(F.unix_micros(c))
    found = (rows.where("event_time IS NOT NULL").groupBy(F.col("event_date").cast("string").alias("day"), (at - F.pmod(at, F.lit(QUARTER_MICROS))).alias("lo"))
             .agg(most("created_at").alias("created"), most("processing_time").alias("processed")).collect())
    days: Bounds = {}
    for r in found:
        own = days.get(r["day"], (r["created"], r["processed"]))
        days[r["day"]] = max(own[0], r["created"]), max(own[1], r["processed"])
    return days, merged([(r["lo"], r["lo"] + QUARTER_MICROS) for r in found])


def hours_of(spans: Spans) -> list[int]:
    """The hours (since 1970) that spans touch."""
    return sorted({h for lo, hi in spans for h in range(lo // HOUR_MICROS, -(-hi // HOUR_MICROS))})


def insert_ignore_duplicates(spark: SparkSession, rows: DataFrame, path: str,
                             order: list[str] | None = None, rejected_path: str | None = None,
                             before: Callable[[DataFrame, Spans], None] | None = None) -> list[str]:
    """Insert raw-table ``rows`` into the table at ``path``; keys already present
    (or repeated inside ``rows``) keep their first row. Rows breaking a table
    rule are appended to ``rejected_path``, or an error without one. Returns the
    files that were opened to look for known keys.

    Meant for one delivery (a micro-batch): the rows and the de-duplicated batch
    are kept with ``persist`` - their lineage is one shuffle long, and a lost
    block is recomputed from the replayable source. Re-running the same delivery
    inserts nothing twice. Of the table only the files are read whose Bloom
    filters say that they may hold a key of the batch; an index from before
    (or of rows that were added by other means) is completed first. The spans of
    the whole batch are logged, so that a delivery that is repeated after a
    failure is also refreshed again. ``before`` gets the new rows, and the spans
    of the batch, before any of them comes into the table."""
    path = path.rstrip("/")
    with rows_in_order(rows, raw_constraint_violation(rows), rejected_path) as good:
        batch = dedupe_raw(good, order).persist()
        try:
            noted = touched(batch)
            spans = noted[1]
            if not spans:
                return []
            hours = hours_of(spans)
            if not keyindex.complete(spark, path) and Folder(spark, path).glob("event_date=*"):
                write_raw(batch.limit(0), path, "append", spread=False)  # indexes what is there
            opened = keyindex.files_that_may_hold(spark, path, batch, hours)
            new = batch
            if opened:
                known = spark.read.schema(RAW_TABLE_SCHEMA).option("basePath", path).parquet(*[f"{path}/{f}" for f in opened])
                new = batch.join(known.select(*RAW_KEY), RAW_KEY, "left_anti").persist()
            try:
                if before:
                    before(new, spans)
                write_raw(new, path, noted=noted)
            finally:
                if opened:
                    new.unpersist()
            return opened
        finally:
            batch.unpersist()


def metrics_table(spark: SparkSession, path: str) -> HourTable:
    return HourTable(spark, path, METRICS_TABLE_SCHEMA, "bucket_start")


def upsert_metrics(spark: SparkSession, metrics: DataFrame, path: str,
                   created_at: Column | None = None, rejected_path: str | None = None) -> None:
    """Upsert window metrics on ``(bucket_start, symbol, scenario)``: every
    non-key column of an existing key is replaced (last write wins, not
    additive) and ``created_at`` is refreshed. Rows breaking a table rule are
    appended to ``rejected_path``, or an error without one."""
    with rows_in_order(metrics, metrics_constraint_violation(metrics), rejected_path) as good:
        new = metrics_table_rows(good, created_at)
        hours = distinct_hours(new, "bucket_start")
        if hours:
            metrics_table(spark, path).upsert(new, METRICS_KEY, hours)
