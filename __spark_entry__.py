"""

Every query reads the driver's ``events`` table, turns each row into a raw
JSON event message (``eventspark.sources.fixtures.event_stream``) and runs
the real ingestion path on the whole stream: decode, validate, route,
enrich, de-duplicate, aggregate. The oracle SQL recomputes the expected
result in DuckDB straight from ``events`` with the fixture's rules.

For comparison, results are presented the same way on both sides:
timestamps as UTC wall-clock (TIMESTAMP without zone), DOUBLE measures
rounded to 6 decimals (two engines may differ in the last bits of a float
sum or interpolation) and decimals as text, with all digits of their scale.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventspark.functions.timefn import instant
from eventspark.operators.ingest import (PROCESSED_COLUMNS, invalid_events, invalid_json, process_events, processed_json,
                                         valid_events)
from eventspark.operators.metrics import MEASURED, window_metrics, window_partials
from eventspark.operators.moments import insert_and_add
from eventspark.operators.recent import rows_for_last_seconds, rows_for_recent_events
from eventspark.operators.rollups import read_rollup, refresh, refresh_from_log
from eventspark.operators.tables import insert_ignore_duplicates, metrics_table, raw_table_rows, upsert_metrics, write_raw
from eventspark.plans import feeds, queries as Q, reports as R
from eventspark.plans.derive import Derived, from_sf
from eventspark.schema import METRIC_COLUMNS, RAW_TABLE_COLUMNS, RAW_TABLE_SCHEMA
from eventspark.session import prepare, work_path
from eventspark.sources.fixtures import BROKEN, RULE_CASES, rule_stream
from eventspark.streaming.jobs import PROCESSED_MESSAGE_SCHEMA, add_partials

SF_SMOKE = "/root/testdata/sf0.001"

def _there(module: str) -> bool:
    """Whether a module or package (not just a folder of its name) can be imported."""
    spec = importlib.util.find_spec(module)
    return spec is not None and spec.origin is not None


# The training-data operators and the corpus pipeline are optional parts.
if _there("eventspark.llm") and _there("corpus_pipeline"):
    import corpus_pipeline
    from eventspark.llm import entry as _llm
    LLM_QUERIES = {**_llm.queries(), "pipeline": corpus_pipeline.run}
    LLM_SQL = _llm.oracle_sql()
else:
    LLM_QUERIES, LLM_SQL = {}, {}


def present(df: DataFrame) -> DataFrame:
    """Values in forms every client reads alike: timestamps and dates as UTC
    wall clock (TIMESTAMP without zone); exact decimals as text; DOUBLE measures
    rounded to 6 decimals."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.DateType)):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _d(spark: SparkSession, sf_dir: str) -> Derived:
    prepare(spark)
    return from_sf(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: 10-second window metrics per (symbol, scenario) at sf0.001."""
    return present(_d(spark, SF_SMOKE).metrics.select(*METRIC_COLUMNS))


# ------------------------------------------------------------------ queries

def _a1(spark, sf):
    return present(_d(spark, sf).metrics.select(*METRIC_COLUMNS))


def _v_processed(spark, sf):
    return present(_d(spark, sf).valid.select(*PROCESSED_COLUMNS))


def _v_errors(spark, sf):
    d = _d(spark, sf)
    return d.processed.groupBy("validation_error").agg(F.count(F.lit(1)).alias("events"))


def _v_rejected(spark, sf):
    d = _d(spark, sf)
    return present(invalid_events(d.processed).select("processing_time", "validation_error"))


def _k3(spark, sf):
    return present(_d(spark, sf).raw)


@contextmanager
def _kept(df: DataFrame):
    """``df`` computed once for the deliveries that are cut out of it: its
    messages are not made and parsed again for each of them."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _quantile(df: DataFrame, col: str, p: float) -> int:
    return df.select(F.percentile_approx(F.unix_micros(col), p)).first()[0]


def _k3_insert(spark, sf):
    """Raw-table insert through real Parquet files in two deliveries that
    overlap in time: everything up to the median processing stamp, then
    everything from the 40th percentile on (both overlap and re-sent copies
    must be absorbed, first copy winning)."""
    d = _d(spark, sf)
    path = work_path(spark, "k3-raw")
    rows = raw_table_rows(d.valid.withColumn("arrival", F.lit(0)), created_at=F.col("processing_time"))
    stamp = F.unix_micros("processing_time")
    with _kept(rows) as rows:
        cut, cut2 = _quantile(rows, "processing_time", 0.5), _quantile(rows, "processing_time", 0.4)
        insert_ignore_duplicates(spark, rows.filter(stamp <= cut), path, ["processing_time"])
        insert_ignore_duplicates(spark, rows.filter(stamp >= cut2), path, ["processing_time"])
    return present(spark.read.schema(RAW_TABLE_SCHEMA).parquet(path).select(*RAW_TABLE_COLUMNS))


def _k3_late(spark, sf):
    """Three deliveries through the key index: the newer half of the events,
    then the older half with a part of the first again (a late delivery that
    lies before everything stored), then everything once more."""
    d = _d(spark, sf)
    path = work_path(spark, "k3-late")
    rows = raw_table_rows(d.valid.withColumn("arrival", F.lit(0)), created_at=F.col("processing_time"))
    with _kept(rows) as rows:
        half, more = rows.select(F.percentile_approx("sequence", [0.5, 0.6])).first()[0]
        for part in (rows.filter(F.col("sequence") > half), rows.filter(F.col("sequence") <= more), rows):
            insert_ignore_duplicates(spark, part, path, ["processing_time"])
    return present(spark.read.schema(RAW_TABLE_SCHEMA).parquet(path).select(*RAW_TABLE_COLUMNS))


def _k4_upsert(spark, sf):
    """Metrics upserted twice: first every window from half of its events (even
    sequence numbers), then every window complete, so that each stored row with
    an even event is replaced. The table must end equal to the metrics."""
    d = _d(spark, sf)
    path = work_path(spark, "k4-metrics")
    upsert_metrics(spark, window_metrics(d.valid.where("sequence % 2 = 0")), path, F.col("bucket_end"))
    upsert_metrics(spark, window_metrics(d.valid), path, F.col("bucket_end"))
    return present(metrics_table(spark, path).read().select(*METRIC_COLUMNS))


def _w1_out_of_order(spark, sf):
    """The streaming job's metrics step on three deliveries that each hold a
    third of every window, the latest events first."""
    d = _d(spark, sf)
    partials, path = work_path(spark, "w1-partials"), work_path(spark, "w1-metrics")
    with _kept(d.valid) as valid:
        for epoch, third in enumerate((2, 0, 1)):
            batch = valid.where(F.col("sequence") % 3 == third)
            upsert_metrics(spark, add_partials(spark, batch, partials, epoch, 10), path, F.col("bucket_end"))
    return present(metrics_table(spark, path).read().select(*METRIC_COLUMNS))


def _w2_compacted(spark, sf):
    """The same in ten deliveries, each of all windows, with the state compacted
    after every third; the sixth is delivered twice, and the second once more
    after it has been merged (neither may count again)."""
    d = _d(spark, sf)
    partials, path = work_path(spark, "w2-partials"), work_path(spark, "w2-metrics")
    with _kept(d.valid.select(*MEASURED, "sequence")) as valid:
        for epoch in (0, 1, 2, 3, 4, 5, 5, 1, 6, 7, 8, 9):
            batch = valid.where(F.col("sequence") % 10 == (epoch * 7) % 10)
            upsert_metrics(spark, add_partials(spark, batch, partials, epoch, 10, merge_after=3), path, F.col("bucket_end"))
    return present(metrics_table(spark, path).read().select(*METRIC_COLUMNS))


def _m7_log(spark, sf):
    """Roll-ups refreshed from the log of changed spans: after the newer events
    came, after a late delivery of every seventh event, and after the rest."""
    d = _d(spark, sf)
    raw, minute, quarter = (work_path(spark, n) for n in ("m7-raw", "m7-minute", "m7-quarter"))
    rows = raw_table_rows(d.valid.withColumn("arrival", F.lit(0)), created_at=F.col("processing_time"))
    with _kept(rows) as rows:
        newer = F.col("sequence") > rows.select(F.percentile_approx("sequence", 0.5)).first()[0]
        seventh = F.col("sequence") % 7 == 0
        for part in (rows.filter(newer & ~seventh), rows.filter(seventh), rows.filter(~newer)):
            insert_ignore_duplicates(spark, part, raw, ["processing_time"])
            refresh_from_log(spark, raw, minute, quarter)
    return present(read_rollup(spark, minute, "events_1min").drop("bucket_date"))


def _m1_delta(spark, sf):
    """The 1-minute roll-up kept by additive moments over four deliveries, each
    with rows of all hours, the state compacted on the way; the third comes
    twice, and the first once more at the end."""
    d = _d(spark, sf)
    raw, state, minute = (work_path(spark, n) for n in ("md-raw", "md-state", "md-minute"))
    rows = raw_table_rows(d.valid.withColumn("arrival", F.lit(0)), created_at=F.col("processing_time"))
    with _kept(rows) as rows:
        for delivery, part in enumerate((0, 1, 2, 2, 3, 0)):
            insert_and_add(spark, rows.filter(F.col("sequence") % 4 == part), raw, state, minute, delivery, ["processing_time"], merge_after=2)
    return present(read_rollup(spark, minute, "events_1min").drop("bucket_date"))


def _messages(spark, sf):
    prepare(spark)
    return process_events(rule_stream(spark, sf), "value", "processing_time")


def _v_rules(spark, sf):
    return _messages(spark, sf).groupBy("validation_error").agg(F.count(F.lit(1)).alias("events"))


def _v_processed_messages(spark, sf):
    """The fields of the processed messages, read back from their JSON."""
    m = processed_json(valid_events(_messages(spark, sf))).select(F.from_json("value", PROCESSED_MESSAGE_SCHEMA).alias("m"))
    return present(m.select("m.*"))


def _v_invalid_messages(spark, sf):
    m = invalid_json(invalid_events(_messages(spark, sf)))
    get = lambda p: F.get_json_object("value", p)
    return m.select(get("$.valid").alias("valid"), get("$.validation_error").alias("validation_error"), get("$.processing_time").alias("processing_time"),
                    get("$.raw").alias("raw"), get("$.payload.source").alias("payload_source"), get("$.payload.sequence").alias("payload_sequence"))


def _m1(spark, sf):
    return present(_d(spark, sf).minute().drop("bucket_date"))


def _m2(spark, sf):
    return present(_d(spark, sf).quarter().drop("bucket_date"))


QUARTER, HOUR = 900_000_000, 3_600_000_000


def _refresh_as_of(d: Derived) -> int:
    """The next whole quarter hour: every bucket of the data lies before it."""
    return (d.raw.agg(F.max(F.unix_micros("event_time"))).first()[0] // QUARTER + 1) * QUARTER


def _refresh_from(d: Derived) -> int:
    """The start of the quarter hour of the oldest event."""
    return (d.raw.agg(F.min(F.unix_micros("event_time"))).first()[0] // QUARTER) * QUARTER


def _m5_minute(spark, sf):
    """1-minute roll-up built by range refresh into a table: first a partial
    range, then a refresh over the whole stream."""
    d = _d(spark, sf)
    path = work_path(spark, "m1")
    as_of = _refresh_as_of(d)
    refresh(spark, d.raw, path, "events_1min", as_of - 1_050_000_000, as_of - 190_000_000)
    refresh(spark, d.raw, path, "events_1min", _refresh_from(d), as_of)
    return present(read_rollup(spark, path, "events_1min").drop("bucket_date"))


def _m5_quarter(spark, sf):
    d = _d(spark, sf)
    mpath, qpath = work_path(spark, "m1"), work_path(spark, "m15")
    since, as_of = _refresh_from(d), _refresh_as_of(d)
    refresh(spark, d.raw, mpath, "events_1min", since, as_of)
    refresh(spark, read_rollup(spark, mpath, "events_1min"), qpath, "events_15min", since, as_of)
    return present(read_rollup(spark, qpath, "events_15min").drop("bucket_date"))


def _m5_emptied(spark, sf):
    """A 30-day roll-up; then the source loses every third day, and the whole
    range is refreshed: the buckets of these days must go."""
    prepare(spark)
    d = from_sf(spark, sf, table_times=True)
    path = work_path(spark, "m1")
    end = _refresh_as_of(d)
    start = end - 60 * 24 * HOUR
    refresh(spark, d.raw, path, "events_1min", start, end)
    refresh(spark, d.raw.where("day(event_time) % 3 != 0"), path, "events_1min", start, end)
    return present(read_rollup(spark, path, "events_1min").drop("bucket_date"))


def _stored(fn, table):
    """A relative-time query over stored, partitioned tables of the 30-day
    stream, with "now" as a literal: the latest event time."""
    def run(spark, sf):
        prepare(spark)
        d = from_sf(spark, sf, table_times=True)
        raw_path = work_path(spark, "stored-raw")
        write_raw(d.raw, raw_path)
        raw = spark.read.schema(RAW_TABLE_SCHEMA).parquet(raw_path)
        now = raw.agg(F.max(F.unix_micros("event_time"))).first()[0]
        if table == "raw":
            return present(fn(raw, now))
        if table == "metrics":
            path = work_path(spark, "stored-metrics")
            upsert_metrics(spark, window_metrics(d.valid), path, F.col("bucket_end"))
            m = metrics_table(spark, path).read()
            last = m.agg(F.max(F.unix_micros("bucket_start"))).first()[0]
            return present(fn(m, start=instant(last - HOUR)))
        end = (now // QUARTER + 1) * QUARTER
        minute, quarter = work_path(spark, "stored-m1"), work_path(spark, "stored-m15")
        refresh(spark, raw, minute, "events_1min", end - 60 * 24 * HOUR, end)
        if table == "minute":
            return present(fn(read_rollup(spark, minute, "events_1min"), now))
        refresh(spark, read_rollup(spark, minute, "events_1min"), quarter, "events_15min", end - 60 * 24 * HOUR, end)
        return present(fn(read_rollup(spark, quarter, "events_15min"), now))
    return run


def _top_stored(rows_of, fn, limit):
    """A top-k report over the stored table of the 30-day stream, from the days
    that the bounds noted by its writes leave."""
    def run(spark, sf):
        prepare(spark)
        path = work_path(spark, "top-raw")
        write_raw(from_sf(spark, sf, table_times=True).raw, path)
        return present(fn(rows_of(spark, path, limit), limit))
    return run


def _d4_exact(spark, sf):
    return present(feeds.d4_exact_p95_per_scenario(window_partials(_d(spark, sf).valid)))


def _raw_q(fn, with_as_of=True):
    def run(spark, sf):
        d = _d(spark, sf)
        return present(fn(d.raw, d.as_of()) if with_as_of else fn(d.raw))
    return run


def _metrics_q(fn):
    def run(spark, sf):
        return present(fn(_d(spark, sf).metrics))
    return run


def _minute_q(fn):
    def run(spark, sf):
        d = _d(spark, sf)
        return present(fn(d.minute(), d.as_of()))
    return run


def _q12(spark, sf):
    d = _d(spark, sf)
    return present(Q.q12_rollup_last_24_hours(d.quarter(), d.as_of()))


def _period_q(fn):
    def run(spark, sf):
        m = _d(spark, sf).metrics
        start = F.timestamp_micros(F.unix_micros(m.select(F.max("bucket_start")).scalar()) - F.lit(3_600_000_000))
        return present(fn(m, start=start))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a1_window_metrics": _a1,
        "v_processed_events": _v_processed,
        "v_validation_errors": _v_errors,
        "v_rejected_events": _v_rejected,
        "k3_raw_table": _k3,
        "k3_raw_insert_two_deliveries": _k3_insert,
        "k3_raw_insert_late_delivery": _k3_late,
        "k4_metrics_upsert": _k4_upsert,
        "w2_metrics_after_compaction": _w2_compacted,
        "m7_refresh_from_log": _m7_log,
        "m1_delta_refresh": _m1_delta,
        "q05_stored_30_days": _top_stored(rows_for_last_seconds, Q.q05_throughput_per_second, 120),
        "q06_stored_30_days": _top_stored(rows_for_recent_events, Q.q06_recent_events, 20),
        "w1_stream_metrics_out_of_order": _w1_out_of_order,
        "v_rule_errors": _v_rules,
        "v_processed_messages": _v_processed_messages,
        "v_invalid_messages": _v_invalid_messages,
        "m5_refresh_emptied_days": _m5_emptied,
        "q02_stored_30_days": _stored(Q.q02_last_1_hour, "raw"),
        "q03_stored_30_days": _stored(Q.q03_last_24_hours, "raw"),
        "q11_stored_30_days": _stored(Q.q11_rollup_last_1_hour, "minute"),
        "q12_stored_30_days": _stored(Q.q12_rollup_last_24_hours, "quarter"),
        "d6_stored_30_days": _stored(feeds.d6_total_events, "metrics"),
        "d7_stored_30_days": _stored(feeds.d7_avg_latency, "metrics"),
        "m1_rollup_1min": _m1,
        "m2_rollup_15min": _m2,
        "m5_refresh_1min": _m5_minute,
        "m5_refresh_15min": _m5_quarter,
        "q01_last_5_minutes": _raw_q(Q.q01_last_5_minutes),
        "q02_last_1_hour": _raw_q(Q.q02_last_1_hour),
        "q03_last_24_hours": _raw_q(Q.q03_last_24_hours),
        "q04_latency_by_scenario": _raw_q(Q.q04_latency_by_scenario, False),
        "q05_throughput_per_second": _raw_q(Q.q05_throughput_per_second, False),
        "q06_recent_events": _raw_q(Q.q06_recent_events, False),
        "q07_aggregated_metrics_recent": _metrics_q(Q.q07_aggregated_metrics_recent),
        "q08_aggregated_throughput": _metrics_q(Q.q08_aggregated_throughput),
        "q09_events_by_producer": _raw_q(Q.q09_events_by_producer, False),
        "q10_rollup_last_5_minutes": _minute_q(Q.q10_rollup_last_5_minutes),
        "q11_rollup_last_1_hour": _minute_q(Q.q11_rollup_last_1_hour),
        "q12_rollup_last_24_hours": _q12,
        "r1_latency_by_scenario": _raw_q(R.r1_latency_by_scenario, False),
        "r2_throughput_by_scenario": _raw_q(R.r2_throughput_by_scenario, False),
        "r3_throughput_by_scenario": _raw_q(R.r3_throughput_by_scenario, False),
        "r4_minute_by_minute": _raw_q(R.r4_minute_by_minute, False),
        "r5_aggregated_metrics": _metrics_q(R.r5_aggregated_metrics),
        "d1_avg_price_per_symbol": _metrics_q(feeds.d1_avg_price_per_symbol),
        "d2_volume_per_symbol": _metrics_q(feeds.d2_volume_per_symbol),
        "d3_avg_latency_per_scenario": _metrics_q(feeds.d3_avg_latency_per_scenario),
        "d4_p95_latency": _metrics_q(feeds.d4_p95_latency),
        "d4_exact_p95_per_scenario": _d4_exact,
        "d5_persisted_throughput": _metrics_q(feeds.d5_persisted_throughput),
        "d6_total_events_last_hour": _period_q(feeds.d6_total_events),
        "d7_avg_latency_last_hour": _period_q(feeds.d7_avg_latency),
        "d8_recent_events": _raw_q(feeds.d8_recent_events, False),
        **LLM_QUERIES,
    }


# --------------------------------------------------------------- oracle SQL

def _hu(num: str, den: str, scale: int, num_scale: int = 0) -> str:
    """Exact HALF_UP of num/den as DECIMAL(38,scale); ``num`` is a non-negative
    integer count of 10^-num_scale units, ``den`` a positive integer."""
    unit = f"{10 ** -scale:.{scale}f}"
    return (f"CAST(CAST((2 * CAST({num} AS HUGEINT) * {10 ** (scale - num_scale)} + ({den})) // (2 * ({den}))"
            f" AS DECIMAL(38,0)) * CAST({unit} AS DECIMAL(38,{scale})) AS DECIMAL(38,{scale}))")


_AVG_PRICE6 = _hu("sum(CAST(price * 1000000 AS BIGINT))", "count(*)", 6, 6)
_AVG_PRICE18 = _hu("sum(CAST(price * 1000000 AS BIGINT))", "count(*)", 18, 6)

# The fixture stream and the ingestion rules, as SQL.
_BASE = """
src AS (
  SELECT event_id, user_id, event_type, value, props, ts, 0 AS copy FROM events
  UNION ALL
  SELECT event_id, user_id, event_type, value, props, ts, 1 AS copy FROM events WHERE CAST(props->>'k' AS INTEGER) = 4
),
f AS (
  SELECT event_id, copy,
         CAST(props->>'k' AS INTEGER) AS k,
         '00000000-0000-4000-a000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS uuid,
         'producer-' || CAST(user_id % 5 AS VARCHAR) AS producer_id,
         upper(event_type) AS symbol,
         CAST(CAST(value AS DECIMAL(18,6)) AS DECIMAL(38,18)) AS price,
         CAST(props->>'k' AS INTEGER) AS quantity,
         CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS scenario,
         'synthetic' AS source,
         event_id AS sequence,
         {{CLOCK}} + to_milliseconds(copy * 1500) AS processing_time,
         {{CLOCK}} - to_milliseconds((event_id * 7919) % 997) AS producer_time,
         {{CLOCK}} - to_milliseconds((event_id * 7919) % 997 + event_id % 13) AS event_time,
         CAST((event_id * 7919) % 997 + copy * 1500 AS BIGINT) AS ingestion_latency_ms,
         CAST((event_id * 7919) % 997 + event_id % 13 + copy * 1500 AS BIGINT) AS event_lag_ms
  FROM src
),
checked AS (
  SELECT *, CASE WHEN k = 3 THEN 'malformed JSON'
                 WHEN k = 1 THEN 'symbol is required and must match [A-Za-z0-9._-]+'
                 WHEN price <= 0 THEN 'price must be greater than zero'
                 WHEN k = 0 THEN 'quantity must be greater than zero'
                 WHEN k = 2 THEN 'event_time is required' END AS validation_error
  FROM f
),
valid AS (SELECT * FROM checked WHERE validation_error IS NULL),
raw AS (
  SELECT uuid AS event_id, producer_id, symbol, price, quantity, event_time, producer_time, processing_time,
         source, scenario, sequence, ingestion_latency_ms, event_lag_ms,
         processing_time AS created_at, CAST(event_time AS DATE) AS event_date
  FROM valid WHERE copy = 0
),
metrics AS (
  SELECT time_bucket(INTERVAL '10 seconds', processing_time) AS bucket_start,
         time_bucket(INTERVAL '10 seconds', processing_time) + INTERVAL '10 seconds' AS bucket_end,
         symbol, scenario,
         count(*) AS event_count,
         {{AVG_PRICE6}} AS avg_price,
         min(price) AS min_price,
         max(price) AS max_price,
         CAST(sum(quantity) AS BIGINT) AS total_quantity,
         {{AVG_LAT}} AS avg_ingestion_latency_ms,
         percentile_disc(0.5) WITHIN GROUP (ORDER BY ingestion_latency_ms) AS p50_ingestion_latency_ms,
         percentile_disc(0.95) WITHIN GROUP (ORDER BY ingestion_latency_ms) AS p95_ingestion_latency_ms,
         max(ingestion_latency_ms) AS max_ingestion_latency_ms,
         {{AVG_LAG}} AS avg_event_lag_ms
  FROM valid GROUP BY ALL
),
minute AS (
  SELECT time_bucket(INTERVAL '1 minute', event_time) AS bucket, symbol, scenario,
         count(*) AS event_count,
         {{AVG_PRICE18}} AS avg_price,
         min(price) AS min_price, max(price) AS max_price,
         CAST(sum(quantity) AS BIGINT) AS total_quantity,
         avg(ingestion_latency_ms) AS avg_latency_ms,
         max(ingestion_latency_ms) AS max_latency_ms,
         stddev_samp(ingestion_latency_ms) AS stddev_latency_ms
  FROM raw GROUP BY ALL
),
quarter AS (
  SELECT time_bucket(INTERVAL '15 minutes', bucket) AS bucket, symbol, scenario,
         CAST(sum(event_count) AS BIGINT) AS event_count,
         {{AVG_AVG18}} AS avg_price,
         min(min_price) AS min_price, max(max_price) AS max_price,
         CAST(sum(total_quantity) AS BIGINT) AS total_quantity,
         avg(avg_latency_ms) AS avg_latency_ms,
         max(max_latency_ms) AS max_latency_ms
  FROM minute GROUP BY ALL
)
"""
for _k, _v in {
    "AVG_PRICE6": _AVG_PRICE6,
    "AVG_PRICE18": _AVG_PRICE18,
    "AVG_LAT": _hu("sum(ingestion_latency_ms)", "count(*)", 2),
    "AVG_LAG": _hu("sum(event_lag_ms)", "count(*)", 2),
    # mean of minute means: their unscaled (10^-18) sum over the minutes, HALF_UP
    "AVG_AVG18": _hu("sum(CAST(avg_price * 1000000000000000000 AS HUGEINT))", "count(*)", 18, 18),
}.items():
    _BASE = _BASE.replace("{{" + _k + "}}", _v)


REPLAY_CLOCK = "TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 200)"
TABLE_CLOCK = "date_trunc('millisecond', ts)"


def _with(body: str, dec: tuple[str, ...] = (), dates: tuple[str, ...] = (), clock: str = REPLAY_CLOCK) -> str:
    """The query over the fixture CTEs; ``dec`` columns (exact decimals) become
    text, ``dates`` become TIMESTAMP - the same presentation as ``present`` on
    the Spark side."""
    base = _BASE.replace("{{CLOCK}}", "(" + clock + ")")
    if not dec and not dates:
        return "WITH " + base + body
    repl = [f"CAST({c} AS VARCHAR) AS {c}" for c in dec]
    repl += [f"CAST({c} AS TIMESTAMP) AS {c}" for c in dates]
    return "WITH " + base + ", __q AS (" + body + ") SELECT * REPLACE (" + ", ".join(repl) + ") FROM __q"


def _broken(field: str, text: str) -> str:
    """The JSON text of a field of ``rule_stream``."""
    cases = " ".join(f"WHEN {n} THEN " + ("NULL" if v is None else "'" + v + "'") for n, (f, v) in BROKEN.items() if f == field)
    return f"CASE event_id % {RULE_CASES} {cases} ELSE {text} END" if cases else text


# The outcome of every case of ``rule_stream``, stated independently of the decoder.
_RULES = """
e AS (
  SELECT event_id, event_id % {{N}} AS c, user_id, upper(event_type) AS symbol, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 200) AS t FROM events
), outcome AS (
  SELECT *, CASE c WHEN 0 THEN 'event_id is required' WHEN 1 THEN 'event_id must be a UUID'
      WHEN 2 THEN 'symbol is required and must match [A-Za-z0-9._-]+' WHEN 17 THEN 'symbol is required and must match [A-Za-z0-9._-]+'
      WHEN 3 THEN 'price must be greater than zero' WHEN 4 THEN 'invalid price' WHEN 5 THEN 'quantity must be greater than zero' WHEN 6 THEN 'invalid quantity'
      WHEN 7 THEN 'event_time is required' WHEN 8 THEN 'producer_time is required'
      WHEN 9 THEN 'event_time is not an ISO-8601 instant' WHEN 10 THEN 'producer_time is not an ISO-8601 instant'
      WHEN 11 THEN 'source is required' WHEN 12 THEN 'scenario is required'
      WHEN 13 THEN 'sequence must be greater than or equal to zero' WHEN 14 THEN 'sequence must be greater than or equal to zero'
      WHEN 15 THEN 'malformed JSON' END AS validation_error FROM e
)
""".replace("{{N}}", str(RULE_CASES))


def _rule_text() -> str:
    iso = lambda ms: f"'\"' || strftime(t - to_milliseconds({ms}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z\"'"
    fields = {
        "event_id": "'\"00000000-0000-4000-a000-' || lpad(event_id::VARCHAR, 12, '0') || '\"'", "producer_id": "'\"producer-' || user_id % 5 || '\"'",
        "symbol": "'\"' || lower(symbol) || '\"'", "price": "(event_id % 900 + 1) || '.25'", "quantity": "(event_id % 7 + 1)::VARCHAR",
        "event_time": iso(5), "producer_time": iso(2), "source": "'\"rules\"'", "scenario": "'\"low\"'", "sequence": "event_id::VARCHAR"}
    return "'{' || concat_ws(',', " + ", ".join(f"'\"{f}\":' || ({_broken(f, t)})" for f, t in fields.items()) + ") || '}'"


_R6 = "round({0}, 6)"
_AS_OF = "(SELECT max(event_time) FROM raw)"


def oracle_sql() -> dict[str, str]:
    metric_cols = ", ".join(METRIC_COLUMNS)
    processed_cols = ("event_id, producer_id, symbol, price, quantity, event_time, producer_time, processing_time, "
                      "source, scenario, sequence, ingestion_latency_ms, event_lag_ms")
    raw_cols = ", ".join(RAW_TABLE_COLUMNS)
    minute_cols = ("bucket, symbol, scenario, event_count, avg_price, min_price, max_price, total_quantity, "
                   "round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms, "
                   "round(stddev_latency_ms, 6) AS stddev_latency_ms")
    quarter_cols = ("bucket, symbol, scenario, event_count, avg_price, min_price, max_price, total_quantity, "
                    "round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms")
    pct = lambda p, name: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY ingestion_latency_ms), 6) AS {name}"
    span_us = "(epoch_us(max(processing_time)) - epoch_us(min(processing_time)))"
    thr = ("SELECT scenario, min(processing_time) AS first_processing_time, max(processing_time) AS last_processing_time, "
           "count(*) AS total_events, CASE WHEN {span} > 0 THEN {rate} ELSE {fallback} END AS effective_events_per_second "
           "FROM raw GROUP BY scenario")
    rate = _hu("count(*) * 1000000", span_us, 2)
    weighted = lambda col, s: _hu(f"sum(CAST({col} * {10 ** s} AS HUGEINT) * event_count)", "sum(event_count)", s)
    period = "WHERE bucket_start >= (SELECT max(bucket_start) FROM metrics) - INTERVAL '1 hour'"
    throughput = ("SELECT bucket_start AS time, scenario, CAST(sum(event_count) AS BIGINT) AS events, "
                  "round(epoch(max(bucket_end) - min(bucket_start)), 6) AS window_seconds, "
                  "round(sum(event_count) / nullif(epoch(max(bucket_end) - min(bucket_start)), 0), 6) AS events_per_second "
                  "FROM metrics GROUP BY bucket_start, scenario")
    recent = ("SELECT event_id, producer_id, symbol, price, quantity, event_time, producer_time, processing_time, "
              "ingestion_latency_ms, event_lag_ms, scenario, source FROM raw "
              "ORDER BY created_at DESC, event_id DESC LIMIT 20")
    sql = {
        "a1_window_metrics": _with(f"SELECT {metric_cols} FROM metrics", ("avg_price", "min_price", "max_price", "avg_ingestion_latency_ms", "avg_event_lag_ms")),
        "v_processed_events": _with(
            f"SELECT CASE WHEN copy = 1 THEN upper(uuid) ELSE uuid END AS event_id, "
            f"{processed_cols.replace('event_id, ', '', 1)} FROM valid", ("price",)),
        "v_validation_errors": _with("SELECT validation_error, count(*) AS events FROM checked GROUP BY validation_error"),
        "v_rejected_events": _with("SELECT processing_time, validation_error FROM checked WHERE validation_error IS NOT NULL"),
        "k3_raw_table": _with(f"SELECT {raw_cols} FROM raw", ("price",), ("event_date",)),
        "k3_raw_insert_two_deliveries": _with(f"SELECT {raw_cols} FROM raw", ("price",), ("event_date",)),
        "k4_metrics_upsert": _with(f"SELECT {metric_cols} FROM metrics", ("avg_price", "min_price", "max_price", "avg_ingestion_latency_ms", "avg_event_lag_ms")),
        "m1_rollup_1min": _with(f"SELECT {minute_cols} FROM minute", ("avg_price", "min_price", "max_price")),
        "m2_rollup_15min": _with(f"SELECT {quarter_cols} FROM quarter", ("avg_price", "min_price", "max_price")),
        "m5_refresh_1min": _with(f"SELECT {minute_cols} FROM minute", ("avg_price", "min_price", "max_price")),
        "m5_refresh_15min": _with(f"SELECT {quarter_cols} FROM quarter", ("avg_price", "min_price", "max_price")),
        "q01_last_5_minutes": _with(
            f"SELECT time_bucket(INTERVAL '10 seconds', event_time) AS bucket, symbol, {_AVG_PRICE18} AS avg_price, "
            f"CAST(sum(quantity) AS BIGINT) AS total_quantity, round(avg(ingestion_latency_ms), 6) AS avg_latency_ms, "
            f"count(*) AS events FROM raw WHERE event_time >= {_AS_OF} - INTERVAL '5 minutes' GROUP BY ALL", ("avg_price",)),
        "q02_last_1_hour": _with(
            f"SELECT time_bucket(INTERVAL '1 minute', event_time) AS bucket, symbol, {_AVG_PRICE18} AS avg_price, "
            f"min(price) AS min_price, max(price) AS max_price, round(avg(ingestion_latency_ms), 6) AS avg_latency_ms, "
            f"count(*) AS events FROM raw WHERE event_time >= {_AS_OF} - INTERVAL '1 hour' GROUP BY ALL", ("avg_price", "min_price", "max_price")),
        "q03_last_24_hours": _with(
            f"SELECT time_bucket(INTERVAL '15 minutes', event_time) AS bucket, scenario, count(*) AS events, "
            f"round(avg(ingestion_latency_ms), 6) AS avg_latency_ms, {pct(0.5, 'p50_latency_ms')}, "
            f"{pct(0.95, 'p95_latency_ms')}, max(ingestion_latency_ms) AS max_latency_ms "
            f"FROM raw WHERE event_time >= {_AS_OF} - INTERVAL '24 hours' GROUP BY ALL"),
        "q04_latency_by_scenario": _with(
            f"SELECT scenario, count(*) AS total_events, round(avg(ingestion_latency_ms), 6) AS avg_latency_ms, "
            f"{pct(0.5, 'p50_latency_ms')}, {pct(0.95, 'p95_latency_ms')}, "
            f"max(ingestion_latency_ms) AS max_latency_ms, round(avg(event_lag_ms), 6) AS avg_event_lag_ms "
            f"FROM raw GROUP BY scenario"),
        "q05_throughput_per_second": _with(
            "SELECT time_bucket(INTERVAL '1 second', processing_time) AS second, scenario, count(*) AS events "
            "FROM raw GROUP BY ALL ORDER BY second DESC, scenario LIMIT 120"),
        "q06_recent_events": _with(recent, ("price",)),
        "q07_aggregated_metrics_recent": _with(
            "SELECT bucket_start, bucket_end, symbol, scenario, event_count, avg_price, total_quantity, "
            "avg_ingestion_latency_ms, p50_ingestion_latency_ms, p95_ingestion_latency_ms, max_ingestion_latency_ms "
            "FROM metrics ORDER BY bucket_start DESC, symbol, scenario LIMIT 50", ("avg_price", "avg_ingestion_latency_ms")),
        "q08_aggregated_throughput": _with(throughput + " ORDER BY time DESC, scenario LIMIT 120"),
        "q09_events_by_producer": _with(
            f"SELECT producer_id, scenario, count(*) AS total_events, "
            f"round(avg(ingestion_latency_ms), 6) AS avg_latency_ms, {pct(0.95, 'p95_latency_ms')}, "
            f"min(event_time) AS first_event_time, max(event_time) AS last_event_time FROM raw GROUP BY ALL"),
        "q10_rollup_last_5_minutes": _with(
            f"SELECT bucket, symbol, event_count, avg_price, total_quantity, round(avg_latency_ms, 6) AS avg_latency_ms, "
            f"max_latency_ms FROM minute WHERE bucket >= {_AS_OF} - INTERVAL '5 minutes'", ("avg_price",)),
        "q11_rollup_last_1_hour": _with(
            f"SELECT bucket, symbol, event_count, avg_price, min_price, max_price, "
            f"round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms FROM minute "
            f"WHERE bucket >= {_AS_OF} - INTERVAL '1 hour'", ("avg_price", "min_price", "max_price")),
        "q12_rollup_last_24_hours": _with(
            f"SELECT bucket, scenario, event_count, round(avg_latency_ms, 6) AS avg_latency_ms, max_latency_ms "
            f"FROM quarter WHERE bucket >= {_AS_OF} - INTERVAL '24 hours'"),
        "r1_latency_by_scenario": _with(
            f"SELECT scenario, count(*) AS total_events, "
            f"{_hu('sum(ingestion_latency_ms)', 'count(*)', 2)} AS avg_latency_ms, "
            f"CAST(round(CAST(stddev_samp(ingestion_latency_ms) AS DECIMAL(38,18)), 2) AS DECIMAL(38,2)) AS stddev_latency_ms, "
            f"{pct(0.5, 'p50_latency_ms')}, {pct(0.95, 'p95_latency_ms')}, max(ingestion_latency_ms) AS max_latency_ms, "
            f"{_hu('sum(event_lag_ms)', 'count(*)', 2)} AS avg_event_lag_ms FROM raw GROUP BY scenario",
            ("avg_latency_ms", "stddev_latency_ms", "avg_event_lag_ms")),
        "r2_throughput_by_scenario": _with(thr.format(span=span_us, rate=rate,
                                                      fallback="CAST(count(*) AS DECIMAL(38,2))"),
                                                   ("effective_events_per_second",)),
        "r3_throughput_by_scenario": _with(thr.format(span=span_us, rate=rate, fallback="CAST(NULL AS DECIMAL(38,2))"),
                                           ("effective_events_per_second",)),
        "r4_minute_by_minute": _with(
            f"SELECT time_bucket(INTERVAL '1 minute', processing_time) AS minute, scenario, count(*) AS events, "
            f"{_hu('sum(ingestion_latency_ms)', 'count(*)', 2)} AS avg_latency_ms, {pct(0.95, 'p95_latency_ms')} "
            f"FROM raw GROUP BY ALL", ("avg_latency_ms",)),
        "r5_aggregated_metrics": _with(
            "SELECT bucket_start, bucket_end, symbol, scenario, event_count, avg_price, total_quantity, "
            "avg_ingestion_latency_ms, p95_ingestion_latency_ms, max_ingestion_latency_ms FROM metrics",
            ("avg_price", "avg_ingestion_latency_ms")),
        "d1_avg_price_per_symbol": _with(
            f"SELECT bucket_start AS time, symbol, {weighted('avg_price', 6)} AS avg_price FROM metrics GROUP BY ALL",
            ("avg_price",)),
        "d2_volume_per_symbol": _with(
            "SELECT bucket_start AS time, symbol, CAST(sum(total_quantity) AS BIGINT) AS volume FROM metrics GROUP BY ALL"),
        "d3_avg_latency_per_scenario": _with(
            f"SELECT bucket_start AS time, scenario, {weighted('avg_ingestion_latency_ms', 2)} AS avg_latency_ms "
            f"FROM metrics GROUP BY ALL", ("avg_latency_ms",)),
        "d4_p95_latency": _with(
            "SELECT bucket_start AS time, scenario, max(p95_ingestion_latency_ms) AS p95_latency_ms_upper "
            "FROM metrics GROUP BY ALL"),
        "d4_exact_p95_per_scenario": _with(
            "SELECT time_bucket(INTERVAL '10 seconds', processing_time) AS time, scenario, "
            "percentile_disc(0.95) WITHIN GROUP (ORDER BY ingestion_latency_ms) AS p95_latency_ms FROM valid GROUP BY ALL"),
        "d5_persisted_throughput": _with(throughput),
        "d6_total_events_last_hour": _with(
            f"SELECT CAST(coalesce(sum(event_count), 0) AS BIGINT) AS total_events FROM metrics {period}"),
        "d7_avg_latency_last_hour": _with(
            f"SELECT {weighted('avg_ingestion_latency_ms', 2)} AS avg_latency_ms FROM metrics {period}",
            ("avg_latency_ms",)),
        "d8_recent_events": _with(recent, ("price",)),
    }
    on_table_clock = lambda q: q.replace(f"({REPLAY_CLOCK})", f"({TABLE_CLOCK})")
    for stored, name in {"q05": "q05_throughput_per_second", "q06": "q06_recent_events", "q02": "q02_last_1_hour", "q03": "q03_last_24_hours", "q11": "q11_rollup_last_1_hour", "q12": "q12_rollup_last_24_hours",
                         "d6": "d6_total_events_last_hour", "d7": "d7_avg_latency_last_hour"}.items():
        sql[f"{stored}_stored_30_days"] = on_table_clock(sql[name])
    sql["m5_refresh_emptied_days"] = on_table_clock(sql["m1_rollup_1min"]).replace("FROM valid WHERE copy = 0", "FROM valid WHERE copy = 0 AND day(event_time) % 3 != 0")
    sql["w1_stream_metrics_out_of_order"] = sql["w2_metrics_after_compaction"] = sql["a1_window_metrics"]
    sql["k3_raw_insert_late_delivery"] = sql["k3_raw_table"]
    sql["m7_refresh_from_log"] = sql["m1_delta_refresh"] = sql["m1_rollup_1min"]
    rules = "WITH " + _RULES
    stamp = lambda t: f"strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
    sql["v_rule_errors"] = rules + "SELECT validation_error, count(*) AS events FROM outcome GROUP BY validation_error"
    sql["v_processed_messages"] = rules + f"""
      SELECT '00000000-0000-4000-a000-' || lpad(event_id::VARCHAR, 12, '0') AS event_id, CASE c WHEN 16 THEN 'unknown' ELSE 'producer-' || user_id % 5 END AS producer_id,
        symbol, CASE c WHEN 19 THEN '0.123456789012345678' WHEN 20 THEN '123456789.123456789012000000'
          WHEN 21 THEN '987654321.123456789012345678' ELSE (event_id % 900 + 1) || '.250000000000000000' END AS price,
        CASE c WHEN 18 THEN 2 ELSE event_id % 7 + 1 END::INTEGER AS quantity, {stamp("t - to_milliseconds(5)")} AS event_time, {stamp("t - to_milliseconds(2)")} AS producer_time,
        {stamp("t")} AS processing_time, 'rules' AS source, 'low' AS scenario, event_id AS sequence, 2::BIGINT AS ingestion_latency_ms, 5::BIGINT AS event_lag_ms, true AS valid
      FROM outcome WHERE validation_error IS NULL"""
    sql["v_invalid_messages"] = rules + f"""
      SELECT 'false' AS valid, validation_error, {stamp("t")} AS processing_time, CASE WHEN c = 15 THEN {_rule_text()} END AS raw,
        CASE c WHEN 15 THEN NULL WHEN 11 THEN ' ' ELSE 'rules' END AS payload_source, CASE c WHEN 13 THEN '-5' WHEN 14 THEN NULL WHEN 15 THEN NULL ELSE event_id::VARCHAR END AS payload_sequence
      FROM (SELECT *, lower(symbol) AS s FROM outcome) WHERE validation_error IS NOT NULL"""
    return {**sql, **LLM_SQL}
