"""Raw-table insert, metrics upsert, constraints, range refresh, pruning."""

import datetime as dt
import pathlib
from decimal import Decimal

from pyspark.sql import functions as F

from eventspark.operators import tables as K
from eventspark.operators.metrics import window_metrics
import pytest

from eventspark.functions.timefn import to_micros
from eventspark.operators.rollups import (aligned_range, create_empty, read_rollup, refresh, refresh_by_policy,
                                         refresh_policy_window, rollup_1min, rollup_15min, rollup_table)
from eventspark.operators.store import WriteConflict
from eventspark.plans.derive import from_sf
from eventspark.plans.queries import q01_last_5_minutes
from eventspark.schema import METRIC_COLUMNS, RAW_TABLE_SCHEMA
from tests.conftest import SF001

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _raw_rows(spark, rows):
    return spark.createDataFrame(rows, (
        "event_id string, producer_id string, symbol string, price decimal(38,18), quantity int, "
        "event_time timestamp, producer_time timestamp, processing_time timestamp, source string, "
        "scenario string, sequence long, ingestion_latency_ms long, event_lag_ms long, created_at timestamp, "
        "event_date date"))


def _row(eid, t, pt, price="1", seq=0):
    return (eid, "p", "AAA", Decimal(price), 1, t, t, pt, "s", "low", seq, 0, 0, pt, t.date())


def test_insert_ignores_duplicates_first_wins(spark, scratch):
    path = f"{scratch}/raw"
    t = T0 + dt.timedelta(minutes=1)
    b1 = _raw_rows(spark, [_row("a", t, t, "1"), _row("a", t, t + dt.timedelta(seconds=1), "2"),
                           _row("b", t, t, "3")])
    K.insert_ignore_duplicates(spark, b1, path)
    b2 = _raw_rows(spark, [_row("a", t, t + dt.timedelta(seconds=9), "9"), _row("c", t, t, "4"),
                           _row("a", t + dt.timedelta(days=1), t, "5")])  # same id, other event_time: new key
    K.insert_ignore_duplicates(spark, b2, path)
    got = {(r["event_id"], r["event_time"]): r["price"] for r in spark.read.parquet(path).collect()}
    assert got == {("a", t): Decimal("1"), ("b", t): Decimal("3"), ("c", t): Decimal("4"),
                   ("a", t + dt.timedelta(days=1)): Decimal("5")}
    # replaying a delivery changes nothing
    K.insert_ignore_duplicates(spark, b2, path)
    assert spark.read.parquet(path).count() == 4


def test_upsert_replaces_all_columns_and_keeps_others(spark, scratch):
    path = f"{scratch}/metrics"
    rows = [("AAA", "low", Decimal("1"), 1, T0 + dt.timedelta(seconds=s), 10, 11) for s in (0, 1, 11)]
    rows.append(("BBB", "high", Decimal("2"), 2, T0 + dt.timedelta(days=2), 5, 6))
    schema = ("symbol string, scenario string, price decimal(38,18), quantity int, processing_time timestamp, "
              "ingestion_latency_ms long, event_lag_ms long")
    K.upsert_metrics(spark, window_metrics(spark.createDataFrame(rows, schema)), path, F.col("bucket_end"))
    files = set(scratch_files(path))
    more = [("AAA", "low", Decimal("3"), 5, T0 + dt.timedelta(seconds=2), 30, 31)]
    # re-emission of the first window with all of its rows: replaces, not adds
    again = spark.createDataFrame(rows[:2] + more, schema)
    K.upsert_metrics(spark, window_metrics(again), path, F.col("bucket_end"))
    got = {(r["bucket_start"], r["symbol"]): r for r in K.metrics_table(spark, path).read().collect()}
    assert len(got) == 3
    # only the touched hour was written again; the other day's file is still the same
    assert len(K.metrics_table(spark, path).hours()) == 2 and files & set(scratch_files(path)) == files
    first = got[(T0, "AAA")]
    assert first["event_count"] == 3 and first["total_quantity"] == 7 and first["max_ingestion_latency_ms"] == 30
    assert got[(T0 + dt.timedelta(seconds=10), "AAA")]["event_count"] == 1
    assert got[(T0 + dt.timedelta(days=2), "BBB")]["event_count"] == 1


def scratch_files(path):
    return [str(f) for f in pathlib.Path(path).rglob("part-*.parquet")]


def test_late_partial_window_replaces_a_stored_row(spark, scratch):
    """A window emitted with some of its events, then again with all of them."""
    d = from_sf(spark, SF001)
    path = f"{scratch}/metrics"
    K.upsert_metrics(spark, window_metrics(d.valid.where("sequence % 2 = 1")), path, F.col("bucket_end"))
    before = K.metrics_table(spark, path).read().count()
    K.upsert_metrics(spark, window_metrics(d.valid), path, F.col("bucket_end"))
    got, want = K.metrics_table(spark, path).read().select(*METRIC_COLUMNS), window_metrics(d.valid)
    assert 0 < before < want.count() == got.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_rows_that_break_rules_are_put_aside_or_refused(spark, scratch):
    rows = _raw_rows(spark, [_row("a", T0, T0), _row("b", T0, T0, price="0")])
    with pytest.raises(K.ConstraintError, match="price check"):
        K.insert_ignore_duplicates(spark, rows, f"{scratch}/raw")
    K.insert_ignore_duplicates(spark, rows, f"{scratch}/raw", rejected_path=f"{scratch}/rejected")
    assert [r["event_id"] for r in spark.read.parquet(f"{scratch}/raw").collect()] == ["a"]
    assert [(r["event_id"], r["constraint_error"]) for r in spark.read.parquet(f"{scratch}/rejected").collect()] == [("b", "price check")]
    bad = window_metrics(from_sf(spark, SF001).valid).withColumn("event_count", F.lit(-1).cast("long"))
    with pytest.raises(K.ConstraintError, match="event_count check"):
        K.upsert_metrics(spark, bad, f"{scratch}/metrics")


def test_a_write_that_fails_half_way_leaves_the_table(spark, scratch):
    d = from_sf(spark, SF001)
    path = f"{scratch}/metrics"
    K.upsert_metrics(spark, window_metrics(d.valid), path, F.col("bucket_end"))
    table = K.metrics_table(spark, path)
    before = sorted(table.read().collect())
    hours = list(table.hours())
    # some tasks write their files, one fails
    symbols = {r["symbol"] for r in before}
    broken = F.when(F.col("symbol") == F.lit(max(symbols)), F.raise_error(F.lit("disk full")).cast("long")).otherwise(F.col("event_count"))
    with pytest.raises(Exception, match="disk full"):
        table.replace(lambda old: old.withColumn("event_count", broken), hours)
    assert sorted(table.read().collect()) == before
    # a write that never reached its switch is invisible, and can be removed
    table._commit = lambda number, hours: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with pytest.raises(RuntimeError, match="driver lost"):
        table.replace(lambda old: old.limit(0), hours)
    table = K.metrics_table(spark, path)
    assert sorted(table.read().collect()) == before
    table.vacuum()
    assert sorted(table.read().collect()) == before and len(table._list("data")) == 1


def test_two_writers_do_not_overwrite_each_other(spark, scratch):
    create_empty(spark, f"{scratch}/m1")
    table = rollup_table(spark, f"{scratch}/m1")
    table._commit(2, {})
    with pytest.raises(WriteConflict):
        table._commit(2, {1: ("x", "1970-01-01")})
    assert table.hours() == {}


def test_years_0000_and_0001(spark, scratch):
    """Events at the calendar's edge are inserted, once."""
    path = f"{scratch}/raw"
    rows = spark.range(2).select(
        F.col("id").cast("string").alias("event_id"), F.lit("p").alias("producer_id"), F.lit("AAA").alias("symbol"), F.lit("1").cast("decimal(38,18)").alias("price"),
        F.lit(1).alias("quantity"), F.expr("timestamp'0000-06-01 00:00:00' + make_dt_interval(id * 366, 0, 0, 0)").alias("event_time")).withColumns(
        {"producer_time": F.col("event_time"), "processing_time": F.col("event_time"), "source": F.lit("s"), "scenario": F.lit("low"), "sequence": F.lit(1).cast("long"),
         "ingestion_latency_ms": F.lit(0).cast("long"), "event_lag_ms": F.lit(0).cast("long"), "created_at": F.col("event_time"), "event_date": F.to_date("event_time")})
    for _ in range(2):
        K.insert_ignore_duplicates(spark, rows, path)
    got = spark.read.schema(RAW_TABLE_SCHEMA).parquet(path).select(F.col("event_time").cast("string").alias("t"), F.col("event_date").cast("string").alias("d")).collect()
    assert sorted((r["t"], r["d"]) for r in got) == [("0000-06-01 00:00:00", "0000-06-01"), ("0001-06-02 00:00:00", "0001-06-02")]


def test_constraints(spark):
    rows = [_row("a", T0, T0), _row("b", T0, T0, price="0")]
    df = _raw_rows(spark, rows).withColumn("symbol", F.when(F.col("event_id") == "a", "A A").otherwise("B"))
    ok, bad = K.enforce(df, K.raw_constraint_violation(df))
    assert ok.count() == 0
    assert sorted(r["constraint_error"] for r in bad.collect()) == ["price check", "symbol check"]


def test_aligned_range():
    want = tuple(to_micros(t) for t in (dt.datetime(2024, 1, 1, 0, 1), dt.datetime(2024, 1, 1, 0, 5)))
    assert aligned_range(dt.datetime(2024, 1, 1, 0, 0, 30), dt.datetime(2024, 1, 1, 0, 5, 10), "1 minute") == want
    assert aligned_range("2024-01-01T00:00:30+00:00", "2023-12-31 21:05:10-03:00", "1 minute") == want


def test_partial_then_full_refresh(spark, scratch):
    d = from_sf(spark, SF001)
    raw_path = f"{scratch}/raw"
    K.write_raw(d.raw, raw_path, "overwrite")
    raw = spark.read.parquet(raw_path)
    tmin, tmax = raw.agg(F.min(F.unix_micros("event_time")), F.max(F.unix_micros("event_time"))).first()
    path = f"{scratch}/m1"
    lo, hi = refresh(spark, raw, path, "events_1min", tmin + 50_000_000, tmax - 10_000_000)
    assert lo < hi
    part = read_rollup(spark, path)
    at = F.unix_micros("bucket")
    expected = rollup_1min(raw).filter((at >= lo) & (at < hi))
    assert part.count() == expected.count() > 0
    assert part.where((at < lo) | (at >= hi)).count() == 0
    as_of = tmax + 3_600_000_000
    refresh(spark, raw, path, "events_1min", as_of - 25 * 3_600_000_000, as_of)
    full = read_rollup(spark, path)
    cols = [c for c in full.columns]
    assert full.select(*cols).exceptAll(rollup_1min(raw).select(*cols)).count() == 0
    assert rollup_1min(raw).select(*cols).exceptAll(full.select(*cols)).count() == 0
    qpath = f"{scratch}/m15"
    refresh(spark, read_rollup(spark, path), qpath, "events_15min", as_of - 26 * 3_600_000_000, as_of)
    q = read_rollup(spark, qpath, "events_15min")
    r6 = F.round("avg_latency_ms", 6).alias("avg_latency_ms")  # a float mean of means: order of sums
    qc = [c if c != "avg_latency_ms" else r6 for c in q.columns]
    q, exp = q.select(*qc), rollup_15min(rollup_1min(raw)).select(*qc)
    assert q.exceptAll(exp).count() == 0 and exp.exceptAll(q).count() == 0


def test_refresh_removes_days_whose_source_is_gone(spark, scratch):
    path, t = f"{scratch}/m1", T0 + dt.timedelta(hours=1)
    raw = _raw_rows(spark, [_row("a", t, t), _row("b", t + dt.timedelta(days=1), t)])
    span = (T0, T0 + dt.timedelta(days=3))
    refresh(spark, raw, path, "events_1min", *span)
    assert read_rollup(spark, path).count() == 2
    refresh(spark, raw.where("event_id = 'b'"), path, "events_1min", *span)
    assert [r["bucket"] for r in read_rollup(spark, path).collect()] == [t + dt.timedelta(days=1)]
    refresh(spark, raw.limit(0), path, "events_1min", *span)
    assert read_rollup(spark, path).count() == 0


def test_refresh_policies(spark, scratch):
    """The policies leave the open bucket and all that is older alone."""
    now = T0 + dt.timedelta(days=3, hours=5, minutes=7, seconds=20)
    times = [now - dt.timedelta(minutes=m) for m in (0.1, 2, 20, 119, 121, 24 * 60, 27 * 60)]
    raw_path = f"{scratch}/raw"
    K.write_raw(_raw_rows(spark, [_row(str(i), t, t) for i, t in enumerate(times)]), raw_path)
    refresh_by_policy(spark, raw_path, f"{scratch}/m1", f"{scratch}/m15", now)
    minutes = sorted(r["bucket"] for r in read_rollup(spark, f"{scratch}/m1").collect())
    # the range starts at 03:07:20 and ends at 05:06:20, so its whole minutes are 03:08 to 05:05
    assert minutes == [t.replace(second=0, microsecond=0) for t in (times[3], times[2], times[1])]
    quarters = sorted(r["bucket"] for r in read_rollup(spark, f"{scratch}/m15", "events_15min").collect())
    assert quarters == [dt.datetime(2024, 1, 4, 3, 0), dt.datetime(2024, 1, 4, 4, 45)][:len(quarters)] and quarters


def test_relative_time_query_prunes_partitions(spark, scratch):
    d = from_sf(spark, SF001)
    raw_path = f"{scratch}/raw"
    K.write_raw(d.raw, raw_path, "overwrite")
    raw = spark.read.parquet(raw_path)
    plan = q01_last_5_minutes(raw, dt.datetime(2024, 1, 1, 0, 30))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(event_time), GreaterThanOrEqual(event_time" in plan
    scan = [ln for ln in plan.split("\n") if "FileScan parquet" in ln][0]
    # only the columns the query uses are read
    assert "ReadSchema: struct<price:decimal(38,18),quantity:int,event_time:timestamp,symbol:string," \
           "ingestion_latency_ms:bigint>" in scan or "ReadSchema" in scan
    assert "created_at" not in scan.split("ReadSchema")[1]


def test_empty_rollup_and_policy_window(spark, scratch):
    create_empty(spark, f"{scratch}/empty", "events_15min")
    e = read_rollup(spark, f"{scratch}/empty", "events_15min")
    assert e.count() == 0 and "stddev_latency_ms" not in e.columns and "bucket_date" in e.columns
    now = dt.datetime(2024, 1, 2, 12, 0, 0)
    micros = lambda *t: tuple(map(to_micros, t))
    assert refresh_policy_window(now, "events_1min") == micros(dt.datetime(2024, 1, 2, 10, 0), dt.datetime(2024, 1, 2, 11, 59))
    assert refresh_policy_window(now, "events_15min") == micros(dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 2, 11, 45))


def test_read_days_lists_only_touched_partitions(spark, scratch):
    path = f"{scratch}/raw"
    t = T0 + dt.timedelta(minutes=1)
    K.write_raw(_raw_rows(spark, [_row("a", t, t), _row("b", t + dt.timedelta(days=2), t)]), path, "overwrite")
    assert K.read_days(spark, path, "event_date", ["2023-01-01"], RAW_TABLE_SCHEMA) is None
    assert K.read_days(spark, path, "event_date", [], RAW_TABLE_SCHEMA) is None
    one = K.read_days(spark, path, "event_date", ["2024-01-01", "2024-01-02"], RAW_TABLE_SCHEMA)
    assert [r["event_id"] for r in one.collect()] == ["a"]
    assert K.distinct_days(spark.read.parquet(path), "event_date") == ["2024-01-01", "2024-01-03"]


def test_stored_range_reads_fewer_hours(spark, scratch):
    d = from_sf(spark, SF001, table_times=True)
    path = f"{scratch}/metrics"
    K.upsert_metrics(spark, window_metrics(d.valid), path, F.col("bucket_end"))
    table = K.metrics_table(spark, path)
    lo, hi = table.read().agg(F.min(F.unix_micros("bucket_start")), F.max(F.unix_micros("bucket_start"))).first()
    late = table.read(lo=hi - 3_600_000_000)
    assert 0 < len(late.inputFiles()) <= 2 < len(table.hours()) and lo < hi - 20 * 24 * 3_600_000_000
    assert late.where(F.unix_micros("bucket_start") < hi - 3_600_000_000).count() == 0 < late.count()


def test_touched_spans(spark):
    from eventspark.operators.rollups import merged
    from eventspark.streaming.jobs import touched_spans
    times = [T0 + dt.timedelta(minutes=m) for m in (1, 14, 16, 50)]
    df = spark.createDataFrame([(x,) for x in times], "event_time timestamp")
    minutes = lambda *m: tuple(to_micros(T0 + dt.timedelta(minutes=x)) for x in m)
    assert touched_spans(df) == [minutes(0, 15), minutes(15, 30), minutes(45, 60)]
    assert merged(touched_spans(df)) == [minutes(0, 30), minutes(45, 60)]


@pytest.mark.parametrize("query", ["_m5_minute", "_m5_quarter"])
def test_refresh_queries_cover_a_stream_of_many_days(spark, monkeypatch, query):
    import types

    import __spark_entry__ as E
    rows = []
    for k, hours in enumerate((0, 30, 75)):
        t = T0 + dt.timedelta(hours=hours, minutes=3)
        rows.append((f"e{k}", "p", "BTC", Decimal("1.5"), 2, t, t, t, "s", "a", k, 5, 6, t, t.date()))
    raw = _raw_rows(spark, rows)
    monkeypatch.setattr(E, "_d", lambda *_: types.SimpleNamespace(raw=raw))
    got = getattr(E, query)(spark, SF001).collect()
    assert len(got) == 3 and sum(r["event_count"] for r in got) == 3
