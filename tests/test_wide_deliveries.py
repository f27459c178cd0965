"""Deliveries that cover many hours: their cost grows with their rows, not with
rows times files."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from eventspark.operators import keyindex, recent, tables as K
from eventspark.operators.metrics import window_partials
from eventspark.operators.partials import PartialStore
from eventspark.plans.derive import from_sf
from tests.conftest import SF001
from tests.test_increments import _delivery
from tests.test_tables import T0


@pytest.fixture()
def many_partitions(spark):
    """Every shuffle keeps its eight partitions, as with much more data."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield 8
    spark.conf.set(name, before)


def test_a_key_lies_within_the_times_of_few_files(spark, scratch, many_partitions):
    """candidates of the key look-up are keys times files around them."""
    path = f"{scratch}/raw"
    first, again = (_delivery(spark, T0 + dt.timedelta(seconds=s), 800, t, 45) for s, t in ((0, "a"), (7, "b")))
    for rows in (first, again, first.unionByName(again)):
        K.insert_ignore_duplicates(spark, rows, path)
    files = spark.read.parquet(f"{path}/_keys").groupBy("file").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    keys = spark.read.parquet(path).select("event_time")
    assert keys.count() == 1600 and files.count() >= 2 * many_partitions
    assert keys.join(files, F.col("event_time").between(F.col("lo"), F.col("hi"))).count() <= 1600 * 2 * 1.2


def test_state_of_an_hour_is_in_few_files(spark, scratch, many_partitions):
    """F2, F3, F5: a micro-batch of many hours doesn't write hours times tasks."""
    start = F.timestamp_micros(F.lit(0) + F.col("id") * 60_000_000)
    events = spark.range(2400).select(start.alias("processing_time"), F.lit("A").alias("symbol"), F.lit("low").alias("scenario"),
                                      (F.col("id") % 7).alias("ingestion_latency_ms"), F.lit(1).cast("decimal(38,18)").alias("price"),
                                      F.lit(1).alias("quantity"), F.lit(1).cast("long").alias("event_lag_ms"))
    store, hours = PartialStore(spark, f"{scratch}/state", merge_after=2), list(range(40))
    for epoch in range(3):
        store.add(window_partials(events), hours, epoch)
        assert len(glob.glob(f"{scratch}/state/bucket_hour=*/epoch={epoch}/*.parquet")) <= len(hours) + many_partitions
    assert store.compact(hours, 2) == hours
    assert len(glob.glob(f"{scratch}/state/_base/bucket_hour=*/*/*.parquet")) <= len(hours) + many_partitions
    assert store.read(hours).agg(F.sum("n")).first()[0] == 3 * 2400


def test_a_delivery_of_many_days_writes_few_small_files(spark, scratch):
    """index files and notes of day bounds don't grow with the hours of a first load."""
    path, days = f"{scratch}/raw", 40
    load = _delivery(spark, T0, days * 24, "a", 3600)
    K.write_raw(load, path)
    assert len(glob.glob(f"{path}/_keys*/*/*.parquet")) <= days + 8
    assert len([f for f in glob.glob(f"{path}/_bounds/*") if not f.endswith(".crc")]) == 1
    assert keyindex.complete(spark, path) and len(recent.bounds(spark, path)) == days
    # its keys are found again, by a narrow delivery as well as by a wide one
    narrow = _delivery(spark, T0 + dt.timedelta(days=7, hours=5), 1, "late")
    assert K.insert_ignore_duplicates(spark, load.where("event_time < '2024-01-02'").unionByName(narrow), path)
    assert K.insert_ignore_duplicates(spark, narrow, path)
    K.insert_ignore_duplicates(spark, load.unionByName(_delivery(spark, T0 + dt.timedelta(days=days + 10), 1, "new")), path)
    stored = spark.read.parquet(path)
    assert stored.count() == days * 24 + 2 == stored.select("event_id", "event_time").distinct().count()
    # a list, single notes and a later list agree with the rows
    rows = stored.groupBy(F.col("event_date").cast("string")).agg(F.max(F.unix_micros("created_at")), F.max(F.unix_micros("processing_time"))).collect()
    noted = recent.bounds(spark, path)
    assert set(noted) == {r[0] for r in rows} and all(noted[r[0]][0] >= r[1] and noted[r[0]][1] >= r[2] for r in rows)
    assert len(glob.glob(f"{path}/_bounds/*.json")) == 1


def test_messages_are_decoded_in_compiled_methods_from_one_scan(spark):
    """generated methods beyond the JVM's limit would be interpreted for every row."""
    valid = from_sf(spark, SF001, table_times=True).valid
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


class _Seen(Exception):
    pass


@pytest.mark.parametrize("query, operator, at", [
    ("k3_raw_insert_two_deliveries", "insert_ignore_duplicates", 1), ("k3_raw_insert_late_delivery", "insert_ignore_duplicates", 1),
    ("m7_refresh_from_log", "insert_ignore_duplicates", 1), ("m1_delta_refresh", "insert_and_add", 1),
    ("w1_stream_metrics_out_of_order", "add_partials", 1), ("w2_metrics_after_compaction", "add_partials", 1)])
def test_messages_are_parsed_once_for_all_deliveries(spark, monkeypatch, query, operator, at):
    def look(*args, **kwargs):
        assert "InMemoryRelation" in args[at]._jdf.queryExecution().withCachedData().toString()
        raise _Seen
    monkeypatch.setattr(E, operator, look)
    with pytest.raises(_Seen):
        E.queries()[query](spark, SF001)
