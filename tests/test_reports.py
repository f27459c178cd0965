"""Run-artefact reports (CSV in, CSV out), catalogue check, feeds."""

import csv
import os

from pyspark.sql import functions as F

from eventspark.plans import feeds, queries as Q, reports as R
from eventspark.plans.derive import from_sf
from eventspark.sources.connect import raw_topic, write_csv
from tests.conftest import SF001

BOM = "﻿"


def _write(path, header, rows, bom=True):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write((BOM if bom else "") + ",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_query_timings_and_resource_usage(spark, scratch):
    root = f"{scratch}/results"
    th = ["query", "window", "scenario", "type", "elapsed_ms"]
    _write(f"{root}/20260101-101010-low/query-response-times.csv", th,
           [["01-last-5-minutes", "5min", "low", "raw", "120.5"], ["", "", "", "", ""],
            ["query", "window", "scenario", "type", "elapsed_ms"]])
    _write(f"{root}/20260101-111111-high/query-response-times.csv", th,
           [["10-cagg-last-5-minutes", "5min", "high", "cagg", "33.25"]])
    _write(f"{root}/Summary-20260101/query-response-times.csv", th, [["x", "y", "z", "raw", "1"]])
    sh = ["timestamp_utc", "container", "cpu_percent", "memory_usage", "memory_percent", "net_io", "block_io"]
    _write(f"{root}/20260101-101010-low/docker-stats-samples.csv", sh,
           [["t", "kafka", "10.00%", "1GiB / 2GiB", "1.115%", "0B / 0B", "0B / 0B"],
            ["t", "kafka", "12.50%", "1GiB / 2GiB", "1.12%", "0B / 0B", "0B / 0B"],
            ["t", "db", "2.125%", "1GiB / 2GiB", "3.00%", "0B / 0B", "0B / 0B"]])
    _write(f"{root}/20260101-111111-high/docker-stats-samples.csv", sh,
           [["t", "kafka", "50%", "1GiB / 2GiB", "5%", "0B / 0B", "0B / 0B"]], bom=False)

    t = R.r6_query_timings(spark, root)
    got = sorted(tuple(r) for r in t.collect())
    assert got == [("01-last-5-minutes", "5min", "low", "raw", "120.5"),
                   ("10-cagg-last-5-minutes", "5min", "high", "cagg", "33.25")]

    u = [tuple(r) for r in R.r7_resource_usage(spark, root).collect()]
    assert u == [("high", "kafka", 1, 50.0, 5.0),
                 ("low", "db", 1, 2.12, 3.0),          # 2.125 rounds half to even
                 ("low", "kafka", 2, 11.25, 1.12)]     # (1.115 + 1.12) / 2 = 1.1175 -> 1.12

    out = f"{scratch}/summary/resource-usage-summary"
    write_csv(R.r7_resource_usage(spark, root), out, single_file=True)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    with open(os.path.join(out, files[0]), encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["scenario", "container", "sample_count", "avg_cpu_percent", "avg_mem_percent"]
    assert len(rows) == 4


def test_healthcheck(spark):
    spark.sql("DROP TABLE IF EXISTS financial_events")
    spark.sql("DROP TABLE IF EXISTS financial_event_metrics")
    spark.sql("CREATE TABLE financial_events (event_id STRING, event_time TIMESTAMP, event_date DATE) "
              "USING parquet PARTITIONED BY (event_date)")
    spark.sql("CREATE TABLE financial_event_metrics (bucket_start TIMESTAMP, bucket_date DATE) "
              "USING parquet PARTITIONED BY (bucket_date)")
    r = Q.q00_healthcheck(spark)
    assert [x["table_name"] for x in r["tables"].collect()] == ["financial_events"]
    assert [(x["table_name"], x["num_dimensions"]) for x in r["partitioned"].collect()] == [
        ("financial_event_metrics", 1), ("financial_events", 1)]


def test_topic_choice():
    assert raw_topic({}) == "financial-events-raw"
    assert raw_topic({"KAFKA_TOPIC_EVENTS": "legacy"}) == "legacy"
    assert raw_topic({"KAFKA_TOPIC_RAW": " ", "KAFKA_TOPIC_EVENTS": "legacy"}) == "legacy"
    assert raw_topic({"KAFKA_TOPIC_RAW": "new", "KAFKA_TOPIC_EVENTS": "legacy"}) == "new"


def test_feeds_consistent_with_metrics(spark):
    d = from_sf(spark, SF001)
    m = d.metrics
    total = m.agg(F.sum("event_count")).first()[0]
    assert feeds.d6_total_events(m).first()["total_events"] == total
    assert feeds.d2_volume_per_symbol(m).agg(F.sum("volume")).first()[0] == m.agg(F.sum("total_quantity")).first()[0]
    assert feeds.d5_persisted_throughput(m).agg(F.sum("events")).first()[0] == total
    assert feeds.d8_recent_events(d.raw).count() == 20
