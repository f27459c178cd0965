"""Benchmark: the reference's timed query set (Q01-Q03 on the raw table
against Q10-Q12 on the roll-ups) plus the ingestion job itself.

Setup (not timed): the raw JSON stream derived from ``events`` is ingested
once into a Parquet raw table (partitioned by day, time-sorted), the
10-second metrics table and both roll-ups (range refresh), in a fresh
scratch folder. Timed: each query, median of ``BENCH_RUNS`` runs after one
warm-up; every run computes the full result (collected, or written to the
``noop`` sink for the ingestion jobs).

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from eventspark.operators.metrics import window_metrics  # noqa: E402
from eventspark.operators.rollups import read_rollup, refresh  # noqa: E402
from eventspark.operators.tables import metrics_table, upsert_metrics, write_raw  # noqa: E402
from eventspark.plans import queries as Q  # noqa: E402
from eventspark.plans import reports as R  # noqa: E402
from eventspark.plans.derive import bench_from_sf, from_sf  # noqa: E402
from eventspark.session import build_session  # noqa: E402
from eventspark.sources.connect import text_sink, text_source  # noqa: E402
from eventspark.sources.fixtures import event_stream  # noqa: E402
from eventspark.streaming.jobs import Paths, start_ingest, start_metrics, start_rollup_refresh  # noqa: E402

HOUR = 3_600_000_000


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = build_session(f"local[{cpus}]", app_name="eventspark-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                                 "spark.checkpoint.dir": f"{scratch}/checkpoints",
                                 "spark.sql.files.maxPartitionBytes": str(32 << 20)})
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")

    # ---------------------------------------------------------------- setup
    splits = int(cpus)  # the tables are one file each
    d = from_sf(spark, sf_dir, splits)
    raw_path, metrics_path = f"{scratch}/financial_events", f"{scratch}/financial_event_metrics"
    minute_path, quarter_path = f"{scratch}/events_1min", f"{scratch}/events_15min"
    write_raw(d.raw, raw_path, "overwrite")
    upsert_metrics(spark, window_metrics(d.valid), metrics_path, F.col("bucket_end"))
    raw = spark.read.parquet(raw_path)
    now = raw.agg(F.max(F.unix_micros("event_time"))).first()[0]  # a literal "now": static pruning + pushed filters
    as_of = (now // HOUR + 1) * HOUR
    refresh(spark, raw, minute_path, "events_1min", as_of - 25 * HOUR, as_of)
    refresh(spark, read_rollup(spark, minute_path, "events_1min"), quarter_path, "events_15min", as_of - 26 * HOUR, as_of)
    metrics = metrics_table(spark, metrics_path).read()
    minute, quarter = read_rollup(spark, minute_path, "events_1min"), read_rollup(spark, quarter_path, "events_15min")
    # the same over the table's own 30 days, where partitions can be pruned
    long_path = f"{scratch}/financial_events_30d"
    write_raw(from_sf(spark, sf_dir, splits, table_times=True).raw, long_path, "overwrite")
    long_raw = spark.read.parquet(long_path)
    long_now = long_raw.agg(F.max(F.unix_micros("event_time"))).first()[0]
    rows = {"raw": raw.count(), "metrics": metrics.count(), "minute": minute.count(), "quarter": quarter.count(),
            "lineitem_events": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()}

    def collect(df_fn):
        return lambda: df_fn().collect()

    def noop(df_fn):
        return lambda: df_fn().write.format("noop").mode("overwrite").save()

    jobs = {
        "q01_last_5_minutes": collect(lambda: Q.q01_last_5_minutes(raw, now)),
        "q02_last_1_hour": collect(lambda: Q.q02_last_1_hour(raw, now)),
        "q03_last_24_hours": collect(lambda: Q.q03_last_24_hours(raw, now)),
        "q10_rollup_last_5_minutes": collect(lambda: Q.q10_rollup_last_5_minutes(minute, now)),
        "q11_rollup_last_1_hour": collect(lambda: Q.q11_rollup_last_1_hour(minute, now)),
        "q12_rollup_last_24_hours": collect(lambda: Q.q12_rollup_last_24_hours(quarter, now)),
        "q04_latency_by_scenario": collect(lambda: Q.q04_latency_by_scenario(raw)),
        "q05_throughput_per_second": collect(lambda: Q.q05_throughput_per_second(raw)),
        "q06_recent_events": collect(lambda: Q.q06_recent_events(raw)),
        "q07_aggregated_metrics_recent": collect(lambda: Q.q07_aggregated_metrics_recent(metrics)),
        "q08_aggregated_throughput": collect(lambda: Q.q08_aggregated_throughput(metrics)),
        "q09_events_by_producer": collect(lambda: Q.q09_events_by_producer(raw)),
        "r1_latency_by_scenario": collect(lambda: R.r1_latency_by_scenario(raw)),
        "r4_minute_by_minute": collect(lambda: R.r4_minute_by_minute(raw)),
        "q02_last_1_hour_of_30_days": collect(lambda: Q.q02_last_1_hour(long_raw, long_now)),
        "q03_last_24_hours_of_30_days": collect(lambda: Q.q03_last_24_hours(long_raw, long_now)),
        # upsert of one hour's windows into the stored metrics
        "k4_metrics_upsert_one_hour": lambda: upsert_metrics(
            spark, metrics.where(F.unix_micros("bucket_start") >= now - HOUR).drop("created_at", "bucket_date"), metrics_path, F.col("bucket_end")),
        # the streaming job's work, in batch form, on the whole stream
        "a1_ingest_window_metrics": noop(lambda: from_sf(spark, sf_dir, splits).metrics),
        "k3_ingest_raw_table": noop(lambda: from_sf(spark, sf_dir, splits).raw),
        "a1_ingest_window_metrics_lineitem": noop(lambda: bench_from_sf(spark, sf_dir, splits).metrics),
    }
    timings = {}
    for name, job in jobs.items():
        job()  # warm-up
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            job()
            ts.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(ts), 4)

    # The streaming job (query A) end to end: the raw stream as 4 files, one
    # micro-batch per file; decode, processed + invalid sinks, first-wins
    # insert into the day-partitioned raw table. Fresh output per run.
    src_dir = f"{scratch}/stream-source"
    stream = event_stream(spark, sf_dir, splits)
    stamp = F.unix_micros("processing_time")
    lo, hi = stream.agg(F.min(stamp), F.max(stamp)).first()
    for i in range(4):
        part = stream.filter(F.floor((stamp - lo) * 4 / (hi - lo + 1)) == i)
        part.coalesce(1).write.mode("append").parquet(src_dir)  # one file per delivery
    n_messages = spark.read.parquet(src_dir).count()

    def stream_run(tag):
        """Seconds of queries A, B and the roll-up refresh, one after another."""
        base = f"{scratch}/stream-{tag}"
        paths = Paths(f"{base}/raw", f"{base}/metrics", f"{base}/ckpt-a", f"{base}/ckpt-b", f"{base}/rejected")
        src = spark.readStream.schema("value string, processing_time timestamp, arrival long") \
            .option("maxFilesPerTrigger", 1).parquet(src_dir)
        out, once = [], {"availableNow": True}
        for start in (lambda: start_ingest(spark, src, paths, text_sink(f"{base}/processed"), text_sink(f"{base}/invalid"), processing_time_col="processing_time", trigger=once),
                      lambda: start_metrics(spark, text_source(spark, f"{base}/processed"), paths, trigger=once),
                      lambda: start_rollup_refresh(spark, paths.raw_table, f"{base}/m1", f"{base}/m15", f"{base}/ckpt-r", trigger=once)):
            t0 = time.perf_counter()
            start().awaitTermination()
            out.append(time.perf_counter() - t0)
        return out

    stream_run("warm")
    timed = [stream_run(f"r{i}") for i in range(runs)]
    for k, name in enumerate(("stream_query_a_ingest", "stream_query_b_metrics", "stream_rollup_refresh")):
        timings[name] = round(statistics.median(t[k] for t in timed), 4)

    headline = ["q01_last_5_minutes", "q02_last_1_hour", "q03_last_24_hours",
                "q10_rollup_last_5_minutes", "q11_rollup_last_1_hour", "q12_rollup_last_24_hours"]
    out = {
        "metric": "sum of median wall seconds, Q01-Q03 raw + Q10-Q12 roll-up",
        "value": round(sum(timings[h] for h in headline), 4),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir),
        "cpus": int(cpus),
        "runs": runs,
        "rows": rows,
        "ingest_events_per_sec_lineitem": round(rows["lineitem_events"] / timings["a1_ingest_window_metrics_lineitem"], 1),
        "stream_query_a_events_per_sec": round(n_messages / timings["stream_query_a_ingest"], 1),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
