"""The same results on a machine whose own zone is not UTC."""

import os
import subprocess
import sys

PROBE = """
import datetime as dt, sys
from decimal import Decimal
from pyspark.sql import functions as F
from eventspark.operators import tables as K
from eventspark.operators.rollups import read_rollup, refresh, refresh_spans
from eventspark.plans.queries import q01_last_5_minutes
from eventspark.session import build_session
from eventspark.streaming.jobs import touched_spans
base = sys.argv[1]
spark = build_session("local[2]", shuffle_partitions=2, extra={"spark.checkpoint.dir": base + "/ckpt", "spark.ui.showConsoleProgress": "false"})
def rows(*texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "event_id string, t string")
    t = F.to_timestamp("t")
    return df.select("event_id", F.lit("p").alias("producer_id"), F.lit("AAA").alias("symbol"), F.lit("1").cast("decimal(38,18)").alias("price"), F.lit(1).alias("quantity"),
        t.alias("event_time"), t.alias("producer_time"), t.alias("processing_time"), F.lit("s").alias("source"), F.lit("low").alias("scenario"), F.lit(1).cast("long").alias("sequence"),
        F.lit(0).cast("long").alias("ingestion_latency_ms"), F.lit(0).cast("long").alias("event_lag_ms"), t.alias("created_at"), F.to_date(t).alias("event_date"))
one = rows("2024-01-02T01:00:00Z")
for _ in range(2):
    K.insert_ignore_duplicates(spark, one, base + "/raw")
inserted = spark.read.parquet(base + "/raw").count()
day = rows("2024-01-02T00:30:00Z", "2024-01-02T23:30:00Z", "2024-01-01T23:30:00Z", "2024-01-03T00:30:00Z")
refresh(spark, day, base + "/m1", "events_1min", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))
in_day = read_rollup(spark, base + "/m1").count()
for t in ("2024-01-02T00:30:00Z", "2024-01-02T23:30:00Z"):
    batch = rows(t)
    refresh_spans(spark, batch, base + "/m2", "events_1min", touched_spans(batch))
spans = read_rollup(spark, base + "/m2").count()
recent = q01_last_5_minutes(day, dt.datetime(2024, 1, 2, 23, 33)).where("events > 0").count()
print("COUNTS", inserted, in_day, spans, recent)
"""


def test_results_do_not_depend_on_the_machine_s_zone(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"TZ": "America/Sao_Paulo", "PYTHONPATH": repo}
    done = subprocess.run([sys.executable, "-c", PROBE, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300, cwd=repo)
    assert "COUNTS 1 2 2 2" in done.stdout, done.stdout[-500:] + done.stderr[-3000:]
