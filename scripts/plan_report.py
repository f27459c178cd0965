"""Print the physical-plan essentials of the main operators and queries.

Builds the tables once from a scale-factor folder (default sf0.01) in a fresh
scratch folder, then for each plan lists: exchanges, aggregate operators,
top-k, joins, and for every Parquet scan its PartitionFilters,
PushedFilters and ReadSchema. Output is Markdown (PLANS.md is made from it).
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from eventspark.operators.metrics import window_metrics  # noqa: E402
from eventspark.operators.rollups import read_rollup, refresh, rollup_1min  # noqa: E402
from eventspark.operators.tables import metrics_table, upsert_metrics, write_raw  # noqa: E402
from eventspark.plans import feeds, queries as Q, reports as R  # noqa: E402
from eventspark.plans.derive import from_sf  # noqa: E402
from eventspark.session import build_session  # noqa: E402

KEEP = ("Exchange", "Aggregate", "TakeOrderedAndProject", "Join", "Window", "Sort ", "Union", "Filter", "Expand")


def essentials(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.split("\n"):
        s = line.strip().lstrip("+-: ").strip()
        if s.startswith(("AdaptiveSparkPlan",)):
            continue
        head = re.sub(r"^\*\(\d+\) ", "", s)[:40]
        if any(k in head for k in KEEP):
            s = re.sub(r"#\d+L?", "", s)
            out.append(s[:160])
        if "FileScan parquet" in s:
            name = re.search(r"Location: \w+(?:\(\d+ paths\))?\[file:[^\]]*/([^/\]]+)\]", s)
            pf = re.search(r"PartitionFilters: (\[[^\]]*\])", s)
            pu = re.search(r"PushedFilters: (\[[^\]]*\])", s)
            rs = re.search(r"ReadSchema: (.*)$", s)
            out.append(f"Scan {name.group(1) if name else '?'}: PartitionFilters {re.sub(r'#[0-9]+L?', '', pf.group(1)) if pf else '-'}; "
                       f"PushedFilters {pu.group(1) if pu else '-'}; ReadSchema {rs.group(1) if rs else '-'}")
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.checkpoint.dir": f"{scratch}/ck", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    d = from_sf(spark, sf)
    write_raw(d.raw, f"{scratch}/financial_events", "overwrite")
    upsert_metrics(spark, window_metrics(d.valid), f"{scratch}/financial_event_metrics", F.col("bucket_end"))
    raw = spark.read.parquet(f"{scratch}/financial_events")
    t = raw.agg(F.max(F.unix_micros("event_time"))).first()[0]
    hour = 3_600_000_000
    as_of = (t // hour + 1) * hour
    refresh(spark, raw, f"{scratch}/events_1min", "events_1min", as_of - 25 * hour, as_of)
    refresh(spark, read_rollup(spark, f"{scratch}/events_1min"), f"{scratch}/events_15min", "events_15min", as_of - 26 * hour, as_of)
    metrics = metrics_table(spark, f"{scratch}/financial_event_metrics").read()
    minute = read_rollup(spark, f"{scratch}/events_1min")
    quarter = read_rollup(spark, f"{scratch}/events_15min", "events_15min")
    plans = {
        "A1 ingest -> 10-s metrics (JSON text in)": d.metrics,
        "K3 ingest -> raw table, first copy wins": d.raw,
        "Q01 last 5 minutes (raw, now = literal)": Q.q01_last_5_minutes(raw, t),
        "Q03 last 24 hours (raw)": Q.q03_last_24_hours(raw, t),
        "Q04 latency by scenario (raw)": Q.q04_latency_by_scenario(raw),
        "Q05 throughput per second, top 120": Q.q05_throughput_per_second(raw),
        "Q06 recent events": Q.q06_recent_events(raw),
        "Q08 aggregated throughput, top 120": Q.q08_aggregated_throughput(metrics),
        "Q10 1-min roll-up, last 5 minutes": Q.q10_rollup_last_5_minutes(minute, t),
        "Q12 15-min roll-up, last 24 hours": Q.q12_rollup_last_24_hours(quarter, t),
        "M1 1-min roll-up over raw": rollup_1min(raw),
        "R1 latency report": R.r1_latency_by_scenario(raw),
        "D1 avg price per symbol": feeds.d1_avg_price_per_symbol(metrics),
    }
    print(f"# Physical plans (essentials)\n\nGenerated by `scripts/plan_report.py {sf}` on Spark "
          f"{spark.version}, AQE on (initial plans shown; AQE may coalesce partitions or switch "
          f"a join to broadcast after measuring).\n")
    for name, df in plans.items():
        print(f"## {name}\n\n```")
        for line in essentials(df):
            print(line)
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
