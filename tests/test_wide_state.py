"""The state and the metrics table under deliveries of very many hours (F1 of
round 4): what the driver does, and the exchanges, don't grow with hours times
calls; the results are those of the batch form."""

import contextlib
import datetime as dt
import glob
import io
import pathlib
import re
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from eventspark.functions.numeric import average_of_sums, ratio_half_up
from eventspark.operators import files, tables as K
from eventspark.operators.metrics import merge_partials, metrics_of_partials, window_metrics, window_partials
from eventspark.operators.partials import PartialStore
from eventspark.plans.derive import from_sf
from eventspark.schema import METRIC_COLUMNS
from eventspark.session import LISTING_TASKS, LONGEST_METHOD
from eventspark.streaming.jobs import add_partials
from tests.conftest import SF001

HOURS = 150


def _events(spark, hours=HOURS, a_minute=1, first=0):
    start = F.timestamp_micros(F.floor(F.col("id") / a_minute) * 60_000_000)
    return spark.range(first, hours * 60 * a_minute).select(
        start.alias("processing_time"), F.concat(F.lit("S"), F.col("id") % 3).alias("symbol"), F.lit("low").alias("scenario"),
        (F.col("id") % 7).alias("ingestion_latency_ms"), (F.col("id") % 11 + F.lit("0.25").cast("decimal(3,2)")).cast("decimal(38,18)").alias("price"),
        F.lit(1).alias("quantity"), (F.col("id") % 5).alias("event_lag_ms"))


def _tasks(spark, step):
    """The most tasks that a stage of ``step`` has."""
    sc = spark.sparkContext
    group = f"counted-{id(step)}"
    sc.setJobGroup(group, "counted")
    try:
        step()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max((s.numTasks for s in stages if s), default=0)


def test_state_of_many_hours_is_listed_in_few_calls(spark, scratch, monkeypatch):
    calls = []
    for name in ("names", "exists"):
        of = getattr(files.Folder, name)
        monkeypatch.setattr(files.Folder, name, lambda self, *a, of=of: calls.append(a) or of(self, *a))
    events, hours = _events(spark), list(range(HOURS))
    store = PartialStore(spark, f"{scratch}/state", merge_after=2)
    for epoch in range(3):
        store.add(window_partials(events), hours, epoch)
        assert store.compact(hours, epoch) == (hours if epoch == 2 else [])
    assert set(store.watermarks([*hours, 10**6]).items()) == {(h, 1) for h in hours} | {(10**6, -1)}
    assert _tasks(spark, lambda: store.read(hours)) <= LISTING_TASKS
    store.add(window_partials(events), hours, 1)       # merged long ago: nothing comes twice
    assert store.read(hours).agg(F.sum("n")).first()[0] == 3 * HOURS * 60
    assert len(calls) <= 20, len(calls)                # not some for each hour and delivery


def test_listing_finds_what_single_listings_find(spark, scratch):
    folder = files.Folder(spark, f"{scratch}/a, b")
    for name in ("x=-1/e=2", "x=-1/e=10", "x=7/e=1"):
        pathlib.Path(f"{scratch}/a, b/{name}").mkdir(parents=True)
        pathlib.Path(f"{scratch}/a, b/{name}/part, 1.txt").write_text("t")
    assert folder.names_in(["x=-1", "x=7", "x=8"]) == {"x=-1": ["e=10", "e=2"], "x=7": ["e=1"]}
    assert folder.names_in([]) == {} and folder.glob("y=*") == []
    assert folder.glob("x=*/e=*/part*") == ["x=-1/e=10/part, 1.txt", "x=-1/e=2/part, 1.txt", "x=7/e=1/part, 1.txt"]


def test_metrics_of_the_state_take_one_exchange_and_compiled_methods(spark, scratch):
    last = None
    for epoch in range(2):
        last = add_partials(spark, _events(spark, 3), f"{scratch}/state", epoch, 10)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(bucket_start#\d+, \d+\)", plan)
    assert not re.search(r"hashpartitioning\(bucket_start#\d+, symbol", plan), plan
    adaptive = "spark.sql.adaptive.enabled"
    spark.conf.set(adaptive, "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            last.select("*").explain("codegen")
    finally:
        spark.conf.set(adaptive, "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) <= LONGEST_METHOD, sizes


def test_partials_of_one_latency_count_on_from_each_other(spark):
    valid = from_sf(spark, SF001).valid
    several = window_partials(valid.where("sequence % 3 = 0"), 600).unionByName(window_partials(valid.where("sequence % 3 <> 0"), 600)).unionByName(window_partials(valid, 600))
    one, twice = metrics_of_partials(merge_partials(several), 600), valid.unionByName(valid)
    want = sorted(map(str, window_metrics(twice, 600).select(*METRIC_COLUMNS).collect()))
    assert want and sorted(map(str, metrics_of_partials(several, 600).collect())) == want == sorted(map(str, one.collect()))


def test_deliveries_of_many_hours_give_the_metrics_of_the_batch(spark, scratch):
    events, path = _events(spark, 30, 4).withColumn("id", F.monotonically_increasing_id()).persist(), f"{scratch}/metrics"
    for epoch in (0, 1, 2, 3, 2, 0, 4):
        batch = events.where((F.col("id") % 5 == epoch) & (F.hour("processing_time") != epoch))
        K.upsert_metrics(spark, add_partials(spark, batch, f"{scratch}/state", epoch, 10, merge_after=2), path, F.col("bucket_end"))
    every = events.where((F.col("id") % 5 <= 4) & (F.hour("processing_time") != F.col("id") % 5))
    got, want = K.metrics_table(spark, path).read().select(*METRIC_COLUMNS), window_metrics(every).select(*METRIC_COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    newest = {v for v, _ in K.metrics_table(spark, path).hours().values()}
    assert all(len(glob.glob(f"{path}/data/version={v}/*/bucket_hour=*/*.parquet")) <= 30 for v in newest)
    events.unpersist()


def test_upsert_keeps_the_rows_of_other_keys(spark, scratch):
    path, key = f"{scratch}/metrics", ["bucket_start", "symbol"]
    first, second = window_metrics(_events(spark, 5)), window_metrics(_events(spark, 7, 1, 3 * 60).where("symbol <> 'S1'")).withColumn("event_count", F.lit(9).cast("long"))
    K.upsert_metrics(spark, first, path, F.col("bucket_end"))
    K.upsert_metrics(spark, second, path, F.col("bucket_end"))
    want = {r[:] for r in first.select(*key, "event_count").collect()}
    new = {r[:] for r in second.select(*key, "event_count").collect()}
    want = {r for r in want if r[:2] not in {n[:2] for n in new}} | new
    got = [r[:] for r in K.metrics_table(spark, path).read().select(*key, "event_count").collect()]
    assert len(got) == len(want) and set(got) == want
    # a part of an hour for each task where there are fewer hours than tasks
    live = K.metrics_table(spark, path)
    hour = dt.datetime(1970, 1, 1, 6, 30, tzinfo=dt.timezone.utc)
    assert live.read(hours=[6]).where(F.col("bucket_start") >= F.lit(hour)).count() == 20


@pytest.mark.parametrize("scale", [2, 6])
def test_averages_are_exact_on_either_side_of_their_fast_path(spark, scale):
    unit = Decimal(1).scaleb(-scale)
    sums = [Decimal(0), Decimal("0.000000000000000001"), Decimal("0.0000015"), Decimal("0.000004499999999999"), Decimal("0.0000045"), Decimal("1.005"),
            Decimal("99999999999.999999999999999999"), Decimal(10**11), Decimal("123456789012.000000499999999999")]
    rows = [(s, n) for s in sums for n in (1, 2, 3, 7, 10**9 - 1, 10**9)]
    df = spark.createDataFrame([(str(s), n) for s, n in rows], "s string, n long").withColumn("s", F.col("s").cast("decimal(38,18)"))
    none = F.lit(None).cast("decimal(38,0)")
    got = [r[0] for r in df.select(average_of_sums(F.col("s"), none, none, F.col("n"), scale)).collect()]
    with_large = [r[0] for r in df.select(average_of_sums(F.col("s"), F.lit(0).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"), F.col("n"), scale)).collect()]

    def exact(s, n):
        whole = int(Fraction(s) * 10**18) * 2 + n * 10 ** (18 - scale)
        return Decimal(whole // (2 * n * 10 ** (18 - scale))) * unit
    want = [exact(s, n) for s, n in rows]
    assert got == with_large == want
    pairs = [(a, b) for a in (0, 1, 5, 2**61 // 10**scale - 1, 2**61 // 10**scale, 2**63 - 1) for b in (1, 2, 3, 8, 10**9, 2**61 // 10**scale)]
    longs = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in longs.select(ratio_half_up(F.col("a"), F.col("b"), scale)).collect()]
    assert got == [(Decimal((2 * a * 10**scale + b) // (2 * b)) * unit) for a, b in pairs]
