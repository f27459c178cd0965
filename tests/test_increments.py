"""Work that must not grow with the table: key look-up, refresh, state, top-k."""

import datetime as dt
import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from eventspark.operators import keyindex, spans as S, tables as K
from eventspark.operators.metrics import PARTIALS_SCHEMA, metrics_of_partials, merge_partials, percentiles_of_partials, window_metrics, window_partials
from eventspark.operators.moments import insert_and_add
from eventspark.operators.partials import PartialStore
from eventspark.operators.percentiles import spread_percentiles
from eventspark.operators.recent import CREATED, bounds, days_for_top, rows_for_last_seconds, rows_for_recent_events
from eventspark.operators.rollups import read_rollup, refresh_from_log, rollup_1min, rollup_15min
from eventspark.operators.spans import SpanLog
from eventspark.operators.store import hour_of
from eventspark.plans.derive import from_sf
from eventspark.plans.queries import q04_latency_by_scenario, q05_throughput_per_second, q06_recent_events, q09_events_by_producer
from eventspark.plans.reports import r1_latency_by_scenario
from eventspark.schema import METRIC_COLUMNS, RAW_TABLE_SCHEMA
from eventspark.streaming.jobs import add_partials
from tests.conftest import SF001
from tests.test_tables import T0, _raw_rows, _row


def _delivery(spark, start, n, tag, step=1.0):
    """n events from ``start`` on, ``step`` seconds apart."""
    times = [start + dt.timedelta(seconds=i * step) for i in range(n)]
    return _raw_rows(spark, [_row(f"{tag}-{i}", t, t + dt.timedelta(seconds=1)) for i, t in enumerate(times)])


# ------------------------------------------------------------------- keys

def test_bloom_filters_miss_no_key_and_rarely_err(spark):
    n = 20_000
    rows = spark.range(n).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.col("id").cast("string").alias("event_id"),
                                 F.timestamp_micros(F.col("id") * 170_000).alias("event_time"))
    index = keyindex.filters(rows).cache()
    blocks = {r["file"]: r["n"] for r in index.groupBy("file").agg(F.count("block").alias("n")).collect()}
    assert set(blocks) == {"f0", "f1"} and all(F_ <= 12 for F_ in blocks.values())  # 10,000 keys, 1,024 a block

    def matches(keys):
        near = keys.withColumns({"event_hour": hour_of("event_time")}).join(index, "event_hour").where(
            F.col("block") == F.pmod(keyindex._hash(0), F.col("n_blocks"))).withColumn("probes", keyindex._probes())
        return near.where(F.forall("probes", keyindex._is_set)).select("event_id", "file")

    found = matches(rows.select("event_id", "event_time"))
    own = found.join(rows.select("event_id", F.col("file").alias("own")), "event_id")
    assert own.where("file = own").count() == n                       # none missed
    others = spark.range(n).select(F.concat(F.lit("x"), "id").alias("event_id"), F.timestamp_micros(F.col("id") * 170_000).alias("event_time"))
    assert matches(others).count() <= 3 and own.where("file != own").count() <= 3


def test_a_delivery_opens_only_files_that_may_hold_its_keys(spark, scratch):
    path = f"{scratch}/raw"
    opened, index_bytes = [], []
    for hour in range(10):  # the day fills up
        batch = _delivery(spark, T0 + dt.timedelta(hours=hour), 60, f"h{hour}", 20)
        opened.append(K.insert_ignore_duplicates(spark, batch, path))
        folders = keyindex.hour_folders(spark, path, [int((T0 + dt.timedelta(hours=hour)).replace(tzinfo=dt.timezone.utc).timestamp()) // 3600])
        index_bytes.append(sum(f.stat().st_size for x in folders for f in pathlib.Path(x.removeprefix("file:")).glob("*.parquet")))
    assert opened == [[]] * 10                                          # no stored row was read
    assert max(index_bytes) < 1.2 * min(index_bytes) and spark.read.parquet(path).count() == 600
    # a delivery that repeats five old events and brings one new opens one file
    old = _delivery(spark, T0 + dt.timedelta(hours=3), 5, "h3", 20).union(_delivery(spark, T0 + dt.timedelta(hours=3, seconds=7), 1, "late"))
    again = K.insert_ignore_duplicates(spark, old, path)
    files = len(list(pathlib.Path(path).glob("event_date=*/*.parquet")))
    assert 1 <= len(again) <= files / 5 and spark.read.parquet(path).count() == 601
    assert K.insert_ignore_duplicates(spark, old, path) and spark.read.parquet(path).count() == 601


def test_files_from_before_the_index_are_found(spark, scratch):
    path = f"{scratch}/raw"
    batch = _delivery(spark, T0, 20, "a", 60)
    batch.write.partitionBy("event_date").parquet(path)
    K.insert_ignore_duplicates(spark, batch.union(_delivery(spark, T0, 1, "b")), path)
    assert spark.read.parquet(path).count() == 21 and list(bounds(spark, path)) == ["2024-01-01"]


def test_a_write_that_dies_leaves_no_rows(spark, scratch, monkeypatch):
    path = f"{scratch}/raw"
    K.insert_ignore_duplicates(spark, _delivery(spark, T0, 10, "a"), path)
    more = _delivery(spark, T0, 10, "b")
    with monkeypatch.context() as m:
        m.setattr(K.Folder, "move", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            K.insert_ignore_duplicates(spark, more, path)
    assert spark.read.parquet(path).count() == 10
    # the index names files that never came; the delivery is repeated as if nothing had happened
    K.insert_ignore_duplicates(spark, more, path)
    assert spark.read.parquet(path).count() == 20
    assert SpanLog(spark, path).take()[1]


def test_rejected_rows_are_found_in_one_pass(spark, scratch):
    seen = spark.sparkContext.accumulator(0)
    good = _delivery(spark, T0, 50, "a")
    bad = _raw_rows(spark, [_row("bad", T0, T0, price="0")])

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = good.union(bad).mapInPandas(count, good.schema)
    K.insert_ignore_duplicates(spark, rows, f"{scratch}/raw", rejected_path=f"{scratch}/rejected")
    assert seen.value == 51 and spark.read.parquet(f"{scratch}/raw").count() == 50 and spark.read.parquet(f"{scratch}/rejected").count() == 1


# ------------------------------------------------------------------ spans

def test_span_sets():
    assert S.merged([(5, 7), (0, 2), (2, 3), (6, 9), (4, 4)]) == [(0, 3), (5, 9)]
    assert S.common([(0, 10), (20, 30)], [(5, 25)]) == [(5, 10), (20, 25)]
    assert S.without([(0, 10), (20, 30)], [(5, 25)]) == [(0, 5), (25, 30)]
    assert S.widened([(3, 4), (17, 21)], 10) == [(0, 30)] and S.widened([(-3, -1)], 10) == [(-10, 0)]
    assert S.at_most([(0, 1), (2, 3), (10, 11), (12, 13), (50, 51)], 3) == [(0, 3), (10, 13), (50, 51)]


def _rollups_equal(spark, path, minute, quarter):
    raw = spark.read.parquet(path)
    digits = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])
    for table, which, want in ((minute, "events_1min", rollup_1min(raw)), (quarter, "events_15min", rollup_15min(rollup_1min(raw)))):
        got = read_rollup(spark, table, which)
        assert sorted(map(str, digits(got).collect())) == sorted(map(str, digits(want.select(*got.columns)).collect()))


def test_a_late_row_refreshes_only_its_span(spark, scratch):
    path, minute, quarter = (f"{scratch}/{n}" for n in ("raw", "m1", "m15"))
    for hour in (0, 5, 30):
        K.insert_ignore_duplicates(spark, _delivery(spark, T0 + dt.timedelta(hours=hour), 30, f"h{hour}", 60), path)
    done = refresh_from_log(spark, path, minute, quarter)
    assert len(done["events_1min"]) == 3
    _rollups_equal(spark, path, minute, quarter)
    log = SpanLog(spark, path)
    assert log.take() == ([], []) and refresh_from_log(spark, path, minute, quarter) == {"events_1min": [], "events_15min": []}
    # one late row: one entry, one quarter of an hour, the other hours' files stay
    before = {str(f) for f in pathlib.Path(minute).rglob("part-*.parquet")}
    K.insert_ignore_duplicates(spark, _delivery(spark, T0 + dt.timedelta(hours=5, minutes=3), 1, "late"), path)
    assert len(log.folder.names()) == 1
    done = refresh_from_log(spark, path, minute, quarter)
    lo = int((T0 + dt.timedelta(hours=5)).replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6
    assert done == {"events_1min": [(lo, lo + 900_000_000)], "events_15min": [(lo, lo + 900_000_000)]}
    assert before <= {str(f) for f in pathlib.Path(minute).rglob("part-*.parquet")}
    _rollups_equal(spark, path, minute, quarter)


def test_policies_leave_the_open_bucket_in_the_log(spark, scratch):
    path, minute, quarter = (f"{scratch}/{n}" for n in ("raw", "m1", "m15"))
    K.insert_ignore_duplicates(spark, _delivery(spark, T0, 120, "a", 60), path)      # two hours
    now = int((T0 + dt.timedelta(hours=2)).replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6
    minutes = lambda m: now - m * 60_000_000
    done = refresh_from_log(spark, path, minute, quarter, now)
    assert done == {"events_1min": [(minutes(120), minutes(1))], "events_15min": [(minutes(120), minutes(15))]}
    assert SpanLog(spark, path).take()[1] == [(minutes(1), now)] and SpanLog(spark, minute).take()[1] == [(minutes(15), now)]
    # later the rest; what is older than the policy's range is given up
    later = now + 3_600_000_000
    assert refresh_from_log(spark, path, minute, quarter, later)["events_1min"] == [(minutes(1), now)]
    _rollups_equal(spark, path, minute, quarter)
    K.insert_ignore_duplicates(spark, _delivery(spark, T0 - dt.timedelta(days=3), 1, "old"), path)
    assert refresh_from_log(spark, path, minute, quarter, later) == {"events_1min": [], "events_15min": []}
    assert SpanLog(spark, path).take()[1] == []


def test_a_refresh_that_dies_finds_its_spans_again(spark, scratch, monkeypatch):
    from eventspark.operators import rollups
    path, minute, quarter = (f"{scratch}/{n}" for n in ("raw", "m1", "m15"))
    K.insert_ignore_duplicates(spark, _delivery(spark, T0, 30, "a", 60), path)
    with monkeypatch.context() as m:
        m.setattr(rollups, "refresh_spans", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            refresh_from_log(spark, path, minute, quarter)
    refresh_from_log(spark, path, minute, quarter)
    _rollups_equal(spark, path, minute, quarter)


# ---------------------------------------------------------------- moments

def test_minutes_from_moments_equal_minutes_from_rows(spark, scratch, monkeypatch):
    raw, state, minute = (f"{scratch}/{n}" for n in ("raw", "state", "m1"))
    d = from_sf(spark, SF001)
    rows = K.raw_table_rows(d.valid, created_at=F.col("processing_time"))
    part = lambda k: rows.where(F.col("sequence") % 3 == k)
    assert len(insert_and_add(spark, part(0), raw, state, minute, 0)) >= 1
    # a delivery that dies between its moments and its rows, and comes again
    with monkeypatch.context() as m:
        m.setattr(K, "write_raw", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            insert_and_add(spark, part(1), raw, state, minute, 1)
    insert_and_add(spark, part(1), raw, state, minute, 1)
    insert_and_add(spark, part(1), raw, state, minute, 2)      # and once more as another delivery
    insert_and_add(spark, part(2), raw, state, minute, 3)
    got = read_rollup(spark, minute)
    want = rollup_1min(spark.read.schema(RAW_TABLE_SCHEMA).parquet(raw)).select(*got.columns)
    exact = [c for c in got.columns if c != "stddev_latency_ms"]
    assert got.count() == want.count() > 0
    assert sorted(map(str, got.select(*exact).collect())) == sorted(map(str, want.select(*exact).collect()))   # averages bit by bit
    both = got.alias("a").join(want.alias("b"), ["bucket", "symbol", "scenario"]).select(F.col("a.stddev_latency_ms").alias("x"), F.col("b.stddev_latency_ms").alias("y")).collect()
    assert all((r["x"] is None) == (r["y"] is None) and (r["x"] is None or abs(r["x"] - r["y"]) < 1e-9) for r in both)


# ------------------------------------------------------------------ state

def test_state_stays_bounded_over_500_micro_batches(spark, scratch):
    """Most micro-batches' files are written here as Spark would name them; every
    twentieth, and those that come twice, go through the store."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    store = PartialStore(spark, f"{scratch}/partials", merge_after=16)
    hour = 473_352

    def values(epoch):
        start = dt.datetime.fromtimestamp(hour * 3600 + 10 * (epoch % 20), dt.timezone.utc)
        return [start, "AAA", "low", epoch % 5, 1, Decimal(1), Decimal(0), Decimal(0), Decimal(1), Decimal(1), 2, 3]

    def frame(epoch):
        return spark.createDataFrame([values(epoch)], PARTIALS_SCHEMA).coalesce(1)

    kinds = [pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.decimal128(38, 18), pa.decimal128(38, 0), pa.decimal128(38, 0),
             pa.decimal128(38, 18), pa.decimal128(38, 18), pa.int64(), pa.int64()]
    files, sizes = [], []
    for epoch in range(500):
        if epoch % 20 == 0:
            store.add(frame(epoch), [hour], epoch)
        else:
            folder = pathlib.Path(f"{scratch}/partials/bucket_hour={hour}/epoch={epoch}")
            folder.mkdir(parents=True)
            pq.write_table(pa.table([pa.array([v], k) for v, k in zip(values(epoch), kinds)], names=PARTIALS_SCHEMA.names), folder / f"part-{epoch:05d}.parquet")
        if epoch % 100 == 57:      # delivered twice
            store.add(frame(epoch), [hour], epoch)
        if epoch == 300:           # and one that has been merged long ago
            store.add(frame(20), [hour], 20)
        store.compact([hour], epoch)
        own = list(pathlib.Path(scratch).rglob("part-*.parquet"))
        files.append(len(own))
        sizes.append(sum(f.stat().st_size for f in own))
    # a base and at most 16 micro-batches and the running one; the last 400 add nothing to what the first 100 take
    assert max(files) <= 18 and max(sizes[100:]) <= 1.1 * max(sizes[:100]), (max(files), max(sizes[:100]), max(sizes[100:]))
    got = metrics_of_partials(merge_partials(store.read([hour])))
    assert got.agg(F.sum("event_count"), F.sum("total_quantity")).first()[:] == (500, 1000) and got.count() == 20


def test_late_events_add_to_a_merged_hour(spark, scratch):
    d = from_sf(spark, SF001)
    path = f"{scratch}/partials"
    for epoch in range(5):
        last = add_partials(spark, d.valid.where(F.col("sequence") % 5 == epoch), path, epoch, 10, merge_after=2)
    assert any(PartialStore(spark, path).watermark(int(p.name.split("=")[1])) >= 0 for p in pathlib.Path(f"{path}/_base").iterdir())
    want = window_metrics(d.valid).select(*METRIC_COLUMNS)
    got = last.select(*METRIC_COLUMNS)
    touched = want.join(got.select("bucket_start", "symbol", "scenario"), ["bucket_start", "symbol", "scenario"], "left_semi").select(*METRIC_COLUMNS)
    assert got.count() > 0 and got.exceptAll(touched).count() == 0 and touched.exceptAll(got).count() == 0


def test_percentiles_of_coarser_groups(spark):
    d = from_sf(spark, SF001)
    got = percentiles_of_partials(window_partials(d.valid), ["scenario"], {"p50": 50, "p95": 95, "p100": 100}).collect()
    rows = [(r["scenario"], r["ingestion_latency_ms"]) for r in d.valid.select("scenario", "ingestion_latency_ms").collect()]
    for r in got:
        own = sorted(x for s, x in rows if s == r["scenario"])
        assert [r["p50"], r["p95"], r["p100"]] == [own[-(-len(own) * p // 100) - 1] for p in (50, 95, 100)]


# ------------------------------------------------------------------ top-k

@pytest.fixture(scope="module")
def forty_days(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("top") / "raw")
    days = [_delivery(spark, T0 + dt.timedelta(days=d), 15, f"d{d}", 600) for d in range(40)]
    # a row of an old day that came last, and two rows of one instant
    late = [_row("late", T0 + dt.timedelta(days=3), T0 + dt.timedelta(days=50)), _row("tie-a", T0 + dt.timedelta(days=7), T0 + dt.timedelta(days=49)),
            _row("tie-b", T0 + dt.timedelta(days=20), T0 + dt.timedelta(days=49))]
    rows = days[0]
    for d in days[1:]:
        rows = rows.union(d)
    K.insert_ignore_duplicates(spark, rows, path)
    K.insert_ignore_duplicates(spark, _raw_rows(spark, late), path)
    return path


def test_top_k_opens_few_days(spark, forty_days):
    everything = spark.read.schema(RAW_TABLE_SCHEMA).parquet(forty_days)
    assert len(bounds(spark, forty_days)) == 40
    for k in (1, 2, 3, 20, 100, 1000):
        some = rows_for_recent_events(spark, forty_days, k)
        assert q06_recent_events(some, k).collect() == q06_recent_events(everything, k).collect()
        days = {f.split("event_date=")[1][:10] for f in some.inputFiles()}
        assert len(days) <= {1: 1, 2: 3, 3: 3, 20: 15}.get(k, 40), (k, days)
        some = rows_for_last_seconds(spark, forty_days, k)
        assert q05_throughput_per_second(some, k).collect() == q05_throughput_per_second(everything, k).collect()


def test_a_bound_that_is_too_high_costs_a_look_only(spark, forty_days):
    from eventspark.operators import recent
    noted = bounds(spark, forty_days)
    recent.note(spark, forty_days, {"2024-01-02": (noted["2024-01-04"][0] + 10**9, 0)})
    some = rows_for_recent_events(spark, forty_days, 3)
    assert q06_recent_events(some, 3).collect() == q06_recent_events(spark.read.schema(RAW_TABLE_SCHEMA).parquet(forty_days), 3).collect()
    assert days_for_top(spark, f"{forty_days}-none", CREATED, lambda rows: None) == []
    assert rows_for_recent_events(spark, f"{forty_days}-none", 5).count() == 0


# ------------------------------------------------------------- percentiles

def test_percentile_reports_scan_once(spark, scratch):
    K.write_raw(from_sf(spark, SF001).raw, f"{scratch}/raw")
    raw = spark.read.schema(RAW_TABLE_SCHEMA).parquet(f"{scratch}/raw")
    for query in (q04_latency_by_scenario, q09_events_by_producer, r1_latency_by_scenario):
        df = query(raw)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1, plan
        # grouped by a null key as well
    odd = spark.createDataFrame([(None, 5, 1), (None, 7, 1), ("a", None, 2), ("a", 3, 2)], "scenario string, v long, w long")
    got = {r["scenario"]: r for r in spread_percentiles(odd, ["scenario"], "v", {"p": 0.5}, F.sum("w").alias("w")).collect()}
    assert (got[None]["p"], got[None]["w"], got["a"]["p"], got["a"]["w"]) == (6.0, 2, 3.0, 4)
