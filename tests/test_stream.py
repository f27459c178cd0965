"""Structured Streaming job: stream = batch, and replay is idempotent."""

from pyspark.sql import functions as F

from eventspark.operators.metrics import window_metrics
from eventspark.plans.derive import from_sf
from eventspark.schema import METRIC_COLUMNS, RAW_TABLE_COLUMNS
from eventspark.sources.fixtures import event_stream
from eventspark.operators.rollups import read_rollup, rollup_15min, rollup_1min
from eventspark.operators.tables import metrics_table
from eventspark.sources.connect import text_sink, text_source
from eventspark.streaming.jobs import Paths, start_ingest, start_metrics, start_rollup_refresh, start_text_job
from tests.conftest import SF001

SOURCE_SCHEMA = "value string, processing_time timestamp, arrival long"


def _write_source(spark, path):
    """The fixture stream as three files, in arrival order."""
    s = event_stream(spark, SF001)
    stamp = F.unix_micros("processing_time")
    lo, hi = s.agg(F.min(stamp), F.max(stamp)).first()
    for i in range(3):
        part = s.filter(F.floor((stamp - lo) * 3 / (hi - lo + 1)) == i)
        # one file per delivery, appended in arrival order
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _paths(base, tag):
    return Paths(raw_table=f"{base}/raw", metrics_table=f"{base}/metrics", checkpoint_a=f"{base}/ckpt-a-{tag}",
                 checkpoint_b=f"{base}/ckpt-b-{tag}", rejected=f"{base}/rejected")


def _run_ingest(spark, src_dir, paths, base):
    # one file per micro-batch: three micro-batches
    src = spark.readStream.schema(SOURCE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src_dir)
    q = start_ingest(spark, src, paths, text_sink(f"{base}/processed"), text_sink(f"{base}/invalid"), processing_time_col="processing_time", trigger={"availableNow": True})
    q.awaitTermination()
    assert q.exception() is None
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) >= 3


def _run_metrics(spark, paths, base):
    q = start_metrics(spark, text_source(spark, f"{base}/processed"), paths, trigger={"availableNow": True})
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch_and_replay_is_idempotent(spark, scratch):
    src_dirs = _write_source(spark, f"{scratch}/source")
    paths = _paths(scratch, "1")
    _run_ingest(spark, src_dirs, paths, scratch)
    _run_metrics(spark, paths, scratch)

    d = from_sf(spark, SF001)
    cols = [c for c in RAW_TABLE_COLUMNS if c != "created_at"]
    raw_stream = spark.read.parquet(paths.raw_table).select(*cols)
    raw_batch = d.raw.select(*cols)
    assert raw_stream.count() == raw_batch.count()
    assert raw_stream.exceptAll(raw_batch).count() == 0 and raw_batch.exceptAll(raw_stream).count() == 0

    m_stream = metrics_table(spark, paths.metrics_table).read().select(*METRIC_COLUMNS)
    m_batch = window_metrics(d.valid).select(*METRIC_COLUMNS)
    assert m_stream.exceptAll(m_batch).count() == 0 and m_batch.exceptAll(m_stream).count() == 0

    n_invalid = spark.read.text(f"{scratch}/invalid").count()
    assert n_invalid == d.processed.filter(F.col("validation_error").isNotNull()).count()

    # replay with fresh checkpoints: both tables unchanged (idempotent sinks)
    raw_before = sorted(spark.read.parquet(paths.raw_table).select(*cols).collect())
    metrics_before = sorted(metrics_table(spark, paths.metrics_table).read().select(*METRIC_COLUMNS).collect())
    replay = _paths(scratch, "2")
    # B first: it re-reads the same processed messages and upserts the same rows
    _run_metrics(spark, replay, scratch)
    assert sorted(metrics_table(spark, paths.metrics_table).read().select(*METRIC_COLUMNS).collect()) == metrics_before
    # then A: every key is already in the raw table, nothing is inserted
    _run_ingest(spark, src_dirs, replay, scratch)
    assert sorted(spark.read.parquet(paths.raw_table).select(*cols).collect()) == raw_before


def test_streaming_rollup_refresh(spark, scratch):
    src_dir = _write_source(spark, f"{scratch}/source")
    paths = _paths(scratch, "1")
    _run_ingest(spark, src_dir, paths, scratch)
    minute, quarter = f"{scratch}/m1", f"{scratch}/m15"
    q = start_rollup_refresh(spark, paths.raw_table, minute, quarter, f"{scratch}/ckpt-r",
                             trigger={"availableNow": True})
    q.awaitTermination()
    assert q.exception() is None
    raw = spark.read.parquet(paths.raw_table)
    r6 = F.round("avg_latency_ms", 6).alias("avg_latency_ms")
    for path, which, expected in ((minute, "events_1min", rollup_1min(raw)), (quarter, "events_15min", rollup_15min(rollup_1min(raw)))):
        table = read_rollup(spark, path, which)
        cols = [c if c != "avg_latency_ms" else r6 for c in table.columns]
        got, exp = table.select(*cols), expected.select(*cols)
        assert got.count() == exp.count() > 0
        assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


MESSAGE = ('{"event_id":"%s","producer_id":"p","symbol":"kelp","price":%s,"quantity":2,"event_time":"2031-05-06T07:08:09Z",'
           '"producer_time":"2031-05-06T07:08:09Z","source":"t","scenario":"low","sequence":1}')


def test_text_job_keeps_the_first_line_of_a_micro_batch(spark, scratch):
    """One micro-batch, one stamp: the order of the lines decides, every time."""
    import pathlib
    for attempt in range(2):
        base = f"{scratch}/{attempt}"
        pathlib.Path(f"{base}/in").mkdir(parents=True)
        same = "7d0c52f4-1b1a-4d8e-8a55-0c9d3e6f1a2b"
        lines = [MESSAGE % (same, 1 + i) for i in range(500)] + ["no json"]
        pathlib.Path(f"{base}/in/a.txt").write_text("\n".join(lines) + "\n")
        paths = _paths(base, "t")
        a, b = start_text_job(spark, f"{base}/in", f"{base}/processed", f"{base}/invalid", paths, trigger={"availableNow": True})
        a.awaitTermination()
        b.awaitTermination()
        assert a.exception() is None and b.exception() is None
        assert [float(r["price"]) for r in spark.read.parquet(paths.raw_table).collect()] == [1.0]
        # B may have started before A wrote: a second run takes what is left
        _run_metrics(spark, paths, base)
        got = metrics_table(spark, paths.metrics_table).read().collect()
        assert sum(r["event_count"] for r in got) == 500 and spark.read.text(f"{base}/invalid").count() == 1


def test_late_deliveries_change_stored_windows(spark, scratch):
    """The third delivery holds a stamp from long before the second's."""
    import pathlib
    paths = _paths(scratch, "late")
    out = pathlib.Path(f"{scratch}/processed")
    out.mkdir()
    row = ('{"event_id":"e","producer_id":"p","symbol":"KELP","price":1.5,"quantity":1,"event_time":"%s","producer_time":"%s","processing_time":"%s",'
           '"source":"t","scenario":"low","sequence":1,"ingestion_latency_ms":%d,"event_lag_ms":0,"valid":true}')
    for i, (second, latency) in enumerate(((1, 10), (26, 20), (7, 30))):
        t = f"2031-05-06T07:08:{second:02d}.000000Z"
        (out / f"{i}.txt").write_text(row % (t, t, t, latency) + "\n")
        _run_metrics(spark, paths, scratch)
    got = {r["bucket_start"].second: r for r in metrics_table(spark, paths.metrics_table).read().collect()}
    assert {k: r["event_count"] for k, r in got.items()} == {0: 2, 20: 1}
    assert got[0]["p95_ingestion_latency_ms"] == 30 and got[0]["p50_ingestion_latency_ms"] == 10
