"""The streaming job as Structured Streaming queries.

A: raw messages -> decode/validate/enrich -> per micro-batch: processed JSON
   sink, invalid JSON sink, raw-table insert (first copy wins).
B: processed messages (A's output, duplicates included, carrying A's
   processing stamp) -> partial metrics per window, kept in the query's
   checkpoint folder -> the touched windows' metrics, upserted.
R: the raw table's log of changed spans -> roll-up refresh.

Sinks are functions of a DataFrame of messages (``connect.text_sink``,
``connect.kafka_sink``). Each query has its own checkpoint, and every write can
be repeated: the insert ignores known keys, the upsert replaces by key, and a
micro-batch's partials replace those of the same micro-batch. Between A and B
the guarantee is at-least-once: a redone batch of A can emit its processed
messages twice.

B keeps no watermark. A window's partials add up in any order, so an event that
arrives after its window, whatever its delay, still changes the stored metrics.
The partials are kept for as long as the query's checkpoint, compacted by hour.

The trigger is the checkpoint interval. ``limits.Limits`` keep the least pause
between micro-batches, and end a query whose micro-batch takes too long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.timefn import interval_micros, time_bucket
from ..operators.ingest import invalid_events, invalid_json, process_events, processed_json, valid_events
from ..operators.metrics import DEFAULT_WINDOW_SECONDS, PARTIALS_SCHEMA, metrics_of_partials, window_partials
from ..operators.partials import MERGE_AFTER, PartialStore
from ..operators.rollups import refresh_from_log
from ..operators.spans import SpanLog
from ..operators.tables import distinct_hours, insert_ignore_duplicates, raw_table_rows, upsert_metrics
from ..schema import PRICE
from ..sources.connect import (DEFAULT_ERRORS_TOPIC, DEFAULT_PROCESSED_TOPIC, kafka_sink, kafka_source, raw_topic,
                               text_sink, text_source, with_line_order)
from .limits import Limits, within_limits

Sink = Callable[[DataFrame], None]
DEFAULT_TRIGGER = {"processingTime": "30 seconds"}
DEFAULT_LIMITS = Limits()


@dataclass
class Paths:
    raw_table: str
    metrics_table: str
    checkpoint_a: str
    checkpoint_b: str
    rejected: str           # rows that break a table rule, with the reason


def _ingest_batch(spark: SparkSession, paths: Paths, processed_sink: Sink, invalid_sink: Sink, value_col: str,
                  processing_time_col: str | None, order: list[str]):
    def run(batch: DataFrame, epoch_id: int) -> None:
        processed = process_events(with_line_order(batch), value_col, processing_time_col).persist()
        try:
            extra = [c for c in order if c in processed.columns and c != "processing_time"]
            valid = valid_events(processed, extra)
            processed_sink(processed_json(valid))
            invalid_sink(invalid_json(invalid_events(processed, value_col)))
            rows = raw_table_rows(valid)
            inserted_order = [c for c in order if c in rows.columns]
            insert_ignore_duplicates(spark, rows, paths.raw_table, inserted_order or None, f"{paths.rejected}/raw")
        finally:
            processed.unpersist()
    return run


def start_ingest(spark: SparkSession, source: DataFrame, paths: Paths, processed_sink: Sink, invalid_sink: Sink,
                 value_col: str = "value", processing_time_col: str | None = None, order: list[str] | None = None,
                 trigger: dict | None = None, limits: Limits | None = DEFAULT_LIMITS) -> StreamingQuery:
    """Query A. ``trigger`` e.g. ``{"processingTime": "30 seconds"}`` or
    ``{"availableNow": True}`` (which makes no pauses)."""
    order = order or ["processing_time", "arrival"]
    run = _ingest_batch(spark, paths, processed_sink, invalid_sink, value_col, processing_time_col, order)
    return _start(spark, source, run, paths.checkpoint_a, trigger, limits)


def _start(spark: SparkSession, source: DataFrame, run, checkpoint: str, trigger: dict | None, limits: Limits | None) -> StreamingQuery:
    trigger = trigger or DEFAULT_TRIGGER
    limited = within_limits(spark, run, limits, pauses="processingTime" in trigger)
    return source.writeStream.foreachBatch(limited).option("checkpointLocation", checkpoint).trigger(**trigger).start()


PROCESSED_MESSAGE_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("producer_id", T.StringType()),
    T.StructField("symbol", T.StringType()), T.StructField("price", PRICE),
    T.StructField("quantity", T.IntegerType()), T.StructField("event_time", T.StringType()),
    T.StructField("producer_time", T.StringType()), T.StructField("processing_time", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("scenario", T.StringType()),
    T.StructField("sequence", T.LongType()), T.StructField("ingestion_latency_ms", T.LongType()),
    T.StructField("event_lag_ms", T.LongType()), T.StructField("valid", T.BooleanType()),
])


def parse_processed(messages: DataFrame, value_col: str = "value") -> DataFrame:
    j = F.from_json(F.col(value_col), PROCESSED_MESSAGE_SCHEMA)
    return messages.select(j.alias("m")).select(
        "m.event_id", "m.producer_id", "m.symbol", "m.price", "m.quantity",
        F.to_timestamp("m.event_time").alias("event_time"),
        F.to_timestamp("m.producer_time").alias("producer_time"),
        F.to_timestamp("m.processing_time").alias("processing_time"),
        "m.source", "m.scenario", "m.sequence", "m.ingestion_latency_ms", "m.event_lag_ms")


def add_partials(spark: SparkSession, batch: DataFrame, path: str, epoch_id: int, window_seconds: int, merge_after: int = MERGE_AFTER) -> DataFrame:
    """Keep a micro-batch's partials below ``path`` (compacted as they become
    many) and return the metrics of the windows it touched, from all partials
    of these windows."""
    store = PartialStore(spark, path, merge_after)
    windows = batch.select(time_bucket(F.col("processing_time"), window_seconds).alias("bucket_start")).distinct()
    hours = distinct_hours(batch, "processing_time")
    if not hours:
        return spark.createDataFrame([], PARTIALS_SCHEMA).transform(metrics_of_partials, window_seconds)
    store.add(window_partials(batch, window_seconds), hours, epoch_id)
    store.compact(hours, epoch_id)
    state = store.read(hours).join(windows, "bucket_start", "left_semi")
    # one exchange, by window, serves all that follows; partials of one group meet in it
    return metrics_of_partials(state.repartition("bucket_start"), window_seconds)


def start_metrics(spark: SparkSession, processed_messages: DataFrame, paths: Paths,
                  window_seconds: int = DEFAULT_WINDOW_SECONDS, trigger: dict | None = None,
                  created_at_col: str | None = None, limits: Limits | None = DEFAULT_LIMITS) -> StreamingQuery:
    """Query B: windowed metrics, upserted per micro-batch (an open window is
    replaced until its last event, so the table ends equal to a once-per-window
    emission). ``created_at`` is the write time unless a column is named
    (replays)."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        events = parse_processed(batch).persist()
        try:
            metrics = add_partials(spark, events, f"{paths.checkpoint_b}/partials", epoch_id, window_seconds)
            upsert_metrics(spark, metrics, paths.metrics_table, F.col(created_at_col) if created_at_col else None, f"{paths.rejected}/metrics")
        finally:
            events.unpersist()

    return _start(spark, processed_messages, run, paths.checkpoint_b, trigger, limits)


def touched_spans(batch: DataFrame, time_col: str = "event_time", width: str = "15 minutes") -> list[tuple[int, int]]:
    """The distinct ``width`` buckets (epoch microseconds) that hold rows of
    ``batch``: a handful for a micro-batch; late data adds a few more."""
    w = interval_micros(width)
    at = F.unix_micros(time_col)
    starts = sorted(r[0] for r in batch.select((at - F.pmod(at, F.lit(w))).alias("b")).distinct().collect())
    return [(b, b + w) for b in starts]


def start_rollup_refresh(spark: SparkSession, raw_table: str, minute_table: str, quarter_table: str, checkpoint: str,
                         trigger: dict | None = None, policy_clock: Callable[[], int] | None = None,
                         limits: Limits | None = DEFAULT_LIMITS) -> StreamingQuery:
    """Query R: a stream over the raw table's log of changed spans, whose entries
    are gone once they are dealt with, so a trigger costs what was written since
    the last one, whatever the table's size. It recomputes the changed spans,
    all in one pass, 1 minute first and then 15 minutes (the second reads what
    the first wrote). With ``policy_clock`` (epoch microseconds) the two refresh
    policies apply at that time, which leave the open bucket and older data
    alone."""
    log = SpanLog(spark, raw_table)
    log.create()

    def run(batch: DataFrame, epoch_id: int) -> None:
        refresh_from_log(spark, raw_table, minute_table, quarter_table, policy_clock() if policy_clock else None)

    return _start(spark, spark.readStream.schema("lo long, hi long").json(log.folder.path), run, checkpoint, trigger, limits)


# ---------------------------------------------------------------- the job

def start_text_job(spark: SparkSession, messages: str, processed: str, invalid: str, paths: Paths,
                   trigger: dict | None = None, max_files: int | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """Queries A and B on folders of text files, one message a line."""
    for folder in (processed, invalid):
        text_sink(folder)(spark.createDataFrame([], "value string"))
    a = start_ingest(spark, text_source(spark, messages, max_files=max_files), paths, text_sink(processed), text_sink(invalid), trigger=trigger)
    return a, start_metrics(spark, text_source(spark, processed), paths, trigger=trigger)


def start_kafka_job(spark: SparkSession, bootstrap: str, paths: Paths, trigger: dict | None = None, topic: str | None = None,
                    processed_topic: str = DEFAULT_PROCESSED_TOPIC, invalid_topic: str = DEFAULT_ERRORS_TOPIC,
                    min_partitions: int | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """Queries A and B on topics (needs Spark's Kafka connector)."""
    source = kafka_source(spark, bootstrap, topic or raw_topic(), min_partitions)
    a = start_ingest(spark, source, paths, kafka_sink(bootstrap, processed_topic), kafka_sink(bootstrap, invalid_topic), trigger=trigger)
    return a, start_metrics(spark, kafka_source(spark, bootstrap, processed_topic, min_partitions), paths, trigger=trigger)
