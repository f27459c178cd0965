"""Schemas of the event stream, its tables and its roll-ups."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(38, 18)
AVG_PRICE = T.DecimalType(38, 6)
AVG_MS = T.DecimalType(38, 2)

# Wire fields of one raw event, in contract order.
WIRE_FIELDS = ["event_id", "producer_id", "symbol", "price", "quantity", "event_time",
               "producer_time", "source", "scenario", "sequence"]
TEXT_FIELDS = ["event_id", "producer_id", "symbol", "event_time", "producer_time", "source", "scenario"]

PROCESSED_FIELDS = [
    ("event_id", T.StringType()),
    ("producer_id", T.StringType()),
    ("symbol", T.StringType()),
    ("price", PRICE),
    ("quantity", T.IntegerType()),
    ("event_time", T.TimestampType()),
    ("producer_time", T.TimestampType()),
    ("processing_time", T.TimestampType()),
    ("source", T.StringType()),
    ("scenario", T.StringType()),
    ("sequence", T.LongType()),
    ("ingestion_latency_ms", T.LongType()),
    ("event_lag_ms", T.LongType()),
]

# Raw event table: processed columns with the canonical UUID, the insert time
# and the date partition column.
RAW_TABLE_COLUMNS = [n for n, _ in PROCESSED_FIELDS] + ["created_at", "event_date"]
RAW_TABLE_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in PROCESSED_FIELDS]
    + [T.StructField("created_at", T.TimestampType(), True),
       T.StructField("event_date", T.DateType(), True)]
)
RAW_KEY = ["event_id", "event_time"]

METRIC_FIELDS = [
    ("bucket_start", T.TimestampType()),
    ("bucket_end", T.TimestampType()),
    ("symbol", T.StringType()),
    ("scenario", T.StringType()),
    ("event_count", T.LongType()),
    ("avg_price", AVG_PRICE),
    ("min_price", PRICE),
    ("max_price", PRICE),
    ("total_quantity", T.LongType()),
    ("avg_ingestion_latency_ms", AVG_MS),
    ("p50_ingestion_latency_ms", T.LongType()),
    ("p95_ingestion_latency_ms", T.LongType()),
    ("max_ingestion_latency_ms", T.LongType()),
    ("avg_event_lag_ms", AVG_MS),
]
METRIC_COLUMNS = [n for n, _ in METRIC_FIELDS]
METRICS_TABLE_COLUMNS = METRIC_COLUMNS + ["created_at", "bucket_date"]
METRICS_KEY = ["bucket_start", "symbol", "scenario"]
METRICS_TABLE_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in METRIC_FIELDS]
    + [T.StructField("created_at", T.TimestampType(), True),
       T.StructField("bucket_date", T.DateType(), True)]
)

ROLLUP_1MIN_FIELDS = [
    ("bucket", T.TimestampType()),
    ("symbol", T.StringType()),
    ("scenario", T.StringType()),
    ("event_count", T.LongType()),
    ("avg_price", PRICE),
    ("min_price", PRICE),
    ("max_price", PRICE),
    ("total_quantity", T.LongType()),
    ("avg_latency_ms", T.DoubleType()),
    ("max_latency_ms", T.LongType()),
    ("stddev_latency_ms", T.DoubleType()),
]
ROLLUP_15MIN_FIELDS = [f for f in ROLLUP_1MIN_FIELDS if f[0] != "stddev_latency_ms"]


def rollup_schema(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields]
                        + [T.StructField("bucket_date", T.DateType(), True)])
