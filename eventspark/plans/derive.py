"""Tables derived in one lazy plan from a raw message stream (batch form).

The same operators as the streaming job, applied to the whole stream at
once: processed events -> raw table (first copy per key) -> 10-second metrics
-> 1- and 15-minute roll-ups. With the injected processing stamp of the
fixture stream, ``created_at`` of a raw row is its processing stamp and that
of a metric row its window end (when the window fires), so every derived
table is reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import process_events, valid_events
from ..operators.metrics import window_metrics
from ..operators.rollups import rollup_15min, rollup_1min
from ..operators.tables import dedupe_raw, metrics_table_rows, raw_table_rows
from ..schema import RAW_TABLE_COLUMNS
from ..session import prepare
from ..sources.fixtures import bench_stream, event_stream


@dataclass
class Derived:
    processed: DataFrame
    valid: DataFrame
    raw: DataFrame
    metrics: DataFrame

    def minute(self) -> DataFrame:
        return rollup_1min(self.raw)

    def quarter(self) -> DataFrame:
        return rollup_15min(self.minute())

    def as_of(self) -> Column:
        """"Now" of the fixture: the latest event time, as a scalar subquery."""
        return self.raw.select(F.max("event_time")).scalar()


def derive(messages: DataFrame, processing_time_col: str | None = "processing_time",
           window_seconds: int = 10) -> Derived:
    processed = process_events(messages, "value", processing_time_col)
    extra = [c for c in ("arrival",) if c in messages.columns]
    valid = valid_events(processed, extra)
    rows = raw_table_rows(valid, created_at=F.col("processing_time"))
    raw = dedupe_raw(rows, ["processing_time", *extra]).select(*RAW_TABLE_COLUMNS)
    metrics = metrics_table_rows(window_metrics(valid.drop(*extra), window_seconds), F.col("bucket_end"))
    return Derived(processed=processed, valid=valid.drop(*extra), raw=raw, metrics=metrics)


def from_sf(spark: SparkSession, sf_dir: str, splits: int | None = None, table_times: bool = False) -> Derived:
    prepare(spark)
    return derive(event_stream(spark, sf_dir, splits, table_times))


def bench_from_sf(spark: SparkSession, sf_dir: str, splits: int | None = None) -> Derived:
    prepare(spark)
    return derive(bench_stream(spark, sf_dir, splits=splits))
