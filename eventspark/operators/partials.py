"""State of a streaming aggregate: partial aggregates per bucket and micro-batch
(of the window metrics, or of the roll-ups' ``moments``).

``bucket_hour=<h>/epoch=<e>`` holds what micro-batch e added to the buckets of
hour h. An hour that has collected ``MERGE_AFTER`` of them is compacted: all
micro-batches before the running one are merged into
``_base/bucket_hour=<h>/upto=<w>``, w being the last one merged, and removed. The
state of an hour is its newest base and the micro-batches after it, so files
and bytes of an hour are bounded, however many micro-batches touched it.

Every step can be repeated. A micro-batch that runs again replaces its own
partials; only the last one can run again, and it is never merged. A base comes
into place by one rename, complete; micro-batches up to its mark are ignored
from then on, removed or not, and are not added a second time. Late events find
the base and add to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Folder, in_threads
from .metrics import PARTIALS_SCHEMA, merge_partials
from .store import BY_HOUR, by_hour, hour_of

#: Micro-batches of an hour that are kept apart before they are merged.
MERGE_AFTER = 16
BASE = "_base"


class PartialStore:
    """``merge`` turns partials of ``schema`` into one row for each group (and of
    further columns it is given); the buckets start at ``time_col``."""

    def __init__(self, spark: SparkSession, path: str, merge_after: int = MERGE_AFTER, schema: T.StructType = PARTIALS_SCHEMA,
                 merge: Callable[..., DataFrame] = merge_partials, time_col: str = "bucket_start"):
        self.spark, self.folder, self.merge_after = spark, Folder(spark, path), merge_after
        self.schema, self.merge, self.time_col = schema, merge, time_col

    def _marked(self, folders: list[str], mark: str) -> dict[str, list[int]]:
        return {f: sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{mark}=")) for f, names in self.folder.names_in(folders).items()}

    def watermarks(self, hours: list[int]) -> dict[int, int]:
        """The last micro-batch that each hour's base holds (-1: no base)."""
        marks = self._marked([f"{BASE}/bucket_hour={h}" for h in hours], "upto")
        return {h: max(marks.get(f"{BASE}/bucket_hour={h}", []), default=-1) for h in hours}

    def watermark(self, hour: int) -> int:
        return self.watermarks([hour])[hour]

    def parts(self, hours: list[int], before: int | None = None) -> dict[int, list[str]]:
        """The folders that make up each hour, or its state before a micro-batch."""
        marks, epochs = self.watermarks(hours), self._marked([f"bucket_hour={h}" for h in hours], "epoch")
        return {h: [f"{BASE}/bucket_hour={h}/upto={marks[h]}"] * (marks[h] >= 0)
                + [f"bucket_hour={h}/epoch={e}" for e in epochs.get(f"bucket_hour={h}", []) if e > marks[h] and (before is None or e < before)] for h in hours}

    def read(self, hours: list[int]) -> DataFrame:
        return self._read([p for parts in self.parts(hours).values() for p in parts])

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder.path}/{p}" for p in parts])

    def add(self, partials: DataFrame, hours: list[int], epoch: int) -> None:
        """Keep a micro-batch's partials, which lie in ``hours``. What a base
        holds already is left out (a micro-batch from long ago run again)."""
        known = [h for h, mark in self.watermarks(hours).items() if mark >= epoch]
        rows = partials.withColumns({"bucket_hour": hour_of(self.time_col), "epoch": F.lit(epoch)})
        if known:
            rows = rows.where(~F.col("bucket_hour").isin(known))
        (rows.hint("rebalance", "bucket_hour").sortWithinPartitions("bucket_hour", self.time_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket_hour", "epoch").parquet(self.folder.path))

    def compact(self, hours: list[int], epoch: int) -> list[int]:
        """Merge what is due of ``hours``: all micro-batches before ``epoch``.
        Returns the hours merged."""
        due = {h: p for h, p in self.parts(hours, before=epoch).items() if sum("/epoch=" in x for x in p) >= self.merge_after}
        if not due:
            return []
        aside = f"_merge/{uuid.uuid4().hex}"
        rows = by_hour(self._read([x for p in due.values() for x in p]), self.time_col, len(due))
        (self.merge(rows, *BY_HOUR).withColumn("upto", F.lit(epoch - 1)).drop("bucket_part")
         .sortWithinPartitions("bucket_hour", self.time_col).write.partitionBy("bucket_hour", "upto").parquet(f"{self.folder.path}/{aside}"))

        def switch(h: int) -> None:
            base = f"bucket_hour={h}/upto={epoch - 1}"
            self.folder.move(f"{aside}/{base}", f"{BASE}/{base}")
            for x in due[h]:
                self.folder.delete(x)

        in_threads(switch, due)
        self.folder.delete(aside)
        return sorted(due)
