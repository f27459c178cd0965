"""Keyed tables in hour partitions, replaced hour by hour and switched by a
small manifest.

Layout below the table's path::

    data/version=<v>/bucket_date=<day>/bucket_hour=<hours since 1970>/part-*.parquet
    manifest/<20-digit number>.json      hour -> (version, day)

A write puts the new contents of the hours it touches into a version folder of
its own and then renames a new manifest into place. The manifest with the
highest number is the table: a reader sees all of a write or nothing of it,
and a write that fails, or is repeated, leaves the table as it was. Hours that
have no rows any more leave the manifest. The bytes written by a small batch
depend on the hours it touches, not on how full the day or the table is.

Two writers at once: the manifest is renamed without replacing, so on file
systems where that is atomic (HDFS and others with a name node) the second one
fails with ``WriteConflict`` and changes nothing. On plain object stores and on
a raw local disk a table must have one writer at a time.

The manifest has one entry per hour of data and is read by the driver. Hours
are integers, days text: no timestamp passes through Python.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Folder

HOUR_MICROS = 3_600_000_000
KEEP_MANIFESTS = 10


class WriteConflict(RuntimeError):
    """Another writer switched the table meanwhile; run the write again."""


def hour_of(column) -> F.Column:
    """Hours since 1970 of a timestamp."""
    m = F.unix_micros(column)
    return ((m - F.pmod(m, F.lit(HOUR_MICROS))) / F.lit(HOUR_MICROS)).cast("long")


#: Columns that ``by_hour`` adds.
BY_HOUR = ["bucket_hour", "bucket_part"]


def by_hour(rows: DataFrame, time_col: str, hours: int) -> DataFrame:
    """Rows of ``hours`` hours dealt to tasks by hour, or by equal parts of an
    hour where there are fewer hours than tasks: in one exchange, without a look
    at the rows before. What is grouped by ``BY_HOUR`` and more, or written by
    hour, needs no other one."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(360, max(1, -(-tasks // max(1, hours))))
    at = F.pmod(F.unix_micros(time_col), F.lit(HOUR_MICROS)) * F.lit(parts)
    part = ((at - F.pmod(at, F.lit(HOUR_MICROS))) / F.lit(HOUR_MICROS)).cast("int")
    return rows.withColumns({"bucket_hour": hour_of(time_col), "bucket_part": part}).repartition(*BY_HOUR)


class HourTable:
    """A table of rows with a time column and the day column ``bucket_date``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time_col: str):
        self.spark, self.path, self.schema, self.time_col = spark, path.rstrip("/"), schema, time_col
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifest

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:20]) for n in self._list("manifest") if re.fullmatch(r"\d{20}\.json", n))

    def _load(self, number: int) -> dict[int, tuple[str, str]]:
        text = self.spark.read.text(f"{self.path}/manifest/{number:020d}.json", wholetext=True).first()[0]
        return {int(h): tuple(v) for h, v in json.loads(text).items()}

    def hours(self) -> dict[int, tuple[str, str]]:
        """Hour -> (version, day) of the table as it is now."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {}

    def _commit(self, number: int, hours: dict[int, tuple[str, str]]) -> None:
        if not Folder(self.spark, f"{self.path}/manifest").create(f"{number:020d}.json", json.dumps(hours)):
            raise WriteConflict(f"{self.path}: version {number} exists")
        for old in self._numbers()[:-KEEP_MANIFESTS]:
            self._fs.delete(self._path(f"{self.path}/manifest/{old:020d}.json"), False)

    # ---------------------------------------------------------------- read

    def read(self, lo: int | None = None, hi: int | None = None, hours: Iterable[int] | None = None) -> DataFrame:
        """The rows, or those with ``lo <= time < hi`` (epoch microseconds), or
        of some hours: only the folders of these hours are listed and read."""
        return self._read(self.hours(), lo, hi, hours)

    def _read(self, live, lo=None, hi=None, hours=None) -> DataFrame:
        wanted = set(live) if hours is None else set(live) & set(hours)
        if lo is not None:
            wanted = {h for h in wanted if h >= lo // HOUR_MICROS}
        if hi is not None:
            wanted = {h for h in wanted if h * HOUR_MICROS < hi}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/version={live[h][0]}/bucket_date={live[h][1]}/bucket_hour={h}" for h in sorted(wanted)]
        df = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*folders).select(*self.schema.names)
        if lo is not None:
            df = df.where(F.col(self.time_col) >= F.timestamp_micros(F.lit(lo)))
        if hi is not None:
            df = df.where(F.col(self.time_col) < F.timestamp_micros(F.lit(hi)))
        return df

    # --------------------------------------------------------------- write

    def replace(self, build, hours: Iterable[int]) -> None:
        """Give ``hours`` new contents. ``build`` gets the present rows of these
        hours and returns all of their new rows (further hours may get rows if
        the table has none there)."""
        def rows(live, hours):
            new = build(self._read(live, hours=hours)).select(*self.schema.names).withColumn("bucket_hour", hour_of(self.time_col))
            return new.repartitionByRange("bucket_hour", self.time_col)
        self._switch(rows, hours)

    def upsert(self, new: DataFrame, keys: list[str], hours: Iterable[int]) -> None:
        """``new`` rows, which lie in ``hours``, take the place of the rows of
        their ``keys``. Old and new rows meet in one exchange by hour, and are
        written from there."""
        def rows(live, hours):
            new_rows = new.select(*self.schema.names)
            if not set(live) & hours:
                return by_hour(new_rows, self.time_col, len(hours))
            both = self._read(live, hours=hours).withColumn("_old", F.lit(True)).unionByName(new_rows.withColumn("_old", F.lit(False)))
            newest = W.partitionBy(*keys, "bucket_date", *BY_HOUR).orderBy("_old")
            return by_hour(both, self.time_col, len(hours)).withColumn("_rank", F.rank().over(newest)).where("_rank = 1").drop("_rank", "_old")
        self._switch(rows, hours)

    def _switch(self, build, hours: Iterable[int]) -> None:
        """Give ``hours`` the rows that ``build`` makes, dealt to tasks by
        ``bucket_hour``, from the table's hours as they are now."""
        numbers = self._numbers()
        live = self._load(numbers[-1]) if numbers else {}
        hours, version = set(hours), uuid.uuid4().hex
        folder = f"{self.path}/data/version={version}"
        (build(live, hours).sortWithinPartitions("bucket_date", "bucket_hour", self.time_col).drop("bucket_part")
         .write.partitionBy("bucket_date", "bucket_hour").parquet(folder))
        new = {}
        for name in Folder(self.spark, folder).glob("bucket_date=*/bucket_hour=*"):
            day, hour = re.fullmatch(r"bucket_date=([^/]+)/bucket_hour=(-?\d+)", name).groups()
            new[int(hour)] = (version, day)
        clash = (set(new) - hours) & set(live)
        if clash:
            raise ValueError(f"rows of hours that are not replaced: {sorted(clash)[:5]}")
        kept = {h: v for h, v in live.items() if h not in hours}
        self._commit((numbers[-1] if numbers else 0) + 1, kept | new)

    def create(self) -> None:
        """An empty table, unless there is one."""
        if not self._numbers():
            self._commit(1, {})

    def vacuum(self) -> None:
        """Delete version folders that none of the kept manifests names. Not to
        be run beside a writer, whose folder isn't named yet."""
        named = {v for n in self._numbers() for v, _ in self._load(n).values()}
        for name in self._list("data"):
            if name.startswith("version=") and name.split("=", 1)[1] not in named:
                self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
