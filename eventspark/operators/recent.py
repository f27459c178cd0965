"""The newest rows of the raw table without reading the older days.

Every write notes, for each day it holds, the greatest ``created_at`` and
``processing_time`` (epoch microseconds) in the name of an empty file below
``_bounds``, or, if it holds more than ``SINGLE`` days, in one list of them; the
bounds of a day are the greatest noted ones. A top-k query opens days from the newest bound down, one, two, four ... more at a time, and
stops when its k-th row beats every bound left. That is exact: no row of a day
left out can be among the first k. A bound may be too high (a write that died
before its rows came), which costs a look at a day and nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import time_bucket
from ..schema import RAW_TABLE_SCHEMA
from .files import Folder

FOLDER = "_bounds"
CREATED, PROCESSED = 0, 1
#: Days of one write that are noted one by one.
SINGLE = 32


def note(spark: SparkSession, path: str, bounds: dict[str, tuple[int, int]]) -> None:
    """Note bounds of days; older notes that they exceed are removed."""
    folder = Folder(spark, f"{path}/{FOLDER}")
    folder.fs.mkdirs(folder.at())
    if len(bounds) > SINGLE:
        lists = _lists(folder)
        every = _greatest([*_listed(spark, folder, lists), *[(day, *own) for day, own in bounds.items()]])
        folder.create(f"{uuid.uuid4().hex}.json", "".join(json.dumps({"day": d, "created": c, "processed": p}) + "\n" for d, (c, p) in sorted(every.items())))
        for name in lists:
            folder.delete(name)
        return
    noted: dict[str, list[tuple[str, int, int]]] = {}
    for day, created, processed in _single(folder):
        noted.setdefault(day, []).append((f"{day},{created},{processed}", created, processed))
    for day, (created, processed) in bounds.items():
        old = noted.get(day, [])
        created, processed = max([created, *[o[1] for o in old]]), max([processed, *[o[2] for o in old]])
        name = f"{day},{created},{processed}"
        if name not in {o[0] for o in old}:
            folder.create(name)
        for o in old:
            if o[0] != name:
                folder.delete(o[0])


def _single(folder: Folder) -> list[tuple[str, int, int]]:
    names = [n.split(",") for n in folder.names() if not n.startswith(".") and not n.endswith(".json")]
    return [(day, int(created), int(processed)) for day, created, processed in names]


def _lists(folder: Folder) -> list[str]:
    return [n for n in folder.names() if not n.startswith(".") and n.endswith(".json")]


def _listed(spark: SparkSession, folder: Folder, lists: list[str]) -> list[tuple[str, int, int]]:
    if not lists:
        return []
    rows = spark.read.schema("day string, created long, processed long").json([f"{folder.path}/{n}" for n in lists]).collect()
    return [(r["day"], r["created"], r["processed"]) for r in rows]


def _greatest(notes: list[tuple[str, int, int]]) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for day, created, processed in notes:
        before = out.get(day, (created, processed))
        out[day] = max(before[0], created), max(before[1], processed)
    return out


def bounds(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Day -> greatest created_at and processing_time of its rows."""
    folder = Folder(spark, f"{path}/{FOLDER}")
    while True:
        lists = _lists(folder)
        try:
            return _greatest([*_listed(spark, folder, lists), *_single(folder)])
        except Exception:  # noqa: BLE001 - a writer may have put the lists into a new one meanwhile
            if set(lists) <= set(_lists(folder)):
                raise


def days_for_top(spark: SparkSession, path: str, which: int, last: Callable[[DataFrame], int | None]) -> list[str]:
    """The days that hold all of a top-k. ``last`` gives the k-th value (epoch
    microseconds) of some rows, or None if they are fewer than k."""
    from .tables import read_days
    left = sorted(((b[which], day) for day, b in bounds(spark, path).items()), reverse=True)
    opened: list[str] = []
    beat, step = None, 1
    while left and (beat is None or left[0][0] >= beat):
        opened += [day for bound, day in left[:step] if beat is None or bound >= beat]
        left, step = left[step:], step * 2
        rows = read_days(spark, path, "event_date", opened, RAW_TABLE_SCHEMA)
        beat = None if rows is None else last(rows)
    return opened


def rows_for_recent_events(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The days that the ``limit`` newest rows by ``created_at`` are in."""
    def last(rows: DataFrame) -> int | None:
        top = rows.select(F.unix_micros("created_at").alias("t")).orderBy(F.desc("t")).limit(limit).agg(F.count("t"), F.min("t")).first()
        return top[1] if top[0] == limit else None
    return _rows(spark, path, days_for_top(spark, path, CREATED, last))


def rows_for_last_seconds(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The days that the ``limit`` newest (second, scenario) groups of
    ``processing_time`` are in, with all of their rows."""
    def last(rows: DataFrame) -> int | None:
        groups = rows.select(F.unix_micros(time_bucket(F.col("processing_time"), "1 second")).alias("t"), "scenario").distinct()
        top = groups.orderBy(F.desc("t")).limit(limit).agg(F.count("t"), F.min("t")).first()
        return top[1] if top[0] == limit else None
    return _rows(spark, path, days_for_top(spark, path, PROCESSED, last))


def _rows(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    from .tables import read_days
    rows = read_days(spark, path, "event_date", days, RAW_TABLE_SCHEMA) if days else None
    return spark.createDataFrame([], RAW_TABLE_SCHEMA) if rows is None else rows
