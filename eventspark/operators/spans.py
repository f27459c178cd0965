"""A log of time spans whose rows have changed.

Every write to a table adds one small file with the spans it touched; a
refresh takes all entries there are, merges them into one set of spans and,
when its work is done, removes them again (and writes back what it left for
later). So the cost of finding out what is new depends on the writes since the
last refresh, not on the size of the table. A refresh that dies half-way finds
the same entries again. Spans are epoch microseconds, [lo, hi).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from .files import Folder

FOLDER = "_spans"

Spans = list[tuple[int, int]]


def merged(spans: Spans) -> Spans:
    """Sorted spans, touching and overlapping ones joined; empty ones left out."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if lo < hi:
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
    return [tuple(x) for x in out]


def common(a: Spans, b: Spans) -> Spans:
    """The times in both."""
    return merged([(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b])


def without(a: Spans, b: Spans) -> Spans:
    """The times in ``a`` and not in ``b``."""
    out = merged(a)
    for lo, hi in merged(b):
        out = [part for x in out for part in ((x[0], min(x[1], lo)), (max(x[0], hi), x[1])) if part[0] < part[1]]
    return out


def widened(spans: Spans, width: int) -> Spans:
    """Both ends moved out to multiples of ``width``."""
    return merged([(lo // width * width, -(-hi // width) * width) for lo, hi in spans])


def at_most(spans: Spans, n: int) -> Spans:
    """No more than n spans that cover the given ones: the smallest gaps are
    closed. (A refresh may recompute more than it has to.)"""
    spans = merged(spans)
    gaps = sorted(range(1, len(spans)), key=lambda i: spans[i][0] - spans[i - 1][1])[: max(0, len(spans) - n)]
    return merged([*spans, *[(spans[i - 1][1], spans[i][0]) for i in gaps]])


class SpanLog:
    """The log of one table (or of one reader of a table)."""

    def __init__(self, spark: SparkSession, path: str, name: str = FOLDER):
        self.spark, self.folder = spark, Folder(spark, f"{path.rstrip('/')}/{name}")

    def create(self) -> None:
        self.folder.fs.mkdirs(self.folder.at())

    def add(self, spans: Spans) -> None:
        spans = merged(spans)
        if spans:
            self.create()
            self.folder.create(f"{uuid.uuid4().hex}.json", "".join(json.dumps({"lo": lo, "hi": hi}) + "\n" for lo, hi in spans))

    def take(self) -> tuple[list[str], Spans]:
        """The names of the present entries, and their spans together."""
        names = [n for n in self.folder.names() if n.endswith(".json")]
        if not names:
            return [], []
        rows = self.spark.read.schema("lo long, hi long").json([f"{self.folder.path}/{n}" for n in names]).collect()
        return names, merged([(r["lo"], r["hi"]) for r in rows])

    def settle(self, names: list[str], left: Spans = ()) -> None:
        """Remove entries that have been dealt with, but for the spans ``left``."""
        self.add(list(left))
        for n in names:
            self.folder.delete(n)
