"""Limits of a streaming query's micro-batches: the least pause between the end
of one and the start of the next, and the longest time that one may take."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class TimeLimitExceeded(RuntimeError):
    """A micro-batch took longer than its limit; the query ends with this error."""


@dataclass(frozen=True)
class Limits:
    """Seconds. (Fixed values: 5 and 120.)"""
    least_pause: float = 5.0
    time_limit: float = 120.0


def within_limits(spark: SparkSession, run: Callable[[DataFrame, int], None], limits: Limits | None,
                  pauses: bool = True) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that keeps ``limits`` (None: no limits).

    All jobs of a micro-batch carry a tag of their own. When its time is over
    they are cancelled and the micro-batch fails, so the query ends and can be
    started again from its checkpoint, which still names this micro-batch as
    the next one. ``pauses=False`` leaves out the pause (a run that catches up
    with what there is and ends)."""
    if limits is None:
        return run
    ended = [float("-inf")]

    def limited(batch: DataFrame, epoch_id: int) -> None:
        wait = ended[0] + limits.least_pause - time.monotonic()
        if pauses and wait > 0:
            time.sleep(wait)
        sc, tag, over = spark.sparkContext, f"micro-batch-{uuid.uuid4().hex}", threading.Event()
        done = threading.Event()

        def watch() -> None:
            if done.wait(limits.time_limit):
                return
            over.set()
            # again and again: a job that starts after the first call is stopped as well
            while not done.is_set():
                sc.cancelJobsWithTag(tag)
                done.wait(0.5)

        watcher = threading.Thread(target=watch, daemon=True)
        sc.addJobTag(tag)
        watcher.start()
        try:
            run(batch, epoch_id)
        except Exception as e:
            if over.is_set():
                raise TimeLimitExceeded(f"micro-batch {epoch_id} took longer than its time limit of {limits.time_limit:g} s") from e
            raise
        finally:
            done.set()
            sc.removeJobTag(tag)
            ended[0] = time.monotonic()
        if over.is_set():
            raise TimeLimitExceeded(f"micro-batch {epoch_id} took longer than its time limit of {limits.time_limit:g} s")
    return limited
