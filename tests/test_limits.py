"""Micro-batch limits, retried database batches, and connector options."""

import json
import pathlib
import time

import pytest

from eventspark.sources import connect as C
from eventspark.sources.database import batches, database_sink, insert_statement, write_partition
from eventspark.streaming.jobs import Paths, start_ingest
from eventspark.streaming.limits import Limits, within_limits
from tests.test_stream import MESSAGE


def test_a_stalled_sink_ends_the_query(spark, scratch):
    pathlib.Path(f"{scratch}/in").mkdir()
    pathlib.Path(f"{scratch}/in/a.txt").write_text(MESSAGE % ("7d0c52f4-1b1a-4d8e-8a55-0c9d3e6f1a2b", 3) + "\n")
    paths = Paths(f"{scratch}/raw", f"{scratch}/metrics", f"{scratch}/a", f"{scratch}/b", f"{scratch}/rejected")

    def sleep(rows):
        time.sleep(60)
        yield from rows

    def stalled(df):
        df.mapInPandas(sleep, df.schema).collect()

    began = time.monotonic()
    q = start_ingest(spark, C.text_source(spark, f"{scratch}/in"), paths, stalled, lambda df: None, trigger={"availableNow": True}, limits=Limits(5, 3))
    with pytest.raises(Exception, match="longer than its time limit of 3 s"):
        q.awaitTermination()
    assert time.monotonic() - began < 40 and "time limit" in str(q.exception())
    # with a sink that works again the query goes on with the same micro-batch
    q = start_ingest(spark, C.text_source(spark, f"{scratch}/in"), paths, C.text_sink(f"{scratch}/processed"), C.text_sink(f"{scratch}/invalid"), trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.read.parquet(paths.raw_table).count() == 1


def test_least_pause(spark):
    starts = []
    run = within_limits(spark, lambda batch, epoch: starts.append(time.monotonic()), Limits(0.4, 60))
    for epoch in range(3):
        run(None, epoch)
    assert all(b - a >= 0.39 for a, b in zip(starts, starts[1:]))
    quick = within_limits(spark, lambda batch, epoch: starts.append(time.monotonic()), Limits(5, 60), pauses=False)
    began = time.monotonic()
    quick(None, 0), quick(None, 1)
    assert time.monotonic() - began < 1


class Target:
    """A keyed table in a file; every n-th write of a connection fails after half of its rows."""

    def __init__(self, path, failures):
        self.path, self.failures, self.open = path, failures, []

    def connect(self):
        target = self

        class Connection:
            def __init__(self):
                self.rows = []

            def cursor(self):
                return self

            def executemany(self, statement, rows):
                if target.failures:
                    target.failures.pop()
                    self.rows = rows[: len(rows) // 2]
                    raise OSError("connection lost")
                self.rows = rows

            def commit(self):
                table = json.loads(target.path.read_text()) if target.path.exists() else {}
                for key, value in self.rows:
                    table.setdefault(str(key), value)
                target.path.write_text(json.dumps(table))
                self.rows = []

            def rollback(self):
                self.rows = []

            def close(self):
                target.open.remove(self)

        target.open.append(Connection())
        return target.open[-1]


def test_a_target_that_fails_twice_gets_every_row_once(tmp_path):
    rows = [(i, i * i) for i in range(1234)]
    target = Target(tmp_path / "t", [1, 1])
    assert write_partition(rows, target.connect, "", batch_rows=500, pause=0) == 3
    assert json.loads(target.path.read_text()) == {str(i): v for i, v in rows} and not target.open
    # the whole partition again (a repeated task) adds nothing
    write_partition(rows, target.connect, "", pause=0)
    assert len(json.loads(target.path.read_text())) == 1234
    broken = Target(tmp_path / "u", [1] * 3)
    with pytest.raises(OSError, match="connection lost"):
        write_partition(rows, broken.connect, "", pause=0)
    assert not broken.open and not broken.path.exists()


class Recorder:
    """One file a batch, in a folder that all tasks see."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        return self

    def cursor(self):
        return self

    def executemany(self, statement, rows):
        import os
        import uuid
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            json.dump([statement, rows], f)

    def commit(self):
        pass

    rollback = close = commit


def test_database_sink_writes_bounded_batches(spark, tmp_path):
    database_sink(Recorder(str(tmp_path)), "events", ["id"], connections=2, batch_rows=100)(spark.range(1050).selectExpr("id", "id * 2 AS twice"))
    written = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert {s for s, _ in written} == {insert_statement("events", ["id", "twice"], ["id"])}
    assert max(len(r) for _, r in written) == 100 and sorted(x[0] for _, r in written for x in r) == list(range(1050))


def test_statements():
    assert insert_statement("t", ["a", "b", "c"], ["a"]) == "INSERT INTO t (a, b, c) VALUES (%s, %s, %s) ON CONFLICT (a) DO NOTHING"
    assert insert_statement("t", ["a", "b", "c"], ["a", "b"], replace=True, mark="?") == "INSERT INTO t (a, b, c) VALUES (?, ?, ?) ON CONFLICT (a, b) DO UPDATE SET c = EXCLUDED.c"
    assert [len(b) for b in batches([(i,) for i in range(7)], 3)] == [3, 3, 1] and list(batches([], 3)) == []


# ---------------------------------------------------------------- options

class FakeReader:
    """Takes the place of a reader or writer; keeps what it is told."""

    def __init__(self, spark):
        self.spark, self.told = spark, {}

    @property
    def readStream(self):  # noqa: N802 - as in Spark
        return self

    @property
    def write(self):
        return self

    def select(self, *columns):
        self.told["columns"] = columns
        return self

    def format(self, name):
        self.told["format"] = name
        return self

    def option(self, key, value):
        self.told[key] = value
        return self

    def options(self, **more):
        self.told.update(more)
        return self

    def mode(self, name):
        self.told["mode"] = name
        return self

    def load(self):
        return self.spark.createDataFrame([(bytearray(b"m"), 3, 7)], "value binary, partition int, offset long")

    def save(self):
        self.told["saved"] = True


def test_topic_source_options(spark):
    fake = FakeReader(spark)
    row = C.kafka_source(fake, "host:1", "topic-a", min_partitions=12, failOnDataLoss="false").first()
    assert fake.told == {"format": "kafka", "kafka.bootstrap.servers": "host:1", "subscribe": "topic-a", "startingOffsets": "earliest",
                         "minPartitions": "12", "failOnDataLoss": "false"}
    assert row["value"] == "m" and row["arrival"] == 3 * (1 << 40) + 7


def test_topic_and_database_sink_options(spark):
    fake = FakeReader(spark)
    C.kafka_sink("host:1", "topic-b")(fake)
    assert fake.told == {"columns": ("value",), "format": "kafka", "kafka.bootstrap.servers": "host:1", "topic": "topic-b", "saved": True}
    fake = FakeReader(spark)
    C.jdbc_sink("jdbc:postgresql://h/db", "events", "u", "p", 200)(fake)
    assert fake.told == {"format": "jdbc", "url": "jdbc:postgresql://h/db", "dbtable": "events", "user": "u", "password": "p", "batchsize": "200",
                         "driver": "org.postgresql.Driver", "mode": "append", "saved": True}
