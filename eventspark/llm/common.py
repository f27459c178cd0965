"""Intermediate tables, and small helpers shared by the operators.

Stages that several later stages read are written as Parquet tables below the
folder named by ``spark.checkpoint.dir``. That folder is shared by the driver
and all executors, so a lost executor costs only the tasks that were running.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.session import work_path

#: Rows and bytes handed to a Python task at once; texts may be long.
ARROW_ROWS, ARROW_BYTES = 1000, "4m"


@contextmanager
def bounded_batches(spark: SparkSession):
    """Bound what a Python task of the jobs run inside holds at once; the
    session has its own settings again afterwards. (A result that is returned
    without being run goes by the session's settings.)"""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Workspace:
    """Tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, work_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and continue from the files."""
        with bounded_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later stage reads."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = hadoop(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the result and delete every other table of the run."""
        out = self.save(df, "result")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        base = hadoop(self.base)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(base):
            if status.getPath().getName() != "result":
                fs.delete(status.getPath(), True)
        return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under its own names, so that
    further columns with clashing names do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def hash_place(*cols: str) -> Column:
    """A reproducible random place in [0, 1) of a row."""
    return F.pmod(F.xxhash64(F.lit(20240613), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def hash_head(df: DataFrame, most: int, *cols: str) -> DataFrame:
    """The first ``most`` rows in hash order. All but about twice as many are
    left out by their place before the rest is sorted, so what reaches one
    task does not grow with the input."""
    share = (2 * most + 100) / max(1, df.count())
    return df.where(hash_place(*cols) < share).orderBy(hash_place(*cols), *cols).limit(most)
