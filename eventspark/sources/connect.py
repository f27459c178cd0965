"""Sources and sinks: Kafka (value only) and its file twins, table paths,
CSV reports and run artefacts.

No Kafka or JDBC connector jar ships with this install, so the Kafka and
JDBC functions only build the reader/writer with the right options; tests
use the text-file twins, which produce the same ``value`` column.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic names and their environment fall-backs.
DEFAULT_RAW_TOPIC = "financial-events-raw"
LEGACY_RAW_TOPIC_ENV = "KAFKA_TOPIC_EVENTS"
RAW_TOPIC_ENV = "KAFKA_TOPIC_RAW"
DEFAULT_PROCESSED_TOPIC = "financial-events-processed"
DEFAULT_ERRORS_TOPIC = "financial-events-invalid"


def first_non_blank(*values: str | None, default: str) -> str:
    for v in values:
        if v is not None and v.strip():
            return v
    return default


def raw_topic(env: dict | None = None) -> str:
    """Preferred topic variable, else the legacy one, else the default."""
    env = os.environ if env is None else env
    return first_non_blank(env.get(RAW_TOPIC_ENV), env.get(LEGACY_RAW_TOPIC_ENV), default=DEFAULT_RAW_TOPIC)


# ------------------------------------------------------------------ sources

def kafka_source(spark: SparkSession, bootstrap: str, topic: str, min_partitions: int | None = None,
                 **options) -> DataFrame:
    """Stream of message values from the earliest offset; the key is ignored.
    ``partition``/``offset`` are kept as the arrival order. ``min_partitions``
    splits the offset ranges of a few topic partitions over more tasks (the
    per-message JSON decode is CPU-bound)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap)
              .option("subscribe", topic)
              .option("startingOffsets", "earliest"))
    if min_partitions:
        reader = reader.option("minPartitions", str(min_partitions))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.col("value").cast("string").alias("value"),
                                (F.col("partition").cast("long") * F.lit(1 << 40) + F.col("offset")).alias("arrival"))


def text_source(spark: SparkSession, path: str, stream: bool = True, max_files: int | None = None) -> DataFrame:
    """Local twin of the Kafka source: one message per line of text files, with
    the file's name and the start of the block that was read (see
    ``with_line_order``)."""
    if stream:
        r = spark.readStream.format("text")
        if max_files:
            r = r.option("maxFilesPerTrigger", str(max_files))
        df = r.load(path)
    else:
        df = spark.read.format("text").load(path)
    return df.select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"))


def with_line_order(batch: DataFrame) -> DataFrame:
    """``arrival`` of messages from ``text_source``: file, block, and the row's
    number in its task, which reads a block from its first line to its last.
    Other batches stay as they are."""
    if "source_block" not in batch.columns or "arrival" in batch.columns:
        return batch
    return batch.withColumn("arrival", F.struct("source_file", "source_block", F.monotonically_increasing_id().alias("line"))).drop("source_file", "source_block")


# -------------------------------------------------------------------- sinks

def kafka_sink_options(bootstrap: str, topic: str) -> dict[str, str]:
    """Options of the value-only Kafka sink (``value`` column, no key)."""
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic}


def kafka_sink(bootstrap: str, topic: str) -> Callable[[DataFrame], None]:
    """Writes messages (``value``) to a topic."""
    return lambda df: df.select("value").write.format("kafka").options(**kafka_sink_options(bootstrap, topic)).save()


def text_sink(path: str) -> Callable[[DataFrame], None]:
    """File twin of the Kafka sink: messages appended as text lines."""
    return lambda df: df.select("value").write.mode("append").text(path)


def jdbc_options(url: str, table: str, user: str, password: str, batch_size: int = 500) -> dict[str, str]:
    """Options for a JDBC target (batched inserts; retries are task retries)."""
    return {"url": url, "dbtable": table, "user": user, "password": password,
            "batchsize": str(batch_size), "driver": "org.postgresql.Driver"}


def jdbc_sink(url: str, table: str, user: str, password: str, batch_size: int = 500) -> Callable[[DataFrame], None]:
    """Appends rows to a database table (needs the database's driver)."""
    return lambda df: df.write.format("jdbc").options(**jdbc_options(url, table, user, password, batch_size)).mode("append").save()


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV report with a header. ``single_file`` only for bounded reports."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


# --------------------------------------------------------------- artefacts

def read_run_csv(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """All files named ``file_name`` below ``root`` (any depth), as text
    columns, with ``source_dir`` = the directory holding each file. A UTF-8 BOM
    in front of the header is removed from the first column name."""
    df = (spark.read.option("header", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", file_name).csv(root))
    renamed = {c: c.lstrip("﻿").strip() for c in df.columns if c != c.lstrip("﻿").strip()}
    if renamed:
        df = df.withColumnsRenamed(renamed)
    path = F.col("_metadata.file_path")
    return df.withColumn("source_dir", F.regexp_extract(path, r"^(.*)/[^/]+$", 1))
