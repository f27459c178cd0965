"""A Bloom filter of its keys for every file of the raw table.

``_keys/event_hour=<h>`` holds rows (file, block, n_blocks, lo, hi, bits): the
keys of one file whose event time lies in one hour, in blocks of 32,768 bits
(32 bits a key), with the least and greatest event time. A key sets 12 bits of
one block; chances of a false match are about one in a million.

A delivery is looked up in the hours it holds only. Its keys meet a file's
blocks only if their time lies within the file's (the time is part of the key),
so a delivery in time order meets the last few files, however full the day is.
Files that hold none of the delivery's keys are never opened.

A delivery of more than ``WIDE`` hours (a first load, a replay) would write a
small file for each of them. Its rows go to ``_keys_by_day/event_day=<d>``, by
hour in each file, so it writes about as many index files as the table gets
days; a look-up reads both folders.

Rows of files that are gone, or never came, do no harm: names are checked
against the table before they are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Folder
from .store import hour_of

FOLDER, BY_DAY = "_keys", "_keys_by_day"
#: Hours of a delivery from which on its index rows are kept by day.
WIDE = 48
BLOCK_BITS, KEYS_A_BLOCK, PROBES = 32_768, 1024, 12
MINUTE_MICROS = 60_000_000
SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n_blocks", T.LongType()),
    T.StructField("lo", T.TimestampType()), T.StructField("hi", T.TimestampType()), T.StructField("bits", T.BinaryType()),
    T.StructField("event_hour", T.LongType()),
])
DAY_SCHEMA = T.StructType([*SCHEMA.fields, T.StructField("event_day", T.LongType())])


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "event_id", "event_time")


#: A key's three hashes give four probes of 15 bits each.
HASHES = [f"h{i}" for i in range(1, PROBES // 4 + 1)]


def _hashes() -> list[Column]:
    return [_hash(i) for i in range(1, len(HASHES) + 1)]


def _named_hashes() -> list[Column]:
    return [h.alias(name) for h, name in zip(_hashes(), HASHES)]


def _probes(hashes: list[Column] | None = None) -> Column:
    """The bits of a key in its block: four of 15 bits from each hash."""
    return F.array(*[F.pmod(F.shiftrightunsigned(h, 16 * j), F.lit(BLOCK_BITS)) for h in hashes or _hashes() for j in range(4)])


def _is_set(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0


def _block_bits():
    """A function of one block's keys (their hashes) that gives its index row."""
    def bits_of(keys: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, np.uint8)
        for name in HASHES:
            h = keys.column(name).to_numpy().view(np.uint64)
            for j in range(4):
                bits[(h >> np.uint64(16 * j)) & np.uint64(BLOCK_BITS - 1)] = 1
        one = keys.slice(0, 1).select(["file", "block", "n_blocks", "lo", "hi", "event_hour"])
        return one.add_column(5, "bits", pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))
    return bits_of


def filters(rows: DataFrame) -> DataFrame:
    """The index rows of (file, event_id, event_time). A key is dealt to its
    block as three hashes, once; a block's bits are set in one go."""
    keyed = rows.withColumn("event_hour", hour_of("event_time"))
    sizes = keyed.groupBy("event_hour", "file").agg(
        F.ceil(F.count(F.lit(1)) / KEYS_A_BLOCK).cast("long").alias("n_blocks"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
    placed = keyed.join(sizes, ["event_hour", "file"])
    return (placed.select("event_hour", "file", F.pmod(_hash(0), F.col("n_blocks")).alias("block"), "n_blocks", "lo", "hi", *_named_hashes())
            .groupBy("event_hour", "file", "block").applyInArrow(_block_bits(), SCHEMA))


def keys_of_files(spark: SparkSession, path: str, schema: T.StructType, folder: str, files: list[str] | None = None) -> DataFrame:
    """(file, event_id, event_time) of files below ``folder``; ``file`` is the
    path relative to the table that they have, or will have."""
    read = spark.read.schema(schema).option("basePath", folder)
    df = read.parquet(*[f"{folder}/{f}" for f in files]) if files else read.parquet(folder)
    return df.select(F.concat(F.lit("event_date="), F.element_at(F.split("_metadata.file_path", "event_date="), -1)).alias("file"), "event_id", "event_time")


def add(rows: DataFrame, path: str, hours: int) -> None:
    """Index the keys of files that cover ``hours`` hours."""
    index = filters(rows)
    if hours <= WIDE:
        index.repartition("event_hour").write.mode("append").partitionBy("event_hour").parquet(f"{path}/{FOLDER}")
        return
    # a busy day is split by its bytes, and small days share a task
    by_day = index.withColumn("event_day", F.floor(F.col("event_hour") / 24)).hint("rebalance", F.col("event_day"))
    by_day.sortWithinPartitions("event_day", "event_hour").write.mode("append").partitionBy("event_day").parquet(f"{path}/{BY_DAY}")
    if not complete(rows.sparkSession, path):
        Folder(rows.sparkSession, f"{path}/{FOLDER}").create("_SUCCESS")


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the table has an index (of all files that came before it, too:
    they are indexed by the first write, which leaves this mark at its end)."""
    return Folder(spark, f"{path}/{FOLDER}").exists("_SUCCESS")


def hour_folders(spark: SparkSession, path: str, hours: list[int]) -> list[str]:
    """The index folders of some hours, looked for one by one if they are few."""
    return _folders(Folder(spark, f"{path}/{FOLDER}"), "event_hour", hours)


def _folders(folder: Folder, part_col: str, values) -> list[str]:
    wanted = [f"{part_col}={v}" for v in sorted(set(values))]
    there = {n for n in wanted if folder.exists(n)} if len(wanted) <= 100 else set(folder.names())
    return [f"{folder.path}/{n}" for n in wanted if n in there]


def index_of(spark: SparkSession, path: str, hours: list[int]) -> DataFrame | None:
    """The index rows of some hours, or None if there is no folder of theirs."""
    found = []
    folders = hour_folders(spark, path, hours)
    if folders:
        found.append(spark.read.schema(SCHEMA).option("basePath", f"{path}/{FOLDER}").parquet(*folders))
    folders = _folders(Folder(spark, f"{path}/{BY_DAY}"), "event_day", {h // 24 for h in hours})
    if folders:
        by_day = spark.read.schema(DAY_SCHEMA).option("basePath", f"{path}/{BY_DAY}").parquet(*folders)
        found.append(by_day.where(F.col("event_hour").between(min(hours), max(hours))).select(*SCHEMA.names))
    if not found:
        return None
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def files_that_may_hold(spark: SparkSession, path: str, keys: DataFrame, hours: list[int]) -> list[str]:
    """The files of the table that may hold any of ``keys`` (event_id,
    event_time), which lie in ``hours``. A list of names of touched hours."""
    index = index_of(spark, path, hours)
    if index is None:
        return []
    minute = lambda c: F.floor(F.unix_micros(c) / MINUTE_MICROS)
    # a file stands under every minute it covers, so a busy hour spreads over its
    # minutes; a key meets it by a number (two files of one number: both are looked at)
    number = F.xxhash64("file").alias("number")
    zones = (index.select("event_hour", number, "n_blocks", "lo", "hi").distinct()
             .withColumn("minute", F.explode(F.sequence(minute("lo"), minute("hi")))))
    near = (keys.select("event_time", minute("event_time").alias("minute"), _hash(0).alias("h0"), *_named_hashes()).join(zones, "minute")
            .where((F.col("event_time") >= F.col("lo")) & (F.col("event_time") <= F.col("hi"))
                   & (F.col("event_hour") == hour_of("event_time")))
            .select("event_hour", "number", F.pmod("h0", F.col("n_blocks")).alias("block"), *HASHES))
    met = near.join(index.select("event_hour", number, "block", "file", "bits"), ["event_hour", "number", "block"]).where(F.forall(_probes([F.col(h) for h in HASHES]), _is_set))
    names = [r[0] for r in met.select("file").distinct().collect()]
    table = Folder(spark, path)
    return sorted(f for f in names if table.exists(f))
