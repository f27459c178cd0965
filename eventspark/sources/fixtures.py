"""Event streams derived from the driver's tables.

``event_stream(spark, sf_dir)`` turns every row of ``events`` into one raw
JSON event message, plus a second delivery of the events with ``props.k = 4``
(about 1 %: a re-sent copy whose UUID text is upper-case and which arrives
1.5 s later), so
that duplicate handling, case-insensitive keys and "first copy wins" are
exercised on the whole table. The processing stamp is injected (a replay
clock) instead of the wall clock so that results are reproducible:

* ``processing_time = 2024-01-01T00:00:00Z + event_id * 200 ms`` (+1.5 s for
  the copy); ``producer_time = processing_time - (event_id * 7919) % 997 ms``
  of the first delivery; ``event_time = producer_time - event_id % 13 ms``.
* symbol ``lower(event_type)`` (upper-cased by ingestion), price
  ``value`` as DECIMAL(18,6), quantity ``props.k``, scenario from
  ``user_id % 3``, producer ``producer-<user_id % 5>``, sequence ``event_id``.
* rule-breaking rows come from the data itself: ``k = 0`` (quantity) and
  ``value = 0`` (price) occur naturally; ``k = 1`` gets a blank in the
  symbol, ``k = 2`` a blank event_time and ``k = 3`` a truncated JSON text.

``bench_stream`` maps ``lineitem`` to events the same way (the high-volume
run: one event per line item, 1,000 per second).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derived stream.
EPOCH = "2024-01-01 00:00:00"
STEP_MS = 200
COPY_DELAY_MS = 1500
RESEND_K = 4
SCENARIOS = ["low", "medium", "high"]
UUID_PREFIX = "00000000-0000-4000-a000-"

_T_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, splits: int | None) -> DataFrame:
    """``splits`` input splits for a source that comes in fewer files than there
    are cores (a benchmark on one machine); None leaves the source as it is."""
    return df.repartition(splits) if splits else df


def _epoch_micros() -> F.Column:
    return F.unix_micros(F.to_timestamp(F.lit(EPOCH)))


def event_stream(spark: SparkSession, sf_dir: str, splits: int | None = None, table_times: bool = False) -> DataFrame:
    """Raw messages ``(value STRING, processing_time TIMESTAMP, arrival BIGINT)``.
    With ``table_times`` the stream runs over the table's own ``ts`` (30 days,
    whole milliseconds) instead of the replay clock."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", "ts")
    ev = spread(ev, splits).select("event_id", "user_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    # one scan, with k read once a row, for both deliveries
    eid, k = F.col("event_id"), F.col("k")
    src = ev.withColumn("copy", F.explode(F.when(k == RESEND_K, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))

    own = F.unix_micros(F.col("ts").cast("timestamp"))
    base = own - F.pmod(own, F.lit(1000)) if table_times else _epoch_micros() + eid * (STEP_MS * 1000)
    pt = F.timestamp_micros(base + F.col("copy") * (COPY_DELAY_MS * 1000))
    prod = F.timestamp_micros(base - ((eid * 7919) % 997) * 1000)
    evt = F.timestamp_micros(base - ((eid * 7919) % 997) * 1000 - (eid % 13) * 1000)
    uuid_text = F.concat(F.lit(UUID_PREFIX), F.lpad(eid.cast("string"), 12, "0"))
    scenario = F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), (F.col("user_id") % 3 + 1).cast("int"))
    symbol = F.lower(F.col("event_type"))
    wire = F.struct(
        F.when(F.col("copy") == 1, F.upper(uuid_text)).otherwise(uuid_text).alias("event_id"),
        F.concat(F.lit("producer-"), (F.col("user_id") % 5).cast("string")).alias("producer_id"),
        F.when(k == 1, F.concat(symbol, F.lit(" x"))).otherwise(symbol).alias("symbol"),
        F.col("value").cast("decimal(18,6)").alias("price"),
        k.alias("quantity"),
        F.when(k == 2, F.lit("")).otherwise(F.date_format(evt, _T_FMT)).alias("event_time"),
        F.date_format(prod, _T_FMT).alias("producer_time"),
        F.lit("synthetic").alias("source"),
        scenario.alias("scenario"),
        eid.alias("sequence"),
    )
    js = F.to_json(wire)
    text = F.when(k == 3, F.expr("substring(_js, 1, length(_js) - 1)")).otherwise(F.col("_js"))
    return (src.withColumns({"_js": js, "processing_time": pt,
                             "arrival": eid * 2 + F.col("copy")})
            .select(text.alias("value"), "processing_time", "arrival"))


#: What ``rule_stream`` does to an event: by ``event_id % RULE_CASES``, the field and its JSON text (None: left out).
RULE_CASES = 24
BROKEN = {
    0: ("event_id", '" "'), 1: ("event_id", '"not-a-uuid"'), 2: ("symbol", '"a b"'), 3: ("price", "0"), 4: ("price", '"abc"'), 5: ("quantity", "-1"),
    6: ("quantity", '"x1"'), 7: ("event_time", None), 8: ("producer_time", '""'), 9: ("event_time", '"2024-01-01"'), 10: ("producer_time", '"yesterday"'),
    11: ("source", '" "'), 12: ("scenario", None), 13: ("sequence", "-5"), 14: ("sequence", None), 15: ("price", "12,"), 16: ("producer_id", None),
    17: ("symbol", None), 18: ("quantity", "2.9"), 19: ("price", "0.123456789012345678"), 20: ("price", "123456789.123456789012"),
    21: ("price", "987654321.123456789012345678"),
}
#: And a further field before all others, which is none of the event's.
FURTHER = {21: '"meta":{"price":987654321.123456789012345699}', 22: '"price_list":[{"price":1.5e3}]'}


def rule_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event; most break one rule each (``BROKEN``), so that
    every rule, default and conversion occurs. Columns as ``event_stream``."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    eid, case = F.col("event_id"), F.col("event_id") % RULE_CASES
    base = _epoch_micros() + eid * (STEP_MS * 1000)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = {
        "event_id": quoted(F.concat(F.lit(UUID_PREFIX), F.lpad(eid.cast("string"), 12, "0"))),
        "producer_id": quoted(F.concat(F.lit("producer-"), (F.col("user_id") % 5).cast("string"))),
        "symbol": quoted(F.lower("event_type")),
        "price": F.concat((eid % 900 + 1).cast("string"), F.lit(".25")),
        "quantity": (eid % 7 + 1).cast("string"),
        "event_time": quoted(F.date_format(F.timestamp_micros(base - 5000), _T_FMT)),
        "producer_time": quoted(F.date_format(F.timestamp_micros(base - 2000), _T_FMT)),
        "source": F.lit('"rules"'),
        "scenario": F.lit('"low"'),
        "sequence": eid.cast("string"),
    }
    members = [F.when(case == n, F.lit(member)) for n, member in FURTHER.items()]
    for name, text in fields.items():
        for n, (field, broken) in BROKEN.items():
            if field == name:
                text = F.when(case == n, F.lit(broken)).otherwise(text)
        members.append(F.concat(F.lit(f'"{name}":'), text))  # null: left out below
    value = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    return ev.select(value.alias("value"), F.timestamp_micros(base).alias("processing_time"), eid.alias("arrival"))


def bench_stream(spark: SparkSession, sf_dir: str, per_second: int = 1000, splits: int | None = None) -> DataFrame:
    """``lineitem`` as raw messages: symbol = returnflag||linestatus, price =
    extendedprice, quantity = quantity; the sequence number is
    ``l_orderkey * 8 + l_linenumber`` (unique and monotone in line order, since
    line numbers are 1..7), so no global sort or window is needed."""
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_suppkey"), splits)
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    step_us = 1_000_000 // per_second
    base = _epoch_micros() + seq * step_us
    pt = F.timestamp_micros(base)
    prod = F.timestamp_micros(base - ((seq * 7919) % 997) * 1000)
    evt = F.timestamp_micros(base - ((seq * 7919) % 997) * 1000 - (seq % 13) * 1000)
    wire = F.struct(
        F.concat(F.lit(UUID_PREFIX), F.lpad(seq.cast("string"), 12, "0")).alias("event_id"),
        F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 7).cast("string")).alias("producer_id"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("symbol"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.date_format(evt, _T_FMT).alias("event_time"),
        F.date_format(prod, _T_FMT).alias("producer_time"),
        F.lit("lineitem").alias("source"),
        F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("scenario"),
        seq.alias("sequence"),
    )
    return li.select(F.to_json(wire).alias("value"), pt.alias("processing_time"), seq.alias("arrival"))
