"""Decode, validate, route and enrich raw JSON events (one projection).

``process_events`` turns a frame with a JSON text column into typed event
columns plus ``validation_error`` (NULL = valid). Validation is ordered and
stops at the first failure; a value that is present but of the wrong JSON
type, or not convertible, is a decode error and comes before every rule.
Everything is a built-in expression, so the whole step is one codegen'd
projection after the scan: no shuffle, no Python.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.plan import fence
from ..functions.text import canonical_uuid, is_blank, is_uuid_text, java_trim, matches_symbol
from ..functions.timefn import format_instant, nonneg_millis_between, parse_instant
from ..schema import PRICE, PROCESSED_FIELDS, TEXT_FIELDS, WIRE_FIELDS

# The rejection messages of the event contract, in rule order,
# and the default producer id.
MSG_EVENT_ID_REQUIRED = "event_id is required"
MSG_EVENT_ID_UUID = "event_id must be a UUID"
MSG_SYMBOL = "symbol is required and must match [A-Za-z0-9._-]+"
MSG_PRICE = "price must be greater than zero"
MSG_QUANTITY = "quantity must be greater than zero"
MSG_EVENT_TIME_REQUIRED = "event_time is required"
MSG_PRODUCER_TIME_REQUIRED = "producer_time is required"
MSG_SOURCE_REQUIRED = "source is required"
MSG_SCENARIO_REQUIRED = "scenario is required"
MSG_SEQUENCE = "sequence must be greater than or equal to zero"
DEFAULT_PRODUCER_ID = "unknown"

# Our own texts for failures whose wording came from library exceptions.
MSG_MALFORMED = "malformed JSON"
MSG_EVENT_TIME_FORMAT = "event_time is not an ISO-8601 instant"
MSG_PRODUCER_TIME_FORMAT = "producer_time is not an ISO-8601 instant"

_JSON_OPTIONS = {
    "columnNameOfCorruptRecord": "_corrupt_record",
    "mode": "PERMISSIVE",
    # Strict JSON, as a default object mapper reads it.
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
}

_INT_BOUNDS = {"int": (-2147483648, 2147483647), "long": (-9223372036854775808, 9223372036854775807)}


def _kind(t: Column) -> Column:
    """JSON kind from ``schema_of_variant``: STRING, NUMBER, BOOLEAN, OBJECT,
    ARRAY, or NULL when the field is missing or JSON null."""
    return (F.when(t.isNull() | (t == "VOID"), F.lit(None))
            .when(t == "STRING", F.lit("STRING"))
            .when(t == "BOOLEAN", F.lit("BOOLEAN"))
            .when(t.startswith("OBJECT"), F.lit("OBJECT"))
            .when(t.startswith("ARRAY"), F.lit("ARRAY"))
            .otherwise(F.lit("NUMBER")))


_INT_LITERAL = r"\A[+-]?[0-9]+\z"
# A price of more digits than a double is sure to hold, or with an exponent
# (the pattern starts with a literal, which is searched for quickly).
_LONG_NUMBER = r"\"price\"\s*:\s*-?[0-9.]*(?:[0-9.]{16}|[eE])"
_JSON_NUMBER = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
_TEXT_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in WIRE_FIELDS]
                            + [T.StructField("_corrupt_record", T.StringType(), True)])


def _context_key() -> int:
    from pyspark import SparkContext
    return id(SparkContext._active_spark_context)


@functools.lru_cache(maxsize=64)
def _decode_stages(ctx: int, value_col: str, columns: tuple[str, ...]) -> list[list[Column]]:
    """The six projections of ``decode`` for an input with ``columns``.

    Built once per Spark context and input shape: the expressions are plain
    unresolved Columns, reusable in every DataFrame (and every micro-batch)
    with the same columns; building them is thousands of calls into the JVM.
    """
    raw = F.col(value_col)
    keep = [F.col(f"`{c}`") for c in columns]
    stages: list[list[Column]] = []
    # 1: text parse. A number's text goes through a double; where that may lose
    #    digits, the root's price is parsed once more, as an exact decimal.
    exact = F.from_json(raw, T.StructType([T.StructField("price", PRICE)]), _JSON_OPTIONS).getField("price")
    stages.append([*keep, F.from_json(raw, _TEXT_SCHEMA, _JSON_OPTIONS).alias("_j"), F.when(raw.rlike(_LONG_NUMBER), exact).alias("_exact")])
    # 2: field texts, trimmed numeric texts, root check, ambiguity flag
    j = lambda f: F.col(f"_j.{f}")
    ambiguous = F.lit(False)
    for f in TEXT_FIELDS:
        ambiguous = ambiguous | F.coalesce(j(f).startswith("{") | j(f).startswith("["), F.lit(False))
    for f in ("quantity", "sequence"):
        ambiguous = ambiguous | F.coalesce(~j(f).rlike(_INT_LITERAL) & java_trim(j(f)).rlike(_JSON_NUMBER),
                                           F.lit(False))
    root_bad = (F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull()
                | ~F.coalesce(raw.rlike(r"\A\s*\{"), F.lit(False)))
    # (a decimal that is another number than the text is none of the message's)
    same = F.col("_exact").cast("double") == j("price").try_cast("double")
    price = F.when(same, F.col("_exact").cast("string")).otherwise(java_trim(j("price")))
    stages.append([*keep, root_bad.alias("_root_bad"), ambiguous.alias("_amb"),
                   *[j(f).alias(f"_s_{f}") for f in WIRE_FIELDS],
                   price.alias("_t_price"), *[java_trim(j(f)).alias(f"_t_{f}") for f in ("quantity", "sequence")]])
    passthrough = [F.col("_root_bad"), F.col("_amb")] + [F.col(f"_s_{f}") for f in WIRE_FIELDS] \
        + [F.col(f"_t_{f}") for f in ("price", "quantity", "sequence")]
    # 3: second parse, only for ambiguous rows (a codegen'd parse, not a
    #    from_json with a VARIANT schema, which is not)
    v_col = F.when(F.col("_amb"), F.try_parse_json(raw)).alias("_v")
    stages.append([*keep, *passthrough, v_col])
    # 4: JSON kinds (ambiguous rows only) and the sub-values needed later
    fv = lambda f: F.try_variant_get(F.col("_v"), f"$.{f}", "variant")
    stage4 = [F.when(F.col("_amb"), _kind(F.schema_of_variant(fv(f)))).alias(f"_k_{f}") for f in WIRE_FIELDS]
    stage4 += [F.when(F.col("_amb"), fv(f)).alias(f"_fv_{f}") for f in ("quantity", "sequence")]
    stages.append([*keep, *passthrough, *stage4])
    # 5: typed values and per-field failures
    stage5 = []
    for f in WIRE_FIELDS:
        s, k = F.col(f"_s_{f}"), F.col(f"_k_{f}")
        if f in TEXT_FIELDS:
            bad = F.coalesce(k.isin("OBJECT", "ARRAY"), F.lit(False))
            stage5 += [F.when(~bad, s).alias(f"w_{f}"), bad.alias(f"_bad_{f}")]
            continue
        t = F.col(f"_t_{f}")
        empty = t.isNull() | (t == "") | (t == "null")
        if f == "price":
            value = t.try_cast(PRICE.simpleString())
        else:
            target = "int" if f == "quantity" else "long"
            lo, hi = _INT_BOUNDS[target]
            from_int = F.when(t.rlike(_INT_LITERAL), F.regexp_replace(t, r"\A\+", "").try_cast(target))
            v = F.col(f"_fv_{f}")
            d = F.try_variant_get(v, "$", "double")
            in_range = d.isNotNull() & (d >= F.lit(float(lo))) & (d <= F.lit(float(hi)))
            # a fractional JSON number is truncated toward zero
            from_fraction = F.when((k == "NUMBER") & in_range,
                                   F.try_variant_get(v, "$", "decimal(38,6)").try_cast(target))
            value = F.coalesce(from_int, from_fraction)
        stage5 += [F.when(~empty, value).alias(f"w_{f}"), (~empty & value.isNull()).alias(f"_bad_{f}")]
    stages.append([*keep, F.col("_root_bad"), *stage5])
    # 6: first decode failure; helpers dropped in the same projection
    err = F.when(F.col("_root_bad"), F.lit(MSG_MALFORMED))
    for f in WIRE_FIELDS:
        err = err.when(F.col(f"_bad_{f}"), F.lit(f"invalid {f}"))
    stages.append([*keep, *[F.col(f"w_{f}") for f in WIRE_FIELDS], err.alias("decode_error")])
    return stages


def decode(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Add typed wire columns ``w_<field>`` and ``decode_error`` to ``df``.

    Fast path: one ``from_json`` with every field as text (scalars come out as
    their text, objects and arrays as their JSON). The JSON *type* of a value
    matters only where that text is ambiguous - a text field holding ``{...}``
    or ``[...]`` (object, or a string that looks like one?), and an integer
    field holding a fractional number (truncated if it is a number, rejected if
    it is a string). Only such rows are parsed a second time, as VARIANT, in a
    lazily evaluated CASE branch. Stages refer to each other by name, so no
    large sub-expression is copied into several consumers.
    """
    out = df
    for stage in _decode_stages(_context_key(), value_col, tuple(df.columns)):
        out = out.select(*stage)
    return out


def validation_error(decoded: DataFrame) -> Column:
    """First failing rule, in contract order, or NULL."""
    c = lambda f: F.col(f"w_{f}")
    return (F.when(F.col("decode_error").isNotNull(), F.col("decode_error"))
            .when(is_blank(c("event_id")), MSG_EVENT_ID_REQUIRED)
            .when(~is_uuid_text(c("event_id")), MSG_EVENT_ID_UUID)
            .when(is_blank(c("symbol")) | ~matches_symbol(c("symbol")), MSG_SYMBOL)
            .when(c("price").isNull() | (c("price") <= 0), MSG_PRICE)
            .when(c("quantity").isNull() | (c("quantity") <= 0), MSG_QUANTITY)
            .when(is_blank(c("event_time")), MSG_EVENT_TIME_REQUIRED)
            .when(is_blank(c("producer_time")), MSG_PRODUCER_TIME_REQUIRED)
            .when(F.col("_event_ts").isNull(), MSG_EVENT_TIME_FORMAT)
            .when(F.col("_producer_ts").isNull(), MSG_PRODUCER_TIME_FORMAT)
            .when(is_blank(c("source")), MSG_SOURCE_REQUIRED)
            .when(is_blank(c("scenario")), MSG_SCENARIO_REQUIRED)
            .when(c("sequence").isNull() | (c("sequence") < 0), MSG_SEQUENCE))


@functools.lru_cache(maxsize=64)
def _process_stages(ctx: int, processing_time_col: str | None, columns: tuple[str, ...],
                    originals: tuple[str, ...]) -> list[list[Column]]:
    """The projections of ``process_events`` after ``decode`` (cached like
    ``_decode_stages``): stamps and parsed times, the rule chain, enrichment."""
    pt = F.col(processing_time_col) if processing_time_col else F.current_timestamp()
    keep = [F.col(f"`{c}`") for c in columns]
    stages = [[*keep, pt.cast("timestamp").alias("_pt"),
               parse_instant(F.col("w_event_time")).alias("_event_ts"),
               parse_instant(F.col("w_producer_time")).alias("_producer_ts")]]
    stages.append([*keep, F.col("_pt"), F.col("_event_ts"), F.col("_producer_ts"),
                   fence(validation_error(None)).alias("validation_error")])
    ok = F.col("validation_error").isNull()
    enriched = {
        "event_id": F.col("w_event_id"),
        "producer_id": F.when(is_blank(F.col("w_producer_id")), F.lit(DEFAULT_PRODUCER_ID))
                        .otherwise(F.col("w_producer_id")),
        "symbol": F.when(ok, F.upper(F.col("w_symbol"))).otherwise(F.col("w_symbol")),
        "price": F.col("w_price"),
        "quantity": F.col("w_quantity"),
        "event_time": F.col("_event_ts"),
        "producer_time": F.col("_producer_ts"),
        "processing_time": F.col("_pt"),
        "source": F.col("w_source"),
        "scenario": F.col("w_scenario"),
        "sequence": F.col("w_sequence"),
        "ingestion_latency_ms": nonneg_millis_between(F.col("_producer_ts"), F.col("_pt")),
        "event_lag_ms": nonneg_millis_between(F.col("_event_ts"), F.col("_pt")),
        "event_uuid": F.when(ok, canonical_uuid(F.col("w_event_id"))),
    }
    passed = [F.col(f"`{c}`") for c in originals if c not in enriched and c != "validation_error"]
    stages.append([*passed, *[e.alias(n) for n, e in enriched.items()], F.col("validation_error")])
    return stages


def process_events(df: DataFrame, value_col: str = "value",
                   processing_time_col: str | None = None) -> DataFrame:
    """Decode + validate + enrich.

    Returns every input column, the processed event columns (typed), the
    canonical key column ``event_uuid`` and ``validation_error``. The processing
    stamp is ``processing_time_col`` when given (replay, tests), else
    ``current_timestamp()``: one value per query / micro-batch, kept in the
    streaming offset log, so a replayed batch gets the same stamp.
    """
    out = decode(df, value_col)
    for stage in _process_stages(_context_key(), processing_time_col, tuple(out.columns), tuple(df.columns)):
        out = out.select(*stage)
    return out


PROCESSED_COLUMNS = [n for n, _ in PROCESSED_FIELDS]


def valid_events(processed: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Valid branch: the processed event columns (plus ``event_uuid`` and extras)."""
    return processed.filter(F.col("validation_error").isNull()) \
        .select(*PROCESSED_COLUMNS, "event_uuid", *(extra or []))


def invalid_events(processed: DataFrame, value_col: str = "value",
                   extra: list[str] | None = None) -> DataFrame:
    """Rejected branch: raw text, reason and stamp."""
    return processed.filter(F.col("validation_error").isNotNull()) \
        .select(F.col(value_col).alias("raw"), "validation_error", "processing_time", *(extra or []))


def processed_json(valid: DataFrame) -> DataFrame:
    """Processed message: the 13 event fields and ``valid=true``, times as ISO text."""
    s = F.struct(
        F.col("event_id"), F.col("producer_id"), F.col("symbol"), F.col("price"), F.col("quantity"),
        format_instant(F.col("event_time")).alias("event_time"),
        format_instant(F.col("producer_time")).alias("producer_time"),
        format_instant(F.col("processing_time")).alias("processing_time"),
        F.col("source"), F.col("scenario"), F.col("sequence"),
        F.col("ingestion_latency_ms"), F.col("event_lag_ms"), F.lit(True).alias("valid"))
    return valid.select(F.to_json(s).alias("value"))


def invalid_json(invalid: DataFrame) -> DataFrame:
    """Invalid envelope: ``valid=false``, reason, stamp, and the payload as JSON
    when the text parses, else the text as ``raw``; NULL fields are left out."""
    payload = F.try_parse_json(F.col("raw"))
    s = F.struct(
        F.lit(False).alias("valid"),
        F.col("validation_error"),
        format_instant(F.col("processing_time")).alias("processing_time"),
        F.when(payload.isNull(), F.col("raw")).alias("raw"),
        payload.alias("payload"))
    return invalid.select(F.to_json(s).alias("value"))
