"""Decode / validate / route / enrich on hand-written edge rows."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from eventspark.operators import ingest as I

PT = dt.datetime(2031, 9, 17, 6, 0, 1)

GOOD = {
    "event_id": "3f1c2a9e-8b7d-4c6e-9f00-1a2b3c4d5e6f",
    "producer_id": "producer-1",
    "symbol": "kelp7",
    "price": 61.375,
    "quantity": 43,
    "event_time": "2031-09-17T06:00:00.123Z",
    "producer_time": "2031-09-17T06:00:00.200Z",
    "source": "test",
    "scenario": "low",
    "sequence": 1,
}


def ev(**changes):
    d = dict(GOOD)
    for k, v in changes.items():
        if v is _MISSING:
            d.pop(k, None)
        else:
            d[k] = v
    return json.dumps(d)


_MISSING = object()
UUIDMSG = I.MSG_EVENT_ID_UUID
TIMEFMT = I.MSG_EVENT_TIME_FORMAT

# (name, raw text, expected validation_error or None for valid)
CASES = [
    ("good", ev(), None),
    ("no producer_id", ev(producer_id=_MISSING), None),
    ("blank producer_id", ev(producer_id="   "), None),
    ("tab producer_id", ev(producer_id="\t"), None),
    ("unknown field", ev(extra_field=1), None),
    ("text after brace", ev() + " trailing", None),
    ("quantity as text", ev(quantity="5"), None),
    ("quantity fractional", ev().replace('"quantity": 43', '"quantity": 5.9'), None),
    ("price as text", ev(price="61.375"), None),
    ("event_id missing", ev(event_id=_MISSING), I.MSG_EVENT_ID_REQUIRED),
    ("event_id tab", ev(event_id="\t"), I.MSG_EVENT_ID_REQUIRED),
    ("event_id not uuid", ev(event_id="not-a-uuid"), UUIDMSG),
    ("event_id short groups", ev(event_id="1-1-1-1-1"), None),
    ("symbol newline", ev(symbol="KELP7\n"), I.MSG_SYMBOL),
    ("symbol blank inside", ev(symbol="A B"), I.MSG_SYMBOL),
    ("symbol empty", ev(symbol=""), I.MSG_SYMBOL),
    ("symbol missing", ev(symbol=_MISSING), I.MSG_SYMBOL),
    ("price zero", ev(price=0), I.MSG_PRICE),
    ("price negative", ev(price=-1), I.MSG_PRICE),
    ("price missing", ev(price=_MISSING), I.MSG_PRICE),
    ("quantity zero", ev(quantity=0), I.MSG_QUANTITY),
    ("quantity negative", ev(quantity=-1), I.MSG_QUANTITY),
    ("quantity missing", ev(quantity=_MISSING), I.MSG_QUANTITY),
    ("event_time blank", ev(event_time=""), I.MSG_EVENT_TIME_REQUIRED),
    ("producer_time blank", ev(producer_time=" "), I.MSG_PRODUCER_TIME_REQUIRED),
    ("event_time date only", ev(event_time="2031-09-17"), TIMEFMT),
    ("event_time no zone", ev(event_time="2031-09-17T06:00:00"), TIMEFMT),
    ("event_time garbage", ev(event_time="garbage"), TIMEFMT),
    ("event_time offset", ev(event_time="2031-09-17T06:00:00+02:00"), None),
    ("event_time nanos", ev(event_time="2031-09-17T06:00:00.123456789Z"), None),
    ("bad time and blank source", ev(event_time="garbage", source=""), TIMEFMT),
    ("source blank", ev(source=""), I.MSG_SOURCE_REQUIRED),
    ("scenario blank", ev(scenario="  "), I.MSG_SCENARIO_REQUIRED),
    ("sequence negative", ev(sequence=-1), I.MSG_SEQUENCE),
    ("sequence missing", ev(sequence=_MISSING), I.MSG_SEQUENCE),
    ("bad price and quantity", ev(price=0, quantity=0), I.MSG_PRICE),
    ("producer_time in future", ev(producer_time="2031-09-17T07:00:00Z"), None),
    ("not json", "nope", I.MSG_MALFORMED),
    ("array root", "[1]", I.MSG_MALFORMED),
    ("null root", "null", I.MSG_MALFORMED),
    ("empty text", "", I.MSG_MALFORMED),
    ("quantity overflow", ev(quantity=99999999999), "invalid quantity"),
    ("quantity boolean", ev(quantity=True), "invalid quantity"),
    ("price text not number", ev(price="abc"), "invalid price"),
    ("month 13", ev(event_time="2031-13-17T06:00:00Z"), TIMEFMT),
    ("symbol object", ev(symbol={"a": 1}), "invalid symbol"),
    ("quantity empty text", ev(quantity=""), I.MSG_QUANTITY),
    ("symbol as number", ev(symbol=7), None),
    ("symbol string holding json", ev(symbol='{"a":1}'), I.MSG_SYMBOL),
    ("quantity fractional text", ev(quantity="5.9"), "invalid quantity"),
    ("single quotes", ev().replace('"source": "test"', "'source': 'test'"), I.MSG_MALFORMED),
    ("lower-case t and z", ev(event_time="2031-09-17t06:00:00z"), None),
]


# JSON numbers that a double does not hold, and prices at the edge of DECIMAL(38,18)
PRICES = [("123456789.123456789012", "123456789.123456789012"), ("1234567890123456.789", "1234567890123456.789"),
          ("0.123456789012345678", "0.123456789012345678"), ("1.25e2", "125"), ("100000000000000000", "1E17"),
          ("99999999999999999999.999999999999999999", "99999999999999999999.999999999999999999"),
          ("0.1000000000000000055", "0.100000000000000006"),
          ("1e21", None), ("1e-19", None)]  # beyond 20 whole digits: invalid; rounds to zero: not greater than zero


def test_prices_keep_their_digits(spark):
    rows = [(i, ev().replace("61.375", text), PT) for i, (text, _) in enumerate(PRICES)]
    df = spark.createDataFrame(rows, "i int, value string, processing_time timestamp")
    got = {r["i"]: r for r in I.process_events(df, "value", "processing_time").collect()}
    for i, (text, want) in enumerate(PRICES):
        if want is not None:
            assert got[i]["validation_error"] is None and got[i]["price"] == Decimal(want), (text, got[i]["price"])
    assert got[len(PRICES) - 2]["validation_error"] == "invalid price"
    assert got[len(PRICES) - 1]["validation_error"] == I.MSG_PRICE
    # the sent digits also come out again, and the largest price has a metric row
    from eventspark.operators.metrics import window_metrics
    good = I.valid_events(I.process_events(df, "value", "processing_time"))
    sent = {json.loads(r["value"], parse_float=Decimal)["price"] for r in I.processed_json(good).collect()}
    assert {Decimal(w) for _, w in PRICES if w} == {Decimal(x) for x in sent}
    row = window_metrics(good.where("price >= 1e16")).first()
    total = Decimal("1E17") + Decimal("99999999999999999999.999999999999999999")
    assert row["event_count"] == 2 and row["avg_price"] == (total / 2).quantize(Decimal("0.000001"))


@pytest.fixture(scope="module")
def processed(spark):
    rows = [(name, text, PT) for name, text, _ in CASES]
    df = spark.createDataFrame(rows, "name string, value string, processing_time timestamp")
    out = I.process_events(df, "value", "processing_time")
    return {r["name"]: r for r in out.collect()}


@pytest.mark.parametrize("name,text,expected", CASES, ids=[c[0] for c in CASES])
def test_routing(processed, name, text, expected):
    assert processed[name]["validation_error"] == expected


def test_values(processed):
    g = processed["good"]
    assert g["symbol"] == "KELP7"
    assert g["price"] == Decimal("61.375")
    assert g["event_uuid"] == GOOD["event_id"]
    assert g["ingestion_latency_ms"] == 800   # 06:00:01.000 - 06:00:00.200
    assert g["event_lag_ms"] == 877
    assert processed["no producer_id"]["producer_id"] == "unknown"
    assert processed["tab producer_id"]["producer_id"] == "unknown"
    assert processed["quantity as text"]["quantity"] == 5
    assert processed["quantity fractional"]["quantity"] == 5
    assert processed["price as text"]["price"] == Decimal("61.375")
    assert processed["event_id short groups"]["event_uuid"] == "00000001-0001-0001-0001-000000000001"
    assert processed["event_id short groups"]["event_id"] == "1-1-1-1-1"
    assert processed["event_time offset"]["event_time"] == dt.datetime(2031, 9, 17, 4, 0, 0)
    assert processed["event_time nanos"]["event_time"] == dt.datetime(2031, 9, 17, 6, 0, 0, 123456)
    assert processed["producer_time in future"]["ingestion_latency_ms"] == 0
    assert processed["symbol as number"]["symbol"] == "7"


def test_envelopes(spark):
    rows = [("nope", PT), (ev(price=0), PT)]
    df = spark.createDataFrame(rows, "value string, processing_time timestamp")
    p = I.process_events(df, "value", "processing_time")
    inv = [json.loads(r["value"]) for r in I.invalid_json(I.invalid_events(p)).collect()]
    by_err = {x["validation_error"]: x for x in inv}
    assert by_err[I.MSG_MALFORMED] == {"valid": False, "validation_error": I.MSG_MALFORMED,
                                       "processing_time": "2031-09-17T06:00:01.000000Z", "raw": "nope"}
    priced = by_err[I.MSG_PRICE]
    assert "raw" not in priced and priced["payload"]["symbol"] == "kelp7" and priced["valid"] is False

    good = spark.createDataFrame([(ev(), PT)], "value string, processing_time timestamp")
    msg = json.loads(I.processed_json(I.valid_events(I.process_events(good, "value", "processing_time")))
                     .first()["value"])
    assert list(msg) == ["event_id", "producer_id", "symbol", "price", "quantity", "event_time", "producer_time",
                         "processing_time", "source", "scenario", "sequence", "ingestion_latency_ms",
                         "event_lag_ms", "valid"]
    assert msg["valid"] is True and msg["symbol"] == "KELP7" and msg["event_time"] == "2031-09-17T06:00:00.123000Z"
    assert Decimal(str(msg["price"])) == Decimal("61.375")


def test_decode_is_one_pass(spark):
    """The valid-branch filter must not copy the decode into a pushed-down filter."""
    df = spark.createDataFrame([(ev(), PT)], "value string, processing_time timestamp")
    plan = I.valid_events(I.process_events(df, "value", "processing_time"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("from_json(") <= 2  # text parse + the lazily evaluated VARIANT fallback
    assert len(plan) < 60_000
