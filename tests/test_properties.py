"""Property tests of the column helpers against plain-Python references."""

import datetime as dt
import uuid
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventspark.functions.numeric import ratio_half_up
from eventspark.functions.text import canonical_uuid, is_blank, is_uuid_text, java_trim
from eventspark.functions.timefn import millis_between, time_bucket

SETTINGS = settings(max_examples=25, deadline=None)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10**15), st.integers(1, 10**9)), min_size=1, max_size=40),
       st.sampled_from([0, 2, 6]))
def test_ratio_half_up_is_exact(spark, pairs, scale):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(ratio_half_up(F.col("n"), F.col("d"), scale)).collect()]
    q = Decimal(1).scaleb(-scale)
    want = [(Decimal(n) / Decimal(d)).quantize(q, rounding=ROUND_HALF_UP) for n, d in pairs]
    assert got == want


hexs = st.text("0123456789abcdefABCDEF", min_size=1, max_size=12)


@SETTINGS
@given(st.lists(st.tuples(hexs, hexs, hexs, hexs, hexs), min_size=1, max_size=30))
def test_uuid_rules_against_python(spark, groups):
    texts = ["-".join(g) for g in groups]
    rows = spark.createDataFrame([(t,) for t in texts], "t string") \
        .select("t", is_uuid_text(F.col("t")).alias("ok"), canonical_uuid(F.col("t")).alias("c")).collect()
    for r in rows:
        parts = r["t"].split("-")
        widths = (8, 4, 4, 4, 12)
        expect_ok = len(r["t"]) <= 36 and all(1 <= len(p) <= w for p, w in zip(parts, widths))
        assert r["ok"] == expect_ok, r["t"]
        if expect_ok:
            assert r["c"] == str(uuid.UUID("-".join(p.zfill(w) for p, w in zip(parts, widths))))


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from([" ", "\t", "\n", "\x00", "\x1f", "a", "b", "é", " "]),
                        max_size=8), min_size=1, max_size=30))
def test_java_trim_and_blank(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string") \
        .select("t", java_trim(F.col("t")).alias("tr"), is_blank(F.col("t")).alias("b")).collect()
    for r in rows:
        expect = r["t"].strip("".join(chr(i) for i in range(0x21)))
        assert r["tr"] == expect
        assert r["b"] == (expect == "")


@SETTINGS
@given(st.lists(st.integers(-10**12, 10**13), min_size=1, max_size=30),
       st.sampled_from(["1 second", "10 seconds", "1 minute", "15 minutes"]),
       st.integers(-5_000_000, 5_000_000))
def test_time_bucket_and_millis(spark, micros, width, delta):
    w = {"1 second": 1, "10 seconds": 10, "1 minute": 60, "15 minutes": 900}[width] * 1_000_000
    epoch = dt.datetime(1970, 1, 1)
    df = spark.createDataFrame([(m,) for m in micros], "m long").select(
        "m", time_bucket(F.timestamp_micros("m"), width).alias("b"),
        millis_between(F.timestamp_micros("m"), F.timestamp_micros(F.col("m") + delta)).alias("ms"))
    for r in df.collect():
        assert r["b"] == epoch + dt.timedelta(microseconds=(r["m"] // w) * w)
        assert r["ms"] == delta // 1000
