"""Window metrics, percentiles, rounding."""

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import functions as F

from eventspark.functions.numeric import bankers, exact_avg_half_up, interpolated, nearest_rank, ratio_half_up
from eventspark.operators.metrics import window_metrics


def test_nearest_rank_matches_ceil_definition(spark):
    """percentile_disc(p) == sorted[ceil(p*n) - 1] for n = 1..400."""
    n_max = 400
    df = spark.range(1, n_max + 1).select(F.col("id").alias("n")) \
        .select("n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")) \
        .withColumn("x", (F.col("i") * 7919) % 1009)
    got = df.groupBy("n").agg(nearest_rank("x", 0.5).alias("p50"), nearest_rank("x", 0.95).alias("p95")).collect()
    for r in got:
        xs = sorted(((i * 7919) % 1009) for i in range(1, r["n"] + 1))
        for p, name in ((0.5, "p50"), (0.95, "p95")):
            idx = max(0, min(math.ceil(p * len(xs)) - 1, len(xs) - 1))
            assert r[name] == xs[idx], (r["n"], p)


def test_interpolated_percentile(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4]], "x long")
    r = df.agg(interpolated("x", 0.5).alias("a"), interpolated("x", 0.95).alias("b")).first()
    assert r["a"] == 2.5 and abs(r["b"] - 3.85) < 1e-12


def test_exact_half_up(spark):
    df = spark.createDataFrame([(1, 8), (5, 1000), (15, 1000), (2, 3), (10**15 + 5, 10**16)], "s long, n long")
    got = [r[0] for r in df.select(exact_avg_half_up(F.col("s"), F.col("n"), 2)).collect()]
    assert got == [Decimal("0.13"), Decimal("0.01"), Decimal("0.02"), Decimal("0.67"), Decimal("0.10")]
    got6 = df.select(ratio_half_up(F.col("s"), F.col("n"), 6)).collect()[0][0]
    assert got6 == Decimal("0.125000")


def test_bankers_rounding(spark):
    r = spark.range(1).select(bankers(F.lit(2.125), 2).alias("b"), F.round(F.lit(2.125), 2).alias("r")).first()
    assert r["b"] == 2.12 and r["r"] == 2.13


def test_window_metrics_small(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = []
    lats = [10, 20, 30, 40, 1000]
    for i, lat in enumerate(lats):
        rows.append(("AAA", "low", Decimal("1.000001") * (i + 1), 2, t0 + dt.timedelta(seconds=i), lat, lat + 1))
    rows.append(("AAA", "low", Decimal("9"), 1, t0 + dt.timedelta(seconds=12), 5, 6))  # next window
    df = spark.createDataFrame(rows, "symbol string, scenario string, price decimal(38,18), quantity int, "
                                     "processing_time timestamp, ingestion_latency_ms long, event_lag_ms long")
    m = {r["bucket_start"]: r for r in window_metrics(df).collect()}
    w = m[t0]
    assert w["bucket_end"] == t0 + dt.timedelta(seconds=10)
    assert w["event_count"] == 5 and w["total_quantity"] == 10
    assert w["avg_price"] == Decimal("3.000003")
    assert w["min_price"] == Decimal("1.000001") and w["max_price"] == Decimal("5.000005")
    assert w["p50_ingestion_latency_ms"] == 30 and w["p95_ingestion_latency_ms"] == 1000
    assert w["max_ingestion_latency_ms"] == 1000
    assert w["avg_ingestion_latency_ms"] == Decimal("220.00")
    assert w["avg_event_lag_ms"] == Decimal("221.00")
    assert m[t0 + dt.timedelta(seconds=10)]["event_count"] == 1


def test_metrics_plan_is_partial_then_one_exchange(spark):
    from eventspark.plans.derive import from_sf
    from tests.conftest import SF001
    plan = from_sf(spark, SF001).metrics._jdf.queryExecution().executedPlan().toString()
    assert "partial_percentile" in plan or "partial_" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert int(spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")) == 4096


def test_partials_of_any_deliveries_give_the_batch_metrics(spark):
    from eventspark.operators.metrics import merge_partials, metrics_of_partials, window_partials
    from eventspark.plans.derive import from_sf
    from tests.conftest import SF001
    valid = from_sf(spark, SF001).valid
    thirds = [window_partials(valid.where(F.col("sequence") % 3 == k)) for k in (2, 0, 1)]
    got = metrics_of_partials(merge_partials(thirds[0].union(thirds[1]).union(thirds[2])))
    want = window_metrics(valid)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_average_price_is_exact_at_any_size(spark):
    import random
    from decimal import ROUND_HALF_UP, localcontext
    from eventspark.functions.numeric import average_price
    rng = random.Random(1)
    rows = [(g, Decimal(rng.randrange(10 ** rng.randrange(1, 38))).scaleb(-18)) for g in range(30) for _ in range(rng.randrange(1, 25))]
    rows += [(99, Decimal("99999999999999999999.999999999999999999"))] * 40 + [(98, Decimal("1E17"))]
    got = spark.createDataFrame(rows, "g int, price decimal(38,18)").groupBy("g").agg(
        average_price("price", 6).alias("six"), average_price("price", 18).alias("eighteen")).collect()
    with localcontext() as c:
        c.prec = 80
        for r in got:
            prices = [p for g, p in rows if g == r["g"]]
            for name, scale in (("six", 6), ("eighteen", 18)):
                assert r[name] == (sum(prices) / len(prices)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)


def test_histogram_percentiles_equal_builtin(spark):
    """with_percentiles / spread_percentiles give percentile_cont bit for bit,
    also for a group holding most rows, with NULL values and NULL keys."""
    import random
    from eventspark.operators.percentiles import spread_percentiles, with_percentiles
    rnd = random.Random(7)
    rows = []
    for g in range(30):
        for _ in range(6000 if g == 0 else rnd.randint(1, 200)):
            rows.append((g % 4 or None, g, rnd.choice([rnd.randint(0, 40), rnd.randint(0, 4000), None]), rnd.randint(0, 9)))
    df = spark.createDataFrame(rows, "a int, g int, x long, y long")
    wanted = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    ref = {(r["a"], r["g"]): r for r in df.groupBy("a", "g").agg(
        F.count(F.lit(1)).alias("n"), F.max("y").alias("my"),
        *[interpolated("x", p).alias(k) for k, p in wanted.items()]).collect()}
    for build in (with_percentiles, spread_percentiles):
        got = build(df, ["a", "g"], "x", wanted, F.count(F.lit(1)).alias("n"), F.max("y").alias("my")).collect()
        assert len(got) == len(ref)
        for r in got:
            for k in wanted:
                assert r[k] == ref[(r["a"], r["g"])][k], (r["a"], r["g"], k)
            assert (r["n"], r["my"]) == (ref[(r["a"], r["g"])]["n"], ref[(r["a"], r["g"])]["my"])
