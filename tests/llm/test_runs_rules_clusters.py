"""Periodic runs, risk-controlled rules and pivot-table clustering."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.llm import diagonal_runs, laesa, risk_rules
from eventspark.llm.entry import op11_diagonal_runs, op12_risk_rules
from tests.conftest import SF001
from tests.llm.fixtures import docs_of, edge_docs, no_docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------ periodic runs

def runs_by_force(words, least=6, fold=4):
    """By the definition: for every period the maximal stretches, kept if no smaller period fits."""
    n, out = len(words), []

    def has(s, e, p):
        return all(words[i] == words[i - p] for i in range(s + p, e))

    for q in range(1, n // fold + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            a = i
            while i < n and words[i] == words[i - q]:
                i += 1
            s, e = a - q, i
            if e - s >= max(least, fold * q) and not any(has(s, e, p) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_by_force(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_are_those_of_the_definition(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
        words = [rng.randrange(letters) for _ in range(rng.randrange(8))] + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
        texts.append(words + [rng.randrange(letters) for _ in range(rng.randrange(30))] * rng.randrange(1, 5))
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = diagonal_runs.find_runs(np.array([w for t in texts for w in t], np.int64), first)
    for d, words in enumerate(texts):
        own = found[(found[:, 0] >= first[d]) & (found[:, 0] < first[d + 1])]
        assert [(int(s) - int(first[d]), int(n), int(q)) for s, n, q in own] == runs_by_force(words), words


def test_long_repetitions_stay_cheap():
    ids = np.zeros(300_000, np.int64)
    ids[100_000:200_000] = np.arange(100_000) % 20_000 + 1
    assert diagonal_runs.find_runs(ids, np.array([0, len(ids)])).tolist() == [[0, 100_000, 1], [100_000, 100_000, 20_000], [200_000, 100_000, 1]]


def test_run_digest_matches_brute_force(spark):
    texts = [("spam " * k + prose(k, 40) + " a b c" * (k % 9)).strip() for k in range(120)] + [None, "", " \n", "ä ß " * 12, "x" * 10_000]
    got = in_order(diagonal_runs.digest(spark, docs_of(spark, texts)).collect())
    assert got == in_order(digest_by_force(i, t) for i, t in enumerate(texts))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))


def test_runs_of_edge_rows(spark):
    docs = edge_docs(spark)
    got = collections.Counter(map(tuple, diagonal_runs.digest(spark, docs).drop("start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()))
    assert sum(got.values()) == docs.count() and (None, 0) in got
    plain = diagonal_runs.runs(docs).where("doc_id IS NULL OR doc_id < 5").collect()
    assert {r["collapsed"] for r in plain if r["n_words"] == 0} == {""}
    assert diagonal_runs.digest(spark, no_docs(spark)).count() == 0
    seeded = diagonal_runs.runs(docs_of(spark, ["a b c d e f g h i j"]), F.lit(8)).first()  # from word 8 on, one word over and over
    assert seeded["collapsed"] == "a b c d e f g h i i" and not seeded["runs"]


def test_run_query_reads_all_documents(spark):
    got = in_order(op11_diagonal_runs(spark, SF001).collect())
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    small = [r for r in rows if len(r["text"] or "") < 6000]
    assert len(got) == len(rows) and set(map(str, (digest_by_force(*r) for r in small))) <= set(map(str, got))


# ------------------------------------------------------------ quality rules

def counts_by_force(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i: i + 5])].append(i)
    twice = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(twice), "n_capitals": len(re.findall("[A-Z]", text)),
            "n_digits": len(re.findall("[0-9]", text)), "n_marks": len(re.findall(r"[!-/:-@\[-`{-~]", text)), "n_distinct_words": len(set(words))}


def test_counts_match_brute_force(spark):
    base = prose(5, 60)
    texts = [None, "", "\n\n", "a", "one two\n one two\none two\n \n \n", base, base + "\n" + base, "x " * 50, "x y " * 30 + "\r\nx y", "é# <日本> |x|\n\té#",
             "a b c d e f a b c d e", "\n".join(["same line here"] * 9), prose(6, 5000) + " " + base + "\v" + base]
    rows = risk_rules.counts(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = counts_by_force(texts[r["doc_id"]])
        assert {c: r[c] for c in risk_rules.COUNTS} == want, texts[r["doc_id"]][:50]
        assert r["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])


def test_counts_of_edge_rows(spark):
    docs = edge_docs(spark)
    rows = collections.Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in risk_rules.counts(docs).collect())
    assert rows == collections.Counter((r["doc_id"], (c := counts_by_force(r["text"]))["n_words"], c["n_repeat_words"]) for r in docs.collect())


def test_binomial_tail_is_exact():
    for n, k, p in [(1, 0, 0.3), (40, 3, 0.2), (300, 0, 0.02), (500, 4, 0.02), (2000, 25, 0.02)]:
        exact = sum(Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert risk_rules.binomial_tail(k, n, p) == pytest.approx(float(exact), rel=1e-10)
    assert risk_rules.binomial_tail(30, 1000, 0.02) == 1.0 and risk_rules.binomial_tail(0, 10**7, 0.02) == 0.0


def _labelled(spark, n, spoiled, strata=("en",), seed=0):
    """Documents whose bad ones are full of signs; ``spoiled`` of the good ones too."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() < 0.7
        signs = not good or rng.random() < spoiled
        text = prose(i, 30 + i % 40)
        rows.append((i, " ".join(w + "###" for w in text.split()) if signs else text, strata[i % len(strata)]))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_certify_and_reject(spark):
    docs, labels = _labelled(spark, 1600, 0.0, ("en", None))
    unlabelled = docs.where("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 10_000)
    rows = risk_rules.judge(spark, docs.union(unlabelled), labels).collect()
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == 1700 and all(r["kept"] == bool(good[r["doc_id"] % 10_000]) for r in rows)
    assert {x for r in rows for x in r["broken_rules"]} >= {"symbols_per_word"}


def test_rules_hold_back_without_proof(spark):
    few, few_labels = _labelled(spark, 300, 0.0)      # too few good ones in the holdout
    assert all(r["kept"] for r in risk_rules.judge(spark, few, few_labels).collect())
    # good documents look like bad ones too often: no rung may reject them
    docs, labels = _labelled(spark, 1600, 0.10)
    counted = risk_rules.counts(docs)
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert not any("symbols_per_word" in r["rules"] for r in risk_rules.certified(spark, counted, labels).collect())
    lost = [not r["kept"] for r in risk_rules.judge(spark, docs, labels).collect() if good[r["doc_id"]]]
    assert sum(lost) < risk_rules.RISK * len(lost)
    # a laxer bound may
    assert risk_rules.certified(spark, counted, labels, risk=0.25, rungs=(0.0, 0.99)).select("rung").first()[0] == 1


def test_rules_without_labels_or_stratum(spark):
    docs, labels = _labelled(spark, 60, 0.0)
    no_labels = labels.limit(0)
    base = {r["doc_id"]: not r["base_failed"] for r in risk_rules.counts(docs).collect()}
    assert {r["doc_id"]: r["kept"] for r in risk_rules.judge(spark, docs.drop("lang"), no_labels).collect()} == base
    clashing = edge_docs(spark)
    assert risk_rules.judge(spark, clashing, labels.union(spark.createDataFrame([(None, 1), (3, None), (3, 0), (3, 1)], "doc_id long, quality int"))).count() == clashing.count()
    assert risk_rules.judge(spark, no_docs(spark), labels).count() == 0


def test_false_rejections_stay_below_the_risk(spark):
    """Over many random tables with a rule that errs just at the risk, certificates are rare."""
    rng = np.random.default_rng(3)
    n, wrong = 400, 0
    for _ in range(2000):
        wrong += risk_rules.binomial_tail(int(rng.binomial(n, risk_rules.RISK)), n, risk_rules.RISK) <= risk_rules.DELTA
    assert wrong / 2000 <= risk_rules.DELTA


def test_rule_query(spark):
    rows = op12_risk_rules(spark, SF001).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        want = counts_by_force(docs[r["doc_id"]])
        assert all(r[c] == want[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert not (r["kept"] and r["base_failed"])


# --------------------------------------------------------------- clustering

def clusters_by_force(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            own[j].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centroids)]
    last = assign()
    inertia = collections.Counter()
    for d, j in last:
        inertia[j] += d
    fits = lambda n: n if n < 1 << 63 else None
    whole = sum(inertia.values())
    return [(i, j, fits(d), fits(inertia[j]), fits(whole), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance string, v int, to_pivots int", verifySchema=False)


def _clustered(n, seed, spread=0.05, size=64):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(20, size))
    return [(i, (middle[i % 20] + spread * rng.normal(size=size)).tolist(), "c", "d", 1, 2) for i in range(n)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_match_brute_force(spark):
    rows = _clustered(700, 1)
    rows += [(i + 1000, r[1], *r[2:]) for i, r in enumerate(rows[:200])] + [(5, rows[7][1], *rows[0][2:])] * 3      # copies, repeated ids
    rows += [(2000, None, "", "", 0, 0), (2001, [1.0] * 63, "", "", 0, 0), (2002, [float("nan")] + [0.0] * 63, "", "", 0, 0),
             (2003, [None] + [0.0] * 63, "", "", 0, 0), (2004, [float("inf")] * 64, "", "", 0, 0), (2005, [-0.0] * 64, "", "", 0, 0), (None, [0.5] * 64, "", "", 0, 0)]
    got = laesa.digest(spark, vectors(spark, rows).repartition(5)).select(COLUMNS).collect()
    assert in_order(got) == in_order(clusters_by_force([r[:2] for r in rows]))


def test_pivots_spare_exact_distances(spark):
    out, _ = laesa.cluster(spark, vectors(spark, _clustered(2000, 2)))
    assert out.agg(F.avg("n_exact")).first()[0] < 4


def test_few_tied_and_huge_vectors(spark):
    tied = [(i, [float(i % 2)] * 64, "", "", 0, 0) for i in range(40)]
    huge = [(i, [(-1.0) ** i * 10.0 ** (i % 30)] + [0.25] * 63, "", "", 0, 0) for i in range(60)] + [(99, [1.7e308] * 64, "", "", 0, 0)]
    for rows in (tied, _clustered(5, 3), huge):
        got = laesa.digest(spark, vectors(spark, rows)).select(COLUMNS).collect()
        assert in_order(got) == in_order(clusters_by_force([r[:2] for r in rows]))
    assert laesa.digest(spark, vectors(spark, [])).count() == 0
