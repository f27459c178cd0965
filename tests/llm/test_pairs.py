"""Near duplicates (texts, vectors) and repeated strings against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.llm import nn_descent, odd_sketch, suffix_dedup
from tests.llm.fixtures import WORDS, docs_of, edge_docs, no_docs, prose


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_by_force(texts, size, num, den):
    sets = [shingles(t, size) for t in texts]
    groups = Sets(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in enumerate(sets)}


def edited(rng, words, rate):
    return [rng.choice(WORDS) + "x" if rng.random() < rate else w for w in words]


def copies(seed, n):
    """Families of copies with more and fewer edits, so that chains, strays
    and near misses all occur."""
    rng = random.Random(seed)
    out = ["", None, "a b", "A  b", "b a", "one", "one"]
    for _ in range(n):
        base = [rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(rng.randrange(20, 160))]
        chain = base
        for _ in range(rng.randrange(1, 12)):
            chain = edited(rng, chain if rng.random() < 0.5 else base, rng.choice([0, 0.01, 0.03, 0.06]))
            out.append(" ".join(chain))
    return out


@pytest.mark.parametrize("size,threshold", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_match_brute_force(spark, size, threshold):
    texts = copies(size, 60)
    got = odd_sketch.near_duplicates(spark, docs_of(spark, texts).repartition(5), size, threshold)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == near_by_force(texts, size, *threshold)


def test_one_large_group_with_strays(spark):
    rng = random.Random(4)
    base = prose(9, 120).split()
    texts = [" ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.05]))) for _ in range(250)] + [" ".join(base)] * 40
    got = odd_sketch.near_duplicates(spark, docs_of(spark, texts), 3, (85, 100))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == near_by_force(texts, 3, 85, 100)


def test_near_duplicates_of_special_rows(spark):
    docs = edge_docs(spark)
    rows = odd_sketch.near_duplicates(spark, docs, 3, (85, 100)).collect()
    assert len(rows) == docs.count()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert [r["component_id"] for r in by_id[8]] == [8, 8] and by_id[9][0]["component_id"] == 8 and by_id[7][0]["component_id"] == 6
    assert by_id[1][0]["n_shingles"] == by_id[2][0]["n_shingles"] == 0 and by_id[4][0]["n_shingles"] == 1
    assert by_id[13][0]["component_id"] == 5  # "One two" and "one TWO"
    assert all(r["component_id"] is None and r["kept"] for r in by_id[None])
    assert odd_sketch.near_duplicates(spark, no_docs(spark)).count() == 0


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    docs = edge_docs(spark)
    kept = odd_sketch.keep_one(spark, docs, shingle_words=3, threshold=(85, 100))
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert [i for _, i in ids] == [1, 2, 3, 4, 5, 6, 8, 10, 11, 12, 14]
    assert kept.where("doc_id IS NULL").count() == 2
    assert odd_sketch.keep_one(spark, no_docs(spark)).count() == 0


def test_keep_one_decides_by_text(spark):
    """Rows under one id are judged each by its own text."""
    a, b, c = (prose(k, 80) for k in (41, 42, 43))
    near = b.replace(b.split()[40], "changed", 1)
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, near, "x"), (2, c, "w"), (2, c, "y"), (4, None, "z"), (4, None, "z")],
                                 "doc_id long, text string, _id string").repartition(4)
    kept = sorted(map(tuple, odd_sketch.keep_one(spark, docs).collect()), key=str)
    assert kept == sorted([(1, a, "x"), (1, b, "x"), (2, c, "w"), (4, None, "z"), (4, None, "z")], key=str)


def repeats_by_force(texts, n):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = {}
    for d, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i:i + n]] > 1:
                gone[i:i + n] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    base = [prose(seed * 100 + k, 120) for k in range(4)] + ["é" * 500]
    texts = [None, "", "short", base[0], base[0], base[1], "a" * 1500, "b" * 400, "c" * 401, "abcdefg" * 130]
    for _ in range(60):
        b = rng.choice(base)
        at = rng.randrange(500)
        text = prose(rng.random(), rng.randrange(30)) + b[at:at + rng.randrange(300, 700)] + prose(rng.random(), rng.randrange(40))
        if rng.random() < 0.4:
            text += rng.choice(base)[rng.randrange(300):][:rng.randrange(100, 600)]
        texts.append(text)
    return texts


@pytest.mark.parametrize("bucket_rows,sample", [(20_000, 1024), (40, 4), (6, 2)])
def test_repeated_strings_match_brute_force(spark, monkeypatch, bucket_rows, sample):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    texts = passages(bucket_rows)
    got = suffix_dedup.digest(spark, docs_of(spark, texts).repartition(4))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == repeats_by_force(texts, 400)


def test_blocks_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    passage = prose(77, 150)
    texts = [prose(5, 800) + passage + prose(6, 500), prose(7, 900) + passage, passage[:500] + prose(8, 100)]
    got = suffix_dedup.digest(spark, docs_of(spark, texts))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == repeats_by_force(texts, 400)


def test_multikey_sort():
    rng = random.Random(3)
    rows = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(300)}, key=lambda _: rng.random())
    words = np.array([list(r.ljust(40, b"\0")) for r in rows], np.uint8).reshape(len(rows), 5, 8).view(">u8")[:, :, 0].astype(np.uint64)
    order, common = suffix_dedup.multikey_sort(words, np.array([len(r) for r in rows]))
    ranked = [rows[i] for i in order]
    assert ranked == sorted(rows)
    for i in range(1, len(ranked)):
        a, b = ranked[i - 1], ranked[i]
        assert common[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeated_strings_of_special_rows(spark):
    docs = edge_docs(spark)
    rows = suffix_dedup.digest(spark, docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["n_removed"] == by_id[6]["n_bytes"] == by_id[7]["n_removed"] > 0 and by_id[6]["n_spans"] == 1
    assert by_id[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and by_id[12]["n_removed"] == 0
    assert suffix_dedup.digest(spark, no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(spark, docs, length=64)


def vectors_by_force(rows, threshold):
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(v)
    ids = sorted(unit)
    groups = Sets([i for i, _ in rows])
    links = collections.Counter()
    if ids:
        x = np.stack([unit[i] for i in ids])
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a < b:
                links[ids[a]] += 1
                links[ids[b]] += 1
                groups.join(ids[a], ids[b])
    return {i: (links[i], groups.find(i)) for i, _ in rows}


def clouds(seed):
    """Tight, loose and far groups in 16 dimensions, and copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for size, spread in ((60, 0.02), (60, 0.08), (50, 0.12), (40, 0.16), (30, 0.2), (2, 0.05)):
        for _ in range(4):
            centre = rng.standard_normal(16)
            centre /= np.linalg.norm(centre)
            rows += [(centre + spread * rng.standard_normal(16)).tolist() for _ in range(size)]
    rows += rng.standard_normal((300, 16)).tolist()
    rows += [rows[0]] * 5
    return [(i, v) for i, v in enumerate(rows)]


def test_near_vectors_match_brute_force(spark):
    rows = clouds(8)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           nn_descent.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = vectors_by_force(rows, 0.9)
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(g for g, _ in got.values()) >= 0.99 * sum(w for w, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def loose_group(seed, n, dim=64, offset=0.277):
    """Vectors that are all linked, but too far apart (22 degrees) for a class."""
    rng = np.random.default_rng(seed)
    centre = np.eye(dim)[0]
    return [(centre + offset / math.sqrt(dim) * rng.standard_normal(dim)).tolist() for _ in range(n)]


@pytest.mark.parametrize("least", [0.9, 0.0])
def test_what_the_lists_cannot_hold_is_compared_exactly(spark, monkeypatch, least):
    """No rounds of descent, and lists of 4 that never grow: by an audit of 0.9,
    or else because they are saturated, all pivots are compared."""
    for name, value in (("LIST", 4), ("ROUNDS", 0), ("GROWN", 0), ("LEAST", least), ("BLOCK", 64)):
        monkeypatch.setattr(nn_descent, name, value, raising=False)
    rows = loose_group(5, 250)
    if least:  # and some whose lists are not saturated
        rows += clouds_of(6, 150)
    rows = list(enumerate(rows))
    got = nn_descent.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == vectors_by_force(rows, 0.9)
    assert {r["audited_recall"] for r in got} == {1.0}


def clouds_of(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, dim))
    return [(centres[k % 10] + 0.3 * rng.standard_normal(dim)).tolist() for k in range(n)]


def test_both_sides_of_an_exact_comparison_are_blocks(spark, monkeypatch):
    compare, most = nn_descent._members_apart, 80

    def bounded(theta_cos):
        run = compare(theta_cos)

        def checked(key, left, right):
            assert left.num_rows <= most and right.num_rows <= most, (left.num_rows, right.num_rows)
            return run(key, left, right)
        return checked

    monkeypatch.setattr(nn_descent, "_members_apart", bounded)
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(7)
    axis = np.eye(64)[0]
    tight = [axis + 0.07 / 8 * rng.standard_normal(64) for _ in range(120)]
    around = rng.standard_normal((250, 64)) * (np.arange(64) > 0)
    around = axis + math.tan(math.acos(0.9)) * around / np.linalg.norm(around, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate([*tight, *around])]
    got = nn_descent.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == vectors_by_force(rows, 0.9)


def test_near_vectors_of_special_rows(spark):
    schema = "vec_id long, embedding array<float>, id long, unit string, u long"
    good = [0.0, 1.0, 0.0]
    rows = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 0.0]), (7, []),
            (8, good), (8, good), (9, [0.0, 3.0, 0.0]), (None, good), (10, [0.0, 1.0, 0.1]), (11, [1.0, 0.0, 0.0]), (12, [1e-30, 0.0, 0.0])]
    got = nn_descent.near_vectors(spark, spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)).collect()
    assert len(got) == len(rows)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert all(found[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7))
    assert found[8] == (3, 8, True) and found[9] == (3, 8, False) and found[10] == (3, 8, False)
    assert found[11] == (1, 11, True) and found[12] == (1, 11, False)
    assert found[None] == (0, None, True)
    assert nn_descent.near_vectors(spark, spark.createDataFrame([], schema)).count() == 0


def test_radius_is_under_half_the_angle():
    assert 2 * nn_descent.RADIUS < math.degrees(math.acos(nn_descent.THRESHOLD))


def test_components_of_a_long_chain(spark):
    from eventspark.llm.common import Workspace
    from eventspark.llm.components import components
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(1).selectExpr("1000L", "1001L"))
    got = {r["node"]: r["component"] for r in components(links, Workspace(spark, "test-cc")).collect()}
    assert got == {**{i: 0 for i in range(401)}, 1000: 1000, 1001: 1000}
