"""Learned operators: held-out accuracy and special rows; the pipeline."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from eventspark.llm import arrow_output, lexicon_toxicity, lsa_vote, script_viterbi
from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, read_table
from eventspark.llm.entry import tokenizer_path
from tests.conftest import SF01
from tests.llm.fixtures import edge_docs, no_docs, prose
from tests.llm.test_pairs import near_by_force
from tests.llm.test_scans import contaminated_by_force, filled

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: read_table(spark, SF01, n) for n in ("documents", "labels", "benchmark")}


def held_out(found, labels, column):
    rows = found.join(labels, "doc_id").where("held_out").collect()
    return [(r["score"], r["predicted"], r[column]) for r in rows]


def test_quality_on_held_out_documents(spark, tables):
    rows = held_out(lsa_vote.score(spark, tables["documents"], tables["labels"]), tables["labels"], "quality")
    assert np.mean([p == y for _, p, y in rows]) > 0.95 and all(0 <= s <= 1 for s, _, _ in rows)


def test_quality_learns_nothing_from_the_held_out_fold(spark, tables):
    from pyspark.sql import functions as F
    flipped = tables["labels"].withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in lsa_vote.score(spark, tables["documents"], x).collect()) for x in (tables["labels"], flipped))
    assert a == b


def test_cosines_are_exact():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 4, (60, lsa_vote.COLUMNS)).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    space = lsa_vote.Space(rows.copy(), labels, (rows[:, :-lsa_vote.RATIOS] > 0).sum(axis=0), 60)
    x = space.place(space.weigh(rows[:5].copy())).astype(float)
    for i in range(5):
        s = space.vectors.astype(float) @ x[i]
        near = np.argsort(-s)[: lsa_vote.NEIGHBOURS]
        w = np.exp(lsa_vote.SHARPNESS * (s[near] - s[near].max()))
        assert abs(space.vote(rows[i:i + 1].copy())[0] - (w * labels[near]).sum() / w.sum()) < 1e-3


def plain_counts(text):
    """The counts of one text, word by word."""
    data = (text or "").encode()
    out = collections.Counter()
    kinds = [int(lsa_vote._SHAPE[b]) for b in data]
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        out[int(lsa_vote._SHAPE_COLUMN[(a * lsa_vote._KINDS + b) * lsa_vote._KINDS + c])] += 1
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data):
        code = K.span_codes(np.frombuffer(m[0], np.uint8), np.array([0]), np.array([len(m[0])]), K.FOLDED_CODES)
        out[lsa_vote.SHAPES + int(lsa_vote._hashed(code, lsa_vote.WORDS)[0])] += 1
        out[lsa_vote.SHAPES + lsa_vote.WORDS + min(len(m[0]), lsa_vote.LENGTHS) - 1] += 1
    return out


def test_quality_query_matches_a_plain_recomputation(spark, tables):
    docs = tables["documents"].where("doc_id < 200")
    ws = Workspace(spark, "test")
    space = lsa_vote.fit(ws, docs, tables["labels"])
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # document frequencies are those of all documents
    having = collections.Counter(t for text in rows.values() if text is not None for t in plain_counts(text))
    n, found = lsa_vote.document_frequencies(docs)
    assert n == sum(t is not None for t in rows.values()) and {i: int(c) for i, c in enumerate(found) if c} == having
    scores = {r["doc_id"]: r["score"] for r in lsa_vote.score(spark, docs, tables["labels"]).collect()}
    assert len(scores) == len(rows)
    for i, text in rows.items():
        x = np.zeros((1, lsa_vote.COLUMNS), np.float32)
        for t, c in plain_counts(text).items():
            x[0, t] = c
        raw = (text or "").encode()
        x[0, -lsa_vote.RATIOS:] = lsa_vote.counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0, -lsa_vote.RATIOS:]
        terms = np.log1p(x[0, :-lsa_vote.RATIOS].astype(float)) * space.idf
        v = np.concatenate([terms / max(np.linalg.norm(terms), 1e-9), x[0, -lsa_vote.RATIOS:] * lsa_vote.RATIO_WEIGHT]) @ space.project.astype(float)
        if not np.linalg.norm(v) > 1e-9:
            assert abs(scores[i] - space.prior) < 1e-9
            continue
        s = space.vectors.astype(float) @ (v / np.linalg.norm(v))
        near = np.argsort(-s)[: lsa_vote.NEIGHBOURS]
        w = np.exp(lsa_vote.SHARPNESS * (s[near] - s[near].max()))
        assert abs(scores[i] - (w * space.labels[near]).sum() / w.sum()) < 2e-3, i


def test_scores_do_not_hang_on_row_placement(spark):
    """Ids with several texts: any partitioning learns from the same ones."""
    rows = [(i, prose(3 * i + k, 40 + i % 30) + (" !!!" * 20 if k == i % 3 else ""), k) for i in range(250) for k in range(3)]
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(250)], LABELS)
    for model in (lsa_vote, lexicon_toxicity):
        a, b = (sorted((r["doc_id"], r["score"]) for r in model.score(spark, spark.createDataFrame(own, "doc_id long, text string, k int").repartition(n), labels).collect())
                for own, n in ((rows, 2), (rows[::-1], 7)))
        # (products of single-precision blocks differ in their last bits)
        assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6, rtol=0)


def test_tied_neighbours_vote_alike():
    """Copies on both sides of the last place: label 0 goes first, in any order."""
    base = np.zeros((1, lsa_vote.COLUMNS), np.float32)
    base[0, :5] = 3
    rows = np.repeat(base, 60, axis=0)
    for labels in (np.arange(60) % 2, 1 - np.arange(60) % 2):
        space = lsa_vote.Space(rows.copy(), labels, np.ones(lsa_vote.COLUMNS - lsa_vote.RATIOS), 10)
        assert space.vote(base.copy())[0] == 0  # 30 of each label, 25 vote


def test_models_on_special_rows(spark, tables):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, 1), (12, 1, 0), (4, None, None), (None, 1, 1), (8, 0, 1), (999, 1, 1)], LABELS)
    for found in (lsa_vote.score(spark, docs, labels), lexicon_toxicity.score(spark, docs, labels), script_viterbi.identify(spark, docs)):
        rows = found.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    kept = lsa_vote.keep(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    for empty in (labels.limit(0), spark.createDataFrame([(1, None, None)], LABELS)):
        assert {r["score"] for r in lsa_vote.score(spark, docs, empty).collect()} == {0.5}
        assert {r["score"] for r in lexicon_toxicity.score(spark, docs, empty).collect()} == {0.0}
    for model in (lsa_vote.score, lexicon_toxicity.score):
        assert model(spark, no_docs(spark), labels).count() == 0
    assert script_viterbi.identify(spark, no_docs(spark)).count() == 0


def test_language_on_held_out_documents(spark, tables):
    found = script_viterbi.identify(spark, tables["documents"])
    rows = found.join(tables["documents"].select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_languages_of_several_scripts_and_spans(spark):
    rng = random.Random(2)
    vocabulary = {"aa": ["kalo", "mire", "sontu", "lapek"], "bb": ["wydra", "chleb", "grzyb", "plot"], "cc": ["дом", "река", "поле", "город"], "dd": ["川", "山", "木", "空"]}
    sentence = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(i, sentence(k, 60), k) for i, k in enumerate(sorted(vocabulary) * 30)]
    mixed = f"{sentence('aa', 40)}. {sentence('cc', 30)}; {sentence('bb', 20)}"
    docs = spark.createDataFrame([*rows, (1000, mixed, None), (1001, None, "aa"), (1002, "123 !!", None), (1003, "δέντρο", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in script_viterbi.identify(spark, docs, with_spans=True).collect()}
    assert all(found[i]["lang_pred"] == k for i, _, k in rows)
    assert [s["lang"] for s in found[1000]["spans"]] == ["aa", "cc", "bb"]
    assert found[1001]["lang_pred"] == found[1002]["lang_pred"] == "und" and found[1001]["score"] == 0
    assert found[1003]["lang_pred"] in vocabulary
    first = found[1000]["spans"][0]
    assert mixed[first["start"]: first["end"]] == mixed.split(".")[0]


def test_language_query_matches_a_plain_recomputation(spark, tables):
    """Word by word: features counted one at a time, the path by plain Viterbi."""
    docs = tables["documents"].where("doc_id < 60 OR lang IS NULL")
    model = script_viterbi.fit(docs)
    lower, scripts = script_viterbi.letter_tables()
    got = {r["doc_id"]: r for r in script_viterbi.identify(spark, docs).collect()}
    for r in docs.collect():
        text = (r["text"] or "")[:200_000]
        words = [m for m in re.finditer(r"[^\W\d_]+", text)]
        letters, best, back = collections.Counter(), None, []
        for m in words:
            raw = m[0].encode()
            w = script_viterbi.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            s = np.zeros(len(model.languages))
            for two, three in zip(w.two, w.three):
                s += model.logs[two] + model.logs[three]
            s += model.logs[w.whole[0]] + model.excluded[w.script[0]]
            if best is None:
                best, stay = s, np.arange(len(s))
            else:
                jump = best.max() - script_viterbi.SWITCH
                stay = np.where(best >= jump, np.arange(len(s)), best.argmax())
                best = np.maximum(best, jump) + s
            back.append(stay)
        if not words:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        k = int(best.argmax())
        for m, stay in zip(reversed(words), reversed(back)):
            letters[k] += len(m[0])
            k = int(stay[k])
        top = max(letters.values())
        assert abs(got[r["doc_id"]]["score"] - top / sum(letters.values())) < 0.02
        assert got[r["doc_id"]]["lang_pred"] in {model.languages[k] for k, n in letters.items() if n >= 0.98 * top}


def _many_languages(n, per_script, seed=0):
    """Languages with scripts of their own, ``per_script`` of them in each."""
    rng = np.random.default_rng(seed)
    _, scripts = script_viterbi.letter_tables()
    known = [int(scripts[ord(c)]) for c in "aд山λ"]
    use = np.zeros((256, n))
    order = known + [k for k in range(1, 200) if k not in known]
    for lang in range(n):
        use[order[lang // per_script], lang] = 1
    return script_viterbi.Model([f"l{k:03d}" for k in range(n)], rng.integers(0, 50, (3 * script_viterbi.BUCKETS, n)).astype(float), use)


def test_narrowing_changes_no_label(monkeypatch):
    model = _many_languages(12, 3)
    texts = [prose(1, 300), "", "дом река " * 40 + prose(2, 50), "山川木 ab " * 30, "123", "ελ δω " * 20 + "дом " * 10]
    w = script_viterbi.Words(*K.string_buffers(pa.array(texts)))
    narrow = model.label(w)
    assert sorted(len(languages) for languages, _ in model.groups(w)) == [3, 6, 6, 6]
    monkeypatch.setattr(script_viterbi.Model, "groups", lambda self, w: [(np.arange(len(self.languages)), np.ones(w.n_texts, bool))])
    assert np.array_equal(model.label(w), narrow)


def test_memory_does_not_grow_with_languages_of_other_scripts():
    import tracemalloc
    w = script_viterbi.Words(*K.string_buffers(pa.array([prose(k, 300) for k in range(100)])))
    peaks = []
    for n in (10, 150):
        model = _many_languages(n, 5)
        model.label(w)
        tracemalloc.start()
        model.label(w)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0], peaks


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n_texts, k = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        text = np.repeat(np.arange(n_texts), rng.integers(0, 300, n_texts))
        s = (rng.standard_normal((len(text), k)) * rng.choice([1, 5])).astype(np.float32)
        switch = float(rng.choice([0.5, 3, 8]))
        path = script_viterbi.viterbi(s, text, n_texts, switch)
        for d in range(n_texts):
            at = np.flatnonzero(text == d)
            if len(at):
                best = s[at[0]].astype(float)
                for i in at[1:]:
                    best = np.maximum(best, best.max() - switch) + s[i]
                value = s[at, path[at]].astype(float).sum() - switch * (np.diff(path[at]) != 0).sum()
                assert abs(best.max() - value) < 1e-2


def test_bytes_that_are_no_utf8():
    raw = np.frombuffer(b"ab \xff\xfe cd\xc3" + b"ef", np.uint8)
    offsets = np.array([0, 8, len(raw)])
    points, start = K.code_points(raw, offsets)
    assert start.tolist() == [0, 8, len(points)] and points[3] == 0xFFFD
    assert lexicon_toxicity.fold(raw, offsets)[0].split() == ["ab", "cd", "ef"]
    assert len(script_viterbi.Words(raw, offsets).start) == 3
    assert len(arrow_output.Encoder(tokenizer_path()).encode(raw, offsets)[1]) == 2


def folded(text):
    raw = text.encode()
    return lexicon_toxicity.fold(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].strip()


def test_folding():
    for text in ("idiot", "IDIOT", "1d10t", "іdіоt", "ïdíôt", "i​diot", "id­iot", "ｉｄｉｏｔ", "ID1OT"):
        assert folded(text) == "idiot", text
    assert folded("$tupid") == "stupid" and folded("f00l") == "fool" and folded("$$$idiot") == "idiot"
    assert folded("12 34") == "" and folded("a-b") == "a b"


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(seed * 10_000 + i, rng.randrange(20, 200)).split()
        kind = i % 4
        if kind == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grumbold", "grumbolds", "snarvic", "sn4rvic"]))
        elif i % 12 == 1:  # harmless: the phrase is an exception
            at = rng.randrange(len(words))
            words[at:at] = ["snarvic", "salad"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 0)))
    return rows, labels


def test_toxicity_with_exceptions(spark):
    rows, labels = toxic_corpus(3, 900)
    extra = [(2000, "what a GRUMB0LD"), (2001, "grumbоld"), (2002, "a snarvic salad"), (2003, "the snarvic"), (2004, "")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    found = {r["doc_id"]: r for r in lexicon_toxicity.score(spark, docs, spark.createDataFrame(labels, LABELS)).collect()}
    wrong = [i for i, _, y in labels if found[i]["predicted"] != y]
    assert len(wrong) <= 0.02 * len(labels), wrong[:5]
    assert [found[i]["predicted"] for i in range(2000, 2005)] == [1, 1, 0, 1, 0]


def test_toxicity_on_held_out_documents(spark, tables):
    rows = held_out(lexicon_toxicity.score(spark, tables["documents"], tables["labels"]), tables["labels"], "toxic")
    assert sum(p == 1 and y == 0 for _, p, y in rows) <= 1
    assert np.mean([p == y for _, p, y in rows]) > 0.93


def plain_features(model, text):
    """The inputs of the curve for one text, by looking at every word."""
    sums, heaviest, n_words = 0.0, 0.0, 0
    versions = [[w for w in lexicon_toxicity.fold(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), r)[0].split()] for r in range(lexicon_toxicity.READINGS)]
    for at in range(len(versions[0])):
        n_words += 1
        for words in versions:
            own = [s for s in model.stems if (words[at] + " ").startswith(s)]
            if own:
                stem = max(own, key=len)
                two = {f"{words[at - 1] if at else ''} {stem.strip()}", f"{stem.strip()} {words[at + 1] if at + 1 < len(words) else ''}"}
                if not two & model.exceptions:
                    sums, heaviest = sums + model.stems[stem], max(heaviest, model.stems[stem])
                break
    return [1.0, np.log1p(sums), sums / np.sqrt(max(1, n_words)), heaviest, float(heaviest > 0)]


def test_toxicity_query_matches_a_plain_recomputation(spark, tables):
    docs = tables["documents"].where("doc_id < 200")
    model = lexicon_toxicity.fit(spark, docs, tables["labels"])
    model = model if model.stems else lexicon_toxicity.fit(spark, tables["documents"], tables["labels"])
    rows = docs.collect()
    data, offsets = K.string_buffers(pa.array([r["text"] or "" for r in rows]))
    x, _ = model.features(data, offsets)
    assert model.stems and np.allclose(x, [plain_features(model, r["text"] or "") for r in rows])
    again = {r["doc_id"]: r["score"] for r in lexicon_toxicity.score(spark, tables["documents"], tables["labels"]).collect()}
    full = lexicon_toxicity.fit(spark, tables["documents"], tables["labels"])
    assert np.allclose([again[r["doc_id"]] for r in rows], full.score(full.features(data, offsets)[0]))


def test_short_words_and_both_readings_of_a_one(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = prose(i + 70_000, rng.randrange(20, 100)).split()
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["zug", "qo", "wortling"]))
        elif i % 3 == 1:
            words.insert(rng.randrange(len(words)), rng.choice(["zugspitze", "qora"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    extra = [(2000, "a ZUG here"), (2001, "zugspitze"), (2002, "the q0 one"), (2003, "wort1ing"), (2004, "wortl1ng"), (2005, "zug"), (2006, "qora qo")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    found = {r["doc_id"]: r for r in lexicon_toxicity.score(spark, docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert [found[i]["predicted"] for i in range(2000, 2007)] == [1, 0, 1, 1, 1, 1, 1]
    assert sum(found[i]["predicted"] != y for i, _, y in labels) <= 9


def test_neighbours_are_whole_words():
    long_word = "x" * 300
    text = f" {long_word} grum {long_word}y "
    at = text.index("grum")
    assert lexicon_toxicity.Lexicon.phrases(text, 0, len(text), at, "grum") == (f"{long_word} grum", f"grum {long_word}y")
    assert lexicon_toxicity.Lexicon.phrases("  ab  ", 0, 6, 2, "ab ") == (" ab", "ab ")


def test_automaton_finds_the_longest_stem():
    model = lexicon_toxicity.Lexicon({"grum": 1.0, "grumbold": 3.0, "old": 2.0}, base=0.0)
    texts = ["grumbolds are old, bold", "grumpy"]
    data, offsets = K.string_buffers(pa.array(texts))
    x, _ = model.features(data, offsets)
    assert np.allclose(np.expm1(x[:, 1]), [5.0, 1.0]) and np.allclose(x[:, 3], [3.0, 1.0])


# ------------------------------------------------------------ the pipeline

def test_pipeline_matches_brute_force(spark, tables):
    """Every stage over all its predecessor kept, recomputed one by one."""
    docs = tables["documents"].where("doc_id < 1000")
    rows = {r["doc_id"]: r for r in docs.collect()}
    quality = {r["doc_id"]: r["predicted"] for r in lsa_vote.score(spark, docs, tables["labels"]).collect()}
    ids = [i for i in sorted(rows) if quality[i] == 1]
    near = near_by_force([rows[i]["text"] for i in ids], 5, 80, 100)
    ids = [i for k, i in enumerate(ids) if near[k][2]]
    items = [(r["item_id"], r["text"]) for r in tables["benchmark"].collect()]
    dirty = contaminated_by_force([rows[i]["text"] for i in ids], items)
    ids = [i for k, i in enumerate(ids) if not dirty[k][3]]
    out = corpus_pipeline.run(spark, SF01).collect()
    per_id = {}
    for r in out:
        per_id.setdefault(r["doc_id"], []).append(r)
    assert set(per_id) <= set(ids) and max(map(len, per_id.values())) <= 2
    # rates of the mix
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"] or "")) for i in ids}
    per_source = {}
    for i in ids:
        per_source[rows[i]["source"]] = per_source.get(rows[i]["source"], 0) + size[i]
    target = filled(per_source)
    for i in ids:
        s = rows[i]["source"]
        rate = target[s] / per_source[s] if per_source[s] else 0
        assert len(per_id.get(i, [])) in {int(rate), int(np.ceil(rate))}
    # tokens of the mix, in order
    enc, start = arrow_output.Encoder(tokenizer_path()), 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(enc.tokenizer.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids) + 1
        start += r["n_tokens"]


def test_stages_take_special_rows(spark, tables):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF01)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, no_docs(spark), SF01).count() == 0, name
