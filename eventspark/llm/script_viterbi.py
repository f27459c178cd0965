"""Language identification of mixed-language text: script ranges narrow the
candidates, Viterbi over per-word scores labels spans.

Model: for every learned language, log probabilities of hashed letter bigrams
and trigrams (word ends included) and of whole words, and the scripts its
letters are in; counted on at most ``DOCS_EACH`` documents a language from the
training folds, taken in hash order, over their whole texts.

Words are runs of letters. A word's script is its first letter's; only
languages that use this script are candidates for it. So texts are sorted by the
languages that any of their scripts allows, and each such group is scored and
solved with these languages alone: a batch needs memory for the languages of
its texts' scripts, not for all languages. The best sequence of
languages pays ``SWITCH`` for every change. It is exact, and computed for all
texts of a batch at once: blocks of ``STEP`` words are first solved from every
entry language (max-plus products), entries then follow from block to block,
and all blocks trace back together.

Rows: null texts and texts without letters are ``und`` with score 0, and so is
everything if nothing could be learned. Each input row gives one output row,
whatever its id; a null id is not held out. Extra columns are ignored. Ties (of
scores, or of letters) go to the language that comes first in the alphabet.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, fold_of, hash_place

FOLDS, HELD_OUT = 4, 2
DOCS_EACH = 300
BUCKETS = 1 << 15
SWITCH = 8.0
STEP = 64
#: Words whose letters are scored at once.
LETTER_WORDS = 1 << 14
#: Pseudo-count, share of a language's letters that makes a script its own, and the score of a language without the word's script.
ALPHA, SCRIPT_SHARE, EXCLUDED = 0.5, 0.01, -50.0
UNKNOWN = "und"

_tables: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, and the number of its script (0:
    no letter). The script is the first word of the letter's Unicode name."""
    if not _tables:
        lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        script = np.zeros(sys.maxunicode + 1, np.uint8)
        numbers: dict[str, int] = {}
        large = ((0x3400, 0x4DC0, "CJK"), (0x4E00, 0xA000, "CJK"), (0xAC00, 0xD7A4, "HANGUL"), (0x20000, 0x323B0, "CJK"))
        for i in range(0x1F000):
            if any(a <= i < b for a, b, _ in large):
                continue
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                lower[i] = ord(low[0])
                name = unicodedata.name(c, "OTHER").split()[0].split("-")[0]
                name = "CJK" if name in ("HIRAGANA", "KATAKANA", "HALFWIDTH", "KANGXI", "BOPOMOFO") else "LATIN" if name in ("FULLWIDTH", "MODIFIER", "FEMININE", "MASCULINE") else name
                script[i] = numbers.setdefault(name, min(len(numbers) + 1, 250))
        for a, b, name in large:
            script[a:b] = np.where([chr(i).isalpha() for i in range(a, b)], numbers.setdefault(name, min(len(numbers) + 1, 250)), 0)
        _tables.extend((lower, script))
    return _tables[0], _tables[1]


class Words:
    """The words of some texts, with the hashed features of every letter."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower, scripts = letter_tables()
        raw, lead = K.code_points(data, offsets)
        n = len(raw)
        self.n_texts = len(offsets) - 1
        code, script = lower[raw].astype(K.U64), scripts[raw]
        letter = script > 0
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        cuts = lead[(lead > 0) & (lead < n)]
        first[cuts] = letter[cuts]
        last = letter.copy()
        last[:-1] &= ~letter[1:]
        last[cuts - 1] = letter[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(lead, self.start, side="right") - 1
        self.begin = lead[self.text] if n else self.start
        self.script = script[self.start]
        at = np.flatnonzero(letter)
        before = np.where(first[at], K.U64(0), code[np.maximum(at - 1, 0)])
        after = np.where(last[at], K.U64(0), code[np.minimum(at + 1, max(n - 1, 0))]) if n else code
        own = code[at]
        shift = K.U64(64 - BUCKETS.bit_length() + 1)
        two = K.mix64(own * K.U64(0x1F123BB5) + after + K.U64(1 << 60)) >> shift
        three = K.mix64((before * K.U64(0x2F0B4C47) + own) * K.U64(0x3C6EF372) + after) >> shift
        power, inverse = K.powers(1 << 12)
        # a word's hash, letter by letter (very long words wrap around, harmlessly)
        length = self.end - self.start
        place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        edge = np.cumsum(length) - length
        whole = np.add.reduceat(own * power[place % (1 << 12)], edge) if len(at) else np.empty(0, K.U64)
        self.edge, self.length = edge, length
        self.two, self.three = two.astype(np.int64), three.astype(np.int64) + BUCKETS
        self.whole = (K.mix64(whole) >> shift).astype(np.int64) + 2 * BUCKETS


class Model:
    """Log probabilities (features x languages) and scripts of languages."""

    def __init__(self, languages: list[str], tallies: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        logs = []
        for part in tallies.reshape(3, BUCKETS, -1):
            p = np.log((part + ALPHA) / (part.sum(axis=0) + ALPHA * BUCKETS))
            logs.append(p - p.mean(axis=1, keepdims=True))
        self.logs = np.concatenate(logs).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=0, keepdims=True))
        uses = share >= SCRIPT_SHARE
        self.excluded = np.where(uses | ~uses.any(axis=1, keepdims=True), 0, EXCLUDED).astype(np.float32)

    def groups(self, w: Words):
        """(languages, texts): which languages are candidates for which texts.
        A script that no language uses allows all of them."""
        pairs = np.unique(w.text * len(self.excluded) + w.script)
        allowed = np.zeros((w.n_texts, len(self.languages)), bool)
        np.logical_or.at(allowed, pairs // len(self.excluded), self.excluded[pairs % len(self.excluded)] == 0)
        sets, which = np.unique(np.packbits(allowed, axis=1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        for g in range(len(sets)):
            texts = which == g
            languages = np.flatnonzero(allowed[np.argmax(texts)])
            if len(languages):
                yield languages, texts

    def word_scores(self, w: Words, words: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """Scores of some words (numbers, ascending) for some languages."""
        logs = self.logs if len(languages) == self.logs.shape[1] else self.logs[:, languages]
        length = w.length[words]
        first = np.cumsum(length) - length
        letters = np.arange(length.sum()) - np.repeat(first, length) + np.repeat(w.edge[words], length)
        out = np.empty((len(words), len(languages)), np.float32)
        for i in range(0, len(words), LETTER_WORDS):
            part = slice(i, i + LETTER_WORDS)
            a = first[i]
            own = letters[a: a + length[part].sum()]
            each = logs[w.two[own]]
            each += logs[w.three[own]]
            out[part] = np.add.reduceat(each, first[part] - a, axis=0)
        out += logs[w.whole[words]]
        out += self.excluded[:, languages][w.script[words]]
        return out

    def label(self, w: Words) -> np.ndarray:
        """The language number of every word."""
        out = np.zeros(len(w.start), np.int64)
        for languages, texts in self.groups(w):
            words = np.flatnonzero(texts[w.text])
            number = np.cumsum(texts) - 1
            out[words] = languages[viterbi(self.word_scores(w, words, languages), number[w.text[words]], int(texts.sum()), SWITCH)]
        return out

    def shares(self, w: Words) -> np.ndarray:
        """For each text, the share of its letters in each language."""
        n = len(self.languages)
        letters = np.bincount(w.text * n + self.label(w), weights=w.length, minlength=w.n_texts * n).reshape(w.n_texts, n)
        return letters / np.maximum(1, letters.sum(axis=1, keepdims=True))


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, switch: float) -> np.ndarray:
    """The best sequence of columns for each text's rows, at ``switch`` a change."""
    n, k = scores.shape
    if not n:
        return np.empty(0, np.int64)
    n_words = np.bincount(text, minlength=n_texts)
    n_blocks = -(-n_words // STEP)
    first_word, first_block = np.cumsum(n_words) - n_words, np.cumsum(n_blocks) - n_blocks
    nth = np.arange(n) - first_word[text]
    block, at = first_block[text] + nth // STEP, nth % STEP
    total = int(n_blocks.sum())
    s = np.zeros((STEP, total, k), np.float32)
    s[at, block] = scores
    # each block from every entry: best score of (entry, exit)
    m = np.full((total, k, k), -switch, np.float32)
    m[:, np.arange(k), np.arange(k)] = 0
    for t in range(STEP):
        if t:
            np.maximum(m, m.max(axis=2, keepdims=True) - switch, out=m)
        m += s[t][:, None, :]
    # entries follow from block to block, all texts at once
    entry = np.zeros((total, k), np.float32)
    for r in range(1, int(n_blocks.max())):
        b = first_block[n_blocks > r] + r
        entry[b] = (entry[b - 1][:, :, None] + m[b - 1]).max(axis=1)
        entry[b] -= entry[b].max(axis=1, keepdims=True)
    # forward again with known entries; came[t]: the language before word t
    best, came = entry, np.empty((STEP, total, k), np.int8 if k < 128 else np.int16)
    for t in range(STEP):
        top = best.argmax(axis=1)
        jump = np.take_along_axis(best, top[:, None], 1) - switch
        stay = best >= jump
        came[t] = np.where(stay, np.arange(k), top[:, None])
        best = np.where(stay, best, jump) + s[t]
    # which entry each exit leads back to, then exits from the last block on
    back = np.broadcast_to(np.arange(k), (total, k)).copy()
    for t in range(STEP - 1, -1, -1):
        back = np.take_along_axis(came[t], back, 1).astype(np.int64)
    out = np.zeros(total, np.int64)
    last = first_block[n_blocks > 0] + n_blocks[n_blocks > 0] - 1
    out[last] = best[last].argmax(axis=1)
    for r in range(int(n_blocks.max()) - 1, 0, -1):
        b = first_block[n_blocks > r] + r
        out[b - 1] = back[b, out[b]]
    path, now = np.empty((STEP, total), np.int64), out
    for t in range(STEP - 1, -1, -1):
        path[t] = now
        now = np.take_along_axis(came[t], now[:, None], 1)[:, 0].astype(np.int64)
    return path[at, block]


def _tally(batches):
    for batch in batches:
        names = batch.column("lang").to_pylist()
        data, offsets = K.string_buffers(batch.column("text"))
        for lang in sorted(set(names)):
            at = [d for d, x in enumerate(names) if x == lang]
            part = np.concatenate([data[offsets[d]: offsets[d + 1]] for d in at])
            w = Words(part, np.concatenate(([0], np.cumsum([offsets[d + 1] - offsets[d] for d in at]))))
            found = np.concatenate([w.two, w.three, w.whole, np.repeat(w.script.astype(np.int64), w.length) + 3 * BUCKETS])
            bucket, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket), pa.array(n)], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> Model | None:
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
    # all but about twice the documents wanted of a language are left out by
    # their place in hash order, so no task ranks all of a language
    share = {r["lang"]: (2 * DOCS_EACH + 50) / r["count"] for r in known.groupBy("lang").count().collect()}
    if not share:
        return None
    shares = F.create_map(*[x for lang, s in sorted(share.items()) for x in (F.lit(lang), F.lit(s))])
    few = known.select("doc_id", "lang").where(hash_place("doc_id") < shares[F.col("lang")])
    chosen = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(hash_place("doc_id"), "doc_id"))).where(
        F.col("rank") <= DOCS_EACH).select(F.col("doc_id").alias("id"), F.col("lang").alias("of")).distinct()
    sample = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of"))).select("lang", "text")
    rows = sample.mapInArrow(_tally, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if not languages:  # learned from texts without a letter
        return None
    table = np.zeros((3 * BUCKETS + 256, len(languages)))
    at = np.searchsorted(languages, rows.column("lang").to_pylist())
    table[rows.column("bucket").to_numpy(), at] = rows.column("n").to_numpy()
    return Model(languages, table[: 3 * BUCKETS], table[3 * BUCKETS:])


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of words of one language."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    out: list[tuple[int, int, str]] = []
    for a, b, k in zip(w.start.tolist(), w.end.tolist(), model.label(w).tolist()):
        if out and out[-1][2] == model.languages[k]:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, model.languages[k]))
    return out


def identify(spark: SparkSession, docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred (the language of most
    letters), score (their share); with ``with_spans`` also the labelled
    spans, as array of start, end (code points) and lang."""
    shared = spark.sparkContext.broadcast(fit(docs))
    names = ["doc_id", "held_out", "lang_pred", "score"] + ["spans"] * with_spans
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("_text"))
            for i, j in K.slices(offsets, 1 << 20):
                if model is None:
                    lang, share = [UNKNOWN] * (j - i), np.zeros(j - i)
                else:
                    shares = model.shares(Words(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]))
                    top, share = shares.argmax(axis=1), shares.max(axis=1)
                    lang = [model.languages[k] if s > 0 else UNKNOWN for k, s in zip(top, share)]
                cols = [batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(lang, pa.string()), pa.array(share)]
                if with_spans:
                    texts = [data[offsets[d]: offsets[d + 1]].tobytes().decode("utf-8", "replace") for d in range(i, j)]
                    cols.append(pa.array([[dict(zip(("start", "end", "lang"), s)) for s in spans(model, t)] if model else [] for t in texts], span))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("_text"))
    more = ", spans array<struct<start:long,end:long,lang:string>>" if with_spans else ""
    return Workspace(spark, "script-viterbi").finish(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double{more}"))
