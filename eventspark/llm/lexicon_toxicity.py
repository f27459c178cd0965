"""Toxicity by a weighted lexicon of stems, matched by Aho-Corasick.

Folding: texts are reduced to the letters a-z and blanks. Case, accents and
compatibility forms go; look-alike letters of other scripts and digits or
signs that stand in for letters are replaced by what they look like (a sign
only next to a letter); invisible characters vanish. A 1 next to letters is read
both as i and as l.

Lexicon: in a bounded sample of labelled documents of the training folds every
word beginning of four letters or more, and every whole word of two or three,
is counted once a document. Beginnings that are far more
frequent in toxic documents are candidates; of nested ones the longest stays
that still covers nearly as many toxic documents, so a word's own stem is found
whatever its endings. An automaton finds all stems at word starts in one pass
over the whole folded text.

Exceptions: a stem with the word before or after it that occurs mostly in
clean documents is an exception phrase, learned in a second count; such a hit
is ignored. Further phrases can be given. Stems that mark toxic documents by
what hits are left stay, with their log odds as weight.

Score: the summed weight of the hits, also divided by the root of the number
of words, the heaviest hit, and whether there is one go into a logistic curve
fitted on the same sample.

Ties: of equally frequent stems or phrases beyond ``LEXICON`` (a bound on the
learned model) the first in the alphabet stay.

Rows: a null, empty or letterless text has the score of a text without hits. Of
several texts under a labelled id the one with the least hash is learned from.
Without toxic labels every score is 0; without clean ones 1. Each input row
gives one output row, whatever its id; a null id is not held out. Extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, fold_of
from eventspark.llm.lsa_vote import sample_of

SAMPLE = 9000
FOLDS, HELD_OUT = 3, 1
PREDICT = 0.7
#: Word beginnings counted; toxic documents a stem needs, and by how many standard
#: deviations over chance; the share of its documents that must be toxic after
#: exceptions; the share of a shorter stem's toxic documents that a longer one covers.
SHORTEST, LONGEST, SUPPORT, DEVIATIONS, PRECISION, COVER = 4, 12, 6, 6.0, 0.6, 0.95
#: Shorter words, down to this length, count only as whole words.
WHOLE = 2
LEXICON = 5000
#: An exception phrase occurs in so many clean documents, and so many times as often as in toxic ones.
CLEAN_SUPPORT, CLEAN_TIMES = 3, 4

# Letters of other scripts, and digits and signs, by the Latin
# letter they resemble.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "вβь", "c": "сϲ", "d": "ԁ", "e": "еεєҽ", "g": "ɡց", "h": "һнհ", "i": "іιıї", "j": "јϳ", "k": "кκ", "l": "ӏⅼ",
    "m": "мμ", "n": "пηո", "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "νѵ", "w": "ԝωш", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
SUBSTITUTES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_BLANK, _INVISIBLE, _STAND_IN = 0, 255, 100
_table: list[np.ndarray] = []
#: Readings of a stand-in with more than one.
READINGS = 2


def fold_table(reading: int = 0) -> np.ndarray:
    """For every code point: 0 blank, 1-26 a letter, 100 + letter a stand-in,
    255 nothing."""
    if not _table:
        letters = np.zeros(0x110000, np.uint8)
        alike = {ord(c): ord(k) - 96 for k, v in LOOK_ALIKES.items() for c in v}
        for i in range(0x80):
            c = chr(i).lower()
            letters[i] = ord(c) - 96 if "a" <= c <= "z" else _BLANK
        for i in (*range(0x80, 0x3000), *range(0xA720, 0xAB70), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)):
            c = chr(i)
            kind = unicodedata.category(c)
            if kind in ("Mn", "Me", "Cf"):
                letters[i] = _INVISIBLE
                continue
            plain = unicodedata.normalize("NFKD", c).lower()
            low = plain[:1]
            if "a" <= low <= "z":
                letters[i] = ord(low) - 96
            elif low and ord(low) in alike:
                letters[i] = alike[ord(low)]
            elif c == "ß":
                letters[i] = ord("s") - 96
            elif kind[0] == "L":
                # other letters keep a word together: folded to one of a-z by rule
                letters[i] = 1 + (ord(low or c) * 7) % 26
        for r in range(READINGS):
            for c, to in SUBSTITUTES.items():
                letters[ord(c)] = _STAND_IN + ord(to[min(r, len(to) - 1)]) - 96
            _table.append(letters.copy())
    return _table[reading]


def fold(data: np.ndarray, offsets: np.ndarray, reading: int = 0) -> tuple[str, np.ndarray]:
    """All texts folded, each between blanks, and where each starts. All
    readings have their letters at the same places."""
    code, lead = K.code_points(data, offsets)
    kind = fold_table(reading)[code]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(lead))
    seen = kind != _INVISIBLE
    kind, text, code = kind[seen], text[seen], code[seen]
    stand = (kind >= _STAND_IN) & (kind < _INVISIBLE)
    if stand.any():
        letter = (kind > 0) & (kind < _STAND_IN)
        same = np.concatenate(([False], text[1:] == text[:-1]))
        before = np.concatenate(([False], letter[:-1])) & same
        after = np.concatenate((letter[1:], [False])) & np.concatenate((same[1:], [False]))
        digit = (code >= 0x30) & (code < 0x3A)
        twice = np.concatenate(([False], code[1:] == code[:-1])) & same & ~digit
        into = stand & (before | after) & ~twice
        # a run of stand-ins next to a letter counts as a whole (as in f00l)
        run = np.concatenate(([False], into[:-1])) & same & stand & digit
        kind = np.where(into | run, kind - _STAND_IN, np.where(stand, _BLANK, kind))
    out = np.where(kind == 0, 32, kind + 96).astype(np.uint8)
    n = np.bincount(text, minlength=len(offsets) - 1)
    start = np.concatenate(([0], np.cumsum(n + 2)))
    full = np.full(start[-1], 32, np.uint8)
    full[np.arange(len(out)) + 2 * text + 1] = out
    return full.tobytes().decode("ascii"), start


def readings(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different foldings of the texts."""
    first, start = fold(data, offsets)
    return list(dict.fromkeys([first, *[fold(data, offsets, r)[0] for r in range(1, READINGS)]])) if (data == ord("1")).any() else [first], start


def stems_of(word: str) -> list[str]:
    """What a word is counted under: its beginnings, or itself with a blank after it."""
    if len(word) < SHORTEST:
        return [word + " "] if len(word) >= WHOLE else []
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)]


def _beginnings(batches):
    """Per batch: how many documents of either label have a word beginning."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        data, offsets = K.string_buffers(batch.column("text"))
        seen: dict[str, list[int]] = {}
        for i, j in K.slices(offsets, 1 << 20):
            texts, start = readings(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
            for d in range(j - i):
                words = {w for folded in texts for w in folded[start[d]: start[d + 1]].split()}
                for stem in {stem for w in words for stem in stems_of(w)}:
                    seen.setdefault(stem, [0, 0])[label[i + d]] += 1
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([n[0] for _, n in rows], pa.int64()),
                                          pa.array([n[1] for _, n in rows], pa.int64())], names=["stem", "clean", "toxic"])


def choose_stems(counted: list[tuple[str, int, int]]) -> list[str]:
    """Of each chain of nested beginnings (stem, clean, toxic) the longest that
    covers nearly what the shortest does."""
    good = {s: t for s, _, t in counted}
    chosen = []
    for stem in sorted(good, key=lambda s: (len(s), s)):
        if any(stem[:k] in good for k in range(SHORTEST, len(stem))):
            continue
        best, longer = stem, [stem]
        while longer:
            best = max(longer, key=lambda s: (good[s], s))
            longer = [s for s in good if len(s) == len(best) + 1 and s.startswith(best) and good[s] >= COVER * good[stem]]
        chosen.append(best)
    return sorted(sorted(chosen, key=lambda s: (-good[s], s))[:LEXICON])


class Lexicon:
    """Stems with weights and exception phrases; scores folded texts."""

    def __init__(self, stems: dict[str, float], exceptions: set[str] = frozenset(), curve: np.ndarray | None = None, base: float = 0.0):
        self.stems, self.exceptions, self.curve, self.base = stems, set(exceptions), curve, base

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def hits(self, folded: str):
        """(place, stem) of the longest stem at every word start that has one."""
        if "automaton" not in self.__dict__:
            self.automaton = ahocorasick.Automaton()
            for s in self.stems:
                self.automaton.add_word(" " + s, s)
            if self.stems:
                self.automaton.make_automaton()
        found = {}
        if self.stems:
            for end, stem in self.automaton.iter(folded):
                found[end - len(stem) + 1] = stem  # later ones are longer
        return found.items()

    @staticmethod
    def phrases(folded: str, lo: int, hi: int, at: int, stem: str) -> tuple[str, str]:
        """The stem at ``at`` with the whole word before it and after it in
        folded[lo: hi], a text between blanks."""
        last = at - 1
        while last > lo and folded[last - 1] == " ":
            last -= 1
        before = folded[max(lo, folded.rfind(" ", lo, last) + 1): last] if last > lo else ""
        first = folded.find(" ", at, hi)
        while 0 <= first < hi and folded[first] == " ":
            first += 1
        after = folded[first: folded.find(" ", first, hi)] if 0 <= first < hi else ""
        return f"{before} {stem.strip()}", f"{stem.strip()} {after}"

    def features(self, data: np.ndarray, offsets: np.ndarray, collect: str | None = None):
        """The inputs of the curve for each text; and its ``phrases`` around
        hits or its ``stems`` hit outside exceptions, if asked for."""
        texts, start = readings(data, offsets)
        folded, n = texts[0], len(offsets) - 1
        total, top, seen = np.zeros(n), np.zeros(n), [set() for _ in range(n)]
        raw = np.frombuffer(folded.encode("ascii"), np.uint8) != 32
        first = np.flatnonzero(raw[1:] & ~raw[:-1])
        n_words = np.bincount(np.searchsorted(start, first, side="right") - 1, minlength=n)[:n] if len(first) else np.zeros(n, np.int64)
        found = {}
        for k, text in reversed(list(enumerate(texts))):
            found.update({at: (stem, k) for at, stem in self.hits(text)})
        for at, (stem, k) in found.items():
            d = int(np.searchsorted(start, at, side="right")) - 1
            if collect == "phrases" or self.exceptions:
                two = self.phrases(texts[k], int(start[d]), int(start[d + 1]), at, stem)
                if collect == "phrases":
                    seen[d].update(two)
                if not self.exceptions.isdisjoint(two):
                    continue
            if collect == "stems":
                seen[d].add(stem)
            total[d] += self.stems[stem]
            top[d] = max(top[d], self.stems[stem])
        x = np.stack([np.ones(n), np.log1p(total), total / np.sqrt(np.maximum(1, n_words)), top, (top > 0).astype(float)], axis=1)
        return x, seen

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small penalty."""
    w, penalty = np.zeros(x.shape[1]), 0.05 * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measured(lexicon, collect: str | None):
    def run(batches):
        model = lexicon.value
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.slices(offsets, 1 << 20):
                x, seen = model.features(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], collect)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64())),
                                                  pa.array([sorted(p) for p in seen], pa.list_(pa.string()))], names=["label", "x", "seen"])
    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "toxic", exceptions: set[str] = frozenset()) -> Lexicon:
    ws = Workspace(spark, "lexicon-fit")
    sample = sample_of(ws, docs, labels, column, FOLDS, HELD_OUT, SAMPLE)
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({}, base=1.0 if n.get(1) else 0.0)
    chance = n[1] / (n[0] + n[1])
    both = F.col("toxic") + F.col("clean")
    counted = (sample.mapInArrow(_beginnings, "stem string, clean long, toxic long").groupBy("stem")
               .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .where((F.col("toxic") >= SUPPORT) & (F.col("toxic") - both * chance >= DEVIATIONS * F.sqrt(both * chance * (1 - chance))))
               .orderBy(F.desc("toxic"), "stem").limit(4 * LEXICON).collect())
    stems = choose_stems([(r["stem"], r["clean"], r["toxic"]) for r in counted])

    def measured(model, collect):
        return sample.mapInArrow(_measured(spark.sparkContext.broadcast(model), collect), "label int, x array<double>, seen array<string>")

    def tallied(model, collect):
        return (measured(model, collect).select("label", F.explode("seen").alias("what")).groupBy("what")
                .agg(F.count_if(F.col("label") == 0).alias("c"), F.count_if(F.col("label") == 1).alias("t")))

    model = Lexicon(dict.fromkeys(stems, 1.0))
    learned = (tallied(model, "phrases").where((F.col("c") >= CLEAN_SUPPORT) & (F.col("c") >= CLEAN_TIMES * F.col("t")))
               .orderBy(F.desc("c"), "what").limit(LEXICON).collect())
    model = Lexicon(model.stems, set(exceptions) | {r["what"] for r in learned})
    left = tallied(model, "stems").where((F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * (F.col("t") + F.col("c")))).collect()
    weight = {r["what"]: float(np.log((r["t"] + 0.5) / (n[1] + 1)) - np.log((r["c"] + 0.5) / (n[0] + 1))) for r in left}
    model = Lexicon(dict(sorted(weight.items())), model.exceptions)
    rows = sorted((r["label"], *r["x"]) for r in measured(model, None).select("label", "x").collect())
    ws.drop("sample")
    table = np.array(rows)
    model.curve = _curve(table[:, 1:], table[:, 0])
    return model


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    lexicon = spark.sparkContext.broadcast(fit(spark, docs, labels))

    def run(batches):
        model = lexicon.value
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("_text"))
            for i, j in K.slices(offsets, 1 << 20):
                x, _ = model.features(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(model.score(x))],
                                                 names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("_text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return Workspace(spark, "lexicon-toxicity").finish(out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int")))
