"""Quality by the votes of the nearest labelled documents in a latent-semantic
space.

A document's terms are counted over its whole text: three-byte shapes (letter
case, digits, white space, single marks), words and word lengths, hashed to
fixed numbers of columns; and a few ratios (repeated words, capitals, marks).
Log counts times inverse document frequency (counted over all documents),
scaled to length 1, are projected on the leading right singular vectors of the
labelled sample's matrix.

The labelled vectors (at most ``SAMPLE`` documents, taken in hash order from
the training folds; a bounded table) go to every executor. Every document's
cosine with each of them is computed exactly, in blocks, and the ``NEIGHBOURS``
nearest vote with weights that grow with similarity.

Ties: of equally similar labelled documents at the last place, those with
label 0 vote first.

Rows: a null or empty text has the zero vector and the share of label 1 as its
score. Without any labelled document the score is 0.5. Each input row gives
one output row, whatever its id; a null id is not held out. Of several texts
under a labelled id the one with the least hash is learned from. Labels without an
id or a value are ignored; of repeated labels the lowest counts. Extra columns
are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, fold_of, hash_head

SAMPLE = 3000
DIMENSIONS, NEIGHBOURS = 48, 25
#: A vote's weight is exp(SHARPNESS * (similarity - nearest similarity)).
SHARPNESS = 12.0
SHAPES, WORDS, LENGTHS, RATIOS = 2048, 2048, 16, 6
COLUMNS = SHAPES + WORDS + LENGTHS + RATIOS
RATIO_WEIGHT = 0.7
PREDICT = 0.3
FOLDS, HELD_OUT = 5, 0

# Classes of bytes: lower case, capital, digit, line end, other white space,
# beyond ASCII, and each mark by itself.
_SHAPE = np.zeros(256, np.int64)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 1, 2, 3, 4
_SHAPE[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _SHAPE[0x0A] = 5, 6
_marks = [b for b in range(0x21, 0x7F) if not _SHAPE[b]]
_SHAPE[_marks] = 7 + np.arange(len(_marks))
_KINDS = 7 + len(_marks)


def _hashed(x: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix64(x.astype(K.U64)) >> K.U64(64 - buckets.bit_length() + 1)).astype(np.int64)


_SHAPE_COLUMN = _hashed(np.arange(_KINDS**3), SHAPES).astype(np.int32)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts and ratios of each text, one row a text."""
    n = len(offsets) - 1
    out = np.zeros((n, COLUMNS), np.float32)
    size = np.diff(offsets)
    if not len(data):
        return out
    kind = _SHAPE[data]
    text = np.repeat(np.arange(n), size)
    if len(kind) > 2:
        tri = _SHAPE_COLUMN[(kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]]
        own = text[:-2] == text[2:]
        out[:, :SHAPES] = np.bincount((text[:-2] * SHAPES + tri)[own], minlength=n * SHAPES).reshape(n, SHAPES)
    start, end, word_text = K.words(data, offsets, K.ALNUM)
    code = K.span_codes(data, start, end, K.FOLDED_CODES)
    n_words = np.maximum(1, np.bincount(word_text, minlength=n))
    out[:, SHAPES:SHAPES + WORDS] = np.bincount(word_text * WORDS + _hashed(code, WORDS), minlength=n * WORDS).reshape(n, WORDS)
    length = np.minimum(end - start, LENGTHS) - 1
    out[:, SHAPES + WORDS:SHAPES + WORDS + LENGTHS] = np.bincount(word_text * LENGTHS + length, minlength=n * LENGTHS).reshape(n, LENGTHS)
    ratio = out[:, -RATIOS:]
    order = np.lexsort((code, word_text))
    again = (code[order][1:] == code[order][:-1]) & (word_text[order][1:] == word_text[order][:-1])
    ratio[:, 0] = np.bincount(word_text[order][1:][again], minlength=n) / n_words
    same = (code[1:] == code[:-1]) & (word_text[1:] == word_text[:-1])
    ratio[:, 1] = np.bincount(word_text[1:][same], minlength=n) / n_words
    letters = np.maximum(1, np.bincount(text, weights=(kind == 1) | (kind == 2) | (kind == 4), minlength=n))
    ratio[:, 2] = np.bincount(text, weights=kind == 2, minlength=n) / letters
    ratio[:, 3] = np.minimum(1, np.bincount(text, weights=kind >= 7, minlength=n) / n_words)
    ratio[:, 4] = np.bincount(text, weights=kind == 3, minlength=n) / np.maximum(1, size)
    ratio[:, 5] = np.minimum(1, np.bincount(word_text, weights=end - start, minlength=n) / n_words / 20)
    return out


class Space:
    """Term weights, projection and labelled vectors. ``rows`` are the sample's
    counts, and are overwritten; ``having`` says how many of ``n`` documents
    have each of the hashed terms."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, having: np.ndarray, n: int, dimensions: int = DIMENSIONS):
        self.idf = np.log((1 + n) / (1 + having)).astype(np.float32) + np.float32(0.1)
        x = self.weigh(rows)
        # leading right singular vectors, by a random range and power steps
        rng = np.random.default_rng(13)
        k = min(dimensions, len(rows))
        basis = x.T @ (x @ rng.standard_normal((x.shape[1], k + 16)).astype(np.float32))
        for _ in range(4):
            basis = x.T @ (x @ np.linalg.qr(basis)[0])
        q = np.linalg.qr(basis)[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.project = np.ascontiguousarray((q @ vt[:k].T).astype(np.float32))
        self.vectors, self.labels = self.place(x), labels.astype(np.float32)
        self.prior = float(labels.mean())

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        """Weighted counts, in the place of the counts."""
        terms = rows[:, :-RATIOS]
        np.log1p(terms, out=terms)
        terms *= self.idf
        for i in range(0, len(rows), 256):
            terms[i: i + 256] /= np.maximum(np.linalg.norm(terms[i: i + 256], axis=1, keepdims=True), 1e-9)
        rows[:, -RATIOS:] *= np.float32(RATIO_WEIGHT)
        return rows

    def place(self, weighed: np.ndarray) -> np.ndarray:
        x = weighed @ self.project
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(norm > 1e-9, x / np.maximum(norm, 1e-9), 0)

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """Scores of documents: exact cosines with all labelled vectors. Of equally
        near ones those of the lower label vote first. ``rows`` is overwritten."""
        x = self.place(self.weigh(rows))
        score = np.full(len(x), self.prior)
        known = np.abs(x).sum(axis=1) > 0
        k = min(NEIGHBOURS, len(self.vectors))
        for i in range(0, len(x), 512):
            part = slice(i, i + 512)
            sim = x[part] @ self.vectors.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            # ties at the last place go by label, so that the vote doesn't hang on an order
            edge = np.take_along_axis(sim, near, 1).min(axis=1, keepdims=True)
            for r in np.flatnonzero((sim >= edge).sum(axis=1) > k):
                near[r] = np.lexsort((self.labels, -sim[r]))[:k]
            s = np.take_along_axis(sim, near, 1).astype(np.float64)
            w = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
            score[part] = np.where(known[part], (w * self.labels[near]).sum(axis=1) / w.sum(axis=1), self.prior)
        return np.clip(score, 0, 1)


def _sparse(batches):
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        for i, j in K.slices(offsets, 1 << 20):
            rows = counts(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                 pa.array([r[a] for r, a in zip(rows, at)], pa.list_(pa.float32()))], names=["id", "label", "at", "value"])


def _having(batches):
    """One row a task: documents, and how many of them have each hashed term."""
    n, having = 0, np.zeros(COLUMNS - RATIOS, np.int64)
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        for i, j in K.slices(offsets, 1 << 20):
            for a in range(i, j, 512):
                b = min(a + 512, j)
                having += (counts(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])[:, :-RATIOS] > 0).sum(axis=0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([having], pa.list_(pa.int64()))], names=["n", "having"])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents with a text, and of those that have each term."""
    each = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_having, "n long, having array<long>")
    sums = (each.select("n", F.posexplode("having").alias("term", "own")).groupBy("term")
            .agg(F.sum("n").alias("n"), F.sum("own").alias("own")).collect())  # a row a term
    having = np.zeros(COLUMNS - RATIOS)
    for r in sums:
        having[r["term"]] = r["own"]
    return (sums[0]["n"] if sums else 0), having


def sample_of(ws: Workspace, docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(id, label, text) of at most ``most`` labelled documents of the training
    folds, in hash order: a bounded table, written once. Of the texts of a
    repeated id the one with the least hash counts, and the lowest label."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold_of("doc_id", folds) != held_out))
             .groupBy(F.col("doc_id").alias("id")).agg(F.min(column).cast("int").alias("label")))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # hash order over labelled ids that have a document
    there = ws.save(known.join(texts.select("id").distinct(), "id", "left_semi"), "there")
    chosen = hash_head(there, most, "id")
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    sample = ws.save(one.select("id", "label", "t.text"), "sample")
    ws.drop("there")
    return sample


def fit(ws: Workspace, docs: DataFrame, labels: DataFrame, column: str = "quality") -> Space | None:
    sample = sample_of(ws, docs, labels, column, FOLDS, HELD_OUT, SAMPLE)
    kind = sample.schema["id"].dataType.simpleString()
    table = sample.mapInArrow(_sparse, f"id {kind}, label int, at array<int>, value array<float>").toArrow()
    ws.drop("sample")
    if not table.num_rows:
        return None
    # by id: the same model whatever the order of the rows
    ids, label = table.column("id").to_pylist(), table.column("label").to_numpy()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    dense = np.zeros((len(ids), COLUMNS), np.float32)
    for r, at, value in zip(place, table.column("at"), table.column("value")):
        dense[r, at.values.to_numpy()] = value.values.to_numpy()
    del table
    n, having = document_frequencies(docs)
    return Space(dense, label[order], having, n)


def _scores(model: Space | None, column: pa.Array) -> pa.Array:
    """The scores of a column of texts."""
    data, offsets = K.string_buffers(column)
    out = np.full(len(column), 0.5)
    if model is not None:
        for i, j in K.slices(offsets, 1 << 20):
            for a in range(i, j, 512):
                b = min(a + 512, j)
                out[a:b] = model.vote(counts(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]))
    return pa.array(out)


def scorer(space):
    """A function from a text column to its scores."""
    @F.arrow_udf("double")
    def score_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield _scores(space.value, column)
    return score_of


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ws = Workspace(spark, "lsa-vote")
    space = spark.sparkContext.broadcast(fit(ws, docs, labels))
    out = docs.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), scorer(space)(docs["text"].cast("string")).alias("score"))
    return ws.finish(out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int")))


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1."""
    space = spark.sparkContext.broadcast(fit(Workspace(spark, "lsa-vote"), docs, labels))
    return docs.where(scorer(space)(docs["text"].cast("string")) >= PREDICT)
