"""Periodic runs of words by an online sparse diagonal table.

A run of period q shows as a diagonal at lag q: every word equals the word q
places before it. Going through the words from left to right, the earlier
occurrence of a word that repeats the L words ending here sets the active lag
of scale L and lengthens its match; when the lag changes, the diagonal ends
and is emitted as a run if it is long enough.

One earlier occurrence a scale is enough, whatever the number of occurrences:
inside a run of smallest period q, L >= q words recur at distance q and at no
smaller one, so the nearest earlier occurrence of the last L words has lag q
exactly. Scale L = 1, 2, 4, ... looks after the periods in (L/2, L]. A lag
found this way is the smallest period of its run: a smaller one would show as a
nearer occurrence. So a text of n words costs O(n log n) even if it repeats one
word throughout, and scales beyond the first ones see only words whose
surroundings repeat. All texts of a batch are worked on at once; words are
compared by their bytes, not by hashes.

Rows: a null or empty text has no words, no runs and an empty collapsed text.
A null id is kept; with ``digest`` its words stay as they are. Each input row
gives one output row, repeated ids too. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace

#: A run has at least this many words, and at least this many periods (3 or more).
LEAST_WORDS, LEAST_PERIODS = 6, 4
_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def coded_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts as numbers (equal numbers: equal bytes), the
    words that the numbers stand for, and n+1 word offsets of the texts."""
    start, end, text = K.words(data, offsets, inside)
    ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    raw = data[inside[data]] if len(data) else data
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1)))).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first


def repeat_tail(ids: np.ndarray, seed: int) -> np.ndarray:
    """The words of one text with its end replaced by repetitions: from word
    a = seed % n on, the first p words after a over and over."""
    n = len(ids)
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    at = np.arange(n)
    return ids[np.where(at < a, at, a + (at - a) % p)]


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (first word, length, period) of all runs in all texts; words are
    numbered through all texts, text d has the words first[d]: first[d + 1]."""
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    begin, size = first[:-1][text], n_words[text]
    rank = np.full(len(ids), -1, np.int64)
    at, key, scale, found = np.arange(len(ids)), None, 1, []
    if len(ids):
        key = text * (ids.max() + 1) + ids
    while len(at):
        # places with equal keys (the same last `scale` words of the same text) side by side, in text order
        order = np.argsort(key, kind="stable")
        sorted_key, place = key[order], at[order]
        same = sorted_key[1:] == sorted_key[:-1]
        now, lag = place[1:][same], (place[1:] - place[:-1])[same]
        own = (2 * lag > scale) & (lag <= scale)
        now, lag = now[own], lag[own]
        by_place = np.argsort(now)
        now, lag = now[by_place], lag[by_place]
        if len(now):
            # an active lag goes on from word to word; where it does not, its diagonal ends
            new = np.concatenate(([True], (now[1:] != now[:-1] + 1) | (lag[1:] != lag[:-1])))
            opened = np.flatnonzero(new)
            closed = np.concatenate((opened[1:], [len(now)])) - 1
            q = lag[opened]
            length = now[closed] - now[opened] + scale + q
            enough = length >= np.maximum(least, periods * q)
            found.append(np.stack([now[opened] - scale + 1 - q, length, q], axis=1)[enough])
        # the next scale: two keys of this one, side by side, that both occur more than once
        again = np.zeros(len(place), bool)
        again[1:] |= same
        again[:-1] |= same
        number = np.concatenate(([0], np.cumsum(~same)))
        ranked = place[again]
        rank[ranked] = number[again]
        at = np.sort(ranked)
        at = at[(at - scale >= begin[at]) & (size[at] >= periods * (scale + 1))]
        at = at[rank[at - scale] >= 0]
        key = rank[at] * (len(place) + 1) + rank[at - scale]
        rank[ranked] = -1
        scale *= 2
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _rows(batches):
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        for i, j in K.slices(offsets, 1 << 20):
            part = batch.slice(i, j - i)
            ids, dictionary, first = coded_words(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], K.NON_SPACE)
            for d, seed in enumerate(part.column("repeat_seed").to_pylist()):
                if seed is not None and first[d] < first[d + 1]:
                    ids[first[d]: first[d + 1]] = repeat_tail(ids[first[d]: first[d + 1]], seed)
            runs = find_runs(ids, first)
            start, length, period = runs.T
            # a word goes if a run holds it after the run's first period
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            kept_first = np.concatenate(([0], np.cumsum(kept)))[first]
            words = pa.LargeListArray.from_arrays(pa.array(kept_first, pa.int64()), dictionary.take(pa.array(ids[kept])))
            run_first = np.searchsorted(start, first)
            own = np.repeat(first[:-1], np.diff(run_first))
            listed = pa.ListArray.from_arrays(pa.array(run_first, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(start - own), pa.array(length), pa.array(period)], fields=list(_RUN_TYPE.value_type)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first)), listed, pc.binary_join(words, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, repeat_seed: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length and period in
    words, by start and period) and collapsed (the words outside of the
    repetitions, joined by one space). ``repeat_seed`` gives, where it is not
    null, a number by which the end of the text is first made to repeat."""
    seed = F.lit(None) if repeat_seed is None else repeat_seed
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), seed.cast("long").alias("repeat_seed"))
    out = rows.mapInArrow(_rows, f"doc_id long, n_words long, runs {_RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns. A tenth of the texts is made to repeat, by the
    crc32 of the id as text."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    found = runs(docs, F.when(h % 10 == 0, F.floor(h / 10)))
    field = lambda r, name: r.getField(name)
    # the first of the runs with the greatest length / period, in exact arithmetic
    better = lambda best, r: best.isNull() | (field(r, "length") * field(best, "period") > field(best, "length") * field(r, "period"))
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[field(r, c).cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return Workspace(spark, "diagonal-runs").finish(out)


SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(crc, b)), 4294967295), 4294967295) AS h
  FROM documents
), seeded AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM sized
), tail AS (
  SELECT *, coalesce(g % n, n) AS a, 1 + (n - coalesce(g % n, n)) // (3 + coalesce(g, 0) % 8) AS p FROM seeded
), word AS (
  SELECT r, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS w FROM tail, unnest(range(n)) AS u(i)
), pair AS (
  SELECT x.r, x.i, x.i - y.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n
), diagonal AS (
  SELECT r, q, min(i) - q AS s, count(*) + q AS len FROM (
    SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pair) GROUP BY r, q, island
), long AS (
  SELECT * FROM diagonal WHERE len >= greatest(6, 4 * q)
), run AS (
  SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.r = l.r AND o.q < l.q AND o.s <= l.s AND o.s + o.len >= l.s + l.len)
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS text,
    arg_min({'s': s, 'len': len, 'q': q}, {'e': -(len::DOUBLE / q), 's': s, 'q': q}) AS best FROM run GROUP BY r
), gone AS (
  SELECT DISTINCT r, i FROM run, unnest(range(s + q, s + len)) AS u(i)
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM sized LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
