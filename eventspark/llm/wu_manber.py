"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of 13 consecutive words of the benchmark items
(an item of fewer words is one window). Patterns of one length m are searched
together, with blocks of two words:

* Shift table: for every block in a pattern, how far its last place in any
  pattern is from that pattern's end; for all other blocks m - 1. The search
  looks at the last block of the place where a window could end, and moves on
  by its shift.
* Where the shift is 0 the block ends some pattern: the hash of this suffix and
  that of the window's first block pick the bucket of patterns that could stand
  there.
* Direct comparison of the words confirms every occurrence; then the search
  moves on by one.

A text is searched from many places at once: it is dealt into stretches of
``STRETCH`` window ends, each with a pointer of its own, and all pointers of a
batch move together.

The patterns go to the executors in blocks of at most ``BLOCK_BYTES`` of item
text; items that are longer are dealt out in overlapping pieces. With several
blocks, the documents are read once for each, and only the hits are written, by
the md5 of the text; they are joined to the documents at the end.

Rows: a null text has no words. Items with a null id or without words are
ignored, repeated items count once. Each input row gives one output row,
whatever its id. Extra columns are ignored by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace

WINDOW = 13
#: Item text searched for in one pass (its windows take some 60 times as much memory, at most).
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
STRETCH = 256
_LOWER = K.fold_case()


def _keyed(code: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from each place."""
    out = np.zeros(len(at), dtype=K.U64)
    for i in range(length):
        out += K.mix64(code[at + i] + K.U64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return out


class Patterns:
    """All windows of one length, with their shift table and their buckets."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.words = list(windows)
        self.items = [sorted(windows[w]) for w in self.words]
        flat = [w for win in self.words for w in win]
        ends = np.cumsum([len(w) for w in flat]).astype(np.int64)
        data = np.frombuffer(b"".join(flat), np.uint8)
        code = K.span_codes(data, ends - [len(w) for w in flat], ends, K.FOLDED_CODES)
        first = np.arange(len(self.words)) * length
        # the shift of a block: its least distance from the end of a pattern
        self.most = length - self.block + 1
        places = (first[:, None] + np.arange(self.most)).ravel()
        block = _keyed(code, places, self.block)
        to_end = np.tile(np.arange(self.most)[::-1], len(first))
        order = np.lexsort((to_end, block))
        self.blocks, at = np.unique(block[order], return_index=True)
        self.shifts = to_end[order][at]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.blocks >> K.U64(44)).astype(np.int64)] = True
        # buckets by suffix and prefix
        key = self._bucket(code, first)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _bucket(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        suffix = _keyed(code, first + self.length - self.block, self.block)
        return K.mix64(suffix * K.U64(0x9FB21C651E98DF25) + _keyed(code, first, self.block))

    def search(self, data, start, end, code, text):
        """Places (word numbers) and pattern numbers of all occurrences."""
        m = self.length
        at = np.arange(m - 1, len(code), STRETCH)
        limit = np.minimum(at + STRETCH, len(code))
        found = []
        while len(at):
            key = _keyed(code, at - (self.block - 1), self.block)
            shift = np.full(len(at), self.most)
            maybe = np.flatnonzero(self.bits[(key >> K.U64(44)).astype(np.int64)])
            row = np.minimum(np.searchsorted(self.blocks, key[maybe]), len(self.blocks) - 1)
            there = self.blocks[row] == key[maybe]
            shift[maybe[there]] = self.shifts[row[there]]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            left = at < limit
            at, limit = at[left], limit[left]
        q = np.sort(np.concatenate(found)) - (m - 1) if found else np.empty(0, np.int64)
        q = q[text[q] == text[q + m - 1]]
        key = self._bucket(code, q)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        out_q, out_p = [], []
        for i in np.flatnonzero(hi > lo):
            p = int(q[i])
            here = tuple(_LOWER[data[start[k]: end[k]]].tobytes() for k in range(p, p + m))
            for j in range(lo[i], hi[i]):
                if self.words[self.order[j]] == here:
                    out_q.append(p), out_p.append(int(self.order[j]))
        return out_q, out_p


def build(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Pattern tables of the items (id, text), one for each window length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        start, end, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
        own = [_LOWER[data[a:b]].tobytes() for a, b in zip(start, end)]
        length = min(window, len(own))
        for i in range(len(own) - length + 1 if own else 0):
            by_length.setdefault(length, {}).setdefault(tuple(own[i: i + length]), set()).add(item)
    return [Patterns(length, windows) for length, windows in sorted(by_length.items())]


def _scan_texts(patterns, data, offsets):
    """For each text: number of words, hit words (their numbers) and items."""
    start, end, text = K.words(data, offsets, K.ALNUM)
    code = K.span_codes(data, start, end, K.FOLDED_CODES)
    n = len(offsets) - 1
    cover = np.zeros(len(code) + 1, dtype=np.int64)
    items = [set() for _ in range(n)]
    for p in patterns:
        at, which = p.search(data, start, end, code, text)
        if at:
            np.add.at(cover, np.array(at), 1)
            np.add.at(cover, np.array(at) + p.length, -1)
            for q, w in zip(at, which):
                items[text[q]].update(p.items[w])
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    n_words = np.bincount(text, minlength=n)
    first = np.concatenate(([0], np.cumsum(n_words)))
    return n_words, hit, first, items


def _scanner(patterns, columns, hits_only: bool):
    """The words, hits and items of every text (or of those with hits only)."""
    def run(batches):
        tables = patterns.value
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.slices(offsets, 1 << 21):
                part = batch.slice(i, j - i)
                n_words, hit, first, items = _scan_texts(tables, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                cut = np.searchsorted(hit, first)
                done = {"_words": pa.array(n_words, pa.int64()), "_hits": pa.array([hit[cut[d]: cut[d + 1]] - first[d] for d in range(j - i)], pa.list_(pa.int64())),
                        "_items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
                out = pa.RecordBatch.from_arrays([done[c] if c in done else part.column(c) for c in columns], names=columns)
                yield out.filter(pa.array(cut[1:] > cut[:-1])) if hits_only else out
    return run


def _pieces(window: int):
    """Items in pieces of at most about ``PIECE_BYTES``; neighbours share all but
    one word of a window, so every window lies whole in one of them."""
    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                raw = text.as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                start, end, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
                a = 0
                while a < len(start):
                    b = max(a + window, int(np.searchsorted(end, start[a] + PIECE_BYTES, side="right")))
                    out.append((item, int(a), raw[start[a]: end[min(b, len(end)) - 1]].decode()))
                    if b >= len(start):
                        break
                    a = b - (window - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.int64(), pa.string()))], names=["item", "piece", "text"])
    return run


class _Search:
    """The benchmark in blocks, each searched for in all documents."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, window: int):
        self.spark, self.window, self.ws = spark, window, Workspace(spark, "wu-manber")
        items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
            F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
        self.items = self.ws.save(items.mapInArrow(_pieces(window), "item string, piece long, text string"), "items")
        size = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = max(1, math.ceil(2 * size / BLOCK_BYTES))

    def patterns(self, k: int = 0):
        own = self.items.where(F.pmod(F.xxhash64("item", "piece"), F.lit(self.blocks)) == k).collect()
        return self.spark.sparkContext.broadcast(build([(r["item"], r["text"]) for r in own], self.window))

    def by_text(self, docs: DataFrame) -> DataFrame:
        """(key: md5 of the text, _hits, _items) of texts with hits."""
        text = docs["text"].cast("string")
        keyed = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text")).where("text IS NOT NULL")
        parts = []
        for k in range(self.blocks):
            table = self.patterns(k)
            found = keyed.mapInArrow(_scanner(table, ["key", "_hits", "_items"], True), "key binary, _hits array<long>, _items array<string>")
            parts.append(self.ws.save(found.groupBy("key").agg(F.first("_hits").alias("_hits"), F.first("_items").alias("_items")), f"hits-{k}"))
            table.unpersist()
        every = functools.reduce(DataFrame.union, parts)
        # at most one row a block and text
        merged = every.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits")))).alias("_hits"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
        return self.ws.save(merged, "hits")


def _n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _key(docs: DataFrame) -> Column:
    return F.unhex(F.md5(docs["text"].cast("string").cast("binary")))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, hit_words (their numbers),
    item_ids (sorted as text) and contaminated (hit words are a twentieth)."""
    search = _Search(spark, benchmark, window)
    if search.blocks == 1:
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
            _scanner(search.patterns(), ["doc_id", "_words", "_hits", "_items"], False), f"doc_id {kind}, _words long, _hits array<long>, _items array<string>")
    else:
        hits = search.by_text(docs)
        found = docs.join(hits, _key(docs) == hits["key"], "left").select(
            docs["doc_id"], _n_words(docs["text"].cast("string")).alias("_words"), F.coalesce(hits["_hits"], F.array().cast("array<long>")).alias("_hits"),
            F.coalesce(hits["_items"], F.array().cast("array<string>")).alias("_items"))
    return search.ws.finish(found.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_hits").alias("hit_words"), F.col("_items").alias("item_ids"),
        _contaminated(F.size("_hits").cast("long"), F.col("_words")).alias("contaminated")))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    search = _Search(spark, benchmark, window)
    text = docs["text"].cast("string")
    if search.blocks > 1:
        hits = search.by_text(docs).select("key", F.size("_hits").cast("long").alias("n_hit"))
        # only texts with hits are counted again and met with the documents
        dirty = docs.join(hits, _key(docs) == hits["key"]).where(_contaminated(hits["n_hit"], _n_words(text))).select(hits["key"].alias("_dirty")).distinct()
        dirty = search.ws.save(dirty, "dirty")
        return docs.join(dirty, _key(docs) == dirty["_dirty"], "left_anti")
    patterns = search.patterns()

    @F.arrow_udf("boolean")
    def is_dirty(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = K.string_buffers(column)
            out = []
            for i, j in K.slices(offsets, 1 << 21):
                n_words, hit, first, _ = _scan_texts(patterns.value, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                n_hit = np.diff(np.searchsorted(hit, first))
                out.append((n_hit > 0) & (20 * n_hit >= n_words))
            yield pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(~is_dirty(text))


def digest(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(spark, docs, benchmark).select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM item, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS g(i) WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT m FROM windows
), places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM doc, lengths, unnest(generate_series(1, len(w) - m + 1)) AS g(i) WHERE len(w) >= m
), found AS (
  SELECT doc_id, places.m, i, item_id FROM places JOIN windows ON places.s = windows.s AND places.m = windows.m
), hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(generate_series(0, m - 1)) AS g(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
