"""Exact removal of long byte strings that occur more than once, by a sparse
suffix array that is range-partitioned at sampled splitters.

Let n be the length (400 bytes). A window is a string of n bytes that starts
somewhere in a text; every byte of a window that also starts anywhere else is
removed.

1. Anchors. The smallest k-gram hash of a window (k = 64; the leftmost of equal
   ones) is its anchor. It depends on the window's bytes alone, so equal
   windows have equal anchors at equal offsets. Windows of one anchor are
   consecutive; the bytes they span are the anchor's hull. There is about one
   anchor in 170 bytes, and only anchors are shuffled.
2. Equal hulls: if a hull occurs twice, all of its windows do. If an anchor's
   k-gram occurs in one hull only, which occurs once, none does.
3. The rest, hulls that share a k-gram but differ, are compared as suffixes:
   the text from the anchor on. Sampled splitters deal the suffixes to buckets
   by range; a bucket sorts its suffixes by multikey quicksort with characters
   of eight bytes. A neighbour in that order has the longest common prefix, so
   a window whose part from the anchor on is longer than that has no equal in
   the bucket; the others are compared by the hash of all their bytes.
4. Across boundaries: a suffix shares with any suffix of another bucket at most
   what it shares with its own bucket's splitters. Windows within that length
   are counted over all buckets by their hashes. Where splitters are equal (a
   passage that very many texts share), their suffixes are spread over all
   buckets between them.
5. The windows found are merged to runs for each text, which are cut out.

Texts are identified by their 64-bit hash, and n-byte strings by hashes of 64
bits. Repeated texts are the same at all of their places, so one copy's result
serves all.

Rows: a null text is empty; every input row gives one output row, whatever
its id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace

LENGTH, GRAM = 400, 64
#: Suffixes in a bucket, on average; most buckets; one anchor in ``SAMPLE`` is a
#: candidate splitter, and about ``CANDIDATES`` for each bucket reach the driver.
BUCKET_ROWS, BUCKETS, SAMPLE, CANDIDATES = 20_000, 50_000, 1024, 20
#: Windows of a text handled at once; places in a block fit in 20 bits.
BLOCK = 1 << 19

_PLACE = K.U64((1 << 20) - 1)
# a hull's first byte, number of windows and anchor offset, in one number
_SPAN_BITS, _OFFSET_BITS = 10, 10


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span:])


def anchors(data: np.ndarray, n: int, k: int, block: int = BLOCK):
    """(k-gram hash, hull hash, hull start, windows, anchor offset) of every
    anchor of one text, as arrays."""
    out = []
    for a in range(0, len(data) - n + 1, block):
        part = data[a: a + block + n - 1]
        s = K.prefix_sums(part, K.BYTE_CODES)
        inverse = K.powers(len(part))[1]
        gram = K.mix64((s[k:] - s[:-k]) * inverse[: len(s) - k])
        place = np.arange(len(gram), dtype=K.U64)
        low = _window_min((gram & ~_PLACE) | place, n - k + 1) & _PLACE
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        last = np.concatenate((first[1:], [len(low)])) - 1
        at = low[first].astype(np.int64)
        end = last + n
        hull = (s[end] - s[first]) * inverse[first]
        offset, windows = at - first, last - first + 1
        hull = K.mix64(hull + K.mix64((offset * (n + 1) + windows).astype(K.U64)))
        out.append((gram[at], hull, first + a, windows, offset))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, K.U64)] * 2 + [np.empty(0, np.int64)] * 3


_ANCHOR = "gram long, hull long, text_key binary, place long, lead binary"


def _anchor_rows(n: int, k: int, sample: int, block: int):
    def run(batches):
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            rows, leads = [], []
            for d in np.flatnonzero(np.diff(offsets) >= n):
                own = data[offsets[d]: offsets[d + 1]]
                gram, hull, first, windows, offset = anchors(own, n, k, block)
                rows.append((gram, hull, np.full(len(gram), d), (first << (_SPAN_BITS + _OFFSET_BITS)) | (windows << _OFFSET_BITS) | offset))
                lead = np.full(len(gram), None, dtype=object)
                for i in np.flatnonzero((K.mix64(hull) & K.U64(sample - 1)) == 0):
                    lead[i] = own[first[i] + offset[i]: first[i] + windows[i] - 1 + n].tobytes()
                leads.append(lead)
            if rows:
                gram, hull, text, place = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(K.as_long(gram)), pa.array(K.as_long(hull)), batch.column("text_key").take(pa.array(text)),
                                                  pa.array(K.as_long(place)), pa.array(np.concatenate(leads), pa.binary())],
                                                 names=["gram", "hull", "text_key", "place", "lead"])
    return run


def _unpack(place):
    return place >> (_SPAN_BITS + _OFFSET_BITS), (place >> _OFFSET_BITS) & ((1 << _SPAN_BITS) - 1), place & ((1 << _OFFSET_BITS) - 1)


def _deal(n: int, splitters: list[bytes]):
    """Cut the wanted hulls out of their texts and deal each to the bucket of
    its suffix; equal splitters share their suffixes."""
    def run(batches):
        cuts = splitters
        import bisect
        for batch in batches:
            text, spots, keys = batch.column("text"), batch.column("spots"), batch.column("text_key").to_pylist()
            out = [[], [], [], [], []]
            for d in range(batch.num_rows):
                raw = text[d].as_buffer().to_pybytes()
                for spot in spots[d].as_py():
                    first, windows, offset = _unpack(spot["place"])
                    hull = raw[first: first + windows - 1 + n]
                    suffix = hull[offset:]
                    lo, hi = bisect.bisect_left(cuts, suffix), bisect.bisect_right(cuts, suffix)
                    bucket = lo if lo == hi else lo + (spot["hull"] % (hi - lo + 1))
                    for c, x in zip(out, (bucket, keys[d], spot["place"], spot["once"], hull)):
                        c.append(x)
                    if len(out[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _DEALT_TYPES)], names=_DEALT_NAMES)
                        out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _DEALT_TYPES)], names=_DEALT_NAMES)
    return run


_DEALT = "bucket int, text_key binary, place long, once boolean, hull binary"
_DEALT_NAMES = ["bucket", "text_key", "place", "once", "hull"]
_DEALT_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]


def multikey_sort(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian 8-byte characters, and the common prefix
    (bytes) of each row with the one before it. All segments of equal prefix
    are sorted by their next character together; rows that stand alone leave."""
    n, depth = words.shape
    order, common = np.arange(n), np.zeros(n, np.int64)
    at = np.arange(n)                      # places still in segments of several rows
    segment = np.zeros(n, np.int64)
    for d in range(depth):
        if len(at) < 2:
            break
        rows = order[at]
        char = words[rows, d]
        sort = np.lexsort((char, segment))
        rows, char = rows[sort], char[sort]  # segments keep their places
        order[at] = rows
        same_segment = np.concatenate(([False], segment[1:] == segment[:-1]))
        differ = np.concatenate(([K.U64(1)], char[1:] ^ char[:-1]))
        new = ~same_segment | (differ != 0)
        cut = same_segment & (differ != 0)
        high = np.frexp((differ[cut] >> K.U64(11)).astype(np.float64))[1] + 11  # bits of the highest difference, to the byte
        small = differ[cut] < K.U64(1 << 53)
        high[small] = np.frexp(differ[cut][small].astype(np.float64))[1]
        common[at[cut]] = 8 * d + (64 - high) // 8
        number = np.cumsum(new)
        alone = np.bincount(number, minlength=number[-1] + 1)[number] == 1
        common[at[same_segment & (differ == 0)]] = 8 * (d + 1)
        at, segment = at[~alone], number[~alone]
    shorter = np.minimum(lengths[order], np.concatenate(([0], lengths[order][:-1]))) if n else lengths
    return order, np.minimum(common, shorter)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def compare_bucket(hulls: list[bytes], places: np.ndarray, n: int, k: int, low: bytes | None, high: bytes | None):
    """Of one bucket's distinct hulls: for every window its row, its number in
    the hull and its hash, with whether it has an equal in the bucket and
    whether it could have one in another bucket. Windows that can't have an
    equal anywhere are left out."""
    _, windows, offset = _unpack(places)
    size = np.array([len(h) for h in hulls], np.int64)
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(hulls) + bytes(n + 8), np.uint8)
    depth = -(-n // 8)
    start, length = first + offset, size - offset
    words = np.empty((len(hulls), depth), K.U64)
    step = np.arange(depth * 8)
    for a in range(0, len(hulls), 2048):
        part = slice(a, a + 2048)
        chars = np.where(step < length[part, None], data[np.minimum(start[part, None] + step, len(data) - 1)], 0).astype(np.uint8)
        words[part] = chars.reshape(-1, depth, 8).view(">u8")[:, :, 0]
    order, common = multikey_sort(words, length)
    del words
    longest = np.zeros(len(hulls), np.int64)
    longest[order] = np.maximum(common, np.concatenate((common[1:], [0])))
    across = np.zeros(len(hulls), np.int64)
    for bound in (low, high):
        if bound is not None:
            near = np.fromiter((_common(hulls[i][offset[i]:], bound) for i in range(len(hulls))), np.int64, len(hulls))
            across = np.maximum(across, near)
    reach = np.maximum(longest, across)
    # window j of a hull starts j bytes into it and needs n - (offset - j) bytes from the anchor on
    some = np.clip(reach - (n - offset) + 1, 0, windows)
    row = np.repeat(np.arange(len(hulls)), some)
    j = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
    need = n - offset[row] + j
    code = np.empty(len(row), K.U64)
    edge = np.searchsorted(row, np.arange(0, len(hulls) + 1024, 1024))
    for lo, hi in zip(edge[:-1], edge[1:]):  # the windows of some hulls together
        if lo < hi:
            a, b = first[row[lo]], first[row[hi - 1]] + size[row[hi - 1]]
            s = K.prefix_sums(data[a:b], K.BYTE_CODES)
            w = first[row[lo:hi]] - a + j[lo:hi]
            code[lo:hi] = (s[w + n] - s[w]) * K.powers(b - a)[1][w]
    code = K.mix64(code + K.mix64((offset[row] - j).astype(K.U64)))
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    return row, j, code, times[back] > 1, need <= across[row]


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching spans of a row, merged; sorted by row, start."""
    if not len(row):
        return row, start, end
    wall = np.maximum.accumulate(end + row * (1 << 40))
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] + row[1:] * (1 << 40) > wall[:-1])))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(row)])) - 1
    return row[at], start[at], wall[last] - row[at] * (1 << 40)


_FOUND = "text_key binary, lo long, hi long, window long"


def _compare(n: int, k: int, splitters: list[bytes]):
    """Spans that have an equal in the bucket, with a null window; and windows
    that might have one in another bucket, with their hash."""
    def work(table: pa.Table, bucket: int):
        hulls = table.column("hull").to_pylist()
        places = table.column("place").to_numpy()
        keys = table.column("text_key").combine_chunks()
        low = splitters[bucket - 1] if bucket else None
        high = splitters[bucket] if bucket < len(splitters) else None
        row, j, code, here, across = compare_bucket(hulls, places, n, k, low, high)
        once = table.column("once").to_numpy(zero_copy_only=False)[row]
        start = _unpack(places)[0][row] + j
        own = here & once
        r, lo, hi = _runs(row[own], start[own], start[own] + n)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), pa.array(lo), pa.array(hi), pa.nulls(len(r), pa.int64())], names=["text_key", "lo", "hi", "window"])
        # a window whose equals are all here is settled, but stands for them elsewhere
        out = np.flatnonzero(across)
        for i in range(0, len(out), 100_000):
            o = out[i: i + 100_000]
            settled = here[o] | ~once[o]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row[o], mask=settled)), pa.array(start[o], mask=settled), pa.array(start[o] + n), pa.array(K.as_long(code[o]))],
                names=["text_key", "lo", "hi", "window"])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            column = batch.column("bucket").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)])) if len(column) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if held and column[a] != bucket:
                    yield from work(pa.Table.from_batches(held), bucket)
                    held = []
                bucket = int(column[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held), bucket)
    return run


def _cut(batches):
    for batch in batches:
        out, text = [], batch.column("text")
        for d, spans in enumerate(batch.column("spans").to_pylist()):
            raw = text[d].as_buffer().to_pybytes()
            lo, hi = np.array([(s["lo"], s["hi"]) for s in sorted(spans, key=lambda s: (s["lo"], s["hi"]))], np.int64).T
            _, lo, hi = _runs(np.zeros(len(lo), np.int64), lo, hi)
            kept, last, spans = [], 0, []
            for a, b in zip(lo.tolist(), hi.tolist()):
                kept.append(raw[last:a])
                spans.append({"lo": a, "hi": b})
                last = b
            kept = b"".join([*kept, raw[last:]])
            out.append((int((hi - lo).sum()), hashlib.sha256(kept).hexdigest(), spans))
        removed, sha, spans = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                                          pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                                         names=["text_key", "n_removed", "kept_sha256", "spans"])


def _at_equal_ranks(ws: Workspace, sample: DataFrame, parts: int) -> list[bytes]:
    """``parts - 1`` values at equal ranks of ``lead``, of all that there are. The
    sample is sorted by Spark, range by range; only the ranges' sizes and the
    chosen values reach the driver."""
    place = F.monotonically_increasing_id()
    ranked = ws.save(sample.repartitionByRange("lead").sortWithinPartitions("lead")
                     .select("lead", F.shiftright(place, 33).alias("range"), place.bitwiseAND((1 << 33) - 1).alias("nth")), "ranked")
    first, total = {}, 0
    for r in sorted(ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["range"]):
        first[r["range"]], total = total, total + r["n"]
    if not total:
        return []
    spark = sample.sparkSession
    offsets = spark.createDataFrame(list(first.items()), "range long, first long")
    wanted = spark.range(1, parts).select((F.col("id") * total / parts).cast("long").alias("rank"), "id")
    chosen = (ranked.join(offsets, "range").select("lead", (F.col("nth") + F.col("first")).alias("rank"))
              .join(wanted, "rank").orderBy("id").select("lead").collect())
    return [bytes(r["lead"]) for r in chosen]


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (the maximal
    removed runs, array of lo and hi) and kept_sha256."""
    if not gram < length < 1 << _OFFSET_BITS:
        raise ValueError(f"length must be over {gram} and under {1 << _OFFSET_BITS}")
    ws = Workspace(spark, "suffix-dedup")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    docs = docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    texts = docs.where(F.col("n_bytes") >= length).groupBy("text_key").agg(F.first("text").alias("text"))

    found = ws.save(docs.select("text_key", "text").mapInArrow(_anchor_rows(length, gram, SAMPLE, BLOCK), _ANCHOR), "anchors")
    hulls = ws.save(found.groupBy("gram", "hull").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "place")).alias("at")), "hulls")
    open_grams = hulls.groupBy("gram").agg(F.count(F.lit(1)).alias("hulls"), F.min("n").alias("least")).where("hulls > 1 AND least = 1").select("gram")
    rest = ws.save(hulls.join(open_grams, "gram"), "rest")

    # splitters: the sampled suffixes of the hulls to be compared, at equal ranks
    n_rest = rest.count()
    buckets = min(BUCKETS, max(1, -(-n_rest // BUCKET_ROWS)))
    share = min(1.0, CANDIDATES * buckets * SAMPLE / max(1, n_rest))
    splitters: list[bytes] = []
    if buckets > 1:
        sample = found.where(F.col("lead").isNotNull() & (F.pmod(F.xxhash64("hull"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)))
        sample = sample.groupBy("gram", "hull").agg(F.first("lead").alias("lead")).join(rest, ["gram", "hull"], "left_semi")
        splitters = _at_equal_ranks(ws, sample.select("lead"), buckets)

    spots = rest.select("at.text_key", F.struct("at.place", "hull", (F.col("n") == 1).alias("once")).alias("spot")).groupBy("text_key").agg(
        F.collect_list("spot").alias("spots"))
    dealt = texts.join(spots, "text_key").select("text_key", "text", "spots").mapInArrow(_deal(length, splitters), _DEALT)
    parts = max(len(splitters) + 1, 1)
    compared = ws.save(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(length, gram, splitters), _FOUND), "compared")
    windows = compared.where(F.col("window").isNotNull())
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    across = windows.where(F.col("text_key").isNotNull()).join(again, "window").select("text_key", "lo", "hi")

    bits = _SPAN_BITS + _OFFSET_BITS
    start = F.shiftright("place", bits)
    many = F.shiftright("place", _OFFSET_BITS).bitwiseAND((1 << _SPAN_BITS) - 1)
    whole = (found.select("gram", "hull", "text_key", "place").join(hulls.where("n > 1").select("gram", "hull"), ["gram", "hull"])
             .select("text_key", start.alias("lo"), (start + many + (length - 1)).alias("hi")))
    covered = whole.union(compared.where(F.col("window").isNull()).select("text_key", "lo", "hi")).union(across)
    spans = covered.groupBy("text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = ws.save(texts.join(spans, "text_key").select("text_key", "text", "spans").mapInArrow(
        _cut, "text_key binary, n_removed long, kept_sha256 string, spans array<struct<lo:long,hi:long>>"), "cut")
    each = docs.select("doc_id", "text_key", "n_bytes", F.sha2("text", 256).alias("whole"))
    out = each.join(cut, "text_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<lo:long,hi:long>>")).alias("spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
    return ws.finish(out)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return repeated_spans(spark, docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
