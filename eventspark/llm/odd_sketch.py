"""Near-duplicate documents by MinHash bands and odd sketches.

1. Every text becomes a set of word shingles (64-bit hashes). Equal sets are
   one node; all further work is on distinct sets.
2. ``BANDS`` x ``ROWS`` MinHash samples give band keys. The same samples,
   hashed with their index into a bitmap where each one flips a bit, form the
   odd sketch: the population count of the XOR of two sketches estimates how
   many samples differ, and so the similarity, most precisely when it is high.
3. In a bucket (equal band key) every node is paired with one centre, the node
   that shares buckets with most others. A pair goes on if sizes and sketches
   allow the threshold; the full sets then decide.
4. Where a bucket's nodes still lie in several components, pairs from different
   components are compared as well, so that a link is never lost to the choice
   of a centre. These pairs come from an exact prefix filter over the shingles
   of the nodes concerned (``_prefix_pairs``). Nodes of one component are not
   compared with each other, so a group of n copies costs n pairs, not n*n.

A pair with similarity s meets in some bucket with probability
1 - (1 - s**ROWS)**BANDS: 0.99999998 at s = 0.85, 0.9999996 at 0.8. The sketch turns a
pair away only if its estimate is ``MARGIN`` below the threshold, over five
standard deviations.

Rows: a null or wordless text has an empty set and links with nothing. A row
with a null id has a null component and is kept. Rows that repeat an id are
each returned. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, text_docs
from eventspark.llm.components import components

BANDS, ROWS = 28, 4
SKETCH_BITS = 512
MARGIN = 0.25
#: Rounds of one centre a bucket before the remaining pairs are compared.
CENTRE_ROUNDS = 1

_SAMPLES = BANDS * ROWS
_MULTIPLIERS = K.mix64(np.arange(1, _SAMPLES + 1, dtype=K.U64)) | K.U64(1)
_ROW_CODES = K.mix64(np.arange(1000, 1000 + _SAMPLES, dtype=K.U64)) | K.U64(1)
_FEATURES = "doc_id long, text_key binary, node binary, n_shingles long, bands array<long>, sketch array<long>"


def shingle_codes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of every text, with repeats, and n+1 offsets. A text
    of fewer words has one: all of its words."""
    start, end, text = K.words(data, offsets, K.NON_SPACE)
    code = K.span_codes(data, start, end, K.FOLDED_CODES)
    n = len(offsets) - 1
    n_words = np.bincount(text, minlength=n)
    first = np.concatenate(([0], np.cumsum(n_words)))
    rolled = np.zeros(max(0, len(code) - size + 1), dtype=K.U64)
    for i in range(size):
        rolled += K.mix64(code[i: len(code) - size + 1 + i] + K.U64(i * 0x51ED2705))
    full = text[: len(rolled)] == text[size - 1:] if len(rolled) else np.empty(0, bool)
    out_n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(out_n)))
    out = np.empty(out_first[-1], dtype=K.U64)
    long_text = np.repeat(n_words >= size, out_n)
    out[long_text] = K.mix64(rolled[full])
    for d in np.flatnonzero((n_words > 0) & (n_words < size)):
        few = code[first[d]: first[d + 1]]
        whole = K.U64(0x6C62272E07BB0142) + K.U64(len(few))
        for c in few:
            whole = K.mix64(np.array([whole ^ c]))[0]
        out[out_first[d]] = whole
    return out, out_first


def sample(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of one set."""
    low = np.full(_SAMPLES, np.iinfo(np.uint64).max, dtype=K.U64)
    for i in range(0, len(shingles), 2048):
        part = np.multiply.outer(shingles[i: i + 2048], _MULTIPLIERS)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    at = (K.mix64(samples + _ROW_CODES) % K.U64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _features(size: int):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            data, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.slices(offsets, 1 << 21):
                code, first = shingle_codes(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], size)
                nodes, counts, bands, sketches = [], [], [], []
                for d in range(j - i):
                    own = np.unique(code[first[d]: first[d + 1]])
                    counts.append(len(own))
                    if not len(own):
                        nodes.append(None), bands.append(None), sketches.append(None)
                        continue
                    check = K.mix64(own + K.U64(0x2545F4914F6CDD1D))
                    nodes.append(np.array([check.sum(), np.bitwise_xor.reduce(K.mix64(check)) + K.U64(len(own))],
                                          dtype=">u8").tobytes())
                    low = sample(own)
                    keyed = (low * _ROW_CODES).reshape(BANDS, ROWS).sum(axis=1)
                    bands.append(K.as_long(K.mix64(keyed + _ROW_CODES[:BANDS])))
                    sketches.append(odd_sketch(low))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), keys.slice(i, j - i), pa.array(nodes, pa.binary()),
                     pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(sketches, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "node", "n_shingles", "bands", "sketch"])
    return run


def _shingles(size: int):
    """The distinct shingles of (node, text), one a row."""
    def run(batches):
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.slices(offsets, 1 << 20):
                code, first = shingle_codes(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], size)
                sets = [np.unique(code[a:b]) for a, b in zip(first[:-1], first[1:])]
                node = batch.column("node").slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), [len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([node, pa.array(K.as_long(np.concatenate(sets)))], names=["node", "shingle"])
    return run


def _set_of(text: bytes | str | None, size: int) -> np.ndarray:
    raw = (text or "").encode() if not isinstance(text, bytes) else text
    code, _ = shingle_codes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), size)
    return np.unique(code)


def _overlaps(size: int):
    """Intersection and union sizes of (a, text_a, b, text_b); rows come
    sorted by b, whose set is kept from row to row."""
    def run(batches):
        last, centre = None, None
        for batch in batches:
            out = []
            b, text_a, text_b = batch.column("b"), batch.column("text_a"), batch.column("text_b")
            for i in range(batch.num_rows):
                if b[i].as_py() != last:
                    last, centre = b[i].as_py(), _set_of(text_b[i].as_py(), size)
                own = _set_of(text_a[i].as_py(), size)
                both = len(np.intersect1d(own, centre, assume_unique=True))
                out.append((both, len(own) + len(centre) - both))
            got = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("a"), b, pa.array(got[:, 0]), pa.array(got[:, 1])],
                                             names=["a", "b", "n_both", "n_any"])
    return run


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those that sizes and sketches let through, with the
    exact overlap of their sets."""
    def side(s):
        return nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n_shingles", "sketch")])

    low, high = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # expected XOR bits of a pair at the least similarity that is let through
    least = num / den - MARGIN
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * _SAMPLES * (1 - least)))
    likely = (pairs.join(side("a"), "a").join(side("b"), "b")
              .where((low * den >= high * num) & (differ <= bits))
              .select("a", "b", "rep_a", "rep_b"))
    t = texts.select(F.struct("doc_id", "text_key").alias("rep"), "text")
    rows = (likely.join(t.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
            .join(t.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")
            .select("a", "text_a", "b", "text_b"))
    return rows.mapInArrow(_overlaps(size), "a binary, b binary, n_both long, n_any long")


def _prefix_pairs(ws: Workspace, open_nodes: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """All pairs of nodes of different components that can reach the threshold.

    Every set is put in one order, rarest shingles first. If the first common
    shingle of a pair stands at places p and q (from 0), the overlap is at
    most min(n_a - p, n_b - q), and num / den needs an overlap of
    num * (n_a + n_b) / (num + den). So a pair is made only at a shingle that
    stands early enough in both; shingles that one edited copy has alone push
    all others back.
    """
    sets = (open_nodes.join(nodes, "node").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"))
            .join(texts, ["doc_id", "text_key"]).select("node", "text"))
    ids = open_nodes.join(nodes.select("node", F.col("n_shingles").alias("n")), "node").withColumn("id", F.xxhash64("node"))
    each = ws.save(sets.mapInArrow(_shingles(size), "node binary, shingle long").select(F.xxhash64("node").alias("id"), "shingle"), "shingles")
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "shingle").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("often", "shingle")) - 1)
    early = (ranked.where("often > 1").join(ids.select("id", "n", "comp"), "id")
             .where((F.col("n") - F.col("place")) * den >= F.col("n") * num).select("shingle", "id", "n", "place", "comp"))
    early = ws.save(early, "early")
    ws.drop("shingles")
    # the smallest set at a shingle says how early any pair there must be
    least = early.groupBy("shingle").agg(F.min("n").alias("least"))
    early = early.join(least, "shingle").where((F.col("n") - F.col("place")) * (num + den) >= (F.col("n") + F.col("least")) * num)
    apart = early.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("shingle")
    early = ws.save(early.join(apart, "shingle"), "at-shingles")
    ws.drop("early")

    def side(s):
        return early.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place", "comp")])

    need = (F.col("n_a") + F.col("n_b")) * num
    near = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (num + den) >= need
    met = (side("a").join(side("b"), "shingle").where((F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b")) & near)
           .select("id_a", "id_b").distinct())
    return (met.join(ids.select(F.col("id").alias("id_a"), F.col("node").alias("a")), "id_a")
            .join(ids.select(F.col("id").alias("id_b"), F.col("node").alias("b")), "id_b").select("a", "b"))


def _groups(spark: SparkSession, docs: DataFrame, shingle_words: int, threshold: tuple[int, int], id_col: str, text_col: str) -> tuple[Workspace, DataFrame]:
    """(doc_id, text_key, n_shingles, low: the smallest (doc_id, text_key) of
    the row's group, null without a group) for every row."""
    ws = Workspace(spark, "odd-sketch")
    num, den = threshold
    docs = text_docs(docs, id_col, text_col).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    feats = ws.save(docs.select("doc_id", F.coalesce("text_key", F.lit(b"")).alias("text_key"), "text")
                    .mapInArrow(_features(shingle_words), _FEATURES), "features")
    nodes = ws.save(feats.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    texts = docs.where(F.col("text").isNotNull()).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))

    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = ws.save(entries.join(shared, "bucket"), "shared")
    known = shared.groupBy("node").agg(F.sum("n").alias("n_met"))
    shared = ws.save(shared.drop("n").join(known, "node"), "buckets")
    ws.drop("shared")

    def against_centres(members: DataFrame, order) -> DataFrame:
        centre = members.groupBy("bucket").agg(F.max(F.struct(order.alias("o"), "node", "comp")).alias("c"))
        return (members.join(centre, "bucket").where(F.col("comp") != F.col("c.comp"))
                .select(F.col("node").alias("a"), F.col("c.node").alias("b")))

    def spread(comp: DataFrame, name: str) -> DataFrame:
        """The members of buckets whose nodes lie in several components."""
        members = shared.join(comp.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
        return ws.save(members.join(apart, "bucket"), name)

    def check(pairs: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
        pairs = ws.save(pairs, f"pairs-{step}")
        found = ws.save(_verify(pairs, nodes, texts, shingle_words, num, den), f"found-{step}")
        return pairs, found.where(F.col("n_both") * den >= F.col("n_any") * num).select("a", "b")

    members = shared.withColumn("comp", F.col("node"))
    checked = links = comp = None
    for step in range(CENTRE_ROUNDS):
        order = F.col("n_met") if step == 0 else F.xxhash64(F.lit(step), "node")
        pairs = against_centres(members, order).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs, found = check(pairs, step)
        checked = pairs if checked is None else checked.union(pairs)
        links = found if links is None else links.union(found)
        comp = ws.save(components(links, ws, f"cc-{step}"), f"components-{step}")
        members = spread(comp, f"members-{step}")
        if members.isEmpty():
            break
    else:
        pairs = _prefix_pairs(ws, members.select("node", "comp").distinct(), nodes, texts, shingle_words, num, den)
        done = checked.union(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        _, found = check(pairs.join(done, ["a", "b"], "left_anti"), CENTRE_ROUNDS)
        comp = ws.save(components(links.union(found), ws, "cc"), "components")

    # the smallest id of each component, over all rows
    keyed = feats.select("doc_id", "text_key", "n_shingles", "node").join(comp, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    # written, so that the join below can split a large component
    low = ws.save(keyed.where(F.col("component").isNotNull() & F.col("doc_id").isNotNull()).groupBy("component").agg(
        F.min(F.struct("doc_id", "text_key")).alias("low")), "low")
    return ws, keyed.join(low, "component", "left")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle_words: int = 5, threshold: tuple[int, int] = (80, 100),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id
    reachable over links of Jaccard similarity >= threshold), kept."""
    ws, found = _groups(spark, docs, shingle_words, threshold, id_col, text_col)
    out = (found.select("doc_id", "n_shingles",
                        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("low.doc_id", "doc_id")).alias("component_id"))
           .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    return ws.finish(out)


def keep_one(spark: SparkSession, docs: DataFrame, shingle_words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` that a near-duplicate filter keeps: of each group of
    texts the one with the smallest (id, md5 of the text). Decisions are by id
    and text, so a row goes only if its own text's group keeps another one; of
    rows that repeat both, the one with the smallest plain values stays. Rows
    without an id, and texts without words, all stay."""
    ws, found = _groups(spark, docs, shingle_words, threshold, "doc_id", "text")
    own = F.struct("doc_id", "text_key")
    marked = ws.save(found.where(F.col("low").isNotNull()).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
                     .agg(F.first(own != F.col("low")).alias("_gone"), F.count(F.lit(1)).alias("_n")).where("_gone OR _n > 1"), "marked")

    def met(keys: DataFrame, how: str) -> DataFrame:
        # equal texts are found by their md5; only the keys of marked rows are shuffled against the documents
        return docs.join(keys, (docs["doc_id"].cast("long") == keys["_id"]) & (F.unhex(F.md5(docs["text"].cast("string").cast("binary"))) == keys["_key"]), how)

    kept = met(marked, "left_anti")
    twice = marked.where("NOT _gone").select("_id", "_key")
    if twice.isEmpty():
        return kept
    plain = [docs[f.name] for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    rows = met(twice, "inner").groupBy(twice["_id"], twice["_key"]).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.struct(*plain)).alias("row"))
    return kept.unionByName(rows.select("row.*"))
