"""Secret scans through an incremental ledger of blobs, in DataFrame
operations only.

Every version of every text is addressed by the SHA-256 of its bytes. The
ledger holds which (blob, rule version) pairs were scanned and what was found;
a scan reads only the pairs it hasn't seen, each distinct blob once, and joins
the findings back to all documents (paths) that hold the blob.

A rule's matches are leftmost and do not overlap. Their places follow from the
text's pieces: the gaps that a split by the rule's pattern leaves, and the
matches, alternate, so a running sum of both lengths (code points) gives every
start in linear time.

Rows: a null text is the empty blob. Repeated rows and ids, and null ids, each
keep their row; they share the findings of their blob. Extra columns are
ignored. Findings are written before their pairs are marked as scanned, and
read without repeats, so a scan that was broken off is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.llm.common import Workspace


@dataclass(frozen=True)
class Rule:
    """``group``: the part of a match whose length must be at least ``least``."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # maximal runs, so shorter ones need not be listed first
)

_PAIR = "blob string, kind string, rule_version int"
_FINDING = f"{_PAIR}, start long, end long"


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, text): every document with the address of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def _sizes_of(rule: Rule):
    return lambda x: F.struct(
        F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["hit"]).cast("long").alias("hit"),
        (F.char_length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) >= rule.least).alias("good"))


def find(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, wanted) -> the findings of the wanted rules (an array of
    kinds) in each blob."""
    found = []
    for rule in rules:
        hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        gaps = F.split("text", rule.pattern, -1)
        wanted = F.array_contains("wanted", rule.kind) & F.col("text").rlike(rule.pattern)
        sizes = F.transform(
            F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
            _sizes_of(rule))
        found.append(F.when(wanted, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("rule_version"), sizes.alias("sizes"))))
    one = blobs.select("blob", F.explode(F.array(*found)).alias("f")).where(F.col("f").isNotNull())
    each = one.select("blob", "f.kind", "f.rule_version", F.posexplode("f.sizes").alias("i", "x")).where(F.col("x.hit").isNotNull())
    so_far = W.partitionBy("blob", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("x.gap") + F.col("x.hit")).over(so_far)
    return each.select("blob", "kind", "rule_version", (end - F.col("x.hit")).alias("start"), end.alias("end"), "x.good").where("good").drop("good")


def scan(spark: SparkSession, docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger (a folder that all executors share) up to date with
    ``docs`` and return (doc_id, blob, kind, start, end): the findings of the
    given rules in every document."""
    conf = spark._jsc.hadoopConfiguration()
    folder = spark._jvm.org.apache.hadoop.fs.Path

    def table(name: str, schema: str) -> DataFrame | None:
        path = folder(f"{ledger}/{name}")
        return spark.read.schema(schema).parquet(f"{ledger}/{name}") if path.getFileSystem(conf).exists(path) else None

    v = versions(docs)
    blobs = v.groupBy("blob").agg(F.first("text").alias("text"))
    now = F.array(*[F.lit(r.kind) for r in rules])
    scanned = table("scanned", _PAIR)
    if scanned is None:
        blobs = blobs.withColumn("wanted", now)
    else:
        current = F.lit(False)
        for r in rules:
            current = current | ((F.col("kind") == r.kind) & (F.col("rule_version") == r.version))
        seen = scanned.where(current).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        blobs = (blobs.join(seen, "blob", "left").withColumn("wanted", F.array_except(now, F.coalesce("seen", F.array().cast("array<string>"))))
                 .where(F.size("wanted") > 0).drop("seen"))
    # what is unseen is fixed before the ledger grows
    ws = Workspace(spark, "secret-scan")
    pairs = ws.save(blobs.select("blob", F.explode("wanted").alias("kind")), "pairs") if scanned is not None else None
    find(blobs, rules).write.mode("append").parquet(f"{ledger}/findings")
    if pairs is None:
        pairs = v.select("blob").distinct().withColumn("kind", F.explode(now))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    pairs.select("blob", "kind", version[F.col("kind")].alias("rule_version")).write.mode("append").parquet(f"{ledger}/scanned")
    ws.drop("pairs")
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("rule_version") == r.version))
    findings = table("findings", _FINDING).where(current).select("blob", "kind", "start", "end").distinct()
    return v.drop("text").join(findings, "blob", "left")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document the counts, the digest and the list of all spans."""
    ws = Workspace(spark, "secret-ledger")
    ledger = ws.path("ledger")
    scan(spark, docs, ledger)
    findings = spark.read.schema(_FINDING).parquet(f"{ledger}/findings").select("blob", "kind", "start", "end").distinct()
    rank = F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(i))])
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in RULES]
    span = F.struct("start", rank[F.col("kind")].alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    # one blob's findings are bounded by its length
    per_blob = findings.groupBy("blob").agg(*counts, F.array_join(F.transform(F.sort_array(F.collect_list(span)), lambda x: x["span"]), ",").alias("spans"))
    out = versions(docs).drop("text").join(per_blob, "blob", "left").fillna(0, [f"n_{r.kind}" for r in RULES]).fillna("", ["spans"])
    return out.select("doc_id", *[f"n_{r.kind}" for r in RULES], F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), piece AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS hits, regexp_extract_all(text, p, 2) AS parts, 6 AS least
  FROM doc, (SELECT '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p)
  UNION ALL
  SELECT doc_id, 1, 'access', string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS h, h, 20 FROM doc
  UNION ALL
  SELECT doc_id, 2, 'hex', string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') AS h, h, 24 FROM doc
), each AS (
  SELECT doc_id, rank, kind, i, gaps[i] AS gap, hits[i] AS hit, len(parts[i]) >= least AS good FROM piece, unnest(generate_series(1, len(hits))) AS g(i)
), placed AS (
  SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM each
), spans AS (
  SELECT doc_id, kind, rank, e - len(hit) AS s, kind || ':' || (e - len(hit))::BIGINT || ':' || e::BIGINT AS span FROM placed WHERE good
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN per USING (doc_id)
"""
