"""Quality rules whose cutoffs carry a proven bound on false rejection.

Every text is counted once (words, marks, repeated lines and windows, ...). A
rule compares one ratio of counts with a cutoff from a fixed grid. Which cutoffs
are in force is decided per stratum (by default the ``lang`` column; null is a
stratum of its own) from labelled documents that pass the base rules:

1. One half of the labelled documents (by crc32 of the id) proposes. For each
   rung of ``RUNGS``, a share of good documents that may be lost, every rule
   takes the cutoff that rejects most bad documents within its part of the
   rung, the mildest of equals. A rung is thus one joint set of cutoffs.
2. The other half, the holdout, tests. With k of n good holdout documents
   rejected by a rung's rules together, the exact binomial tail P(X <= k | n, RISK)
   is the p-value of "this rung rejects RISK of good documents or more".
3. Rungs are tested in order, mildest first, up to the first that fails (a fixed
   sequence needs no further correction), each at DELTA divided by the number of
   strata (Bonferroni). The last rung that passed gives the cutoffs.

So with probability 1 - DELTA at least, over all strata together, no stratum
loses RISK or more of its good documents to the rules, whatever the proposing
half looked like (if labelled documents are drawn independently). A stratum
without enough labelled documents has no proof, and so no rule beyond the base.
All labelled documents are used; tables of cutoffs have a row a stratum, rule
and rung and stay in Spark.

Rows: a null or empty text has no words and fails the base rules. Each input
row gives one output row, repeated ids too; a null id matches no label.
Labels without an id or a value are ignored; of repeated labels the lowest
counts. Without labels, or a stratum column, only the base rules apply to all or
all documents are one stratum. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventspark.llm import kernels as K
from eventspark.llm.common import Workspace, fold_of
from eventspark.llm.diagonal_runs import coded_words

#: Base rules: fewest words, and the largest share (in 1/100) of words in repeated windows of five.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Good documents lost, at most, and the chance of being wrong about it in any stratum.
RISK, DELTA = 0.02, 0.05
#: Shares of good documents that the proposing half may lose, mildest first.
RUNGS = (0.0, 0.001, 0.002, 0.005, 0.01)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_digits", "n_marks", "n_distinct_words")

#: name: (count, count that it is divided by, cutoffs in 1/1000 from strict to mild). A
#: rule with rising cutoffs rejects what is above them, one with falling cutoffs what is below.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words", tuple(range(20, 2000, 20))),
    "marks_per_word": ("n_marks", "n_words", tuple(range(100, 4000, 50))),
    "long_words": ("word_chars", "n_words", tuple(range(4500, 12000, 100))),
    "short_words": ("word_chars", "n_words", tuple(range(4500, 1500, -100))),
    "repeated_lines": ("n_dup_lines", "n_lines", tuple(range(20, 1000, 20))),
    "repeated_words": ("n_repeat_words", "n_words", tuple(range(5, 200, 5))),
    "capitals": ("n_capitals", "word_chars", tuple(range(20, 1000, 10))),
    "digits": ("n_digits", "word_chars", tuple(range(10, 1000, 10))),
    "few_distinct_words": ("n_distinct_words", "n_words", tuple(range(700, 20, -10))),
}

_SYMBOL, _DIGIT, _CAPITAL, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT[0x30:0x3A] = _CAPITAL[0x41:0x5B] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def _again(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which entries have the same code as an earlier one of their group."""
    order = np.lexsort((code, group))
    out = np.zeros(len(code), bool)
    out[order[1:]] = (code[order][1:] == code[order][:-1]) & (group[order][1:] == group[order][:-1])
    return out


def _repeat_words(ids: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Per text: words inside a window of ``size`` words found twice or more."""
    n = len(ids) - size + 1
    if n < 1:
        return np.zeros(n_texts, np.int64)
    # equal windows get equal numbers, of twice the length each time (exact: no hashes)
    code, length = ids, 1
    while length < size:
        step = min(length, size - length)
        count = len(code) - step
        code = np.unique(code[:count] * (code.max() + 1) + code[step: step + count], return_inverse=True)[1]
        length += step
    inside = np.flatnonzero(text[:n] == text[size - 1:])
    order = inside[np.lexsort((code[inside], text[inside]))]
    same = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    hit = np.concatenate((order[1:][same], order[:-1][same]))
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + size, -1)
    return np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n_texts)


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text."""
    n = len(offsets) - 1
    ids, _, first = coded_words(data, offsets, K.NON_SPACE)
    text = np.repeat(np.arange(n), np.diff(first))

    def each(marked: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marked)))
        return total[offsets[1:]] - total[offsets[:-1]]

    # lines: everything between line ends and ends of texts, as words of another kind
    line_bytes = np.ones(256, bool)
    line_bytes[0x0A] = False
    line, lines, line_first = coded_words(data, offsets, line_bytes)
    of = np.repeat(np.arange(n), np.diff(line_first))
    line_raw, line_ends = K.string_buffers(lines)
    _, _, wordy = K.words(line_raw, line_ends, K.NON_SPACE)
    with_word = np.zeros(len(lines), bool)
    with_word[wordy] = True
    shown = with_word[line] if len(line) else np.zeros(0, bool)
    line, of = line[shown], of[shown]
    return {
        "n_words": np.diff(first), "word_chars": each(K.NON_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": each(_SYMBOL[data]),
        "n_lines": np.bincount(of, minlength=n), "n_dup_lines": np.bincount(of[_again(of, line)], minlength=n),
        "n_repeat_words": _repeat_words(ids, text, n, WINDOW), "n_capitals": each(_CAPITAL[data]), "n_digits": each(_DIGIT[data]),
        "n_marks": each(_MARK[data]), "n_distinct_words": np.diff(first) - np.bincount(text[_again(text, ids)], minlength=n),
    }


def _counted(columns):
    def run(batches):
        for batch in batches:
            data, offsets = K.string_buffers(batch.column("_text"))
            for i, j in K.slices(offsets, 1 << 20):
                found = count_texts(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *[pa.array(found[c].astype(np.int64)) for c in COUNTS]],
                                                 names=[*columns, *COUNTS])
    return run


def counts(docs: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """One row per document: doc_id, stratum, the counts, base_failed."""
    own = docs[stratum].cast("string") if stratum and stratum in docs.columns else F.lit(None).cast("string")
    # a null stratum is one of its own: strata are marked so that no name can be taken for it
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), own), F.lit("null")).alias("stratum"),
                       docs["text"].cast("string").alias("_text"))
    out = rows.mapInArrow(_counted(["doc_id", "stratum"]), "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", base)


def _passed(name: str):
    """How many cutoffs of a rule, from the strictest on, a document breaks."""
    part, whole, grid = RULES[name]
    sign = 1 if grid[0] < grid[-1] else -1
    return F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: sign * (F.col(part) * 1000 - g * F.col(whole)) > 0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n draws with chance p; 1 from the mean on (an upper
    bound there, where nothing could be proven anyway)."""
    if k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > 1e-18 * total:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return min(1.0, total)


def proposals(labelled: DataFrame, rungs: tuple[float, ...] = RUNGS) -> DataFrame:
    """(stratum, rung, rules): for every rung the cutoffs of its rules, as a map
    from the rule to the number of its cutoff."""
    broken = labelled.where("proposes").select("stratum", "good", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), _passed(r))])).alias("rule", "broken"))
    tally = broken.groupBy("stratum", "rule", "broken").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    stricter = W.partitionBy("stratum", "rule").orderBy(F.desc("broken"))
    # cutoff number c rejects the documents that break more than c cutoffs
    sums = tally.select("stratum", "rule", (F.col("broken") - 1).alias("cutoff"), F.sum("good").over(stricter).alias("lost"), F.sum("bad").over(stricter).alias("caught"),
                        F.sum("good").over(W.partitionBy("stratum", "rule")).alias("n_good")).where("cutoff >= 0 AND caught > 0")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(r / len(RULES)).alias("share")) for i, r in enumerate(rungs)])).alias("step")
    allowed = sums.select("*", steps).where(F.col("lost") <= F.col("n_good") * F.col("step.share"))
    best = allowed.groupBy("stratum", F.col("step.rung").alias("rung"), "rule").agg(F.max_by("cutoff", F.struct("caught", "cutoff")).alias("cutoff"))
    return best.groupBy("stratum", "rung").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "cutoff")))).alias("rules"))


def broken_rules():
    """The names of the rules in the map ``rules`` that a row breaks."""
    return F.array_compact(F.array(*[F.when(_passed(r) > F.element_at("rules", F.lit(r)), F.lit(r)) for r in RULES]))


def certified(spark: SparkSession, counted: DataFrame, labels: DataFrame, column: str = "quality", risk: float = RISK, delta: float = DELTA,
              rungs: tuple[float, ...] = RUNGS, ws: Workspace | None = None) -> DataFrame:
    """(stratum, rung, rules, n_good, n_lost, p_value): the cutoffs in force."""
    ws = ws or Workspace(spark, "risk-rules")
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.min(F.col(column)) > 0).alias("good")))
    labelled = counted.where(~F.col("base_failed")).join(known, "doc_id").withColumn("proposes", fold_of("doc_id", 2) == 0)
    labelled = ws.save(labelled, "labelled")
    proposed = ws.save(proposals(labelled, rungs), "proposed")
    m = labelled.select("stratum").distinct().count()
    tail = F.pandas_udf(lambda k, n: pd.Series([binomial_tail(int(a), int(b), risk) for a, b in zip(k, n)]), "double")
    tested = (labelled.where("good AND NOT proposes").join(proposed, "stratum").withColumn("lost", F.size(broken_rules()) > 0)
              .groupBy("stratum", "rung").agg(F.count(F.lit(1)).alias("n_good"), F.count_if("lost").alias("n_lost"))
              .withColumn("p_value", tail("n_lost", "n_good")))
    before = W.partitionBy("stratum").orderBy("rung")
    passed = tested.withColumn("holds", F.min(F.col("p_value") <= F.lit(delta / max(1, m))).over(before)).where("holds").drop("holds")
    last = passed.groupBy("stratum").agg(F.max_by(F.struct("rung", "n_good", "n_lost", "p_value"), "rung").alias("t")).select("stratum", "t.*")
    return ws.save(last.join(proposed, ["stratum", "rung"]), "certified")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and
    broken_rules (names of the certified rules that it breaks; none for a
    document that the base rules reject)."""
    ws = Workspace(spark, "risk-rules")
    counted = ws.save(counts(docs, stratum), "counts")
    cutoffs = certified(spark, counted, labels, ws=ws, **options).select("stratum", "rules")
    names = F.when(~F.col("base_failed"), broken_rules())
    joined = counted.join(cutoffs, "stratum", "left").withColumn("broken_rules", F.coalesce(names, F.array().cast("array<string>")))
    out = joined.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    return ws.finish(out.select("doc_id", *COUNTS, "base_failed", "kept", "broken_rules"))


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(spark, docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                             F.array_join("broken_rules", ",").alias("broken_rules"))


def _sql() -> str:
    values = ", ".join(f"({i}, '{name}', '{part}', '{whole}', {list(grid)}, {1 if grid[0] < grid[-1] else -1})" for i, (name, (part, whole, grid)) in enumerate(RULES.items()))
    counts_of = ", ".join(f"'{c}': {c}" for c in COUNTS)
    rungs = ", ".join(f"({i}, {r / len(RULES)!r}::DOUBLE)" for i, r in enumerate(RUNGS))
    return rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), gram AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM doc, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS u(i)
), twice AS (
  SELECT r, unnest(list(i)) AS i FROM gram GROUP BY r, g HAVING count(*) > 1
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range({WINDOW})) AS u(k) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc
), counted AS (
  SELECT doc.r, doc_id, stratum, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(regexp_extract_all(t, '[0-9]')) AS n_digits, len(regexp_extract_all(t, '[!-/:-@\[-`{{-~]')) AS n_marks,
    len(list_distinct(w)) AS n_distinct_words FROM doc JOIN lines USING (r) LEFT JOIN repeated USING (r)
), judged AS (
  SELECT *, coalesce(chars, 0) AS word_chars, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted
), rules AS (
  SELECT * FROM (VALUES {values}) AS v(nth, rule, part, whole, grid, sign)
), broken AS (
  SELECT r, doc_id, stratum, nth, rule, len(list_filter(grid, lambda g: sign * (m[part] * 1000 - g * m[whole]) > 0)) AS n
  FROM (SELECT r, doc_id, stratum, MAP {{{counts_of}}} AS m FROM judged WHERE NOT base_failed), rules
), known AS (
  SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), halves AS (
  SELECT doc_id, good, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 2 = 0 AS proposes
  FROM known
), labelled AS (
  SELECT * FROM broken JOIN halves USING (doc_id)
), tally AS (
  SELECT stratum, rule, n - 1 AS cutoff, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM labelled WHERE proposes GROUP BY ALL
), sums AS (
  SELECT stratum, rule, cutoff, sum(good) OVER stricter AS lost, sum(bad) OVER stricter AS caught, sum(good) OVER (PARTITION BY stratum, rule) AS n_good
  FROM tally WINDOW stricter AS (PARTITION BY stratum, rule ORDER BY cutoff DESC)
), proposed AS (
  SELECT stratum, rung, rule, arg_max(cutoff, {{'a': caught, 'b': cutoff}}) AS cutoff FROM sums, (VALUES {rungs}) AS v(rung, share)
  WHERE cutoff >= 0 AND caught > 0 AND lost <= n_good * share GROUP BY ALL
), held AS (
  SELECT r, stratum, rung, bool_or(n > cutoff) AS lost FROM labelled JOIN proposed USING (stratum, rule) WHERE good AND NOT proposes GROUP BY ALL
), tested AS (
  SELECT stratum, rung, count(*) AS n, count(*) FILTER (lost) AS k FROM held GROUP BY ALL
), tails AS (
  SELECT stratum, rung, CASE WHEN k >= n * {RISK} THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) END AS p FROM tested
), passed AS (
  SELECT stratum, rung, bool_and(p <= {DELTA} / (SELECT count(DISTINCT stratum) FROM labelled)) OVER (PARTITION BY stratum ORDER BY rung) AS holds FROM tails
), force AS (
  SELECT stratum, rule, cutoff FROM proposed JOIN (SELECT stratum, max(rung) AS rung FROM passed WHERE holds GROUP BY stratum) USING (stratum, rung)
), out AS (
  SELECT r, string_agg(rule, ',' ORDER BY nth) AS names FROM broken JOIN force USING (stratum, rule) WHERE n > cutoff GROUP BY r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND names IS NULL AS kept, coalesce(names, '') AS broken_rules
FROM judged LEFT JOIN out USING (r)
"""


SQL = _sql()
