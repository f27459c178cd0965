"""Small documents that hold every special case, and tables around them."""

import random

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, node string, size long, "
              "target double, label int, _text string, component string, bucket long, item string, unit string, u long")

WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper", "kapok", "larch", "maple", "nutmeg", "oak", "pine"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def edge_rows():
    long_text = prose(1, 60_000)
    base = prose(2, 300)
    near = base.replace(base.split()[150], "changed", 1)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, long_text), (7, long_text), (8, base), (8, base), (9, near),
            (None, base), (None, None), (10, "élan 日本語 текст 🙂 naïve"), (11, "!!! ??? 123 $$$"), (12, prose(3, 400)), (13, "one TWO"), (14, "\x00\x7f\x80 ﬁ")]
    sources = ["a", "b", None]
    langs = ["xx", None, "yy"]
    return [(i, t, langs[k % 3], sources[k % 3], None if k % 2 else k, "r", "n", 5, 1.5, 7, "other text", "c", 3, "x", None, 9) for k, (i, t) in enumerate(rows)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOC_SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def docs_of(spark, texts):
    """Documents numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
