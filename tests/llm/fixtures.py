"""Small tables with every odd case: nulls, blanks, long texts, ties, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "node long, row string, size string, shard string, copies string, key string, quality string, pii string, n string, sid string"


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n)]


def odd_documents(spark, clashing=False):
    rng = random.Random(4)
    base = words(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (3, " ".join(base)),  # a repeated row
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "One"),
        (8, "one"),
        (9, "TWO words"),
        (None, "a row without a number that is quite its own in all it says here"),
        (None, " ".join(base)),
        (11, " ".join(words(rng, 20_000, 4000))),  # very long
        (12, "x" * 50_000),
        (13, "été déjà vu: naïve façade — ½ 漢字 🙂 " * 5),
        *((20 + i, " ".join(words(rng, 40))) for i in range(20)),
    ]
    sources = [None, "b", "a", "z", "A"]
    data = [(i, t, None if k % 3 else "en", sources[k % 5], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, DOCS)
    if clashing:
        from pyspark.sql import functions as F

        for field in CLASHING.split(", "):
            name, kind = field.split()
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
