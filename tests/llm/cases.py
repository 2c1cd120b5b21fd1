"""Small tables of the awkward cases that every operator must survive."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(spark, extra=True):
    """Nulls in every column, empty and long texts, ties, repeated rows; with columns whose names clash if extra."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7),
        (5, long, "en", "a", len(long)), (6, long + " tail", "en", None, None), (None, "no id here at all, really none", "en", "b", 1), (8, None, None, None, None), (9, "é" * 50, "fr", "c", 50),
    ]
    rows += [(10 + i, " ".join(words(rng, 60)), "en", "ab"[i % 2], 300) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("size", "shard", "src", "node", "key", "row", "band", "text_a", "n", "id", "code", "grp", "copies", "p", "line", "kind", "start", "host", "path", "term", "win"):
            df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
