import random

import pytest

CLASHING = "score double, matches string, lines_removed int, words_left int, taken string, size int, entities int, licenses int, rkey long, node int, comp int, n_tokens string"


def words(n, seed, pool=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def edge_rows():
    """(doc_id, text, lang, source): nulls in every column, empty, blank and very long texts, repeated rows, one id with two texts."""
    long = words(60_000, 1, 10**6)
    shared = words(60, 2)
    return [
        (1, None, "en", "a"), (2, "", None, "b"), (3, " \n\t ", "en", None), (None, words(50, 3), "en", "a"), (None, None, None, None), (5, shared, "en", "a"), (5, shared, "en", "a"),
        (5, words(40, 5), "de", "c"), (6, shared, "en", "c"), (7, shared + " one more", "en", "b"), (8, long, "en", "a"), (9, "one two", "en", "b"), (10, "one two", "en", "c"), (11, "x" * 70_000 + " y", "en", "a"), (12, "a b c d e", "en", "é"),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in edge_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASHING.split(", ")}
    return df.withColumns(clash).cache()


@pytest.fixture(scope="session")
def none(edges):
    return edges.limit(0)
