"""Small tables with the awkward rows that every operator must bear."""

import random

import pytest

WORDS = "the of to river stone market window summer carbon signal garden answer bridge candle doctor engine flower ground".split()


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(n))


LONG = prose(99, 30_000)

#: doc_id, text, lang, source, n_chars, and columns whose names operators use themselves.
AWKWARD = [
    (1, prose(1, 120), "en", "src0", 1), (2, prose(1, 120), "en", "src1", 1), (3, prose(1, 119) + " changed", None, "src1", None),
    (4, None, "en", "src0", None), (5, "", None, None, 0), (6, " \t\n ", "de", "src2", 3), (7, LONG, "en", "src0", 1), (8, LONG, "en", "src0", 1),
    (9, "Êtes-vous là? Ça va bien, Ärger über Öl", "fr", "src3", 1), (9, "Êtes-vous là? Ça va bien, Ärger über Öl", "fr", "src3", 1),
    (None, prose(1, 120), "en", "src0", 1), (None, None, None, None, None), (10, "1234 !!! 567", "en", "src0", 1), (11, "x", "en", "src9", 1),
    (12, "one two three four five\x1csix seven eight", "en", "src4", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    names = ("digest", "anchor", "shard", "block", "word", "n", "start", "fp", "node", "copy", "score", "label", "file", "row", "body", "u", "v")
    return df.select("*", *(F.lit("clash").alias(n) for n in names))


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


def stored(df, folder, parts=3):
    path = str(folder / "table.parquet")
    df.repartition(parts).write.parquet(path)
    return path
