"""Small tables that hold what operators must bear: nulls anywhere, empty, wordless and very long texts, repeated rows, extra columns with awkward names."""

import random

from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, tk string, root string, spans string, ids string, score string, p_toxic string, __key string, c0 string"
EXTRA = ("x",) * 10

WORDS = "the of and a to in is that it was for on are with as his they at be this have from or one had by word but not what all were we when your can said".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ",", str(r.randint(0, 99))]) for _ in range(n))


LONG = prose(99, 30_000)
ROWS = [
    (1, prose(1, 200), "en", "a"), (2, prose(1, 200), "en", "b"), (3, prose(1, 198) + " changed end", "en", "a"), (4, None, "en", "a"), (None, prose(4, 90), None, None), (5, "", "de", "b"),
    (6, "  \t\n ", "de", None), (7, LONG, "en", "a"), (8, "two words", None, "c"), (8, "two words", None, "c"), (9, prose(5, 60), "de", "c"), (9, prose(6, 60), "de", "c"),
    (None, None, None, None), (10, "Über çà 日本 \x00 ends\r\n'll  x", "fr", "b"), (11, prose(1, 200).upper(), "en", "c"),
]


def documents(spark: SparkSession, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or "") if r[1] else None, *EXTRA) for r in rows], SCHEMA).repartition(3)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)
