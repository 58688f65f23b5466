"""Language by rank order: the most frequent n-grams of a text are compared with those of each language by out-of-place distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyhue.llm import arrow_text as A
from skyhue.llm.tables import others, ship, staged

#: Letters in an n-gram at most, and n-grams in a profile.
LONGEST, PROFILE = 3, 300
SALTS = 32
#: What stands for everything that isn't a letter; below any letter, and not 0, so that n-grams of different lengths differ.
EDGE = 1

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else EDGE."""
    if not _letters:
        table = np.full(0x110000, EDGE, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(text: bytes) -> np.ndarray:
    """Codes of all n-grams of a text; words are set off by one edge on either side, and edges alone are no n-gram. None without letters."""
    points = letters()[np.frombuffer(text.decode().encode("utf-32-le"), dtype=np.uint32)].astype(np.uint64)
    points = np.concatenate([[np.uint64(EDGE)], points, [np.uint64(EDGE)]])
    keep = points != EDGE
    keep[1:] |= points[:-1] != EDGE
    keep[0] = True
    points = points[keep]
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint64)
    parts, code = [points[points != EDGE]], points
    for _ in range(LONGEST - 1):
        code = (code[:-1] << np.uint64(21)) | points[len(points) - len(code) + 1 :]
        parts.append(code)
    return np.concatenate(parts)


def ranked(codes: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent codes, most frequent first, ties to the smaller code."""
    unique, times = np.unique(codes, return_counts=True)
    return unique[np.argsort(-times, kind="stable")[:PROFILE]]


def held_out(id: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in that part. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def profiles(learn: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """Ranked n-grams of each language. Counts are over all texts and are summed by Spark; only the profiles, PROFILE codes for each language code of
    the table, reach the driver."""
    ship(learn.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def fold() -> None:
            for name, parts in waiting.items():
                codes, times = np.unique(np.concatenate(parts), return_counts=True)
                if name in total:
                    codes, where = np.unique(np.concatenate([total[name][0], codes]), return_inverse=True)
                    times = np.bincount(where, np.concatenate([total[name][1], times])).astype(np.int64)
                total[name] = codes, times
            waiting.clear()

        for block in A.blocks(batches, "text"):
            for name, raw in zip(block.rows.column(block.rows.schema.get_field_index("lang")).to_pylist(), block.texts()):
                codes = grams(raw)
                waiting.setdefault(name, []).append(codes)
                held += len(codes)
                if held > 1 << 21:
                    fold()
                    held = 0
        fold()
        for name, (codes, times) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(times)], ["lang", "code", "n"])

    counts = learn.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(run, "lang string, code bigint, n bigint")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("salt", F.pmod("code", F.lit(SALTS)))
    order = (F.col("n").desc(), "code")
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= PROFILE)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= PROFILE)
    out: dict[str, list] = {}
    for row in staged(best.select("lang", "code", "rank")).orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["code"])
    return {name: np.array(codes, dtype=np.uint64) for name, codes in out.items()}


def predicted(docs: DataFrame, known: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred and score to the columns of docs, in place of the text.

    Out-of-place distance: of each n-gram among the text's PROFILE most frequent ones, how far its rank is from that in the profile; PROFILE where the profile
    lacks it. The nearest language wins, ties go to the smaller name. score is 1 - distance / the largest possible one. Null texts and such
    without a letter, or no known language at all: `und` and score 0. Repeated rows get the same; texts are read whole; columns of docs that
    bear the name of an added one are replaced.
    """
    ship(docs.sparkSession)
    names = sorted(known, key=lambda x: x.encode())
    by_code = [(np.sort(known[x]), np.argsort(known[x], kind="stable")) for x in names]
    rest = others(docs, text, "lang_pred", "score")

    def one(raw: bytes) -> tuple[str, float]:
        own = ranked(grams(raw))
        if not len(own) or not names:
            return "und", 0.0
        best, at = math.inf, 0
        ranks = np.arange(len(own))
        for k, (codes, rank) in enumerate(by_code):
            where = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            away = np.where(codes[where] == own, np.minimum(np.abs(rank[where] - ranks), PROFILE), PROFILE)
            if (total := int(away.sum())) < best:
                best, at = total, k
        return names[at], 1 - best / (PROFILE * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, text):
            found = [one(raw) for raw in block.texts()]
            yield pa.RecordBatch.from_arrays(
                [*(block.rows.column(block.rows.schema.get_field_index(c)) for c in rest), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*rest, "lang_pred", "score"]
            )

    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(f"`{c}`" for c in rest), f"`{text}`").mapInArrow(run, schema)
