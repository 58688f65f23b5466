"""Audit of how far the sources of a language diverge: sparse count vectors of documents, sums of groups, distances of pairs over the terms either side has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyhue.llm import arrow_text as A
from skyhue.llm.tables import ship, staged
from skyhue.sources.staging import folder

#: Documents of its language that hold a kept term at least, what is added to each count, parts of a whole, ranks of the term part.
MIN_DOCS, ADDED, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes that stand between terms (fixed values), and A-Z as a-z.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[[*range(0, 65), *range(91, 97), *range(123, 128)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Kept terms that one vocabulary holds, about; a larger one is cut by a hash of the terms, as a vocabulary passes through the driver and is broadcast.
SLICE = 1 << 20
#: One in so many terms (a power of two, by a hash) is counted beforehand, to see how many slices there are.
PROBE = 256
SALTS = 32

#: How Parquet holds a vector.
VECTOR = T.StructType([T.StructField("type", T.ByteType()), T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def _stable(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on; those that fit in two bytes are counted instead of compared."""
    return np.argsort(values.astype(np.min_scalar_type(int(values.max(initial=0)))), kind="stable")


def _named(rep: np.ndarray, w: A.Words, data: np.ndarray, names: list[bytes]) -> pa.StringArray:
    """Words as strings, each behind the name of its row."""
    row, size = w.row[rep], w.end[rep] - w.start[rep]
    before = np.array([len(x) for x in names], dtype=np.int64)[row]
    at, read = np.concatenate([[0], np.cumsum(before + size)]), np.cumsum(size) - size
    out, place = np.empty(at[-1], dtype=np.uint8), np.arange(size.sum())
    out[np.repeat(at[:-1] + before - read, size) + place] = data[np.repeat(w.start[rep] - read, size) + place]
    for name in set(names):
        begin = at[:-1][np.array([x == name for x in names])[row]]
        for k, byte in enumerate(name):
            out[begin + k] = byte
    return pa.StringArray.from_buffers(len(rep), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> lang, source, times, terms, probe: of each document a row for the different terms that occur equally often, or one without terms."""
    for block in A.blocks(batches, "text"):
        lang, source = (block.rows.column(block.rows.schema.get_field_index(c)) for c in ("lang", "source"))
        w = A.words(block, BETWEEN)
        h = A.word_hashes(block, w)
        order = np.argsort(h)
        order = order[_stable(w.row[order])]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
        first = np.flatnonzero(fresh)
        rep, times = order[first], np.diff(np.append(first, len(order)))
        by = _stable(times)
        by = by[_stable(w.row[rep[by]])]
        rep, times = rep[by], times[by]
        row, probed = w.row[rep], (h[rep] & np.uint64(PROBE - 1)) == 0
        cut = np.ones(len(rep), dtype=bool)
        cut[1:] = (row[1:] != row[:-1]) | (times[1:] != times[:-1])
        begin, none = np.flatnonzero(cut), np.flatnonzero(w.count == 0)
        strings = _named(rep, w, FOLD[block.data], [x.encode() + b"\x00" for x in lang.to_pylist()])
        ends = np.concatenate([begin, np.full(len(none) + 1, len(rep))])
        rows, seen = pa.array(np.concatenate([row[begin], none])), np.concatenate([[0], np.cumsum(probed)])
        yield pa.RecordBatch.from_arrays(
            [lang.take(rows), source.take(rows), pa.array(np.concatenate([times[begin], np.zeros(len(none), dtype=np.int64)])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), pa.ListArray.from_arrays(pa.array(seen[ends], pa.int32()), strings.filter(pa.array(probed)))],
            ["lang", "source", "times", "terms", "probe"],
        )


def bags(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Documents as bags of terms, written once: lang, source, times, terms (each with its language's name in front) and probe (one in PROBE of them).

    A document's terms are dealt to rows by how often they occur in it, so a document is the sum of times * its rows, a term stands in one row of a document, and
    a row holds each term once, however often it is repeated.
    """
    ship(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))), F.col(text).alias("text"))
    found = plain.mapInArrow(_counted, "lang string, source string, times long, terms array<string>, probe array<string>")
    return staged(found)


def _slices(found: DataFrame, min_docs: int, size: int) -> int:
    """Into how many parts the terms of all languages have to be cut for each to keep about size of them: by exact counts of one in PROBE terms."""
    kept = found.select(F.explode("probe").alias("term")).groupBy("term").count().where(F.col("count") >= min_docs).count()
    return max(1, -(-kept * PROBE // size))


def group_counts(found: DataFrame, min_docs: int = MIN_DOCS, size: int = SLICE) -> DataFrame:
    """Documents as `bags` has them -> place, lang, term, source, n: occurrences of each kept term (place is its number) in each group that has it.

    A language's terms are told apart from another's by its name in front, so that one CountVectorizer counts documents for each language; a term stands in one row
    of a document, so rows count documents. It keeps all terms in at least min_docs of them. Rows become sparse vectors, written once; times * their entries
    are summed for each group. Vocabularies of over
    size terms are cut into slices, each of which is fitted, applied and summed by itself.
    """
    spark, out = found.sparkSession, None
    slices = _slices(found, min_docs, size)
    for k in range(slices):
        own = F.col("terms") if slices == 1 else F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(slices)) == k)
        named = found.select("source", "times", own.alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1).fit(named)
        known = [(i, *name.rsplit("\x00", 1)) for i, name in enumerate(model.vocabulary)]
        if not known:
            continue
        path = folder(spark)
        model.transform(named.where(F.size("terms") > 0)).select("source", "times", "vector").write.parquet(path)
        schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("times", T.LongType()), T.StructField("vector", VECTOR)])
        entries = spark.read.schema(schema).parquet(path).select("source", "times", F.inline(F.arrays_zip("vector.indices", "vector.values"))).toDF("source", "times", "at", "n")
        sums = entries.groupBy("at", "source").agg(F.sum(F.col("n").cast("long") * F.col("times")).alias("n"))
        words = staged(spark.createDataFrame(known, "at int, lang string, term string"))
        sums = staged(sums.join(words, "at").select((F.lit(k).cast("long") * (1 << 32) + F.col("at")).alias("place"), "lang", "term", "source", "n"))
        out = sums if out is None else out.unionByName(sums)
    return spark.createDataFrame([], "place long, lang string, term string, source string, n long") if out is None else out


def _part(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * kept)), exactly."""
    above = (n + ADDED).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)")
    below = F.greatest(total + ADDED * kept, F.lit(1)).cast("decimal(31,0)")
    return F.lit(1) + F.call_function("div", above, below)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, ranks: int = RANKS, size: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank: how far each (lang, source) group is from the lang's other sources, and by which terms from the lang.

    p of a group and a kept term is 1 + floor(WHOLE * (count + ADDED) / (N + ADDED * V)). Part `pair`: for each other source, the sum of |p - q| over all
    kept terms; terms that neither group has add the same, so only those that one of them has are looked at. Part `term`: terms that the group has and that
    are more frequent there than in the lang, by p - q, the first `ranks` of them. Ranks count from 1 by falling value, ties by the item's bytes.

    Null texts have no terms; null langs and sources count as ''. Repeated rows count as often as they stand. A lang without kept terms gives values of 0 and no
    term rows; a group without terms still is one. No rows give none. Texts are read whole; further columns aren't read, so their names can't clash.
    """
    found = bags(docs, text, lang, source)
    counts = group_counts(found, min_docs, size)
    in_lang = staged(counts.groupBy("place").agg(F.first("lang").alias("lang"), F.sum("n").alias("lang_n")))
    per_lang = in_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    in_lang = in_lang.join(per_lang, "lang").select("place", _part(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    groups = found.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")))
    groups = staged(groups.withColumns({"p0": _part(F.lit(0), F.col("total"), F.col("kept")), "grp": F.monotonically_increasing_id()}))
    rows = counts.join(groups, ["lang", "source"]).withColumn("p", _part(F.col("n"), F.col("total"), F.col("kept")))
    rows = staged(rows.select("place", "grp", "term", "p", "p0"))
    return _pairs(rows, groups).unionByName(_terms(rows, groups, in_lang, ranks))


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    # terms that both have: what |p - q| differs by from what each side's own terms add below. A term has a row for each source at most
    other = rows.select("place", F.col("grp").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = rows.join(other, "place").where("grp < other").groupBy("grp", "other").agg(F.sum(F.abs(p - q) - F.abs(p - q0) - F.abs(p0 - q) + F.abs(p0 - q0)).alias("value"))
    # terms that one side has: equal counts are taken together
    own = groups.select("lang", "grp", "p0", "kept")
    pairs = own.join(groups.select("lang", F.col("grp").alias("other"), F.col("p0").alias("q0")), "lang").where("grp <> other")
    alike = rows.groupBy("grp", "p").agg(F.count("*").alias("times"))
    one = alike.join(pairs.select("grp", "other", "p0", "q0"), "grp").groupBy("grp", "other").agg(F.sum(F.col("times") * (F.abs(p - q0) - F.abs(p0 - q0))).alias("value"))
    # what all kept terms add where neither side has any
    base = pairs.select("grp", "other", (F.col("kept") * F.abs(p0 - q0)).alias("value"))
    turned = [x.select(F.col("other").alias("grp"), F.col("grp").alias("other"), "value") for x in (both, one)]
    total = base.unionByName(both).unionByName(one).unionByName(turned[0]).unionByName(turned[1]).groupBy("grp", "other").agg(F.sum("value").alias("value"))
    named = total.join(groups.select("grp", "lang", "source"), "grp").join(groups.select(F.col("grp").alias("other"), F.col("source").alias("item")), "other")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(rows: DataFrame, groups: DataFrame, in_lang: DataFrame, ranks: int) -> DataFrame:
    more = rows.join(in_lang, "place").withColumn("value", F.col("p") - F.col("q")).where("value > 0").select("grp", F.col("term").alias("item"), "value", F.pmod("place", F.lit(SALTS)).alias("salt"))
    order = (F.col("value").desc(), "item")
    first = F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))
    best = more.withColumn("rank", first).where(F.col("rank") <= ranks)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= ranks)
    return best.join(groups.select("grp", "lang", "source"), "grp").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
