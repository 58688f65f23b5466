"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyhue.llm.tables import others, staged, words

SALTS = 16
#: Hex digits of the random order that make a bucket: 4096 buckets for each source.
DIGITS = 3


def random_order(id: Column, seed: int) -> Column:
    """Hex digits that order documents at random, alike in every run. Null ids share one place."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("none"))))


def _numbered(sources: DataFrame) -> DataFrame:
    """Numbers distinct sources from 0 by code point, null last: a range for each task, and counts of the ranges before it."""
    parts = staged(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("number", inside).join(counts, "part").withColumn("number", F.col("number") - 1 + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, size) of documents -> source, source_size, target.

    Each source asks for level * weight, at most most * source_size. The level rises until no further source is above its limit: sources
    at their limit keep it, and what is left of the whole goes to the others by weight. Only the sums of a round reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*(F.lit(w) for w in weights))
    per = staged(_numbered(per).withColumn("weight", F.get(cycle, F.pmod("number", F.lit(len(weights))).cast("int"))).withColumn("limit", most * F.col("source_size")))
    level, full = 0.0, -1
    while True:
        at = F.col("limit") < level * F.col("weight")
        s = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(at, F.col("limit")).otherwise(0)).alias("kept"), F.sum(F.when(at, 0).otherwise(F.col("weight"))).alias("open"), F.sum(at.cast("long")).alias("full")).first()
        if not s["open"] or s["full"] == full:
            break
        level, full = (share * s["all"] - s["kept"]) / s["open"], s["full"]
    return per.select("source", "source_size", F.least(F.col("limit").cast("double"), level * F.col("weight")).alias("target"))


def _cuts(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Where the fractional repetition of each source ends: documents ordered before (cut, cut_size) are repeated once more, those at it by cut_words."""
    ask = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("whole", whole).withColumn("extra", ask - F.col("whole") * F.col("source_size"))
    sums = rows.groupBy("source", F.substring("place", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(upto)).join(per, sums["source"].eqNullSafe(per["source"])).select(sums["source"], "bucket", (F.col("upto") - F.col("n")).alias("before"), "upto", "extra")
    last = sums.where("before <= extra AND extra < upto").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "extra")
    inside = rows.withColumn("bucket", F.substring("place", 1, DIGITS)).join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    same = inside.groupBy("source", "place", "size", "before", "extra").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("end", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order)).withColumn("begin", F.col("end") - F.col("size") * F.col("n"))
    cut = same.where("begin <= extra AND extra < end").select(F.col("source").alias("s"), F.col("place").alias("cut"), F.col("size").alias("cut_size"), F.floor((F.col("extra") - F.col("begin")) / F.col("n")).cast("long").alias("cut_words"))
    return per.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11
) -> DataFrame:
    """Adds to docs: size (words), source_size, target, taken (words that the mix takes, repetitions counted).

    Sources, by code point and null last, weigh as weights say, over and over, and share share * all words; none gets more than most times its
    words. A source's documents are taken floor(target / source_size) times whole; in a seeded order of ids they are then taken once more until the
    target is met, the last one in part. Rows that repeat an id and size share the last part evenly. Null ids have one place in the order.

    Null texts have size 0. No words at all: every target is 0. The order depends on nothing but seed and ids, so reruns agree. Of
    an empty table no rows come back. A column that bears the name of an added one is replaced.
    """
    keep = others(docs, "size", "source_size", "target", "taken")
    names = [c for c in docs.columns if c.lower() in (id.lower(), text.lower(), source.lower())]
    at = {c.lower(): f"__m_c{i}" for i, c in enumerate([*keep, *(c for c in names if c not in keep)])}
    docs = docs.select(*(F.col(f"`{c}`").alias(at[c.lower()]) for c in [*keep, *(c for c in names if c not in keep)]))  # no clash with names used here
    id, text, source = at[id.lower()], at[text.lower()], at[source.lower()]
    place = random_order(F.col(id), seed)
    rows = staged(docs.select(F.col(source).cast("string").alias("source"), place.alias("place"), F.size(words(text)).cast("long").alias("size")))
    cuts = _cuts(rows, staged(targets(rows, weights, share, most)))
    cuts = cuts.select(*(F.col(c).alias(f"__m_{c}") for c in cuts.columns), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__m_salt"))
    out = docs.select(*(at[c.lower()] for c in keep), F.size(words(text)).cast("long").alias("size"), place.alias("__m_place"), F.col(source).cast("string").alias("__m_name"))
    out = out.withColumn("__m_deal", F.pmod(F.xxhash64("__m_place"), F.lit(SALTS)).cast("int"))
    out = out.join(cuts, F.col("__m_name").eqNullSafe(F.col("__m_source")) & (F.col("__m_deal") == F.col("__m_salt")), "left")
    here, cut = F.struct("__m_place", "size"), F.struct("__m_cut", "__m_cut_size")
    more = F.when(F.col("__m_cut").isNull(), F.lit(0)).when(here < cut, F.col("size")).when(here == cut, F.col("__m_cut_words")).otherwise(0)
    return out.select(*(F.col(at[c.lower()]).alias(c) for c in keep), "size", F.col("__m_source_size").alias("source_size"), F.col("__m_target").alias("target"), (F.col("__m_whole") * F.col("size") + more).cast("long").alias("taken"))


def repeated(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself, with the columns of docs: every row as often as `mix` takes it whole; where it takes a part, once more with the text's first words, joined
    by one blank. Rows of which nothing is taken, such as texts without words, go."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    mixed = mix(plain, at[how.pop("id", "doc_id")], at[text], at[how.pop("source", "source")], **how)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    left = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    part = F.when(left > 0, F.array(F.array_join(F.slice(words(at[text]), 1, F.greatest(left, F.lit(1))), " "))).otherwise(F.array().cast("array<string>"))
    mixed = mixed.withColumn("__text", F.explode(F.concat(F.array_repeat(F.col(at[text]), whole), part)))
    return mixed.select(*(F.col("__text" if c == text else at[c]).alias(c) for c in docs.columns))
