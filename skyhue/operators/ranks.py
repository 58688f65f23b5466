"""Deterministic samples: ranks by hash, nested across sizes, without one global sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyhue.functions import checks


def seed_hash(seed, key) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    k = key if isinstance(key, Column) else F.col(key)
    return F.md5(F.concat(s.cast("string"), F.lit(":"), k.cast("string")))


def bucketed_rank(df: DataFrame, order: list[str], bucket: Column, keys: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """1-based rank in the order of ``(bucket, *order)``, buckets being monotone in the order.

    Two levels: counts per bucket (a table of one row per bucket) give the offset, ``row_number`` runs
    inside a bucket.
    """
    keys = list(keys)
    d = df.withColumn("__b", bucket)
    counts = d.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    return (
        d.withColumn("__i", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*order)))
        .join(offsets, keys + ["__b"])
        .withColumn(name, (F.col("__before") + F.col("__i")).cast("bigint"))
        .drop("__b", "__i", "__before")
    )


def hash_rank(df: DataFrame, id_column: str, seed, name: str = "rank", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rank of each row under md5(seed:id). ``seed`` may be a column, then it belongs into ``keys``.

    4,096 buckets from the first three hex digits; ids are unique, so no bucket can be hot.
    """
    d = df.withColumn("__h", seed_hash(seed, id_column))
    return bucketed_rank(d, ["__h", id_column], F.substring("__h", 1, 3), keys, name).drop("__h")


#: Buckets of ids and of sampling hashes: a window over their counts is bounded, whatever the table holds.
BUCKETS = 65_536


def _in_even_buckets(df: DataFrame, id_column: str) -> tuple[DataFrame, Column]:
    """The rows with the ends of a whole-number id (one row, joined to each), and the id's bucket between them."""
    ends = df.agg(F.min(id_column).alias("__lo"), F.max(id_column).alias("__hi"))
    at = (F.col(id_column).cast("double") - F.col("__lo")) / (F.col("__hi").cast("double") - F.col("__lo") + 1)
    return df.crossJoin(F.broadcast(ends)), F.floor(at * BUCKETS)


def id_rank(df: DataFrame, id_column: str, name: str = "rank") -> DataFrame:
    """Rank in the order of a whole-number id, in even buckets between its ends."""
    d, bucket = _in_even_buckets(df, id_column)
    return bucketed_rank(d, [id_column], bucket, (), name).drop("__lo", "__hi")


def smallest(df: DataFrame, order: list[str], bucket: Column, size: int) -> DataFrame:
    """The first ``size`` rows in the order of ``(bucket, *order)``, without sorting the table.

    Counts of buckets tell in which one the last row lies: rows of earlier buckets stay as they are, later ones go before anything is shuffled, and
    only that one bucket is put in order.
    """
    d = df.withColumn("__b", bucket)
    counts = d.groupBy("__b").agg(F.count("*").alias("__n"))
    upto = W.partitionBy(F.lit(0)).orderBy(F.col("__b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    before = counts.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).where(F.col("__before") < size)
    last = before.agg(F.max(F.struct("__before", "__b")).alias("l")).select("l.__before", F.col("l.__b").alias("__last"))
    d = d.crossJoin(F.broadcast(last))
    whole = d.where(~F.col("__b").eqNullSafe(F.col("__last")) & F.coalesce(F.col("__b") < F.col("__last"), F.col("__b").isNull()))
    edge = d.where(F.col("__b").eqNullSafe(F.col("__last"))).withColumn("__i", F.row_number().over(W.partitionBy("__b").orderBy(*order)))
    edge = edge.where(F.col("__before") + F.col("__i") <= size).drop("__i")
    return whole.unionByName(edge).drop("__b", "__before", "__last")


def subset(df: DataFrame, id_column: str, size: int, seed: int | None) -> DataFrame:
    """``size`` rows (0 = all): the first in the order of a whole-number id without a seed, else nested by hash rank."""
    if size <= 0:
        return df
    if seed is None:
        d, bucket = _in_even_buckets(df, id_column)
        return smallest(d, [id_column], bucket, size).drop("__lo", "__hi")
    return smallest(df.withColumn("__h", seed_hash(seed, id_column)), ["__h", id_column], F.substring("__h", 1, 4), size).drop("__h")


def given(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows of the ids in a table; an id that the rows lack stops the query."""
    ids = ids.select(id_column).distinct()
    absent = ids.join(df.select(id_column), id_column, "left_anti").agg(F.min(F.col(id_column).cast("string")).alias("a"), F.count("*").alias("n"))
    text = F.format_string(f"%s {id_column} not found, the first is %s", "n", "a")
    return checks.guard_with(df.join(ids, id_column, "left_semi"), absent.select(F.when(F.col("n") > 0, text).alias("message")))


def memberships(df: DataFrame, id_column: str, seeds: list[int], sizes: list[int]) -> DataFrame:
    """(repetition, size, id): which nested subset holds which id. Sizes above the population mean all of it."""
    reps = F.explode(F.array(*[F.struct(F.lit(i).alias("repetition"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)]))
    ranked = hash_rank(
        df.select(id_column).withColumn("__r", reps).select(id_column, "__r.repetition", "__r.seed"),
        id_column, F.col("seed"), "rank", ("repetition", "seed"),
    )
    fits = F.filter(F.array(*[F.lit(int(n)) for n in sorted(sizes)]), lambda n: F.col("rank") <= n)
    return ranked.withColumn("sample_size", F.explode(fits))


def evenly_spaced(df: DataFrame, order: list[str], number: int, rank: str = "rank") -> DataFrame:
    """Rows at ``rint(i*(n-1)/(k-1))`` of the ranking already in column ``rank`` (1-based)."""
    total = df.agg(F.count("*").alias("__total"))
    k = F.least(F.lit(number), F.col("__total"))
    picks = total.select(
        F.explode(F.sequence(F.lit(0), k.cast("int") - 1)).alias("pick"), k.alias("__k"), "__total"
    ).select(
        "pick",
        (F.when(F.col("__k") > 1, F.rint(F.col("pick") * (F.col("__total") - 1) / (F.col("__k") - 1))).otherwise(F.lit(0.0)) + 1)
        .cast("bigint").alias(rank),
    )
    return df.join(picks, rank)
