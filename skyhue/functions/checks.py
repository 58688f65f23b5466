"""Contract checks. Guards are part of a query's plan and stop it where data break the contract; no job runs while the query is built. The ``require_``
functions act at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Action: fails when a key repeats. The count per key combines map side."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"key {keys} is not unique")
    return df


def unmatched_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One row: keys on either side only, and in both."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("in_right").isNull()).alias("n_left_only"),
        F.count_if(F.col("in_left").isNull()).alias("n_right_only"),
        F.count_if(F.col("in_left") & F.col("in_right")).alias("n_both"),
    )


def _stops(ok: Column, message: Column) -> Column:
    """A condition that holds, or stops the query. As a filter it can't be pruned with columns that nobody reads."""
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def guard_rows(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """The rows as they are; one that isn't ``ok`` stops the query."""
    return df.where(_stops(ok, F.lit(message) if isinstance(message, str) else message))


def guard_with(df: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows as they are, if ``verdict`` (one row, ``message``) has no message; else the query stops with it. The verdict is worked out as part of
    the query and is the one row that is broadcast."""
    return df.crossJoin(F.broadcast(verdict.where(_stops(F.col("message").isNull(), F.col("message"))).select()))


def guard_same_keys(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """``left``, if both tables hold the same keys; else the query stops."""
    n = unmatched_keys(left, right, *keys)
    text = F.format_string(f"the tables do not hold the same {', '.join(keys)}: %s only left, %s only right", "n_left_only", "n_right_only")
    return guard_with(left, n.select(F.when(F.col("n_left_only") + F.col("n_right_only") > 0, text).alias("message")))


def _single(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(F.lit(True).alias("__in"), *rest)).alias("__r"))
    text = F.concat(F.lit(f"the {side} table repeats "), F.to_json(F.struct(*keys)))
    return guard_rows(one, F.col("__n") == 1, text).select(*keys, F.col("__r").alias(f"__{side}"))


def one_to_one(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join of two tables that hold each key once; a repeated key stops the query.

    Either side is aggregated by the keys, which combines before the shuffle, and the join reads the same partitions: counting needs no shuffle
    of its own, and a key that is repeated without bound becomes one row before it could grow a task.
    """
    keys = list(keys)
    d = _single(left, keys, "left").join(_single(right, keys, "right"), keys, how)
    own = [F.col(f"__left.{c}").alias(c) for c in left.columns if c not in keys]
    return d.select(*keys, *own, *[F.col(f"__right.{c}").alias(c) for c in right.columns if c not in keys])


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Observation]:
    """The rows, and named measures of them that the first action on them brings along; ``.get`` waits for it."""
    seen = Observation()
    return df.observe(seen, *[m.alias(n) for n, m in measures.items()]), seen


def require_bands(depths: DataFrame, bands) -> dict[str, float]:
    """Depth per band from a table of at most a few rows; each band exactly once and finite."""
    rows = (
        depths.where(F.col("band").isin(list(bands)))
        .groupBy("band").agg(F.count("*").alias("n"), F.max("m5").alias("m5")).collect()
    )
    found = {r["band"]: r for r in rows}
    for band in bands:
        row = found.get(band)
        if row is None:
            raise ValueError(f"no depth for band {band}")
        if row["n"] != 1:
            raise ValueError(f"depth of band {band} is ambiguous")
        if row["m5"] is None or row["m5"] != row["m5"] or abs(row["m5"]) == float("inf"):
            raise ValueError(f"depth of band {band} is not finite")
    return {b: found[b]["m5"] for b in bands}

