"""Equi-joins one of whose sides has keys with very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a key that one part takes.
ROWS = 100_000


def split_join(many: DataFrame, few: DataFrame, keys: list[str], rows_per_part: int = ROWS) -> DataFrame:
    """Inner join in which a key of ``many`` with over ``rows_per_part`` rows is dealt to as many parts as it needs, by a hash of the row, and the rows of ``few``
    with that key are copied to each.

    Keys are counted first, which combines before the shuffle; only crowded ones are kept, at most one for each ``rows_per_part`` rows. No part then grows with a key.
    """
    crowded = many.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_per_part)
    crowded = crowded.select(*keys, F.ceil(F.col("__n") / rows_per_part).cast("int").alias("__parts"))
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    left = many.withColumn("__row", F.xxhash64(*many.columns)).join(crowded, keys, "left").withColumn("__part", F.pmod("__row", parts).cast("int")).drop("__row", "__parts")
    right = few.join(crowded, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"]).drop("__part")
