"""Ordered scans over long series whose key may be hot.

A window over ``(key)`` puts a whole key on one task. These helpers cut each series into chunks of the order
column (for example whole days), run the window inside ``(key, chunk)`` and carry one small row per chunk across
the cut. The carried table has one row per key and chunk, so a key with a third of all rows is spread over its
chunks and the result is the same as that of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = "__chunk"


def chunk_by(t, width: float) -> Column:
    c = t if isinstance(t, Column) else F.col(t)
    return F.floor(c / F.lit(float(width))).cast("bigint")


def _order(order):
    return [o if isinstance(o, Column) else F.col(o).asc_nulls_first() for o in order]


def row_numbers(df: DataFrame, keys: list[str], order: list, chunk: Column, name: str = "row_number") -> DataFrame:
    """``row_number`` over keys; ``chunk`` must not decrease along the order."""
    d = df.withColumn(CHUNK, chunk)
    counts = d.groupBy(*keys, CHUNK).agg(F.count("*").alias("__n"))
    before = counts.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__n")
    inside = F.row_number().over(W.partitionBy(*keys, CHUNK).orderBy(*_order(order)))
    return (
        d.withColumn("__inside", inside).join(before, keys + [CHUNK])
        .withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint"))
        .drop("__inside", "__before", CHUNK)
    )


def scan(df: DataFrame, keys: list[str], t: str, order: list, chunk: Column, name: str = "scan") -> DataFrame:
    """Adds a struct: ``number`` (1-based, in the order of t and order), ``place`` (0-based) and ``together`` among rows of the same t, ``next`` (the next
    different t of the series, NULL at its end) and ``first`` (the series' first t). ``chunk`` must be a function of t and not decrease with it.

    One shuffle of the rows, by key and chunk; all windows and the counts of chunks use it, and only a row for each chunk goes further.
    """
    d = df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK)
    inside = W.partitionBy(*keys, CHUNK).orderBy(F.col(t).asc_nulls_first(), *_order(order))
    epoch = W.partitionBy(*keys, CHUNK, t)
    d = d.withColumns({"__number": F.row_number().over(inside), "__lead": F.lead(t).over(inside), "__place": F.row_number().over(epoch.orderBy(*_order(order))) - 1})
    d = d.withColumns({"__together": F.count("*").over(epoch), "__following": F.max("__lead").over(epoch)}).drop("__lead")
    ends = df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK).groupBy(*keys, CHUNK).agg(F.count("*").alias("__n"), F.min(t).alias("__first"))
    w = W.partitionBy(*keys).orderBy(F.col(CHUNK).asc_nulls_first())
    ends = ends.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, CHUNK])], F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.lead("__first").over(w).alias("__later"), F.min("__first").over(W.partitionBy(*keys)).alias("__start"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, CHUNK])]
    on = same[0]
    for c in same[1:]:
        on = on & c
    following = F.when(F.col("__following") > F.col(t), F.col("__following")).otherwise(F.col("__later"))
    made = F.struct(
        (F.col("__before") + F.col("__number")).cast("bigint").alias("number"), F.col("__place").alias("place"), F.col("__together").alias("together"),
        following.alias("next"), F.col("__start").alias("first"),
    )
    return d.join(ends, on).withColumn(name, made).select(*df.columns, name)


def neighbours(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: Column,
    previous: str | None = "previous", following: str | None = "following",
) -> DataFrame:
    """Adds a struct of ``values`` of the previous and/or following row of the series (NULL at its ends)."""
    d = df.withColumn(CHUNK, chunk).withColumn("__row", F.struct(*order, *[v for v in values if v not in order]))
    edge_values = d.groupBy(*keys, CHUNK).agg(F.min("__row").alias("__first"), F.max("__row").alias("__last"))
    w = W.partitionBy(*keys).orderBy(CHUNK)
    carried = edge_values.select(
        *keys, CHUNK,
        F.lag("__last").over(w).alias("__from_left"), F.lead("__first").over(w).alias("__from_right"),
    )
    inner = W.partitionBy(*keys, CHUNK).orderBy("__row")
    out = d.withColumns({
        "__lag": F.lag("__row").over(inner), "__lead": F.lead("__row").over(inner),
    }).join(carried, keys + [CHUNK])
    if previous:
        out = out.withColumn(previous, F.coalesce("__lag", "__from_left"))
    if following:
        out = out.withColumn(following, F.coalesce("__lead", "__from_right"))
    return out.drop("__row", "__lag", "__lead", "__from_left", "__from_right", CHUNK)


def bracket(
    df: DataFrame, keys: list[str], order: list[str], knot: str, chunk: Column,
    previous: str = "previous", following: str = "following", strict: bool = False,
) -> DataFrame:
    """As-of in both directions: nearest non-NULL ``knot`` struct at or before, and at or after, each row.

    Rows with a NULL knot are queries. Equal order values see each other unless ``strict``.
    """
    d = df.withColumn(CHUNK, chunk)
    knots = d.where(F.col(knot).isNotNull()).groupBy(*keys, CHUNK).agg(
        F.min_by(knot, F.struct(*order)).alias("__first"), F.max_by(knot, F.struct(*order)).alias("__last")
    )
    # every chunk that holds rows needs a carried row, also one without knots
    chunks = d.groupBy(*keys, CHUNK).agg(F.count("*").alias("__n")).join(knots, keys + [CHUNK], "left")
    w = W.partitionBy(*keys).orderBy(CHUNK)
    carried = chunks.select(
        *keys, CHUNK,
        F.last("__last", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("__from_left"),
        F.first("__first", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("__from_right"),
    )
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order)
    if strict:
        back, ahead = inner.rowsBetween(W.unboundedPreceding, -1), inner.rowsBetween(1, W.unboundedFollowing)
    else:
        back = inner.rangeBetween(W.unboundedPreceding, W.currentRow)
        ahead = inner.rangeBetween(W.currentRow, W.unboundedFollowing)
    return (
        d.withColumns({"__b": F.last(knot, True).over(back), "__a": F.first(knot, True).over(ahead)})
        .join(carried, keys + [CHUNK])
        .withColumns({previous: F.coalesce("__b", "__from_left"), following: F.coalesce("__a", "__from_right")})
        .drop("__b", "__a", "__from_left", "__from_right", CHUNK)
    )


def key_totals(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Group aggregates joined back to the rows; the aggregate combines map side, unlike a window over the key."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(totals, keys)
