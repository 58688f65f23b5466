"""Result conventions: floating results rounded to six places without a negative zero, counts as BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed value: six places.
SCALE = 1e6


def rounded(c: Column) -> Column:
    """Six places, a half away from zero, by binary arithmetic as in the SQL: scaled, made whole, scaled back.

    The built-in ``round`` rounds the shortest decimal text instead; a value one last digit short of a half then goes the other way.
    """
    y = c * F.lit(SCALE)
    near = F.rint(y)
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * F.lit(0.5)).otherwise(near)
    out = whole / F.lit(SCALE)
    # values without a finite result stay as they are
    return F.when(F.abs(out) < F.lit(float("inf")), out).otherwise(c)


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    d = df.select(*columns) if columns else df
    out = []
    for f in d.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((rounded(c.cast("double")) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return d.select(*out)
