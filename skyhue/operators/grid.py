"""Regular time grids, bin assignment with named edge rules, and dense spines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyhue.functions.columns import col

EDGE_RULES = ("left_open", "right_open", "last_closed")


@dataclass(frozen=True)
class TimeGrid:
    """Bins ``[lo + i*width, lo + (i+1)*width]``; ``n`` bins."""

    lo: float
    hi: float
    width: float

    def __post_init__(self):
        if self.width <= 0 or self.hi <= self.lo:
            raise ValueError("need lo < hi and width > 0")
        n = (self.hi - self.lo) / self.width
        if abs(n - round(n)) > 1e-8:
            raise ValueError("the range must be a whole number of bins")

    @property
    def n(self) -> int:
        return round((self.hi - self.lo) / self.width)

    def edge(self, i: Column) -> Column:
        return F.lit(self.lo) + i.cast("double") * F.lit(self.width)

    def centre(self, i: Column) -> Column:
        return F.lit(self.lo) + (i.cast("double") + F.lit(0.5)) * F.lit(self.width)

    def centre_cell(self, t) -> Column:
        """Index of the first centre ``>= t``: 0..n, where n lies beyond the last centre.

        The quotient is only a guess; comparing with the centres themselves removes its rounding.
        """
        t = col(t)
        guess = F.ceil((t - F.lit(self.lo)) / F.lit(self.width) - F.lit(0.5)).cast("int")
        guess = F.greatest(F.lit(0), F.least(F.lit(self.n), guess))
        up = F.when((guess < self.n) & (self.centre(guess) < t), 1).otherwise(0)
        down = F.when((guess > 0) & (self.centre(guess - 1) >= t), 1).otherwise(0)
        return (guess + up - down).cast("int")

    def bin_of(self, t, rule: str = "right_open") -> Column:
        """Bin of a time under an edge rule, NULL outside.

        left_open ``(lo, hi]``; right_open ``[lo, hi)``; last_closed ``[lo, hi)`` but the last bin is closed.
        """
        if rule not in EDGE_RULES:
            raise ValueError(f"edge rule must be one of {EDGE_RULES}")
        t = col(t)
        guess = F.floor((t - F.lit(self.lo)) / F.lit(self.width)).cast("int")
        if rule == "left_open":
            up = F.when(t > self.edge(guess + 1), 1).otherwise(0)
            down = F.when(t <= self.edge(guess), 1).otherwise(0)
        else:
            up = F.when(t >= self.edge(guess + 1), 1).otherwise(0)
            down = F.when(t < self.edge(guess), 1).otherwise(0)
        i = guess + up - down
        if rule == "last_closed":
            i = F.when((i == self.n) & (t <= self.edge(F.lit(self.n))), F.lit(self.n - 1)).otherwise(i)
        return F.when((i >= 0) & (i < self.n), i.cast("int"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per bin: bin_index, t_min_days, t_max_days, t_center_days."""
        i = F.col("id").cast("int")
        return spark.range(self.n).select(
            i.alias("bin_index"),
            self.edge(i).alias("t_min_days"),
            self.edge(i + 1).alias("t_max_days"),
            self.centre(i).alias("t_center_days"),
        )

    def with_times(self, df: DataFrame, index: str = "bin_index") -> DataFrame:
        i = F.col(index)
        return df.withColumns({
            "t_min_days": self.edge(i), "t_max_days": self.edge(i + 1), "t_center_days": self.centre(i),
        })


def match_interval(points: DataFrame, t: str, rules: DataFrame, rule: str = "left_open", how: str = "left", cell: float = 1.0) -> DataFrame:
    """Point -> interval join against a rule table of t_min_days and t_max_days. Intervals may overlap; a point then has a row for each."""
    p, lo, hi = F.col(t), F.col("t_min_days"), F.col("t_max_days")
    inside = {
        "left_open": (p > lo) & (p <= hi),
        "right_open": (p >= lo) & (p < hi),
        "closed": (p >= lo) & (p <= hi),
    }[rule]
    return interval_join(points, t, rules, "t_min_days", "t_max_days", inside, cell, how)


def interval_join(points: DataFrame, x: str, rules: DataFrame, low: str, high: str, inside: Column, cell: float, how: str = "left") -> DataFrame:
    """Points with the finite intervals that hold them, as an equi-join: an interval is copied to the cells that it reaches, a point lies in one.

    No point is compared with intervals of other cells, and whether a side is broadcast is left to its size.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("bigint")
    spread = rules.withColumn("__cell", F.explode(F.sequence(at(low), at(high))))
    return points.withColumn("__at", at(x)).join(spread, (F.col("__at") == F.col("__cell")) & inside, how).drop("__at", "__cell")
