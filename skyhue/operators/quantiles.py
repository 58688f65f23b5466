"""Exact quantiles of few, very large groups, and the other quantile rules the analyses need.

``linear`` interpolation between order statistics is the default rule. Two methods with equal results:

* ``hash``   - the built-in ``percentile``: it keeps every distinct value of a group in one buffer, so use it for
  groups that are known to be small (tables of bins, repetitions, cuts).
* ``select`` - for groups of any size. A mergeable sketch brackets each order statistic; one more pass counts what lies
  below each bracket and keeps the few values inside it. A second sketch, of the kept values, deals them to buckets; the counts of
  buckets tell which of them hold a wanted order statistic, and only those are put in order, each by itself.
  All passes combine map side, equal values fold into one counted row, and neither a group nor its kept values are ever held or
  sorted whole. Groups may be of any number: only groups of more rows than ``accuracy`` have brackets, so these are at most one for each
  ``accuracy`` rows and are broadcast, and no row is dealt by its group.
  A sketch depends on the order in which its parts are merged, so a second evaluation may differ: the values in their buckets are written once,
  and counts and order are read from that one table.

Percentiles may differ from group to group: give them as a table (some of the keys, ``percents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyhue.sources.staging import materialize

SKETCH_ACCURACY = 10_000
UNROLLED = 7
#: Even steps of the sketch that brackets percentiles known only as a column.
STEPS = 1000
#: Buckets of a group's kept values; a power of two.
BUCKETS = 256
RULES = ("linear", "inverse", "sample")


def exact_quantiles(
    df: DataFrame, keys: list[str], value, percents: list[float] | DataFrame, method: str = "select",
    n_name: str = "n", q_name: str = "quantiles", accuracy: int = SKETCH_ACCURACY, rule: str = "linear",
) -> DataFrame:
    """keys, ``n`` (non-NULL values) and ``quantiles`` (array in the order of ``percents``, 0-100).

    rule: ``linear`` (an infinite neighbour is the answer, not NaN), ``inverse`` (order statistic ``max(1, ceil(q n / 100))``) or ``sample`` (the one
    at ``rint((n - 1) q / 100)``, half to even).
    """
    v = value if isinstance(value, Column) else F.col(value)
    src = df.select(*keys, v.cast("double").alias("__v")).where("__v IS NOT NULL")
    if method == "hash":
        if rule != "linear" or isinstance(percents, DataFrame):
            raise ValueError("method 'hash' is for linear quantiles of given percents")
        qs = F.array(*[F.lit(p / 100.0) for p in percents])
        return src.groupBy(*keys).agg(F.count("*").alias(n_name), F.percentile("__v", qs).alias(q_name))
    if method != "select" or rule not in RULES:
        raise ValueError(f"method is 'hash' or 'select', rule one of {RULES}")
    return _select(src, list(keys), percents, n_name, q_name, accuracy, rule)


def _number(v: float) -> str:
    return f"double('{v!r}')"


MINUS, PLUS = "double('-Infinity')", "double('Infinity')"


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys) if keys else left.crossJoin(right)


def _brackets(src, keys, percents, accuracy) -> tuple[DataFrame, str, str]:
    """(keys, __n, __lo, __hi) with an array entry for each wanted fraction, and SQL text of the fractions in order and of the asked-for ones (p, j).

    A small group is kept whole; the outermost brackets are open. Expressions are SQL text: they repeat per percentile, and one text costs one call.
    """
    counted = F.count("*").alias("__n")
    if isinstance(percents, DataFrame):
        steps = ", ".join(_number(i / STEPS) for i in range(STEPS + 1))
        sketch = src.groupBy(*keys).agg(counted, F.expr(f"percentile_approx(__v, array({steps}), {accuracy})").alias("__e"))
        fractions = "transform(percents, p -> p / 100.0D)"
        on = [k for k in keys if k in percents.columns]
        asked = percents.select(*on, F.expr(f"array_sort(array_distinct({fractions}))").alias("__p"), F.expr(fractions).alias("__q"))
        margin = 1 + -(-2 * STEPS // accuracy)  # more steps than the sketch may be off by
        low, high = f"cast(floor(p * {STEPS}) AS int) - {margin}", f"cast(ceil(p * {STEPS}) AS int) + {margin}"
        lows = f"transform(__p, p -> if(__n <= {accuracy} OR {low} < 0, {MINUS}, try_element_at(__e, {low} + 1)))"
        highs = f"transform(__p, p -> if(__n <= {accuracy} OR {high} > {STEPS}, {PLUS}, try_element_at(__e, {high} + 1)))"
        got = _on(sketch, asked, on).select(*keys, "__n", "__p", "__q", F.expr(lows).alias("__lo"), F.expr(highs).alias("__hi"))
        return got, "__p", "transform(__q, p -> named_struct('p', p, 'j', cast(array_position(__p, p) AS int) - 1))"
    probs = sorted(set(p / 100.0 for p in percents))
    m, eps = len(probs), 3.0 / accuracy
    ends = ", ".join(_number(e) for e in [max(0.0, p - eps) for p in probs] + [min(1.0, p + eps) for p in probs])
    sketch = src.groupBy(*keys).agg(counted, F.expr(f"percentile_approx(__v, array({ends}), {accuracy})").alias("__e"))
    lows = ", ".join(MINUS if p - eps <= 0 else f"if(__n <= {accuracy}, {MINUS}, __e[{j}])" for j, p in enumerate(probs))
    highs = ", ".join(PLUS if p + eps >= 1 else f"if(__n <= {accuracy}, {PLUS}, __e[{m + j}])" for j, p in enumerate(probs))
    got = sketch.select(*keys, "__n", F.expr(f"array({lows})").alias("__lo"), F.expr(f"array({highs})").alias("__hi"))
    order = ", ".join(f"named_struct('p', {_number(p / 100.0)}, 'j', {probs.index(p / 100.0)})" for p in percents)
    return got, f"array({', '.join(_number(p) for p in probs)})", f"array({order})"


def _select(src, keys, percents, n_name, q_name, accuracy, rule):
    brackets, wanted, order = _brackets(src, keys, percents, accuracy)
    own = [c for c in ("__p", "__q") if c in brackets.columns]
    # a group without a bracket is small and kept whole
    large = F.broadcast(brackets.where(F.col("__n") > accuracy).select(*keys, "__lo", "__hi"))
    joined = src.join(large, keys if keys else F.lit(True), "left")
    m = 0 if own else len(set(percents))
    few = not own and m <= UNROLLED
    if few:
        kept = " OR ".join(f"(__v >= __lo[{j}] AND __v <= __hi[{j}])" for j in range(m))
        region = " + ".join(f"cast(__v > __lo[{j}] AS int) + cast(__v > __hi[{j}] AS int)" for j in range(m))
    else:  # generated code for so many comparisons would outgrow a method
        below = "size(filter({0}, e -> e < __v))"
        kept = f"size(filter(__lo, e -> e <= __v)) > {below.format('__hi')}"
        region = f"{below.format('__lo')} + {below.format('__hi')}"
    # rows outside every bracket fold to one counted row per region
    counted = joined.select(
        *keys, F.expr(f"CASE WHEN __lo IS NULL THEN 0 ELSE {region} END").alias("__r"), F.expr(f"CASE WHEN __lo IS NULL OR {kept} THEN __v END").alias("__x")
    ).groupBy(*keys, "__r", "__x").agg(F.count("*").alias("__c"))

    # position of a quantile among the sorted values, and the first and last order statistic it needs
    position = {
        "linear": lambda p: f"({p} * (__n - 1))",
        "inverse": lambda p: f"greatest(double(0), double(ceil({p} * 100.0D * __n / 100.0D)) - 1)",
        "sample": lambda p: f"rint({p} * (__n - 1))",
    }[rule]
    first = lambda p: f"floor({position(p)})"
    last = lambda p: f"least({first(p)} + 1, __n - 1)" if rule == "linear" else first(p)
    covers = lambda p: f"(__start <= {last(p)} AND {first(p)} < __end)"
    literal = [_number(p) for p in sorted(set(x / 100.0 for x in percents))] if few else []
    needed = " OR ".join(covers(p) for p in literal) if few else f"exists({wanted}, p -> {covers('p')})"
    ranked = _needed_values(counted, keys, needed, brackets.select(*keys, *own) if own else None)
    # which order statistics a counted value covers: id 2j and 2j + 1 are the neighbours of position j
    ids = f"""flatten(transform({wanted}, (p, j) -> array(
        named_struct('id', 2 * j, 'k', {first('p')}), named_struct('id', 2 * j + 1, 'k', {last('p')}))))"""
    hits = ranked.select(*keys, *own, "__n", "__x", F.expr(f"explode(filter({ids}, w -> w.k >= __start AND w.k < __end))").alias("__w"))
    got = hits.groupBy(*keys, *own, "__n").agg(F.expr("map_from_entries(collect_list(struct(__w.id, __x)))").alias("__m"))
    missing = "cast(raise_error('order statistic outside its bracket') AS double)"
    at = lambda i: f"coalesce(try_element_at(__m, {i}), {missing})"
    low, high, part = at("2 * o.j"), at("2 * o.j + 1"), f"({position('o.p')} - {first('o.p')})"
    between = f"CASE WHEN {low} = {high} OR {part} = 0 THEN {low} WHEN {high} = {PLUS} THEN {PLUS} WHEN {low} = {MINUS} THEN {MINUS} ELSE {low} + ({high} - {low}) * {part} END"
    value = between if rule == "linear" else low
    return got.select(*keys, F.col("__n").alias(n_name), F.expr(f"transform({order}, o -> {value})").alias(q_name))


def _needed_values(counted: DataFrame, keys: list[str], needed: str, own: DataFrame | None) -> DataFrame:
    """Kept values that cover a wanted order statistic, from __start to before __end of the group's order.

    Regions follow each other in value, and so do a region's buckets: of a group no more than a row for each bucket meets in one task.
    """
    cuts = ", ".join(_number(i / BUCKETS) for i in range(1, BUCKETS))
    counted = counted.drop("__n")
    sketch = counted.where("__x IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("__k"), F.expr(f"percentile_approx(__x, array({cuts}), {20 * BUCKETS})").alias("__cuts"))
    sketch = F.broadcast(sketch.where(F.col("__k") > SKETCH_ACCURACY).drop("__k"))
    halves = ", ".join(str(BUCKETS >> k) for k in range(1, BUCKETS.bit_length()))
    search = f"aggregate(array({halves}), 0, (a, s) -> if(try_element_at(__cuts, a + s) < __x, a + s, a))"
    placed = counted.join(sketch, keys if keys else F.lit(True), "left").withColumn("__b", F.expr(f"CASE WHEN __x IS NULL THEN -1 ELSE {search} END"))
    placed = materialize(placed.drop("__cuts"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = group.orderBy("__r", "__b").rowsBetween(W.unboundedPreceding, 0)
    sums = placed.groupBy(*keys, "__r", "__b").agg(F.sum("__c").alias("__m")).withColumns({"__n": F.sum("__m").over(group), "__end": F.sum("__m").over(upto)})
    sums = sums.withColumn("__start", F.expr("__end - __m"))
    with_own = (lambda d: _on(d, own, keys)) if own is not None else (lambda d: d)
    sums = with_own(sums.where("__b >= 0")).where(needed).select(*keys, "__n", "__r", "__b", F.col("__start").alias("__from"))
    inside = W.partitionBy(*keys, "__r", "__b").orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.where("__x IS NOT NULL").join(sums, [*keys, "__r", "__b"])
    ranked = ranked.withColumn("__end", F.col("__from") + F.sum("__c").over(inside)).withColumn("__start", F.expr("__end - __c"))
    return with_own(ranked).where(needed)


def nearest_rank(
    df: DataFrame, keys: list[str], value, percents: list[float], n_name: str = "n", q_name: str = "quantiles",
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Inverse ECDF: order statistic ``max(1, ceil(q n / 100))``; infinities are ordinary values."""
    return exact_quantiles(df, keys, value, percents, "select", n_name, q_name, accuracy, "inverse")


def nearest_sample(values: Column, fraction: float, missing: Column | None = None) -> Column:
    """Sample at ``rint((n-1) q)`` (half to even) of a small array, NULLs dropped.

    missing: number of samples without a value that count and come after all others; the answer is NULL where one of them is met.
    """
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s) if missing is None else F.size(s) + missing
    k = F.rint((n - 1) * F.lit(fraction)).cast("int") + 1
    return F.when((F.size(s) > 0) & (k <= F.size(s)), F.element_at(s, F.greatest(k, F.lit(1))))


def infinity_quantile(values: Column, fraction: float) -> Column:
    """Linear quantile of a small array that keeps an infinity as the answer instead of NaN; NULLs dropped."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    h = (F.size(s) - 1) * F.lit(fraction)
    lo, hi = F.floor(h).cast("int") + 1, F.ceil(h).cast("int") + 1
    a, b = F.element_at(s, F.greatest(lo, F.lit(1))), F.element_at(s, F.greatest(hi, F.lit(1)))
    inf = F.lit(float("inf"))
    mixed = F.when(a == b, a).when(b == inf, inf).otherwise(a + (b - a) * (h - F.floor(h)))
    return F.when(F.size(s) > 0, mixed)

