"""Nearest neighbours by inner product along shifted space-filling curves.

Each curve projects the vectors on a few random directions, shifts them, and orders them by their place on a Hilbert curve. The order is dealt out by
range; counts of the ranges give every vector its position. Positions fall into slabs, and a query is compared with all vectors of its slab and of
neighbouring ones, by matrix products in blocks. What its windows on all curves find is merged, and the best are scored anew from the original vectors.

Inner products are turned into directions first: a candidate gets one more component that fills its length up to the longest one's, a query gets 0.

The window is a share of all vectors, WINDOW / SLABS of them on each curve. Vectors without any structure need that: on directions drawn at random a near vector
is hardly closer on a curve than a far one, so a window of fixed size would find ever less as the table grows. With vectors that cluster, far
smaller windows reach the same recall; they are a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyhue.llm.tables import ship, staged

CURVES, DIRECTIONS, BITS = 10, 6, 10
#: Slabs of a curve, and slabs on either side that a query's window takes in.
SLABS, ASIDE = 16, 1
#: Times the median length beyond which a vector is compared with every query.
GIANT = 16
#: Vectors in a slab and queries in a block, at most; a slab that would hold more is cut finer, and its window takes in as many more.
SLAB_ROWS, BLOCK_QUERIES = 32768, 4096
#: Merged candidates that are scored anew, beyond those asked for: rounding may order equal scores at random.
SPARE = 20


def directions(dims: int, curve: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, curve])
    k = min(DIRECTIONS, dims)
    return np.linalg.qr(rng.normal(size=(dims, k)))[0], rng.random(k)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n x k, each component under 2 ** bits) on the Hilbert curve."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    # from the coarsest bit down, undo how the curve is turned and mirrored in each part of the cube
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for i in range(len(x)):
            upper = (x[i] & high) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << bit), flip ^ ((1 << bit) - 1), flip)
    key = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for part in x:
            key = (key << 1) | (((part ^ flip) >> bit) & 1)
    return key


def place(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on a curve."""
    base, shift = directions(vectors.shape[1], curve)
    spread = 1 / (1 + np.exp(-1.7 * np.sqrt(vectors.shape[1]) * (vectors @ base)))  # about even in 0 to 1
    cells = ((spread + shift) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec, v) that take part: finite, not zero, of the commonest length, one row for each id."""
    v = F.col(vector).cast("array<double>")
    good = rows.select(F.col(id).cast("long").alias("vec"), v.alias("v")).where(
        "vec IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    return good.groupBy("vec").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m")).select("vec", "m.v")


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _keys(rows: DataFrame, scale: float) -> DataFrame:
    """(vec, v, query, candidate) -> curve, key, vec, query: a row for each curve, and another one for queries' own places. Candidates up to scale in length get a
    further component that makes all of them as long; longer ones, and queries, are scaled by their own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, flags = part.column(0).to_numpy(), [part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
                v = _stacked(part.column(1))
                own = v / np.abs(v).max(axis=1)[:, None]
                own = own / np.sqrt((own * own).sum(axis=1))[:, None]
                short = np.abs(v).max(axis=1) <= scale
                held = np.where(short[:, None], v / scale, own)
                rest = np.sqrt(np.maximum(0, 1 - (held * held).sum(axis=1)))
                for query, flag, points in ((False, flags[1], np.column_stack([held, rest])), (True, flags[0], np.column_stack([own, np.zeros(len(v))]))):
                    some = np.flatnonzero(flag)
                    if not len(some):
                        continue
                    for c in range(CURVES):
                        keys = place(points[some], c)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, dtype=np.int32)), pa.array(keys), pa.array(ids[some]), pa.array(np.full(len(some), query))], ["curve", "key", "vec", "query"])

    return rows.select("vec", "v", "query", "candidate").mapInArrow(run, "curve int, key bigint, vec bigint, query boolean")


def _positions(keys: DataFrame) -> DataFrame:
    """Adds pos: how many candidates of the curve stand before a row. Ranges are numbered in their tasks, and shifted by the counts of the ranges before."""
    dealt = staged(keys.repartitionByRange("curve", "key", "vec", "query").withColumn("part", F.spark_partition_id()))
    one = F.when(F.col("query"), 0).otherwise(1)
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task and curve
    counts = dealt.groupBy("curve", "part").agg(F.sum(one).alias("n")).select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("curve", "part").orderBy("key", "vec", "query").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("pos", F.sum(one).over(inside)).join(counts, ["curve", "part"]).select("curve", "vec", "query", (F.col("pos") + F.col("before") - one).alias("pos"))


def _best(most: int):
    """Rows (grp, query, vec, v) sorted by grp, queries first -> (q, vec, s): the best of each query in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, top_s, top_v = None, [], [], None, None
        matrix = None

        def flush() -> Iterator[pa.RecordBatch]:
            if top_s is not None and len(ids):
                q = np.repeat(np.concatenate(ids), top_s.shape[1])
                keep = top_v.ravel() != q
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(top_v.ravel()[keep]), pa.array(top_s.ravel()[keep])], ["q", "vec", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if group[a] != now:
                    yield from flush()
                    now, ids, vectors, top_s, top_v, matrix = group[a], [], [], None, None, None
                part_ids, part = batch.column(2).slice(a, b - a).to_numpy(), _stacked(batch.column(3).slice(a, b - a))
                if kind[a]:
                    ids.append(part_ids)
                    vectors.append(part)
                    continue
                if not ids:
                    continue
                if matrix is None:
                    matrix = np.concatenate(vectors)
                for at in range(0, len(part), 2048):
                    s = matrix @ part[at : at + 2048].T
                    v = np.broadcast_to(part_ids[at : at + 2048], s.shape)
                    s = np.where(v == np.concatenate(ids)[:, None], -np.inf, s)
                    if top_s is not None:
                        s, v = np.hstack([top_s, s]), np.hstack([top_v, v])
                    if s.shape[1] > most:
                        at_ = np.argpartition(-s, most - 1, axis=1)[:, :most]
                        s, v = np.take_along_axis(s, at_, 1), np.take_along_axis(v, at_, 1)
                    top_s, top_v = s, v
        yield from flush()

    return run


def nearest(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, slabs: int = SLABS, aside: int = ASIDE) -> DataFrame:
    """For each query (a row whose id is divisible by `every`), its k nearest found by inner product: query_id, rank (from 1), vec_id, score.

    Scores are sums in double precision over the original components, infinite where they overflow; ties go to the smaller vec_id. Fewer candidates than k: all of them. Rows take
    no part whose id or vector is null, or whose vector is empty, zero, holds null or values that aren't finite, or hasn't the commonest length. Of rows that
    repeat an id, one takes part. Equal vectors under different ids are all found: of any one vector the k + 1 smallest ids stand for all, since
    no more can be among the k nearest of a query. Further columns are ignored; an empty table gives no rows. Vectors over
    GIANT times as long as the median are likely near to any query, and are compared with every one.
    """
    ship(rows.sparkSession)
    most = F.array_max(F.transform("v", F.abs))
    length = F.aggregate(F.transform("v", lambda x: x / F.col("most")), F.lit(0.0), lambda a, x: a + x * x)
    base = staged(_usable(rows, id, vector).withColumn("most", most).withColumn("length", F.col("most") * F.sqrt(length)).drop("most"))
    found = base.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.percentile_approx("length", 0.5).alias("median"), F.max("length").alias("longest")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    dims, scale = (found["dims"], min(found["longest"], GIANT * found["median"], 1e308)) if found else (1, 1.0)
    base = base.where(F.size("v") == dims)
    base = base.withColumn("same", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b")))
    # equal vectors may be a third of all rows, so the smallest ids are found in two steps
    few = base.select("vec", "same").withColumn("salt", F.pmod(F.xxhash64("vec"), F.lit(32)))
    for by in (("same", "salt"), ("same",)):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec"))).where(F.col("r") <= k + 1)
    few = few.select("vec", F.lit(True).alias("candidate"))
    candidate = F.coalesce("candidate", F.lit(False))
    base = staged(base.join(few, "vec", "left").select("vec", "v", candidate.alias("candidate"), (candidate & (F.col("length") > scale)).alias("giant"), (F.col("vec") % every == 0).alias("query")))
    size = base.agg(F.count_if("candidate").alias("n"), F.count_if("query").alias("q")).first()
    finer = max(1, -(-size["n"] // (slabs * SLAB_ROWS)))
    total, reach = slabs * finer, aside * finer
    blocks = max(1, -(-size["q"] * (2 * aside + 1) // (slabs * BLOCK_QUERIES)))
    at = _positions(_keys(base.where("candidate OR query"), scale))
    slab = F.least(F.floor(F.col("pos") * total / F.lit(max(1, size["n"]))), F.lit(total - 1)).cast("int")
    at = at.withColumn("slab", slab)
    low = F.least(F.greatest(F.col("slab") - reach, F.lit(0)), F.lit(max(0, total - 1 - 2 * reach)))  # as wide at the ends
    asked = at.where("query").select("curve", "vec", "query", F.explode(F.sequence(low, F.least(low + 2 * reach, F.lit(total - 1)))).alias("slab"), F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("block"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    held = at.where("NOT query").select("curve", "vec", "query", "slab", each)
    giants = base.where("giant").select(F.lit(0).alias("curve"), "vec", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("slab")).select("*", each)
    grouped = asked.unionByName(held).unionByName(giants).select(F.xxhash64("curve", "slab", "block").alias("grp"), "query", "vec").join(base.select("vec", "v"), "vec").select("grp", "query", "vec", "v")
    pairs = grouped.repartition("grp").sortWithinPartitions("grp", F.col("query").desc()).mapInArrow(_best(k + SPARE), "q bigint, vec bigint, s double")
    pairs = pairs.groupBy("q", "vec").agg(F.max("s").alias("s"))  # windows of several curves find the same
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "vec"))).where(F.col("r") <= k + SPARE)
    both = pairs.select("q", "vec").join(base.select("vec", "v"), "vec").join(base.select(F.col("vec").alias("q"), F.col("v").alias("w")), "q")
    exact = F.aggregate(F.zip_with("w", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    both = both.select("q", "vec", exact.alias("score"))
    nearness = F.nanvl("score", F.lit(float("-inf")))  # a sum of both infinities is no nearness
    rank = F.row_number().over(Window.partitionBy("q").orderBy(nearness.desc(), "vec"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
