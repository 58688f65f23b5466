"""Greedy one-to-one pairing of two bands in rounds over ever wider chunks of time.

A chunk sees its own points and those of its neighbours within reach of its border. It goes through the possible pairs in greedy order. A pair is taken if the order
can't have used either point before, whatever happens outside; where that isn't sure, both points stay unsure for later pairs. Taken points leave, the
others go to the next round, whose chunks are WIDER times as wide and have their borders elsewhere; the last round's chunk is all that is left of an event. Rounds are few and known
beforehand, however long a chain of pairs that wait for each other is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WIDER, ROUNDS = 64, 2
#: Columns of a point, and those of the second point in a pair.
POINT, SECOND = ("first", "t", "x", "m", "e", "row"), ("t2", "m2", "e2", "row2")


def settled(points: list[tuple], own: list[bool], reach: float, zero: bool, later: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Points (first band?, t, x, .., .., row) of a chunk, own ones marked -> pairs that are sure, and own points that may still be paired."""
    a = sorted((i for i, p in enumerate(points) if p[0]), key=lambda i: points[i][2])
    b = sorted((i for i, p in enumerate(points) if not p[0]), key=lambda i: points[i][2])
    xs = [points[j][2] for j in b]
    edges = []
    for i in a:
        p = points[i]
        for j in b[bisect_left(xs, p[2] - reach - 1e-9) : bisect_right(xs, p[2] + reach + 1e-9)]:
            q = points[j]
            if abs(p[2] - q[2]) <= reach and (own[i] or own[j]):
                edges.append((0.0 if zero else abs(p[1] - q[1]), max(p[1], q[1]) if later else 0.0, p[1], p[5], q[1], q[5], i, j))
    edges.sort()
    taken, unsure, pairs = set(), {i for i, mine in enumerate(own) if not mine}, []
    for *_, i, j in edges:
        if i in taken or j in taken:
            continue
        if i in unsure or j in unsure:
            unsure |= {i, j}
        else:
            taken |= {i, j}
            pairs.append((i, j))
    waiting = {k for *_, i, j in edges if i not in taken and j not in taken for k in (i, j)}
    return pairs, [i for i in sorted(waiting) if own[i]]


def _round(reach: float, zero: bool, later: bool):
    """For mapInArrow. Rows (key, chunk, own, pair, point, second) sorted by key and chunk -> rows without chunk and own; pairs pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, types, names = None, [], [], None, None

        def flush() -> None:
            pairs, rest = settled([r[4:10] for r in held], [r[2] for r in held], reach, zero, later)
            for i, j in pairs:
                p, q = held[i], held[j]
                out.append((now[0], True, *p[4:10], q[5], q[7], q[8], q[9]))
            out.extend((now[0], False, *held[i][4:10], None, None, None, None) for i in rest)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        for batch in batches:
            keep = [0, *range(3, len(batch.schema))]
            types, names = [batch.schema.field(k).type for k in keep], [batch.schema.field(k).name for k in keep]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[3]:
                    out.append((row[0], *row[3:]))
                    continue
                if row[:2] != now:
                    if held:
                        flush()
                    now, held = row[:2], []
                held.append(row)
            if len(out) >= 5000:
                yield made()
                out.clear()
        if held:
            flush()
        if out:
            yield made()

    return run


def greedy(points: DataFrame, reach: float, zero: bool, later: bool, width: float) -> DataFrame:
    """points: key, first, t, x, m, e, row -> pairs: key, the first point's columns, and t2, m2, e2, row2."""
    row_type = points.schema["row"].dataType
    key_type = points.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, pair boolean, first boolean, t double, x double, m double, e double, row {row_type.simpleString()}, t2 double, m2 double, e2 double, row2 {row_type.simpleString()}"
    none = [F.lit(None).cast("double").alias(c) for c in SECOND[:3]]
    at = points.select("key", F.lit(False).alias("pair"), *POINT, *none, F.lit(None).cast(row_type).alias("row2"))
    width = max(width, 8 * reach)
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            size = width * WIDER**k
            cell = lambda x: F.floor((x - F.lit(size / 3)) / F.lit(size)).cast("bigint")
            home = cell(F.col("x"))
            chunks = F.when(F.col("pair"), F.array(home)).otherwise(F.sequence(cell(F.col("x") - reach), cell(F.col("x") + reach)))
            at = at.select("key", F.explode(chunks).alias("chunk"), home.alias("home"), "pair", *POINT, *SECOND).withColumn("own", F.col("chunk") == F.col("home"))
        else:
            at = at.withColumns({"chunk": F.lit(0).cast("bigint"), "own": F.lit(True)})
        at = at.select("key", "chunk", "own", "pair", *POINT, *SECOND).repartition("key", "chunk").sortWithinPartitions("key", "chunk")
        at = at.mapInArrow(_round(reach, zero, later), schema)
    return at.where("pair")
