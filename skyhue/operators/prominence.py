"""Brightness peaks of a curve by one left-to-right fold whose parts join associatively.

A part of a curve is summed up by what the rest of the curve can still need of it: its ends, its peaks whose surroundings aren't settled yet, and for either
direction a short staircase: walking into the part, the faintest magnitude met before the first point brighter than a given one. Steps are where that answer changes,
so a staircase is as long as new extremes of both kinds alternate, not as long as the part.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa

Step = tuple[float, float]  # faintest magnitude so far, and the brightest point reached with it


class Peak(NamedTuple):
    """A peak whose prominence may still change: y, time, its neighbours, and the climb to either side, open where nothing brighter has been met there."""

    y: float
    x: float
    xp: float
    yp: float
    xn: float
    yn: float
    left: float
    left_open: bool
    right: float
    right_open: bool


class Run(NamedTuple):
    """Points of one magnitude that follow each other."""

    y: float
    xs: tuple[float, ...]


class Part(NamedTuple):
    n: int
    head: Run
    after: tuple[float, float] | None  # the point behind the head; None if all points are one run
    tail: Run
    before: tuple[float, float] | None
    faintest: float
    brightest: float
    rightward: tuple[Step, ...]
    leftward: tuple[Step, ...]
    peaks: tuple[Peak, ...]
    found: int
    best: tuple | None  # (-prominence, y, x, xp, yp, xn, yn)


def point(x: float, y: float) -> Part:
    run, step = Run(y, (x,)), ((-math.inf, y),)
    return Part(1, run, None, run, None, y, y, step, step, (), 0, None)


def _climb(steps: tuple[Step, ...], faintest: float, y: float) -> tuple[float, bool]:
    """Faintest magnitude before something brighter than y, and whether all was passed without meeting any."""
    k = bisect_left(steps, True, key=lambda s: s[1] < y)
    return (steps[k][0], False) if k < len(steps) else (faintest, True)


def _walk(near: Part, near_steps: tuple[Step, ...], far_steps: tuple[Step, ...]) -> tuple[Step, ...]:
    out = list(near_steps)
    for m, y in far_steps:
        if y < near.brightest:
            m = max(m, near.faintest)
            if out and out[-1][0] == m:
                out.pop()
            out.append((m, y))
    return tuple(out)


def _peak(run: Run, before: tuple[float, float], after: tuple[float, float], a: Part, b: Part) -> Peak | None:
    """A run between parts a and b (at the end of one or the begin of the other) as a peak, if both neighbours are fainter."""
    if not (before[1] > run.y and after[1] > run.y):
        return None
    k = (len(run.xs) - 1) // 2
    xp, yp = (run.xs[k - 1], run.y) if k else before
    xn, yn = (run.xs[k + 1], run.y) if k + 1 < len(run.xs) else after
    return Peak(run.y, run.xs[k], xp, yp, xn, yn, *_climb(a.leftward, a.faintest, run.y), *_climb(b.rightward, b.faintest, run.y))


def _settled(p: Peak, whole: bool = False) -> bool:
    """Whether the smaller climb can't change any more."""
    return whole or not (p.left_open and (p.right_open or p.left < p.right) or p.right_open and p.right < p.left)


def _better(best: tuple | None, p: Peak, least: float) -> tuple | None:
    climb = min(p.left, p.right) - p.y
    mine = (-climb, p.y, p.x, p.xp, p.yp, p.xn, p.yn)
    return mine if climb >= least and (best is None or mine < best) else best


def joined(a: Part, b: Part, least: float) -> Part:
    """Part a and then b; least: the smallest prominence that counts."""
    fresh, head, after, tail, before = [], a.head, a.after, b.tail, b.before
    if a.tail.y == b.head.y:
        run = Run(a.tail.y, a.tail.xs + b.head.xs)
        if a.before is None and b.after is None:
            head = tail = run
        elif a.before is None:
            head, after = run, b.after
        elif b.after is None:
            tail, before = run, a.before
        else:
            fresh.append(_peak(run, a.before, b.after, a, b))
    else:
        left, right = (a.tail.xs[-1], a.tail.y), (b.head.xs[0], b.head.y)
        if a.before is None:
            after = right
        else:
            fresh.append(_peak(a.tail, a.before, right, a, b))
        if b.after is None:
            before = left
        else:
            fresh.append(_peak(b.head, left, b.after, a, b))
    new = [p for p in fresh if p]
    peaks, best = list(new), a.best if b.best is None or a.best is not None and a.best < b.best else b.best
    for p in a.peaks:
        if p.right_open:
            m, free = _climb(b.rightward, b.faintest, p.y)
            p = p._replace(right=max(p.right, m), right_open=free)
        peaks.append(p)
    for p in b.peaks:
        if p.left_open:
            m, free = _climb(a.leftward, a.faintest, p.y)
            p = p._replace(left=max(p.left, m), left_open=free)
        peaks.append(p)
    for p in peaks:
        if _settled(p):
            best = _better(best, p, least)
    return Part(
        a.n + b.n, head, after, tail, before, max(a.faintest, b.faintest), min(a.brightest, b.brightest), _walk(a, a.rightward, b.rightward), _walk(b, b.leftward, a.leftward),
        tuple(p for p in peaks if not _settled(p)), a.found + b.found + len(new), best,
    )


def result(part: Part, least: float) -> tuple:
    """n_points, n_interior, x_first, y_first, y_min, and of the best peak: climb, y, x, xp, yp, xn, yn (None without one)."""
    best = part.best
    for p in part.peaks:
        best = _better(best, p, least)
    found = (-best[0], *best[1:]) if best else (None,) * 7
    return (part.n, part.found, part.head.xs[0], part.head.y, part.brightest, *found)


RESULT = "n_points bigint, n_interior bigint, x_first double, y_first double, y_min double, climb double, y double, x double, xp double, yp double, xn double, yn double"


def folded(groups: int, least: float, parts: bool):
    """For mapInArrow. Rows (groups group columns, then x, y or a part) sorted by all of them -> each group's part, or its result if rows hold parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        now, have, types, done = None, None, None, []

        def made() -> pa.RecordBatch:
            names = [f"g{k}" for k in range(groups)]
            columns = [pa.array([d[0][k] for d in done], types[k]) for k in range(groups)]
            if not parts:
                return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(tuple(d[1])) for d in done], pa.binary())], [*names, "part"])
            rows = [result(d[1], least) for d in done]
            kinds = [pa.int64()] * 2 + [pa.float64()] * 10
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*names, *(c.split()[0] for c in RESULT.split(", "))])

        for batch in batches:
            types = [f.type for f in batch.schema]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                group = row[:groups]
                one = revived(pickle.loads(row[-1])) if parts else point(row[-2], row[-1])
                if group != now:
                    if have is not None:
                        done.append((now, have))
                    now, have = group, one
                else:
                    have = joined(have, one, least)
            if len(done) >= 1000:
                yield made()
                done.clear()
        if have is not None:
            done.append((now, have))
        if done:
            yield made()

    return run


def revived(fields: tuple) -> Part:
    n, head, after, tail, before, *middle, peaks, found, best = fields
    return Part(n, Run(*head), after, Run(*tail), before, *middle, tuple(Peak(*p) for p in peaks), found, best)
