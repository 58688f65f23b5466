"""Passages that stand somewhere else as well: every byte covered by a string of SPAN bytes that starts at two places or more.

Sorting all suffixes of a corpus in one order needs every suffix in one place. Instead, suffixes are first dealt to groups outside of which none
can share SPAN bytes:

1. Each window of SPAN bytes names its anchor, the place of the smallest hash among the strings of GRAM bytes in it. Equal windows name the
   same anchor string at the same offset. Neighbouring windows mostly name the same place; such a run of windows is a stretch of text around its anchor.
2. Stretches whose anchor string occurs once are out. That is nearly all of a text without repeats, and costs eight bytes in a hundred or so.
3. Stretches that are equal as a whole are folded: all their windows repeat.
4. Only stretches that differ, but have the anchor in common (edges of passages, edits in copies), are fetched. In each group their suffixes from the
   anchor on, and their reversed prefixes before it, are sorted (deep-shallow). Common prefixes of neighbours give, for any offset, classes
   of stretches that agree so far to the right and to the left; a window repeats if another stretch is in both its classes.

A group of more than GROUP different stretches isn't brought to one task. Its windows are counted by hash, as an aggregate that combines
before it is dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhue.llm import arrow_text as A
from skyhue.llm.suffixes import deep_shallow
from skyhue.llm.tables import others, ship, staged, text_key

SPAN, GRAM = 400, 128
#: Different stretches of one anchor that a task sorts; and bytes of a text that are looked at together.
GROUP, PART = 20_000, 1 << 22
SALTS = 8
_LOW = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of that width."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    table = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    table[: len(values)] = values
    table = table.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts one after the other: anchor hash, row, first and last window start of each stretch, and place of its anchor, within the data."""
    n = len(data)
    if n < span:
        return (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(4)))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(A.SYMBOLS[data] * A.powers(A.BASE, n), out=prefix[1:])
    grams = A.mixed((prefix[gram:] - prefix[:-gram]) * A.powers(A.BASE_INVERSE, n)[: n - gram + 1])
    place = _least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), span - gram + 1) & _LOW
    place = place.astype(np.int64)
    room = np.diff(offsets) - span + 1
    inside = np.zeros(len(place) + 1, dtype=np.int64)
    fits = room > 0
    inside[offsets[:-1][fits]] += 1
    np.subtract.at(inside, (offsets[:-1] + room)[fits], 1)
    inside = np.cumsum(inside[:-1]) > 0
    cut = np.ones(len(place), dtype=bool)
    cut[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(place)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    at = place[first]
    return grams[at], np.searchsorted(offsets, first, "right") - 1, first, last, at


def _anchored(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """docs (k1, k2: the text's key, text) -> a row for each stretch: anchor, ctx (hash of its bytes), k1, k2, s1 (first window's start), and in one number
    (`shape`) how far the last window's start and the anchor are behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, "text", min(A.BLOCK, PART)):
            keys = [block.rows.column(block.rows.schema.get_field_index(k)) for k in ("k1", "k2")]
            # a very long text is a block of its own; it is looked at in parts that overlap by a window
            for base in range(0, max(1, len(block.data)), PART):
                data, offsets = block.data, block.offsets
                if len(block.data) > PART:
                    data = block.data[base : base + PART + span - 1]
                    offsets = np.array([0, len(data)])
                anchor, row, first, last, at = stretches(data, offsets, span, gram)
                if not len(anchor):
                    continue
                raw = data.tobytes()
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + span).tolist())), dtype=np.uint64, count=len(first))
                start = block.offsets[row] if len(block.data) <= PART else -base
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), *(k.take(pa.array(row)) for k in keys), pa.array((first - start).astype(np.int64)), pa.array(((last - first) << 32 | (at - first)).astype(np.int64))],
                    ["anchor", "ctx", "k1", "k2", "s1", "shape"],
                )

    return docs.mapInArrow(run, "anchor bigint, ctx bigint, k1 bigint, k2 bigint, s1 bigint, shape bigint")


def repeated_offsets(stretch: list[bytes], before: list[int], span: int, wanted: list[bool]) -> list[list[tuple[int, int]]]:
    """Different stretches of one anchor, which stands before[i] bytes after the begin of the i-th: for each wanted one, the runs (least, largest) of
    offsets o such that the window beginning o bytes before the anchor stands in another one too."""
    n = len(stretch)
    right, r_shared = deep_shallow([s[b:] for s, b in zip(stretch, before)])
    left, l_shared = deep_shallow([s[:b][::-1] for s, b in zip(stretch, before)])
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:
        o1, o2 = max(0, span - r_shared[1]), min(l_shared[1], span)
        if o1 <= o2:
            found = [[(o1, o2)] if wanted[i] else [] for i in range(2)]
        return found
    size = np.array([len(s) for s in stretch])
    before_ = np.array(before)
    r_rank, l_rank = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    r_rank[right], l_rank[left] = np.arange(n), np.arange(n)
    r_shared_, l_shared_ = np.array(r_shared), np.array(l_shared)
    hit: list[list[int]] = [[] for _ in range(n)]
    for o in range(int(before_.max()) + 1):
        # classes: stretches that agree for span - o bytes from the anchor on, and for o bytes before it
        fits = np.flatnonzero((before_ >= o) & (size - before_ >= span - o))
        if len(fits) < 2:
            continue
        r_class = np.cumsum(r_shared_ < span - o)[r_rank[fits]]
        l_class = np.cumsum(l_shared_ < o)[l_rank[fits]]
        _, which, times = np.unique(r_class * (n + 1) + l_class, return_inverse=True, return_counts=True)
        for i in fits[times[which] > 1].tolist():
            hit[i].append(o)
    for i in range(n):
        if wanted[i] and hit[i]:
            o = np.array(hit[i])
            cuts = np.flatnonzero(np.diff(o) > 1)
            found[i] = list(zip(o[np.r_[0, cuts + 1]].tolist(), o[np.r_[cuts, len(o) - 1]].tolist()))
    return found


def _cut_out(span: int):
    """Rows (text, tk, parts) -> each part's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, "text"):
            rows, raw = block.rows, block.data.tobytes()
            parts = rows.column(rows.schema.get_field_index("parts")).cast(rows.schema.field("parts").type)
            held = parts.flatten()
            row = np.repeat(np.arange(rows.num_rows), np.diff(parts.offsets.to_numpy()))
            base = block.offsets[row]
            s1, s2 = (held.field(c).to_numpy(zero_copy_only=False) for c in ("s1", "s2"))
            yield pa.RecordBatch.from_arrays(
                [held.field("anchor"), held.field("big"), held.field("single"), rows.column(rows.schema.get_field_index("tk")).take(pa.array(row)), held.field("s1"), held.field("p"),
                 pa.array([raw[a:b] for a, b in zip((base + s1).tolist(), (base + s2 + span).tolist())], pa.binary())],
                ["anchor", "big", "single", "tk", "s1", "p", "bytes"],
            )

    return run


def _sorted_groups(span: int):
    """Rows of small groups, sorted by anchor -> (tk, s, e): bytes from s to before e repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def flush() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            runs = repeated_offsets([x[4] for x in held], [x[3] - x[2] for x in held], span, [x[0] for x in held])
            out = [(x[1], x[3] - o2, x[3] - o1 + span) for x, offsets in zip(held, runs) for o1, o2 in offsets]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(3)], ["tk", "s", "e"]) if out else None

        for batch in batches:
            kinds = (batch.schema.field("tk").type, pa.int64(), pa.int64())
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024).to_pydict()
                for anchor, *row in zip(part["anchor"], part["single"], part["tk"], part["s1"], part["p"], part["bytes"]):
                    if anchor != now:
                        if (made := flush()) is not None:
                            yield made
                        held, now = [], anchor
                    held.append(tuple(row))
        if held and (made := flush()) is not None:
            yield made

    return run


def _windows(span: int):
    """Rows of large groups -> each window: tk, s, anchor, o (offset) and hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, s, o, h = [], [], [], []
                for i, (s1, p, raw) in enumerate(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("s1", "p", "bytes")))):
                    for k in range(len(raw) - span + 1):
                        row.append(i), s.append(s1 + k), o.append(p - s1 - k), h.append(xxhash.xxh3_64_intdigest(raw[k : k + span]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in ("tk", "anchor", "single")), pa.array(s, pa.int64()), pa.array(o, pa.int64()), pa.array(np.array(h, dtype=np.uint64).view(np.int64))],
                    ["tk", "anchor", "single", "s", "o", "h"],
                )

    return run


def repeated_spans(docs: DataFrame, text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """tk (see text_key) of each text that has repeated bytes, and spans: where they are, as an array of (s, e), unordered and overlapping."""
    ship(docs.sparkSession)
    base = docs.select(text_key(text).alias("tk"), F.col(text).alias("text"))
    kind = base.schema["tk"].dataType.simpleString()
    found = staged(_anchored(base.select("tk.k1", "tk.k2", "text"), span, gram))
    often = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).where("n > 1")
    # written first: a join whose sides are both read anew is split by adaptive execution where an anchor has very many rows
    often = staged(often.select("anchor", (F.col("c1") != F.col("c2")).alias("differ")))
    rows = staged(found.join(often, "anchor"))
    times = rows.groupBy("anchor", "ctx").agg(F.count("*").alias("times"), F.max("differ").alias("differ"), F.min(F.struct("k1", "k2", "s1", "shape")).alias("at"))
    times = staged(times)
    tk, s2, p = F.struct("k1", "k2").alias("tk"), lambda s1, shape: F.col(s1) + F.shiftright(shape, 32), lambda s1, shape: F.col(s1) + F.col(shape).bitwiseAND(F.lit((1 << 32) - 1))
    whole = rows.join(times.where("times > 1").select("anchor", "ctx"), ["anchor", "ctx"]).select(tk, F.col("s1").alias("s"), (s2("s1", "shape") + span).alias("e"))
    # anchors with some stretch that occurs once, and another one
    groups = times.where("differ").groupBy("anchor").agg(F.count("*").alias("k"), F.min("times").alias("least")).where("least = 1")
    groups = staged(groups.select("anchor", (F.col("k") > GROUP).alias("big")))
    parts = times.where("differ").join(groups, "anchor").select("anchor", "big", (F.col("times") == 1).alias("single"), "at.*")
    parts = parts.select(tk, F.struct("anchor", "big", "single", "s1", s2("s1", "shape").alias("s2"), p("s1", "shape").alias("p")).alias("part"))
    parts = parts.groupBy("tk").agg(F.collect_list("part").alias("parts"))  # as many as a text has stretches
    texts = base.join(parts.select("tk"), "tk", "left_semi").groupBy("tk").agg(F.first("text").alias("text"))
    cut = texts.join(parts, "tk").mapInArrow(_cut_out(span), f"anchor bigint, big boolean, single boolean, tk {kind}, s1 bigint, p bigint, bytes binary")
    cut = staged(cut)
    spans = cut.where("NOT big").drop("big").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_groups(span), f"tk {kind}, s bigint, e bigint")
    windows = cut.where("big").mapInArrow(_windows(span), f"tk {kind}, anchor bigint, single boolean, s bigint, o bigint, h bigint")
    same = windows.groupBy("anchor", "o", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    large = windows.where("single").join(same, ["anchor", "o", "h"]).select("tk", "s", (F.col("s") + span).alias("e"))
    return whole.unionByName(spans).unionByName(large).distinct().groupBy("tk").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_KEPT = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "removed": "array<struct<s:bigint,e:bigint>>", "kept_bytes": "binary", "kept_text": "string", "kept_sha256": "string"}
_ARROW = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "removed": pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), "kept_bytes": pa.binary(), "kept_text": pa.string(), "kept_sha256": pa.string()}


def without_repeats(docs: DataFrame, text: str = "text", add: tuple[str, ...] = ("kept_text",), span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The columns of docs but the text, and those asked for in add: n_bytes, n_removed, n_spans, removed (runs of bytes), kept_bytes, kept_text, kept_sha256.

    A byte goes if a string of span bytes that covers it also starts at another place of any text, the same one included; strings may overlap, and are judged on
    the texts as given. Strings never cross texts. kept_text leaves out what a cut has left of a character.

    Null counts as empty (kept_text stays null), and texts shorter than span lose nothing. Rows that repeat one another repeat each other's
    strings, so all of their bytes go from span bytes on. No ids are needed; columns of docs that bear the name of an added one are replaced. Texts of any
    length are looked at whole.
    """
    names = others(docs, text, *add)
    spans = repeated_spans(docs, text, span, gram)
    rest = [f"c{i}" for i in range(len(names))]  # no clash with names used here
    rows = docs.select(*(F.col(f"`{c}`").alias(r) for c, r in zip(names, rest)), F.col(text).alias("__text"), text_key(text).alias("__tk"))
    spread = spans.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("spans", "__spans").withColumnRenamed("tk", "__key")
    rows = rows.withColumn("__deal", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(SALTS)).cast("int"))
    rows = rows.join(spread, (F.col("__tk") == F.col("__key")) & (F.col("__deal") == F.col("__salt")), "left").select(*rest, "__text", "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in A.blocks(iter([batch]), "__text"):
                part = block.rows
                given = part.column(part.schema.get_field_index("__text")).is_null().to_pylist()
                found = part.column(part.schema.get_field_index("__spans")).to_pylist()
                made: dict[str, list] = {c: [] for c in add}
                for raw, none, spans_ in zip(block.texts(), given, found):
                    runs = merged([(x["s"], x["e"]) for x in spans_]) if spans_ else []
                    kept, at = [], 0
                    for s, e in runs:
                        kept.append(raw[at:s])
                        at = e
                    left = b"".join([*kept, raw[at:]]) if runs else raw
                    values = {
                        "n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": len(runs), "removed": [{"s": s, "e": e} for s, e in runs], "kept_bytes": left,
                        "kept_text": None if none else left.decode(errors="ignore") if "kept_text" in made else None, "kept_sha256": hashlib.sha256(left).hexdigest() if "kept_sha256" in made else "",
                    }
                    for c in add:
                        made[c].append(values[c])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), *(pa.array(made[c], _ARROW[c]) for c in add)], [*rest, *add])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {_KEPT[c]}" for c in add)])
    return rows.mapInArrow(run, schema).toDF(*names, *add)
