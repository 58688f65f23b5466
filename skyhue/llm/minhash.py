"""Near copies by b-bit MinHash.

Each text gives its distinct word shingles, and each of many random orders of shingles their minimum. Only the low bits of the minima are kept,
packed into a few longs; the minima themselves go, four at a time, into band hashes. Texts that share a band are candidates. Counting equal
low bits estimates the similarity, corrected for low bits that agree by chance; candidates whose estimate a pair at the threshold would hardly ever
have (MISSED) go, and the rest are confirmed on the full sets of shingles.

How the work stays linear where thousands of texts share a band:

* texts with equal words are one class from the start;
* first every member of a band is compared with the band's smallest member alone, and what is linked becomes a component;
* then members of bands that still hold several components name their likeliest partners in other components, by packed signature;
* last, texts that bands tie together, directly or through others, and that still lie in several components are compared in blocks, on the full
  sets, where the estimate allows a link. Those of the largest component of such a family are compared with the others only, never with each
  other. So no link between components is lost, and no pair inside one is made; of this step only links leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyhue.llm import arrow_text as A
from skyhue.llm.components import components
from skyhue.llm.tables import ship, staged, text_key

BANDS, ROWS, BITS = 32, 4, 2
MINIMA = BANDS * ROWS
#: Chance, by the exact binomial tail, under which an estimate may rule out a pair that stands at the threshold.
MISSED = 1e-10
#: Members of a band or family that one block holds: of signatures, and of full sets.
MEMBERS, WHOLE = 2048, 384
#: How many likeliest partners each member of a band names before the exact step.
LIKELIEST = 3

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_WEIGHTS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEQUENCE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def shingle_sets(block: A.Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's rows one after the other, where each row's begin (and the end), and class keys (rows x 2)."""
    w = A.words(block)
    h = A.word_hashes(block, w)
    rows, bounds = len(w.count), np.concatenate([[0], np.cumsum(w.count)])
    keys = np.zeros((rows, 2), dtype=np.uint64)
    full = np.flatnonzero(w.count)
    if len(full):
        place = np.arange(len(h)) - np.repeat(bounds[:-1], w.count)
        for k, base in enumerate(_SEQUENCE):
            keys[full, k] = A.mixed(np.add.reduceat(h * A.powers(base, int(w.count.max()))[place], bounds[:-1][full]) + w.count[full].astype(np.uint64))
    grams = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        grams += h[j : j + len(grams)] * _WEIGHTS[j]
    grams = A.mixed(grams)
    sets = []
    for r, (a, n) in enumerate(zip(bounds.tolist(), w.count.tolist())):
        sets.append(np.unique(grams[a : a + n - size + 1]) if n >= size else keys[r : r + 1, 0] if n else grams[:0])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return np.concatenate(sets) if sets else grams[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), keys


def signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (rows x longs) and band hashes (rows x bands); zeros for rows without shingles."""
    rows = len(bounds) - 1
    full = np.flatnonzero(np.diff(bounds))
    minima = np.zeros((MINIMA, rows), dtype=np.uint64)
    if len(full):
        heads = bounds[:-1][full]
        work = np.empty_like(values)
        for i in range(MINIMA):
            np.multiply(values, _FACTORS[i], out=work)
            work += _ADDED[i]
            minima[i, full] = np.minimum.reduceat(work, heads)
    low = A.mixed(minima) & np.uint64((1 << BITS) - 1)
    each = 64 // BITS
    packed = np.zeros((rows, MINIMA // each), dtype=np.uint64)
    for i in range(MINIMA):
        packed[:, i // each] |= low[i] << np.uint64(BITS * (i % each))
    bands = np.zeros((rows, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        mix = np.full(rows, b + 1, dtype=np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            mix = A.mixed(mix * _WEIGHTS[i % ROWS] + minima[i])
        bands[:, b] = mix
    return packed, bands


def _array(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix).view(np.int64).ravel(), type=pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), flat)


def _binary(keys: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(keys)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, 16 * len(raw) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


def sketch(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Adds cls (16 bytes for the words of the text; null without words), n_shingles, sig and bands to the columns, in place of the text."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, text):
            values, bounds, keys = shingle_sets(block, size)
            n = np.diff(bounds)
            packed, bands = signatures(values, bounds)
            cls = _binary(keys)
            cls = pa.compute.if_else(pa.array(n > 0), cls, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*(block.rows.column(block.rows.schema.get_field_index(c)) for c in rest), cls, pa.array(n), _array(packed), _array(bands)],
                [*rest, "cls", "n_shingles", "sig", "bands"],
            )

    kept = docs.select(*rest).schema
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "cls binary, n_shingles bigint, sig array<bigint>, bands array<bigint>"]))


def estimate(equal: np.ndarray | float) -> np.ndarray | float:
    """Similarity from the share of equal low bits: chance makes 1 in 2 ** BITS of the others agree."""
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def least_equal(percent: int) -> int:
    """Equal low-bit groups that a pair at the threshold falls short of with a chance under MISSED."""
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * percent / 100
    least, tail = 0, 0.0
    while (tail := tail + math.comb(MINIMA, least) * p**least * (1 - p) ** (MINIMA - least)) < MISSED:
        least += 1
    return least


def _equal(a, b):
    """Of two sig columns: how many low-bit groups agree."""
    ones = int("01" * 32, 2)
    total = F.lit(MINIMA)
    for i in range(MINIMA * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        total = total - F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(ones)))
    return total


_ONES = np.uint64(int("01" * 32, 2))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by grp, one table for each value of it."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(batch.schema.get_field_index("grp")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(cuts, cuts[1:]):
            if held and group[a] != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = group[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("sig").chunk(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(table.num_rows, -1)


def _codes(values: list) -> np.ndarray:
    ids = {v: i for i, v in enumerate(dict.fromkeys(values))}
    return np.array([ids[v] for v in values])


def _ordered(cls: list, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    ends = [sorted((cls[i], cls[j])) for i, j in zip(x.tolist(), y.tolist())]
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], ["a", "b"])


def _unequal(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    diff = left[:, None, :] ^ right[None, :, :]
    return np.bitwise_count((diff | (diff >> np.uint64(1))) & _ONES).sum(axis=2, dtype=np.int64)


def _likeliest(least: int):
    """Rows (grp, cls, root, sig) sorted by grp -> for each the pairs with its most similar rows of other roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cls, roots, sig = t.column("cls").to_pylist(), _codes(t.column("root").to_pylist()), _matrix(t)
            for at in range(0, len(cls), 64):
                apart = _unequal(sig[at : at + 64], sig)
                apart[(MINIMA - apart < least) | (roots[at : at + 64, None] == roots[None, :])] = MINIMA + 1
                y = np.argsort(apart, axis=1, kind="stable")[:, :LIKELIEST]
                x = np.repeat(np.arange(len(y)), y.shape[1])
                keep = apart[x, y.ravel()] <= MINIMA
                if keep.any():
                    yield _ordered(cls, x[keep] + at, y.ravel()[keep])

    return run


def _linked(least: int, percent: int):
    """Rows (grp, side, cls, root, sig, grams) sorted by grp -> links across roots that join what wasn't joined before in the group.

    side 0 is compared with side 1; a group of one side, with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            cls, root, sig, side = t.column("cls").to_pylist(), _codes(t.column("root").to_pylist()), _matrix(t), t.column("side").to_numpy()
            grams = t.column("grams").chunk(0)
            at = grams.offsets.to_numpy()
            flat = grams.values.to_numpy(zero_copy_only=False)
            size = np.diff(at)
            right = np.flatnonzero(side == side.max())
            for i in np.flatnonzero(side == side.min()).tolist():
                own = flat[at[i] : at[i + 1]]
                to = right[(size[right] * 100 >= size[i] * percent) & (size[right] * percent <= size[i] * 100)]
                to = to[MINIMA - _unequal(sig[i : i + 1], sig[to])[0] >= least]
                while len(to := to[root[to] != root[i]]):
                    now, to = to[:16], to[16:]
                    both = np.array([len(np.intersect1d(own, flat[at[j] : at[j + 1]], assume_unique=True)) for j in now.tolist()])
                    for j in now[100 * both >= percent * (size[i] + size[now] - both)].tolist():
                        if root[i] != root[j]:
                            yield _ordered(cls, np.array([i]), np.array([j]))
                            root[root == root[j]] = root[i]

    return run


def _sets(docs: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """Full sets of shingles of the wanted classes (cls, tk): cls, grams. One text of a class stands for it."""
    texts = docs.select(F.col(text).alias("text"), text_key(text).alias("tk")).join(wanted, "tk", "left_semi").groupBy("tk").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, "text"):
            values, bounds, _ = shingle_sets(block, size)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.rows.column(block.rows.schema.get_field_index("cls")), sets], ["cls", "grams"])

    return texts.join(wanted, "tk").select("cls", "text").mapInArrow(run, "cls binary, grams array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full sets of shingles are similar enough."""
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.where(100 * common >= percent * (F.size("ga") + F.size("gb") - common)).select("a", "b")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, rows["cls"] == roots["node"], "left").withColumn("root", F.coalesce("root", "cls")).drop("node")


def _named(members: DataFrame, roots: DataFrame, sig: DataFrame, least: int) -> DataFrame:
    """Likeliest pairs (a, b) across components within the bands."""
    at = staged(_rooted(members.select("bucket", "n", "cls"), roots))
    # written first, so that adaptive execution can split the join where a band has very many members
    several = staged(at.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("bucket"))
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / MEMBERS))
    rest = at.join(several, "bucket").join(sig, "cls").select(F.xxhash64("bucket", part).alias("grp"), "cls", "root", "sig")
    return rest.repartition("grp").sortWithinPartitions("grp").mapInArrow(_likeliest(least), "a binary, b binary").distinct()


def _exact(families: DataFrame, roots: DataFrame, sig: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (a, b) across components within families (node, root) of classes that bands tie together."""
    family = families.select(F.col("node").alias("cls"), F.col("root").alias("family"))
    family = family.unionByName(family.select(F.col("family").alias("cls"), "family").distinct())
    at = staged(_rooted(family, roots))
    sizes = at.groupBy("family", "root").agg(F.count("*").alias("n"))
    several = sizes.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).where("k > 1")
    several = staged(several.select("family", F.col("most.root").alias("main"), F.ceil(F.col("most.n") / WHOLE).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most.n")) / WHOLE).cast("int").alias("others")))  # written first, as above
    # those of the largest component are dealt to blocks; each of its blocks meets each block of the others, and these meet each other
    rows = at.join(several, "family").withColumn("in_main", F.col("root") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    meets = F.when(F.col("in_main"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(o.alias("o"), F.col("own").alias("m"), F.lit(1).alias("side"))))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: F.struct(F.col("own").alias("o"), m.alias("m"), F.lit(0).alias("side")))
    with_others = F.transform(
        F.sequence(F.lit(0), F.col("others") - 1),
        lambda o: F.struct(F.least(o, "own").alias("o"), (-1 - F.greatest(o, "own")).alias("m"), F.when(o < F.col("own"), 1).otherwise(0).alias("side")),
    )
    rows = rows.select("family", "cls", "root", F.explode(meets.otherwise(F.concat(with_main, with_others))).alias("at"))
    rows = rows.join(sig, "cls").join(sets, "cls").select(F.xxhash64("family", "at.o", "at.m").alias("grp"), "at.side", "cls", "root", "sig", "grams")
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_linked(least, percent), "a binary, b binary")


def classes_and_links(docs: DataFrame, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Table of rows (the columns but the text, tk, cls, n_shingles) and of linked classes (node, root)."""
    ship(docs.sparkSession)
    rows = staged(sketch(docs.withColumn("tk", text_key(text)), text, size))
    classes = staged(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min("tk").alias("tk")))
    buckets = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = staged(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cls").alias("rep")).where("n > 1"))
    members = staged(buckets.join(shared, "bucket"))
    least, sig = least_equal(percent), classes.select("cls", "sig")
    sets = staged(_sets(docs, text, size, members.select("cls").distinct().join(classes.select("cls", "tk"), "cls")))
    star = staged(members.where("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct())
    near = star.join(sig.toDF("b", "sb"), "b").join(sig.toDF("a", "sa"), "a").where(_equal(F.col("sa"), F.col("sb")) >= least).select("a", "b")
    links = staged(_confirmed(near, sets, percent))
    named = _named(members, components(links), sig, least).join(star, ["a", "b"], "left_anti")
    links = links.unionByName(staged(_confirmed(named, sets, percent)))
    links = links.unionByName(_exact(components(star), components(links), sig, sets, least, percent))
    return rows.drop("sig", "bands"), components(links)


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """Every row's id, n_shingles, tk (see text_key), component_id and kept.

    Rows are linked whose sets of shingles have 100 * intersection >= percent * union. Words are cut at blanks and lower-cased in A-Z; a text with
    fewer words than a shingle has is one shingle. component_id is the smallest id in the component; kept says that the row has it.

    Null or wordless texts have no shingles and are components of their own, with their own id, and kept. Null ids: such rows take
    part, but have no say in component_id unless all ids of a component are null, when it is null; kept is true for a null id only then. Rows that
    repeat an id are all kept if it is the smallest. Further columns are ignored. An empty table gives no rows.
    """
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows, links = classes_and_links(base, "text", shingle, percent)
    least = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("least"))
    rooted = least.join(links, least["cls"] == links["node"], "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(smallest, "root").select("cls", "component_id", "root")
    # a class may hold a third of all rows: its row here is split over salts, as its copies are
    salts = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")
    spread = by_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = rows.withColumn("salt", salts).join(spread, ["cls", "salt"], "left")
    own = F.col("cls").isNull()
    component = F.when(own, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", "tk", "root", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of `near_copies`, with the columns of docs: that with the smallest id (null last).

    Of rows that repeat that id, the one with the smallest text, by its hash, stays; of rows that agree in both, one. Texts without words: one row for each null
    or wordless text and id.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no clash with names used here
    id, text = f"c{names.index(id)}", f"c{names.index(text)}"
    found = near_copies(docs, id, text, shingle, percent)
    alone = F.col("root").isNull()
    best = found.groupBy("root", F.when(alone, F.col(id).cast("string")).alias("own"), F.when(alone, F.col("tk")).alias("text"))
    best = best.agg(F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "tk")).alias("best"))
    chosen = best.select(F.col("best.id").alias("__id"), F.col("best.tk").alias("__tk"))
    rows = docs.withColumn("__key", text_key(text))
    same = F.col(id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__tk"))
    rows = rows.join(chosen, same, "left_semi")
    # rows that agree in id and text are rare, and only they are put together
    times = found.groupBy(F.col(id).alias("__id"), F.col("tk").alias("__tk")).agg(F.count("*").alias("n")).where("n > 1")
    single = rows.join(times, same, "left_anti")
    several = rows.join(times, same, "left_semi").dropDuplicates([id, "__key"])
    return single.unionByName(several).drop("__key").toDF(*names)
