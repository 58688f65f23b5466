"""Toxicity by a chain of linear classifiers: each category's model also reads the probabilities of the categories before it.

The models are fitted on a bounded sample of labelled rows. A later model is trained with out-of-fold probabilities of the earlier ones, so it learns how
reliable these are on texts they haven't seen, not on those they were fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyhue.llm import arrow_text as A
from skyhue.llm.tables import others, ship, staged

#: Labelled rows that the models are fitted on, at most; those first in a random order of ids.
SAMPLE = 8000
#: Features are bins of hashes of words and of grams: runs of 3 to 5 bytes of a word and the blanks around it. The models read the most telling ones.
BINS, FEATURES = 1 << 20, 1024
GRAMS = (3, 4, 5)
FOLDS = 5
#: Categories in the order of the chain, and where a row of labels is in one; null there is no label.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def features(block: A.Block, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bins of a block, each pair once, in order: words and their grams, A-Z folded. known: for each bin, whether it is wanted."""
    sizes, w = np.diff(block.offsets) + 1, A.words(block)
    data = np.insert(block.data, block.offsets, 32)  # a blank before each text and after the last one
    symbols = np.where(A.WHITE, A.FOLDED[32], A.FOLDED)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(symbols[data] * A.powers(A.BASE, len(data)), out=prefix[1:])
    back, white = A.powers(A.BASE_INVERSE, len(data)), np.concatenate([[0], np.cumsum(A.WHITE[data])])
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for k in (0, *GRAMS):
        if k == 0:
            row, hashes = w.row, A.word_hashes(block, w)
        else:
            n = max(0, len(data) - k + 1)
            at = np.flatnonzero(white[k - 1 : k - 1 + n] == white[1 : 1 + n])  # blanks at its ends only
            row, hashes = row_of[at], A.mixed((prefix[at + k] - prefix[at]) * back[at] + np.uint64(k))
        bins = (hashes >> np.uint64(44)).astype(np.int64)
        wanted = slice(None) if known is None else known[bins]
        found.append(row[wanted] * BINS + bins[wanted])
    both = np.unique(np.concatenate(found))
    return both // BINS, both % BINS


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 120) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the intercept, which isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    shrink = np.full(x.shape[1], ridge, dtype=np.float32)
    shrink[-1] = 0
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(10):  # largest eigenvalue, for the length of a step
        u = x.T @ (x @ v)
        v = u / max(float(np.linalg.norm(u)), 1e-9)
    rate = 1 / (0.25 * float(v @ (x.T @ (x @ v))) * 1.1 + ridge)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - y) + shrink * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """names: categories in order; bins: those of the features; weights: of each category's model (features, earlier categories, intercept);
    threshold: of the last category."""

    names: tuple[str, ...]
    bins: np.ndarray
    weights: list[np.ndarray]
    threshold: float


def fit_chain(x: np.ndarray, labels: dict[str, np.ndarray], folds: np.ndarray, bins: np.ndarray) -> Chain:
    """labels: of each category 1, 0 or -1 (not labelled: such rows don't teach it, yet get its probability)."""
    weights = []
    for y in labels.values():
        given, target = y >= 0, (y > 0).astype(np.float32)
        out = np.zeros(len(x), dtype=np.float32)
        for k in range(FOLDS):
            test, rest = folds == k, (folds != k) & given
            if test.any() and rest.any():
                out[test] = chance(x[test], fit(x[rest], target[rest]))
        weights.append(fit(x[given], target[given]) if given.any() else np.r_[np.zeros(x.shape[1]), -30.0])
        x = np.hstack([x, out[:, None]])
    # the threshold that parts the last category best, by F1, on out-of-fold probabilities
    out, y = out[given], y[given]
    order = np.argsort(-out, kind="stable")
    hits = np.cumsum(y[order] > 0)
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, int((y > 0).sum()))) if len(order) else np.zeros(1)
    k = int(np.argmax(f1))
    low = out[order[k + 1]] if k + 1 < len(order) else 0.0
    return Chain(tuple(labels), bins, weights, float((out[order[k]] + low) / 2) if len(order) and hits[-1] else 1.0)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", categories: dict[str, str] | None = None) -> Chain:
    """Fits a chain of the categories in their order; each is a condition on a row of labels, which is null where the row has no such label.

    By default low_quality, then toxic: junk tells the second model which of its marks are those of noise. Labels with null id, without any label, or of rows
    without text aren't used; of repeated ids each row is. No labelled row of a category: no text is in it. Every target comes from labels; the telling features
    are shared out evenly among categories, and no words are given beforehand.
    """
    ship(docs.sparkSession)
    names = tuple(categories or CATEGORIES)
    marks = [f"y{k}" for k in range(len(names))]
    place = F.md5(F.col("id").cast("string"))
    # the sample is drawn from the labels, so texts of other documents never move; SAMPLE rows of a few numbers bound what is broadcast
    drawn = labels.select(F.col(id).cast("long").alias("id"), *(F.coalesce(F.expr(c).cast("int"), F.lit(-1)).alias(m) for m, c in zip(marks, (categories or CATEGORIES).values())))
    drawn = staged(drawn.where("id IS NOT NULL").where(F.greatest(F.lit(-1), *marks) >= 0).orderBy(place, "id", *marks).limit(SAMPLE))
    marked = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(drawn), "id")
    sample = marked.orderBy(place, "id", *marks, F.xxhash64("text")).limit(SAMPLE)
    sample = staged(sample.select((F.conv(F.substring(place, 1, 4), 16, 10).cast("int") % FOLDS).alias("fold"), *marks, "text").repartition(16))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(marks), 2, BINS), dtype=np.int32)
        for block in A.blocks(batches, "text"):
            row, bin_ = features(block)
            for k, m in enumerate(marks):
                y = block.rows.column(block.rows.schema.get_field_index(m)).to_numpy(zero_copy_only=False)[row]
                for value in (0, 1):
                    seen[k, value] += np.bincount(bin_[y == value], minlength=BINS).astype(np.int32)
        for k in range(len(marks)):
            bins = np.flatnonzero(seen[k].sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), k)), pa.array(bins), *(pa.array(seen[k, v, bins].astype(np.int64)) for v in (0, 1))], ["category", "bin", "without", "having"])

    counts = sample.select(*marks, "text").mapInArrow(count, "category bigint, bin bigint, without bigint, having bigint").groupBy("category", "bin").agg(F.sum("without").alias("without"), F.sum("having").alias("having"))
    counts = staged(counts)
    sizes = sample.agg(*(F.count(F.when(F.col(m) == v, 1)).alias(f"{m}_{v}") for m in marks for v in (0, 1))).first()
    chosen: set[int] = set()
    for k, m in enumerate(marks):
        a, b = float(sizes[f"{m}_1"]) + 1, float(sizes[f"{m}_0"]) + 1
        telling = F.abs(F.log((F.col("having") + 0.5) / a) - F.log((F.col("without") + 0.5) / b)) / F.sqrt(1 / (F.col("having") + 0.5) + 1 / (F.col("without") + 0.5))
        chosen |= {r["bin"] for r in counts.where(F.col("category") == k).orderBy(telling.desc(), "bin").limit(FEATURES // len(marks)).collect()}
    bins = np.array(sorted(chosen), dtype=np.int64)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(BINS, dtype=bool)
        known[bins] = True
        for block in A.blocks(batches, "text"):
            row, bin_ = features(block, known)
            at = np.searchsorted(row, np.arange(block.rows.num_rows + 1)).astype(np.int32)
            on = pa.ListArray.from_arrays(pa.array(at), pa.array(np.searchsorted(bins, bin_).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(block.rows.column(block.rows.schema.get_field_index(c)) for c in ("fold", *marks)), on], ["fold", *marks, "on"])

    schema = ", ".join(["fold int", *(f"{m} int" for m in marks), "on array<int>"])
    rows = sample.mapInArrow(select, schema).orderBy("fold", *marks, "on").collect()
    x = np.zeros((len(rows), max(1, len(bins))), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["on"]] = 1
    if not len(rows):
        return Chain(names, bins, [np.r_[np.zeros(max(1, len(bins)) + k), -30.0] for k in range(len(names))], 1.0)
    return fit_chain(x, {c: np.array([r[m] for r in rows]) for c, m in zip(names, marks)}, np.array([r["fold"] for r in rows]), bins)


def scored(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds p_<category> of every category, and toxic (the last one's probability reaches the threshold), to the columns of docs, in place of the text.

    Each category's model reads the text's features and the probabilities of the categories before it.

    Null texts and such without words: probabilities 0, not toxic. Texts are read whole; repeated rows get the same; columns of docs that bear the name of an
    added one (case aside) are replaced. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    added = [*(f"p_{c}" for c in chain.names), "toxic"]
    rest = others(docs, text, *added)
    n = max(1, len(chain.bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(BINS, dtype=bool)
        known[chain.bins] = True
        for block in A.blocks(batches, text):
            row, bin_ = features(block, known)
            some, at = A.words(block).count > 0, np.searchsorted(chain.bins, bin_)
            p = np.zeros((block.rows.num_rows, len(chain.names)))
            for k, w in enumerate(chain.weights):
                z = np.bincount(row, w[at], block.rows.num_rows) + p[:, :k] @ w[n : n + k] + w[-1]
                p[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p[~some] = 0
            yield pa.RecordBatch.from_arrays(
                [*(block.rows.column(block.rows.schema.get_field_index(c)) for c in rest), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(some & (p[:, -1] >= chain.threshold))], [*rest, *added]
            )

    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(c, T.DoubleType()) for c in added[:-1]), T.StructField("toxic", T.BooleanType())])
    return docs.select(*(f"`{c}`" for c in rest), f"`{text}`").mapInArrow(run, schema)
