"""Importance resampling towards a target: hashed n-gram features, gains by bucket as an array, the highest perturbed scores drawn by bisection."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyhue.llm import arrow_text as A
from skyhue.llm.tables import ship, staged

#: Buckets of features, words of the longest feature, the seed's text, words that a drawn document has at least, per cent drawn.
BUCKETS, LONGEST, SEED, MIN_WORDS, PERCENT = 10_000, 3, 42, 20, 5
#: Words handled at once, so that a very long text takes no more memory than its words' places.
PIECE = 1 << 19
#: Bytes of a word up to which CRCs are worked out for all words together.
SHORT = 48
#: Thresholds that one count job tries.
TRIES = 31

OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def _zeros(steps: np.ndarray) -> np.ndarray:
    """What steps (the registers after a number of zero bytes, for each byte at each of four places) become after one zero byte more."""
    return CRC[steps & np.uint32(255)] ^ (steps >> np.uint32(8))


def _near_and_far() -> tuple[np.ndarray, list[np.ndarray]]:
    now = np.array([[b << 8 * k for b in range(256)] for k in range(4)], dtype=np.uint32)
    near = [now]
    for _ in range(63):
        near.append(now := _zeros(now))
    far = [_zeros(now)]
    while len(far) < 26:
        t = far[-1]
        far.append(t[0][t & 255] ^ t[1][t >> 8 & 255] ^ t[2][t >> 16 & 255] ^ t[3][t >> 24])
    return np.concatenate([x.ravel() for x in near]), [x.ravel() for x in far]


#: Registers after 0 to 63 zero bytes, and after 64, 128, 256, ... of them.
NEAR, FAR = _near_and_far()


def _moved(table: np.ndarray, base: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.int64)
    return table[base + (c & 255)] ^ table[base + 256 + (c >> 8 & 255)] ^ table[base + 512 + (c >> 16 & 255)] ^ table[base + 768 + (c >> 24)]


def followed(crc: np.ndarray, next_crc: np.ndarray, next_size: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with those of next_crc, next_size bytes long, put behind them."""
    out = _moved(NEAR, (next_size & 63) << 10, crc)
    for k, table in enumerate(FAR if len(next_size) and next_size.max() > 63 else []):
        on = np.flatnonzero(next_size >> (6 + k) & 1)
        if len(on):
            out[on] = _moved(table, 0, out[on])
    return out ^ next_crc


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    sizes, at = size[order], start[order]
    long = int(np.searchsorted(-sizes, -SHORT))
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(sizes[long]) if long < len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))
        c = crc[long:n]
        crc[long:n] = CRC[(c ^ data[at[long:n] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def features(block: A.Block, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words of each row, and (row, bucket) of all runs of one to LONGEST words of a row, a bounded number at a time."""
    data = FOLD[block.data]
    w = A.words(block, OUTSIDE)

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        blank = np.uint32(zlib.crc32(b" "))
        for a in range(0, len(w.start), PIECE):
            b = min(a + PIECE, len(w.start))
            to = min(b + LONGEST - 1, len(w.start))
            row, size = w.row[a:to], w.end[a:to] - w.start[a:to]
            crc = word_crcs(data, w.start[a:to], w.end[a:to])
            behind = followed(np.full(len(crc), blank), crc, size)  # of a blank and the word
            run, n = crc, b - a
            yield row[:n], run[:n] % np.uint32(buckets)
            for more in range(1, LONGEST):
                run = followed(run[: len(crc) - more], behind[more:], size[more:] + 1)
                n = min(b - a, len(run))
                same = row[:n] == row[more : more + n]
                yield row[:n][same], (run[:n] % np.uint32(buckets))[same]

    return w.count, pieces()


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. Tasks count by themselves; only the sums, one for each bucket, reach the driver."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for block in A.blocks(batches, "text"):
            for _, found in features(block, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 * the logarithm of how much likelier each bucket is in the target, rounded down; a feature of each bucket is added to either side."""
    s, t, k = float(own.sum()), float(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(own.tolist(), target.tolist())], dtype=np.int64)


def noise(id: Column, seed: int) -> Column:
    """1000 * a Gumbel value, rounded down, by the id alone. A null id counts as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the features' gains) and score (weight + noise) of every row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in A.blocks(batches, "text"):
            n, found = features(block, len(own))
            weight = np.zeros(len(n), dtype=np.int64)
            for row, bucket in found:
                weight += np.bincount(row, own[bucket], minlength=len(n)).astype(np.int64)
            many = sum(np.maximum(n - k, 0) for k in range(LONGEST))
            ids = block.rows.column(block.rows.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(many.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    found = plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _kth(rows: DataFrame, key: Column, k: int) -> tuple[int, int]:
    """The k-th smallest key, and how many keys are smaller. Each job counts exactly how many keys reach up to each of TRIES thresholds."""
    least = rows.agg(F.min(key), F.max(key)).first()
    low, high, below = least[0], least[1], 0  # below: keys under low
    while low < high:
        step = max(1, -(-(high - low) // (TRIES + 1)))
        tries = list(range(low + step - 1, high, step))[:TRIES] or [low]
        counts = rows.agg(*(F.sum((key <= F.lit(t)).cast("long")) for t in tries)).first()
        at = next((i for i, n in enumerate(counts) if n >= k), len(tries))
        if at:
            low, below = tries[at - 1] + 1, counts[at - 1]
        if at < len(tries):
            high = tries[at]
    return low, below


def drawn(rows: DataFrame, n: int) -> Column:
    """The condition that the n highest scores of a written table (doc_id, score, n_features, place) meet.

    The cutoff is found by bisection over the numbers that order rows: score, then doc_id among rows with the cutoff's score, then n_features and a
    number of the row among rows that repeat an id. Nothing is sorted or sent to the driver but counts.
    """
    if n <= 0:
        return F.lit(False)
    none = F.lit(9_223_372_036_854_775_807)
    taken, tied = F.lit(False), F.lit(True)
    for key in (-F.col("score"), F.coalesce(F.col("doc_id"), none), F.col("n_features"), F.col("place")):
        among = rows.where(tied)
        cut, below = _kth(among, key, n)
        taken, tied, n = taken | (tied & (key < cut)), tied & (key == cut), n - below
    return taken | tied


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank, from 1, in that order: a range of it for each task, and counts of the ranges before."""
    parts = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    counts = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return parts.withColumn("part", part).join(counts, "part").withColumn("rank", place + F.col("before") + 1).drop("part", "before", "__at")


def resampled(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; rank counts the drawn ones, percent of those with min_words words, by score.

    Words are runs of 0-9, a-z (A-Z count as those) and anything beyond ASCII; features are all runs of one to LONGEST words, a CRC-32 deals them to
    BUCKETS. The array of gains is as long as there are buckets, whatever the corpus holds. The noise of Gumbel's distribution makes the highest scores a sample
    without replacement in proportion to exp(weight / 1000).

    Null and empty texts have no features and weight 0, and aren't drawn. Ties go to the smaller id, null ids last; rows that repeat an id and tie are drawn
    in order of n_features, and else are alike. Ids are whole numbers. Texts are read whole. No rows in docs: none come back; no target: every text is scored against
    even buckets. Further columns aren't read, so their names can't clash.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scores = staged(scored(docs, gain, id, text, seed).withColumn("place", F.monotonically_increasing_id()))
    long = scores.where(F.col("n_words") >= min_words)
    taken = drawn(long, percent * long.count() // 100)
    taken = (F.col("n_words") >= min_words) & taken
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("place").asc()]
    return ranked(scores.where(taken), order).select(*out, "rank").unionByName(scores.where(~taken).select(*out, F.lit(None).cast("long").alias("rank")))
