"""Quality rules: measures of single texts, then lines that many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhue.llm.tables import SPACE, others, text_key, words

#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SALTS = 16
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_words", "clean_text", "kept")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(w: Column) -> Column:
    """How many of the words w stand in a window of WINDOW words that is found twice or more in w."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = _let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    last = F.size(w) - WINDOW
    hashes = F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WINDOW)))))
    return _let(hashes, lambda h: F.when(F.coalesce(F.size(F.array_distinct(h)) == F.size(h), F.lit(True)), F.lit(0)).otherwise(covered(h)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_hashes(text: Column) -> Column:
    """For each \\n-split line: hash of its words, lower-cased and joined by one blank (null without words), and their number."""
    plain = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(_lines(plain), lambda line: _let(F.trim(line), lambda t: F.struct(F.when(t != "", F.xxhash64(t)).alias("line"), F.when(t == "", 0).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).alias("n"))))


def quality(
    docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 10, most_repeated: int = 20, min_docs: int = 10, min_share: float = 0.05, most_removed: float = 0.6, most_docs: int = 10_000
) -> DataFrame:
    """Adds to the columns of docs: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_lines, removed_words, clean_text, kept.

    Base: base_failed where a text has fewer than min_words words, or over most_repeated % of them in repeated five-word windows.

    Cross-document line frequency: lines are compared by a hash of their lower-cased words. A line goes where at least min_docs distinct texts and
    a share of min_share of all distinct texts of the host (or most_docs, whatever the host's size) hold it; copies of one text count once, so that a
    copied text isn't its own boilerplate. The host's first text that holds such a line, by a hash of the text, keeps it: of a family of near copies, whose lines are
    each other's, one is left as it is. clean_text has the other lines. A document is depleted, and rejected, if more than most_removed of its words stood in such lines.
    kept = not base_failed and not depleted.

    A null text has no words and is rejected; clean_text is null then. Null hosts are one host. Rows that repeat one another each get the same
    result. No ids are needed. Columns of docs that bear the name of an added one (case aside) are replaced, others stay; an empty table gives no rows.
    """
    kept = others(docs, *ADDED)
    given = [*kept, *(c for c in docs.columns if c not in kept and c.lower() in (text.lower(), host.lower()))]
    at = {c.lower(): f"c{i}" for i, c in enumerate(given)}
    docs = docs.select(*(F.col(f"`{c}`").alias(at[c.lower()]) for c in given))  # no clash with names used here
    text, host = at[text.lower()], at[host.lower()]
    t, h = F.coalesce(F.col(text), F.lit("")), F.col(host)
    key = F.struct(h.isNull().alias("none"), F.coalesce(h, F.lit("")).alias("host"))
    measures = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    full = _let(F.filter(_lines(t), lambda x: F.rlike(x, F.lit(SPACE.replace("[", "[^")))), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    own = docs.columns
    rows = docs.withColumns({
        "__q_host": key, "__q_key": text_key(text), "__q_m": measures, "__q_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "__q_dup": full.cast("long"), "__q_lines": _line_hashes(t),
        "__q_place": F.conv(F.substring(F.md5(t.cast("binary")), 1, 15), 16, 10).cast("long"),
    })
    # distinct texts of a host that hold a line; each level of counting combines before it is dealt out, so a frequent line or host is no hot task
    held = rows.select("__q_host", "__q_key", "__q_place", F.explode(F.array_distinct(F.transform("__q_lines", lambda x: x["line"]))).alias("line")).where("line IS NOT NULL")
    held = held.select(F.col("__q_host").alias("host"), F.col("__q_key").alias("key"), F.col("__q_place").alias("place"), "line").distinct()
    total = rows.select(F.col("__q_host").alias("host"), F.col("__q_key").alias("key")).distinct().groupBy("host").agg(F.count("*").alias("texts"))
    often = held.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("place").alias("first")).where(F.col("n") >= min_docs)
    often = often.join(total, "host").where((F.col("n") >= min_share * F.col("texts")) | (F.col("n") >= most_docs))
    salted = often.select("host", "line", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    drop = held.withColumn("salt", F.pmod("key.k1", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"]).where("place <> first").groupBy("host", "key").agg(F.collect_list("line").alias("__q_drop"))
    drop = drop.select(F.col("host").alias("__q_dhost"), F.col("key").alias("__q_dkey"), "__q_drop", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__q_dsalt"))
    out = rows.withColumn("__q_salt", F.pmod(F.xxhash64(F.struct(*own)) if own else F.lit(0), F.lit(SALTS)).cast("int"))
    # texts that lose lines grow with the corpus: never broadcast
    out = out.join(drop.hint("merge"), (F.col("__q_host") == F.col("__q_dhost")) & (F.col("__q_key") == F.col("__q_dkey")) & (F.col("__q_salt") == F.col("__q_dsalt")), "left")
    gone = F.filter("__q_lines", lambda x: F.coalesce(F.array_contains("__q_drop", x["line"]), F.lit(False)))
    gone = F.when(F.col("__q_drop").isNotNull(), gone)
    out = out.withColumns({"__q_gone": F.coalesce(F.size(gone), F.lit(0)).cast("long"), "__q_words": F.coalesce(F.aggregate(gone, F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")})
    failed = (F.col("__q_m.n_words") < min_words) | (100 * F.col("__q_m.n_repeat_words") > most_repeated * F.col("__q_m.n_words"))
    clean = F.when(F.col("__q_drop").isNull(), F.col(text)).otherwise(F.array_join(F.filter(_lines(t), lambda x, i: ~F.coalesce(F.array_contains("__q_drop", F.get("__q_lines", i)["line"]), F.lit(False))), "\n"))
    return out.select(
        *(F.col(at[c.lower()]).alias(c) for c in kept), "__q_m.n_words", "__q_m.word_chars", F.col("__q_symbols").alias("n_symbols"), F.col("__q_dup").alias("n_dup_lines"), "__q_m.n_repeat_words", failed.alias("base_failed"),
        F.col("__q_gone").alias("removed_lines"), F.col("__q_words").alias("removed_words"), clean.alias("clean_text"),
        (~failed & ~(F.col("__q_words") > most_removed * F.col("__q_m.n_words"))).alias("kept"),
    )


def passed(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Rows that `quality` keeps, with clean_text as their text and the columns of docs alone."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no clash with names of measures
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = quality(plain, at[text], at[host]).where("kept")
    return kept.select(*(F.col("clean_text" if c == text else at[c]).alias(c) for c in docs.columns))
