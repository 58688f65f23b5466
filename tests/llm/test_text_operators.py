"""Operators on documents against brute force, on tables with every awkward case."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from skyhue.llm import arrow_text as A
from skyhue.llm import bpe, components, context_mixing, language, line_quality, minhash, mixing, repeats, suffixes, toxicity
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


def texts():
    return [r[1] for r in cases.ROWS]


# quality rules


def repeated(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    return len({i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)})


def test_measures(docs):
    got = sorted((r.text is None, r.text or "", r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_quality.quality(docs.select("doc_id", "text", "source")).collect())
    want = []
    for t in texts():
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        rep = repeated(w)
        want.append((t is None, t or "", len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)))
    assert got == sorted(want)


def test_shared_lines_go_and_depleted_documents_with_them(spark):
    body = [cases.prose(100 + i, 30) for i in range(40)]
    rows = [(i, f"{body[i]}\nAll  rights   RESERVED here\n{cases.prose(i, 5)}", "en", "a") for i in range(30)]
    rows += [(100 + i, "\n".join(["all rights reserved here"] * 9 + [body[i][:20]]), "en", "a") for i in range(2)]
    rows += [(200 + i, "\n".join([body[39], cases.prose(77, 12)]), "en", "a") for i in range(25)]  # copies don't make their own lines boilerplate
    rows += [(300 + i, f"{body[i + 5]}\nall rights reserved here", "en", None) for i in range(4)]
    got = {r.doc_id: r for r in line_quality.quality(cases.documents(spark, rows).select("doc_id", "text", "source")).collect()}
    first = min((r[0] for r in rows[:32]), key=lambda i: hashlib.md5(next(r[1] for r in rows if r[0] == i).encode()).hexdigest())  # keeps the line
    assert all(got[i].kept and (i == first or got[i].removed_lines == 1 and got[i].clean_text == "\n".join(rows[i][1].split("\n")[::2])) for i in range(30)) and first < 100
    assert not got[100].kept and got[100].removed_words == 36
    assert all(got[200 + i].kept and got[200 + i].removed_lines == 0 for i in range(25))
    assert all(got[300 + i].removed_lines == 0 for i in range(4))


def test_a_family_of_near_copies_leaves_one_after_both_stages(spark):
    """200 near copies of a clean text of ten lines, one word changed in each, in a host of 400 other clean texts."""
    r = random.Random(8)
    base = [cases.prose(900 + i, 12) for i in range(10)]
    rows = [(i, "\n".join(cases.prose(5000 + 10 * i + k, 12) for k in range(10)), "en", "a") for i in range(400)]
    for i in range(200):
        lines = [line.split() for line in base]
        lines[r.randrange(10)][r.randrange(12)] = f"changed{i}"
        rows.append((1000 + i, "\n".join(map(" ".join, lines)), "en", "a"))
    kept = minhash.representatives(corpus_pipeline.staged(line_quality.passed(cases.documents(spark, rows))), shingle=5, percent=80)
    ids = {x.doc_id for x in kept.select("doc_id").collect()}
    assert ids >= set(range(400)) and len(ids) == 401


def test_lines_of_many_texts_go_from_large_hosts(spark):
    rows = [(i, f"{cases.prose(100 + i, 15)}\nin few texts" if i < 12 else cases.prose(100 + i, 15), "en", "a") for i in range(300)]
    docs = cases.documents(spark, rows).select("doc_id", "text", "source")
    removed = lambda **how: line_quality.quality(docs, **how).agg(F.sum("removed_lines")).first()[0]
    assert removed() == 0 and removed(most_docs=12) == 11 and removed(most_docs=13) == 0


def test_quality_of_no_rows_and_of_extra_columns(spark, docs):
    assert line_quality.quality(cases.empty(spark).select("doc_id", "text", "source")).count() == 0
    assert line_quality.passed(docs).columns == docs.columns
    assert {r.doc_id for r in line_quality.passed(docs).collect()} <= {r[0] for r in cases.ROWS}


# near copies


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def test_near_copies(spark):
    r = random.Random(3)
    rows = [(x[0], x[1]) for x in cases.ROWS]
    for g in range(6):
        base = cases.prose(500 + g, 120).split()
        for k in range(8):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append((1000 + 10 * g + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_copies(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(brute_components(rows, 3, 85), key=key)


def test_representatives(spark, docs):
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and 11 not in ids and ids.count(8) == 1 and ids.count(9) == 2
    assert minhash.near_copies(cases.empty(spark)).count() == 0


def test_estimate_is_corrected_for_chance():
    assert minhash.estimate(1.0) == 1 and abs(minhash.estimate(0.25)) < 1e-12


@pytest.mark.parametrize("percent", [80, 85])
def test_estimates_hardly_ever_rule_out_a_pair_at_the_threshold(percent):
    least = minhash.least_equal(percent)
    p = 0.25 + 0.75 * percent / 100
    below = sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(least))
    assert 0 < below < 1e-10


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 5: 3, 9: 3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# repeated passages


@given(st.lists(st.binary(max_size=60) | st.text("ab", max_size=60).map(str.encode), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_deep_shallow_order(strings):
    strings = strings + [s * 3 for s in strings[:5]]
    order, shared = suffixes.deep_shallow(strings)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert a[: shared[k]] == b[: shared[k]] and (shared[k] == min(len(a), len(b)) or a[shared[k]] != b[shared[k]])


def brute_repeats(found, span):
    times = collections.Counter(t[i : i + span] for t in found for i in range(len(t) - span + 1))
    out = []
    for t in found:
        hit = [False] * len(t)
        for i in range(len(t) - span + 1):
            if times[t[i : i + span]] > 1:
                hit[i : i + span] = [True] * span
        edges = [i for i in range(len(t) + 1) if (i > 0 and hit[i - 1]) != (i < len(t) and hit[i])]
        out.append(list(zip(edges[::2], edges[1::2])))
    return out


@pytest.mark.parametrize(("group", "part"), [(20_000, 1 << 22), (2, 300)])
def test_repeats(spark, monkeypatch, group, part):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "PART", part)
    r = random.Random(group)
    passages = ["".join(r.choice("abcdé \n") for _ in range(r.randint(30, 150))) for _ in range(6)]
    rows = ["".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcdefg é") for _ in range(r.randint(5, 60))) for _ in range(r.randint(0, 5))) for _ in range(60)]
    rows += ["ab" * 150, "a" * 300, "a" * 45, rows[0], rows[1], None, "", *(passages[1] + passages[2] + x + passages[0] for x in "xyz")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in repeats.without_repeats(df, add=("n_bytes", "removed", "kept_bytes", "kept_sha256"), span=40, gram=13).collect()}
    for i, (t, want) in enumerate(zip(rows, brute_repeats([(t or "").encode() for t in rows], 40))):
        raw, at, left = (t or "").encode(), 0, b""
        for s, e in want:
            left, at = left + raw[at:s], e
        left += raw[at:]
        assert [(x.s, x.e) for x in got[i].removed] == want and bytes(got[i].kept_bytes) == left and got[i].kept_sha256 == hashlib.sha256(left).hexdigest()


def test_repeats_keep_columns_and_nulls(spark, docs):
    got = repeats.without_repeats(docs)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["kept_text"]
    rows = got.collect()
    assert len(rows) == len(cases.ROWS) and sum(r.kept_text is None for r in rows) == sum(t is None for t in texts())
    assert repeats.without_repeats(cases.empty(spark)).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def pair():
    with open(RANKS, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.codec(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = st.sampled_from(["a", " ", "  ", "'s", "'", "the", "\n", " \n", "é", "1", "...", "\t", "\xa0", "日", "x" * 9, "ing", "\x1c", "'ll", "S", "<|endoftext|>"])


@given(st.lists(PIECES, max_size=60), st.sampled_from([2, 7, 1 << 14]))
@settings(max_examples=200, deadline=None)
def test_encoding_equals_the_library(pair, parts, leaf):
    own, library = pair
    text, before = "".join(parts), bpe.LEAF
    bpe.LEAF = leaf
    try:
        assert own.pieces(text) == own.match(text)
        assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()
    finally:
        bpe.LEAF = before


def test_long_pieces(pair):
    own, library = pair
    r = random.Random(1)
    for n in (300, 3000, 60_000):
        text = "".join(r.choice("abcdeinorst") for _ in range(n))
        assert own.encode(text) == library.encode_ordinary(text)


def test_round_trip(spark, docs, pair):
    got = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, add=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    rows = got.collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for t in texts())
    for r in rows:
        assert r.ids == pair[1].encode_ordinary(bytes(r.decoded).decode()) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    assert bpe.encoded(cases.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


# mixing sources


def test_targets_fill_up_to_the_limits(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 400}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (3, 1, 2), 1.5, 2).collect()}
    whole = 1.5 * sum(sizes.values())
    assert got["a"] == 200 and got["c"] == 20 and abs(sum(got.values()) - whole) < 1e-6
    assert got[None] == 800 and abs(got["b"] - (whole - 1020)) < 1e-6


def test_mix(spark, docs):
    a, b = (sorted(mixing.mix(docs).select("source", "doc_id", "size", "source_size", "target", "taken").collect(), key=str) for _ in range(2))
    assert a == b and len(a) == len(cases.ROWS)
    taken = collections.Counter()
    for r in a:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for r in a:
        assert abs(taken[r.source] - r.target) <= 3
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_mix_as_rows(docs):
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect():
        assert words[r.source] == r.n


# language


def test_language(spark, docs):
    r = random.Random(4)
    kinds = {"en": "the and of thing with", "de": "der und schön nicht über", "fr": "les été déjà avec même"}
    rows = [(i, " ".join(r.choice(kinds[k].split()) for _ in range(30)), k, "s") for i in range(120) for k in [r.choice(sorted(kinds))]]
    known = language.profiles(cases.documents(spark, rows), "text", "lang")
    assert set(known) == set(kinds) and all(len(v) <= language.PROFILE for v in known.values())
    counts = collections.Counter(itertools.chain.from_iterable(language.grams(x[1].encode()).tolist() for x in rows if x[2] == "de"))
    assert known["de"].tolist() == [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]
    got = language.predicted(cases.documents(spark, rows), known)
    assert all(x.lang == x.lang_pred and 0 <= float(x.score) <= 1 for x in got.collect())
    odd = {x.doc_id: (x.lang_pred, x.score) for x in language.predicted(docs, known).collect()}
    assert odd[4] == odd[5] == odd[6] == ("und", 0.0) and odd[10][0] in kinds
    assert language.predicted(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.predicted(cases.empty(spark), known).count() == 0 and language.profiles(cases.empty(spark), "text", "lang") == {}


def test_grams():
    code = lambda *c: sum(ord(x) << 21 * (len(c) - 1 - i) if x != "_" else 1 << 21 * (len(c) - 1 - i) for i, x in enumerate(c))
    assert sorted(language.grams(b"Ab, 7a")) == sorted([code("a"), code("b"), code("a"), code("_", "a"), code("a", "b"), code("b", "_"), code("_", "a"), code("a", "_"), code("_", "a", "b"), code("a", "b", "_"), code("b", "_", "a"), code("_", "a", "_")])
    assert len(language.grams(b" 12 !")) == 0


def test_held_out(spark):
    rows = spark.range(50).select("id", language.held_out(F.col("id"), 4).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


# toxicity


def marked_texts():
    """Texts and their labels; toxic ones hold invented stems with changing ends, junk repeats one sign."""
    r = random.Random(8)
    stems = ["vequor", "zhalun", "grämpf", "odiwex"]
    rows, marks = [], []
    for i in range(400):
        toxic, junk = i % 5 == 0, i % 7 == 3
        w = cases.prose(i, 60).split()
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(stems) + r.choice(["", "s", "ed", "ish", "-", "!"]))
        w += ["~~~", "$$=="] * (12 if junk else 0)
        rows.append((i, " ".join(w), "en", "s"))
        marks.append((i, None if i % 11 == 0 else int(not junk), int(toxic)))
    return rows, marks


def test_toxicity(spark, docs):
    rows, marks = marked_texts()
    table, labels = cases.documents(spark, rows), spark.createDataFrame(marks[:300] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(table, labels)
    assert chain.names == ("low_quality", "toxic") and [len(w) for w in chain.weights] == [len(chain.bins) + 1, len(chain.bins) + 2]
    got = {x.doc_id: x for x in toxicity.scored(table, chain).collect()}
    wrong = [i for i in range(300, 400) if got[i].toxic != bool(marks[i][2])]
    assert len(wrong) <= 2, wrong
    assert sum((got[i].p_low_quality > 0.5) != (i % 7 == 3) for i in range(300, 400)) <= 2
    odd = {x.doc_id: x for x in toxicity.scored(docs, chain).collect()}
    assert odd[4].p_toxic == 0 and not odd[4].toxic and not odd[5].toxic and not odd[6].toxic
    nothing = toxicity.learn(table, labels.limit(0))
    assert toxicity.scored(table, nothing).where("toxic").count() == 0
    assert toxicity.scored(cases.empty(spark), chain).count() == 0
    unknown = toxicity.learn(table, labels.withColumn("quality", F.lit(None).cast("int")))  # an earlier category without a label
    assert sum(x.toxic != bool(marks[x.doc_id][2]) for x in toxicity.scored(table, unknown).collect()) <= 8
    lone = toxicity.learn(table, labels, categories={"toxic": "toxic = 1"})
    assert lone.names == ("toxic",) and toxicity.scored(table, lone).columns[-2:] == ["p_toxic", "toxic"]


def test_toxicity_against_brute_force(spark):
    """Probabilities from grams made word by word, and the chain written out."""
    rows, marks = marked_texts()
    rows += [(900, cases.LONG + " Vequors", "en", "s"), (901, " a  \tb\n\nVEQUOR x", "en", "s"), (902, "é", "fr", "s")]
    table = cases.documents(spark, rows)
    chain = toxicity.learn(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    place, mask = {int(b): i for i, b in enumerate(chain.bins)}, (1 << 64) - 1

    def bin_of(raw: bytes, more: int) -> int:
        h = sum(int(A.SYMBOLS[x]) * pow(int(A.BASE), i, 1 << 64) for i, x in enumerate(raw)) + more & mask
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * times & mask
        return (h ^ h >> 31) >> 44

    known: dict[bytes, set[int]] = {}
    got = {x.doc_id: x for x in toxicity.scored(table, chain).collect()}
    for i, text, *_ in rows[::9] + rows[-3:]:
        on = set()
        for w in text.encode().lower().split():
            if w not in known:
                padded = b" " + w + b" "
                bins = {bin_of(w, 0)} | {bin_of(padded[j : j + k], k) for k in toxicity.GRAMS for j in range(len(padded) - k + 1)}
                known[w] = {place[b] for b in bins if b in place}
            on |= known[w]
        before: list[float] = []
        for w in chain.weights:
            z = sum(float(w[k]) for k in on) + sum(p * float(q) for p, q in zip(before, w[len(place) :])) + float(w[-1])
            before.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert [got[i].p_low_quality, got[i].p_toxic] == pytest.approx(before, abs=1e-4)
        assert got[i].toxic == (got[i].p_toxic >= chain.threshold)


def test_names_that_differ_in_case_only(spark, tmp_path):
    """Extra columns named like an added one in other letters, or like names used inside, are replaced or kept, and the result can be written."""
    base = cases.documents(spark).select("doc_id", "text", "lang", "source").withColumns({"__q_host": F.lit("q"), "__m_place": F.lit("m"), "__M_SALT": F.lit("m")})
    rows, marks = marked_texts()
    chain = toxicity.learn(cases.documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    made = {
        "KEPT": line_quality.quality, "Size": mixing.mix, "Kept_Text": repeats.without_repeats, "Toxic": lambda d: toxicity.scored(d, chain),
        "Score": lambda d: language.predicted(d, {}), "IDS": lambda d: bpe.encoded(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    }
    for name, run in made.items():
        out = run(base.withColumn(name, F.lit("x")))
        assert name not in out.columns and {"doc_id", "__q_host", "__m_place", "__M_SALT"} <= set(out.columns), name
        out.write.parquet(str(tmp_path / name))
        assert out.count() == len(cases.ROWS)


# language model


def test_scores(spark):
    rows = [(i, cases.prose(i % 30, 80), "en", "s") for i in range(60)] + [(x[0], x[1], x[2], x[3]) for x in cases.ROWS if x[1] != cases.LONG]
    df = cases.documents(spark, rows).withColumn("out", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    got = context_mixing.scored(df, F.col("out")).collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(FOLD)), None]
    count = collections.Counter(itertools.chain.from_iterable(tokens(t) for i, t, _, _ in rows if i is None or i % 3))
    n, v = sum(count.values()), len(count)
    want = sorted((i is None, i or 0, len(tokens(t)), sum(w in count for w in tokens(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _, _ in rows)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
    assert {x.train_tokens for x in got} == {n} and all(x.score < 0 for x in got)
    held = [x for x in got if x.held_out and x.n_tokens > 50]
    sizes = {i: len(t.encode()) for i, t, _, _ in rows if t}
    assert sum(-x.score / math.log10(2) for x in held) / sum(sizes[x.doc_id] for x in held) < 4  # bits per byte


def test_probabilities_of_a_byte_sum_to_one(spark):
    df = cases.documents(spark, [(i, cases.prose(i, 40), "en", "s") for i in range(10)]).select("text")
    model = context_mixing.learn(context_mixing.staged(context_mixing.counts(df)))
    import numpy as np

    for context in (b"\0\0\0\0", b" the", b"\xff\x01zz"):
        codes = (int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert abs((10 ** model.log10(codes)).sum() - 1) < 1e-6


def test_scores_without_training_rows(spark):
    df = cases.documents(spark, [(1, "ab", "en", "s")])
    row = context_mixing.scored(df, F.lit(True)).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and abs(row.score - 24 * math.log10(0.5)) < 2
    assert context_mixing.scored(cases.empty(spark), F.lit(False)).count() == 0


def test_counts_of_nodes_are_exact_and_grow_with_the_corpus(spark):
    r = random.Random(12)
    rows = [(i, "".join(r.choice("abcdeé ") for _ in range(150)), "en", "s") for i in range(40)]
    df = cases.documents(spark, rows).select("text")
    model = context_mixing.learn(context_mixing.staged(context_mixing.counts(df)))
    width = context_mixing.ORDERS
    strings = collections.Counter(b[i - width : i] for t in (x[1] for x in rows) for b in [b"\0" * (width - 1) + t.encode() + b"\xff"] for i in range(width, len(b) + 1))
    got = {x.code: (x.n, bytes(x.nodes)) for x in model.rows.collect()}
    assert {k: n for k, (n, _) in got.items()} == {int.from_bytes(k, "big"): n for k, n in strings.items()}
    for key in r.sample(sorted(strings), 200):
        nodes = memoryview(got[int.from_bytes(key, "big")][1]).cast("H")
        for k in range(width):
            same = [(s[-1], n) for s, n in strings.items() if s[width - 1 - k : -1] == key[width - 1 - k : -1]]
            for j in range(8):
                at = [0, 0]
                for last, n in same:
                    if last >> (8 - j) == key[-1] >> (8 - j):
                        at[last >> (7 - j) & 1] += n
                assert list(nodes[16 * k + 2 * j : 16 * k + 2 * j + 2]) == at


def test_bits_per_byte(spark):
    rows = [(i, cases.prose(i % 30, 80), "en", "s") for i in range(60)] + [(100, "", "en", "s"), (101, None, "en", "s")]
    for x in context_mixing.scored(cases.documents(spark, rows), F.col("doc_id") % 3 == 0).collect():
        size = len((dict((i, t) for i, t, *_ in rows)[x.doc_id] or "").encode())
        assert x.bits_per_byte is None if not size else abs(x.bits_per_byte + x.score / math.log10(2) / size) < 1e-9
