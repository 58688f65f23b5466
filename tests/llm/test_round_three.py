"""Source divergence, importance resampling and reply trees against brute force, on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyhue.llm import arrow_text as A
from skyhue.llm import divergence, importance, reply_trees
from tests.llm import cases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# divergence


def brute_audit(rows, min_docs, ranks=50):
    """rows: (lang, source, text)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(a or "", b or "", term.findall((t or "").translate(FOLD))) for a, b, t in rows]
    held = collections.Counter((a, x) for a, _, t in docs for x in set(t))
    kept = collections.defaultdict(list)
    for (a, x), n in held.items():
        if n >= min_docs:
            kept[a].append(x)
    count = collections.defaultdict(collections.Counter)
    for a, b, t in docs:
        count[a, b].update(x for x in t if held[a, x] >= min_docs)
        count[a].update(x for x in t if held[a, x] >= min_docs)
    groups = {(a, b) for a, b, _ in docs}

    def part(key, x, v):
        n = sum(count[key].values())
        return 1 + 1_000_000_000 * (count[key][x] + 5) // (n + 5 * v)

    out = []
    for a, b in groups:
        v = len(kept[a])
        p = {x: part((a, b), x, v) for x in kept[a]}
        found = [("pair", c, sum(abs(p[x] - part((a, c), x, v)) for x in kept[a])) for d, c in groups if d == a and c != b]
        found += [("term", x, p[x] - part(a, x, v)) for x in kept[a] if count[a, b][x] and p[x] > part(a, x, v)]
        for name in ("pair", "term"):
            these = sorted((f for f in found if f[0] == name), key=lambda f: (-f[2], f[1].encode()))
            out += [(a, b, name, item, value, k + 1) for k, (_, item, value) in enumerate(these) if name == "pair" or k < ranks]
    return sorted(out)


def audit_rows():
    r = random.Random(5)
    words = ["the", "The", "naïve", "ÀB", "straße", "x1y", "日本", "zebra", "Über", "über"] + [f"w{chr(97 + k)}" for k in range(12)]
    rows = [(r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", None, "é"]), " ".join(r.choice(words[: r.randint(2, len(words))]) for _ in range(r.randint(0, 30)))) for _ in range(150)]
    return rows + [("lonely", "a", "once only"), ("lonely", "b", None), ("zz", "only", "nothing"), ("en", "quiet", "12 34 !!"), rows[0], rows[0], ("en\x00x", "a\x00b", "the\x00zebra")]


@pytest.mark.parametrize("size", [1 << 20, 6])
def test_audit(spark, monkeypatch, size):
    monkeypatch.setattr(divergence, "PROBE", 1)
    rows = audit_rows()
    schema = "lang string, source string, text string, value long, __at long, Term string"
    docs = spark.createDataFrame([(*x, 1, 2, "t") for x in rows], schema).repartition(3)
    got = divergence.audit(docs, min_docs=8, ranks=4, size=size)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 8, 4)


def test_audit_of_awkward_tables(spark):
    assert divergence.audit(cases.empty(spark)).count() == 0
    docs = cases.documents(spark)
    rows = [(x[2], x[3], x[1]) for x in cases.ROWS]
    assert sorted(map(tuple, divergence.audit(docs, min_docs=2).collect())) == brute_audit(rows, 2)
    assert {x.value for x in divergence.audit(docs, min_docs=1000).collect()} == {0}  # no kept term


def test_parts_are_exact_beyond_64_bits(spark):
    n, total, kept = 3 * 10**15 + 7, 10**16 + 1, 123_456
    got = spark.range(1).select(divergence._part(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * kept)


# importance resampling


def block(texts):
    data = [t.encode() for t in texts]
    return A.Block(None, np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("piece", [1 << 19, 3])
def test_features(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = ["", "one", "Two words", "naïve Ünder 日本 x", "a" * 47 + " " + "b" * 48 + " " + "c" * 49 + " " + "d" * 5000 + " e", "--", "a-b_c d", cases.prose(3, 90), "x" * 64 + " " + "y" * 63 + " " + "z" * 129]
    counts, found = importance.features(block(texts), 10_000)
    got = collections.Counter((int(r), int(b)) for rows, buckets in found for r, b in zip(rows, buckets))
    want = collections.Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in brute_features(t)[1])
    assert got == want and counts.tolist() == [len(brute_features(t)[0]) for t in texts]


def brute_resample(rows, target, percent=5, min_words=20):
    own, to = collections.Counter(), collections.Counter()
    for c, texts in ((own, [t for _, t in rows]), (to, target)):
        for t in texts:
            c.update(zlib.crc32(f.encode()) % 10_000 for f in brute_features(t)[1])
    s, t = sum(own.values()), sum(to.values())
    gain = lambda b: math.floor(1000 * math.log((to[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000))))
    out = []
    for i, text in rows:
        w, f = brute_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(x.encode()) % 10_000) for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    long = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(long[: percent * len(long) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("percent", [0, 5, 37, 100])
def test_resampled(spark, percent):
    rows = [(x[0], x[1]) for x in cases.ROWS] + [(100 + i, cases.prose(i % 9, 25 + i % 9)) for i in range(60)]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, score string, place long").repartition(4)
    target = spark.createDataFrame([(1, cases.prose(2, 60)), (2, None), (3, "")], "item_id long, text string")
    got = importance.resampled(docs, target, percent=percent).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, [cases.prose(2, 60), None, ""], percent)


def test_ties_of_score_id_and_features(spark):
    """Scores that tie, also in id and features: exactly the wanted number is drawn."""
    r = random.Random(1)
    rows = [(r.randint(0, 5), r.randint(-3, 3) * 10**12, r.randint(1, 3), i) for i in range(400)] + [(None, 0, 1, 400 + i) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, score long, n_features long, place long").cache()
    order = sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or 0, x[2], x[3]))
    for n in (0, 1, 60, 199, 419, 420):
        got = sorted(map(tuple, table.where(importance.drawn(table, n)).collect()), key=repr)
        assert got == sorted(order[:n], key=repr), n


def test_resampling_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, cases.prose(1, 30))], "doc_id long, text string")
    assert importance.resampled(none, some).count() == 0 and importance.resampled(some, none).count() == 1


# reply trees


def brute_paths(messages):
    """messages: {id: (parent, score)} without repeats -> {root: leaves with their paths}, circles left out."""
    up = {i: p if p in messages else None for i, (p, _) in messages.items()}
    answered, out = set(up.values()), {}
    for i in messages:
        path, seen = [i], {i}
        while up[path[-1]] is not None and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if i not in answered and up[path[-1]] is None:
            out[i] = path[::-1]
    return out


@pytest.mark.parametrize("branches", [None, 1, 2])
def test_paths(spark, branches):
    r = random.Random(9)
    messages = {i: (r.choice([None, 999, *range(max(0, i - 6), i)]) if i else None, float(r.randint(0, 3))) for i in range(150)}
    messages |= {200 + i: (199 + i if i else None, 1.0) for i in range(70)}  # one long chain
    messages |= {300: (302, 1.0), 301: (300, 1.0), 302: (301, 1.0), 303: (302, 1.0)}  # a circle, and a reply to it
    rows = [(i, p, "user" if i % 2 else "assistant", f"m{i}", s, "x") for i, (p, s) in messages.items()]
    df = spark.createDataFrame(rows, "id long, parent long, role string, text string, score double, place string").repartition(5)
    got = collections.defaultdict(list)
    for x in reply_trees.paths(df, branches, score=F.col("score")).collect():
        got[x.tree, x.leaf, x.branch].append((x.place, int(x.text[1:])))
    found = {tuple(m for _, m in sorted(p)): k[2] for k, p in got.items()}
    assert all([q for q, _ in sorted(p)] == list(range(len(p))) for p in got.values())
    want = {tuple(p) for p in brute_paths(messages).values()}
    if branches is None:
        assert set(found) == want and set(found.values()) == {None}
        return
    mean = lambda p: sum(messages[i][1] for i in p) / len(p)
    trees = collections.defaultdict(list)
    for p in want:
        trees[p[0]].append(p)
    assert len(found) == sum(min(branches, len(t)) for t in trees.values())
    for t in trees.values():
        best = sorted(((-mean(p), -len(p)) for p in t))[:branches]
        assert sorted((-mean(p), -len(p)) for p in t if p in found) == best


def test_paths_of_awkward_messages(spark):
    schema = "id long, parent long, role string, text string"
    rows = [(1, None, "user", None), (2, 1, None, "b"), (2, 1, "user", "c"), (3, 2, "tool", "d"), (None, 1, "user", "e"), (None, None, "user", "f"), (4, 4, "user", "self")]
    got = collections.defaultdict(list)
    for x in reply_trees.paths(spark.createDataFrame(rows, schema), None).collect():
        got[x.leaf].append((x.place, x.text))
    assert sorted([t for _, t in sorted(p)] for p in got.values()) == [["", "b", "d"], ["", "c"], ["", "e"], ["f"]]
    assert reply_trees.paths(spark.createDataFrame([], schema)).count() == 0


ODD = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s> [\\INST]", "[ROLE] x [AS] y [/ROLE]", "<<SYS>><</SYS>>", "<<<SYS>>>", "", " ", "\n", "\\", "$1 \\2", "[", "<", "[/INST", "é日本 <s>", "<</s>", " [AS] "]


def test_templates_read_back(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for k in range(r.randint(1, 9)):
            rows.append((c, k, r.choice(["user", "assistant", "system", "tool", "", None, "a [AS] b", "</s>"]), r.choice([*ODD, None, " ".join(r.choices(ODD, k=4))])))
    rows += [(None, 1, "assistant", "null id"), (None, None, "user", "null turn"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (7, 3, "assistant", "tie")]
    rows += [(50, k, "assistant" if k % 2 else "user", cases.prose(k, 30)) for k in range(300)] + [(51, 0, "assistant", cases.LONG)]
    df = spark.createDataFrame([(*x, "n", 3) for x in rows], "conv_id long, turn long, role string, text string, name string, id long").repartition(7)
    chats = reply_trees.formatted(reply_trees.paths(reply_trees.chains(df), name="conversation"))
    chats = chats.select("name", "n_turns", reply_trees.whole_text(F.col("segments")).alias("chat"), reply_trees.learnt(F.col("segments")).alias("loss"))
    got = {x.name: x for x in chats.select("*", reply_trees.turns(F.col("chat")).alias("turns")).collect()}
    want = collections.defaultdict(list)
    for c, k, role, text in rows:
        want[c].append(((k is not None, k or 0), (role is not None, role or ""), text or ""))
    assert set(got) == set(want)
    for c, items in want.items():
        turns = [(role[1], text) for _, role, text in sorted(items)]
        assert [(t.role, t.text) for t in got[c].turns] == turns and got[c].n_turns == len(turns)
        assert got[c].loss == [t for role, t in turns if role == "assistant"]
    assert reply_trees.formatted(reply_trees.paths(reply_trees.chains(df.where("false")))).count() == 0
