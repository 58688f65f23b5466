import struct

import numpy as np
import pytest
import zstandard

from skyhue.llm import curves_ann, warc


def test_hilbert_curve_visits_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = np.argsort(curves_ann.hilbert(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def exact(ids, x, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = x @ x[i]
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:k]
            out[ids[i]] = [ids[j] for j in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[600:650] = x[3]  # many equal ones
    rows = [(i, x[i].tolist()) for i in range(700)]
    odd = [(None, [1.0] * 16), (800, None), (820, [0.0] * 16), (840, [float("nan")] * 16), (860, [1.0, None] * 8), (880, [1.0] * 3), (900, []), (920, [float("inf")] * 16), rows[20]]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, rank string").repartition(3)
    got = {}
    for r in curves_ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(list(range(700)), x.astype(np.float64))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.9
    for q, found in got.items():
        assert [(-s, v) for v, s in found] == sorted((-s, v) for v, s in found) and q not in [v for v, _ in found]
        assert np.allclose([s for _, s in found], [x[v].astype(np.float64) @ x[q].astype(np.float64) for v, _ in found], rtol=1e-12, atol=1e-12)
    same = {3, *range(600, 650)}
    assert [v for v, _ in got[620] if v in same] == [v for v in want[620] if v in same] and len(same & set(want[620])) > 10


def test_vectors_of_any_size(spark):
    """Squares that overflow or vanish take no vector out, and no other one's neighbours."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    x[7] = [1e200, 0, 0, 0]
    x[8] = [0, -1e300, 1e300, 0]
    x[40] = 1e-200
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in curves_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(list(range(60)), x)
    assert set(got) == set(want) == {0, 20, 40} and all(len(v) == 20 for v in got.values())
    hits = [len(set(got[q]) & set(want[q])) for q in (0, 20)]
    assert [got[q][0] for q in (0, 20)] == [want[q][0] for q in (0, 20)] and sum(hits) >= 32, hits


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in curves_ann.nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert curves_ann.nearest(df.limit(0)).count() == 0


PAGES = [(5, "http://a", "x" * 150), (3, None, "x" * 150), (9, "http://b", "y" * 99), (2, "http://c", "y" * 99), (None, "u", "x" * 150), (7, "http://d\r\nX: 1", None), (8, "e", ""), (4, "é ü", "日本" * 60), (4, "é ü", "日本" * 60), (6, "f", "日本" * 60)]


def test_archives(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, size string").repartition(2)
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in warc.round_trip(df).collect())
    want = []
    for i, _, html in PAGES:
        same = [p for p, _, h in PAGES if h == html and p is not None]
        again = len((html or "").encode()) >= 100 and i != min(same)
        want.append((i is None, i or 0, "revisit" if again else "response", min(same) if again else None, len((html or "").encode()), None if again else html or ""))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def some_records(n=40):
    return [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Date": "2024-01-01T00:00:00Z"}, f"<html><body>page number {i} of many</body></html>".encode() * 20) for i in range(n)]


def test_reader_takes_plain_and_packed_dictionaries():
    made = warc.archive(some_records())
    magic, size = struct.unpack_from("<II", made)
    assert magic == warc.DICTIONARY_FRAME
    packed = zstandard.ZstdCompressor().compress(made[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + made[8 + size :]
    extra = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    for raw in (made, again, made + extra):
        assert [b for _, b in warc.records(raw)] == [r.partition(b"\r\n\r\n")[2][:-4] for r in some_records()]
    assert [h["warc-record-id"] for h, _ in warc.records(warc.archive(some_records(2)))] == ["<urn:page:0>", "<urn:page:1>"]
    assert list(warc.records(b"")) == []


@pytest.mark.parametrize("spoil", [
    lambda a: a[:-3], lambda a: a[:4], lambda a: b"1234" + a, lambda a: a[:-20] + bytes([a[-20] ^ 255]) + a[-19:],
    lambda a: a + zstandard.ZstdCompressor().compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"), lambda a: a + zstandard.ZstdCompressor().compress(some_records(1)[0][:-5] + b"\r\n\r\n"),
])
def test_reader_refuses_damaged_archives(spoil):
    with pytest.raises(warc.Damaged):
        list(warc.records(spoil(warc.archive(some_records()))))
