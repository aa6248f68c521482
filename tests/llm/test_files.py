"""ZIP packages, WARC records and nearest neighbours."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest

from vellum.llm import ann, warc, zips
from vellum.plans.runtime import Scratch


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader_and_writer(zip64):
    f = io.BytesIO()
    parts = [("a/x.bin", [b"hello ", b"world"]), ("é.txt", [b""]), ("indexes/i", [b"1\n2\n"])]
    size = zips.write_stored(f, parts, zip64)
    assert size == len(f.getvalue())
    assert [(i.filename, zipfile.ZipFile(f).read(i)) for i in zipfile.ZipFile(f).infolist()] == [(n, b"".join(p)) for n, p in parts]
    for m, (n, p) in zip(zips.members(f, size), parts, strict=True):
        f.seek(zips.data_offset(f, m))
        assert m.name == n and m.stored and f.read(m.size) == b"".join(p)


def test_zip_reader_on_foreign_archives():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr(zipfile.ZipInfo("stored"), b"abc" * 10)
        z.writestr("deflated", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    found = zips.members(f, len(f.getvalue()))
    assert [m.stored for m in found] == [True, False]
    with pytest.raises(zips.ZipError):
        zips.members(io.BytesIO(b"not a zip" * 10), 90)


def brute_pages(pages):
    payload = {i: (h or "").encode() for i, (_, _, h) in enumerate(pages)}
    owner = {}
    for i, (p, _, _) in enumerate(pages):
        if len(payload[i]) >= 1000 and p is not None:
            owner[payload[i]] = max(owner.get(payload[i], p), p)
    out = []
    for i, (p, _, _) in enumerate(pages):
        o = owner.get(payload[i])
        revisit = o is not None and p != o
        out.append((p, len(payload[i]), hashlib.sha1(payload[i]).hexdigest(), "revisit" if revisit else "response", o if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("zip64", [None, True])
def test_warc_round_trip(spark, zip64):
    big = "<p>é repeated</p>" * 100
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://c/ d\n", big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", "x" * 300000), (7, "u", "x" * 300000), (8, "u", "y" * 999), (10, "u", "y" * 999), (None, "u", "no id")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, payload string")
    got = warc.round_trip(pages, Scratch(spark, "t"), payloads=True, zip64=zip64).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_pages(rows)
    text = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert text[9] == big and text[3] == "" and text[7] == "x" * 300000
    assert warc.round_trip(pages.limit(0), Scratch(spark, "t")).count() == 0


def test_warc_parse_checks_records():
    good = warc.record(1, "http://x/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"PAYLOAD\r\n"))


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=6)
    cells = ann.traverse(a, b, np.ones(36, int), 36)
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert sorted(cells) == list(range(36)) and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:], strict=False))


def test_neighbours_reach_recall_and_handle_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[500:560] = x[500]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(20000, None, 1), (20020, [0.0] * 16, 1), (20040, [float("nan")] * 16, 1), (20060, [1.0, None] * 8, 1), (20080, [1.0] * 3, 1), rows[40], rows[41], rows[60]]
    x, ids = np.concatenate([x, [[1.0] * 3 + [0.0] * 13], x[[40, 41, 60]]]), np.array([*range(3000), 20080, 40, 41, 60])
    random.Random(1).shuffle(rows)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), Scratch(spark, "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {*range(0, 3000, 20), 20080}
    hits = wanted = 0
    for q, found in by.items():
        found.sort()
        for own in np.flatnonzero(ids == q)[:1]:
            scores = x @ x[own]
            order = [i for i in np.lexsort((ids, -scores)) if i != own][:20]
        times = sum(ids == q)
        assert [f[0] for f in found] == sorted([*range(1, 21)] * times)
        assert times > 1 or q not in [f[1] for f in found]
        assert all(min(abs(f[2] - s) for s in scores[ids == f[1]]) < 1e-9 for f in found)
        if times == 1:
            assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
            hits, wanted = hits + len({f[1] for f in found} & set(ids[order].tolist())), wanted + len(set(ids[order].tolist()))
    assert hits / wanted >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (20, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, rank int")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(few, Scratch(spark, "t")).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.search(few.limit(0), Scratch(spark, "t")).count() == 0
