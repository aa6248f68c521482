"""Near duplicates, repeated strings and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.helpers import AWKWARD, LONG, frame, sliced
from vellum.llm import components, neardup, repeats
from vellum.plans.runtime import Scratch


def brute_components(rows, n, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def near_rows():
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(2, 120))] for _ in range(30)]
    rows, at = [], 10
    for b in base:
        for _ in range(rnd.randint(1, 6)):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((at, " ".join(w)))
            at += 1
    line = " ".join(vocab[:60])
    rows += [(at + i, line + " " + " ".join(rnd.choice(vocab) for _ in range(60))) for i in range(40)]
    return rows + [(r[0], r[1]) for r in AWKWARD] + [(5000, "x"), (5001, "x y"), (5002, "X  Y")]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    for n, num in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(frame(spark, rows), Scratch(spark, "t"), n, num, 100).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, num, 100)
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_shingle_sets_of_slices():
    texts = pa.array(["Ab cD é"] * 50 + [None, "", "X y Z w"] + ["q R"] * 20)
    whole = [s.tolist() for s in neardup.shingle_sets(texts, 2)]
    for at, size in ((3, 10), (49, 6), (60, 13)):
        assert [s.tolist() for s in neardup.shingle_sets(texts.slice(at, size), 2)] == whole[at : at + size]


def test_near_duplicates_in_many_slices(spark, monkeypatch):
    sliced(monkeypatch, neardup)
    test_near_duplicates_match_brute_force(spark)


def test_near_duplicates_in_default_slices(spark):
    """Over 8 MB in one batch: several slices of the production size."""
    rnd = random.Random(6)
    vocab = [f"W{i}" for i in range(500)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(9000)) for _ in range(160)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t.lower()) for i, t in enumerate(texts[::8])]
    got = neardup.near_duplicates(frame(spark, rows).coalesce(1), Scratch(spark, "t"), 3, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 85, 100)


def test_long_lists_take_the_full_set_path_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", 2)
    monkeypatch.setattr(neardup, "LONG", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = near_rows()
    got = neardup.near_duplicates(frame(spark, rows), Scratch(spark, "t"), 3, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 85, 100)


def test_least_shared_bounds_the_loss():
    assert 1 <= neardup.least_shared(0.8) < neardup.least_shared(0.85) < neardup.SKETCH


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 175)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == i - i % 10 for i in range(40)) and got[101] == 100 and got[200] == got[175] == 150
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def brute_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in texts for i in range(len(x) - length + 1))
    out = []
    for d, x in texts:
        cover = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for p in bytes(cover).split(b"\0") if p)
        out.append((d, len(x), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(x, cover, strict=True) if not c)).hexdigest()))
    return Counter(out)


def test_repeats_match_brute_force(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 90, 300)]
    rows = [(i, word(rnd.randint(0, 80)) + rnd.choice(shared) + word(rnd.randint(0, 60)) + rnd.choice(["", *shared])) for i in range(60)]
    rows += [(100, "ab" * 200), (101, "a" * 39), (102, "a" * 40), (103, None), (104, ""), (105, shared[4]), (105, shared[4]), (None, shared[3] + "q"), (106, shared[4] + "z" * 45 + shared[4])]
    got = repeats.remove_repeats(frame(spark, rows), Scratch(spark, "t"), length=40, k=8).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 40)
    assert repeats.remove_repeats(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_repeats_in_many_slices(spark, monkeypatch):
    sliced(monkeypatch, repeats)
    test_repeats_match_brute_force(spark)


def test_repeats_production_length(spark):
    rows = [(1, LONG[:900] + "tail one"), (2, "head " + LONG[100:600]), (3, "unique " * 3), (4, None)]
    got = repeats.remove_repeats(frame(spark, rows), Scratch(spark, "t")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)


def test_construction_orders_suffixes():
    rnd = random.Random(9)
    segs = [bytes(rnd.choice(b"ab") for _ in range(30)) for _ in range(40)]
    hits = repeats.construct(repeats.columns(segs, np.zeros(40, int)), np.zeros(40, int), 6)
    for c in range(25):
        tails = Counter(s[c : c + 6] for s in segs)
        assert [bool(h) for h in hits[c]] == [tails[s[c : c + 6]] > 1 for s in segs]


def test_full_sets_give_only_links_that_join_components():
    """A group of near copies of over WIDE shingles: as many pairs as links needed, not as pairs that may be similar."""
    rnd = random.Random(8)
    base = [rnd.getrandbits(62) for _ in range(300)]
    sets = [np.unique(np.array(base[:290] + [rnd.getrandbits(62) for _ in range(10)], np.int64)) for _ in range(60)]
    labels, n = [bytes([i + 1]) * 16 for i in range(60)], np.full(60, 300)
    assert len(list(neardup.compare(n, labels, sets, None, 85, 100, block=16))) == 59
    assert len(list(neardup.compare(n, labels, [s[: neardup.WIDE] for s in sets], neardup.WIDE, 85, 100))) > 59
