"""The pipeline's stages and run() against brute force over a small corpus with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.llm.helpers import LONG, frame
from tests.llm.test_dedup import brute_components
from tests.llm.test_text import brute_spans
from vellum.llm import decontaminate, secrets

WORDS = {"en": "the house and with this water there is a garden by every river road tree stone bridge field", "fr": "le les maison avec leur eau une rue arbre pierre pont champ jardin chaque chemin"}


def corpus():
    rnd = random.Random(3)
    text = lambda lang, n: " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))
    item = text("en", 40)
    rows = [(i, text(lang, rnd.randint(20, 60)), lang, f"s{i % 3}") for i in range(80) for lang in [rnd.choice(list(WORDS))]]
    near = rows[5][1].split()
    near[-1] = "changed"
    edited = ["road" if k % 9 == 8 else w for k, w in enumerate(item.split())]
    rows += [
        (100, rows[3][1], "en", "s0"), (101, rows[3][1].upper(), None, None), (102, " ".join(near), "en", "s1"),
        (103, text("en", 15) + " " + item + " " + text("en", 9), "en", "s1"), (104, " ".join(edited), "en", "s2"),
        (105, text("en", 20) + " password=abcdefgh12 " + text("en", 5), "en", "s0"), (None, text("en", 30), "en", "s0"), (None, item, "en", "s0"), (None, rows[7][1], "en", "s0"),
        (106, None, "en", "s0"), (107, "", "en", "s0"), (108, "12 34 !", "en", "s0"), (109, LONG, "en", "s0"), (109, LONG, "en", "s0"), (110, text("fr", 30), "fr", "s1"), (110, text("fr", 30), "fr", "s1"),
        (111, text("en", 10) + " token: 0123456789abcdef0123456789abcdef", "en", None),
    ]
    return rows, item


def rows_of(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


def brute_dedup(rows):
    """(doc_id, text) of the rows that stay; those of a group in order of doc_id, nulls last."""
    groups, named = {}, [(i, r) for i, r in enumerate(rows)]
    numbered = [(i, r[1]) for i, r in named]
    for (i, _, least), n in brute_components(numbered, 5, 80, 100).items():
        assert n == 1
        groups.setdefault(least, []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out.append({(rows[i][0], rows[i][1]) for i in members if rows[i][0] == (min(ids) if ids else None)})
    return out


def brute_leaks(text, item):
    """The best alignment's share, if the text and the item share a seed."""
    t, b = decontaminate.words_of(text), decontaminate.words_of(item)
    if not {tuple(b[i : i + 4]) for i in range(len(b) - 3)} & {tuple(t[i : i + 4]) for i in range(len(t) - 3)}:
        return 0.0
    h = [0] * (len(t) + 1)
    best = 0
    for w in b:
        row = [0]
        for j, v in enumerate(t):
            row.append(max(0, h[j] + (2 if v == w else -1), h[j + 1] - 1, row[j] - 1))
        best, h = max(best, *row), row
    return best / (2 * len(b))


def brute_mix(rows):
    """Words taken by (doc_id, text): targets by reshaping the excess until no source is above its cap."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    target |= share
    taken = Counter()
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str("null" if r[0] is None else r[0]).encode()).hexdigest(), size(r[1])))
        goal = int(target[s] + 0.5)
        for _ in range(2):
            for r in own:
                n = min(goal, size(r[1]))
                goal -= n
                if n:
                    taken[r[0], r[1]] += n
    return taken


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows, item = corpus()
    root = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, item


def test_stages_match_brute_force_in_order(spark, sf):
    root, item = sf
    docs = spark.read.parquet(f"{root}/documents.parquet")
    given = rows_of(docs)
    kept = rows_of(pipeline.language_id(spark, docs, root))
    # 109 has none of the few words that the languages were learnt from: it is not typical.
    assert Counter(kept) == Counter(r for r in given if re.search(r"[^\W\d_]", r[1] or "") and r[0] != 109)

    # Everything is given to the later stages, so that each meets every awkward row.
    got, want = Counter((r[0], r[1]) for r in rows_of(pipeline.near_dedup(spark, docs, root))), brute_dedup(given)
    for group in want:
        assert sum(got[x] for x in group) == 1
    assert sum(got.values()) == len(want)

    got = Counter(rows_of(pipeline.decontamination(spark, docs, root)))
    assert got == Counter(r for r in given if len(r[1] or "") > 9999 or brute_leaks(r[1], item) < decontaminate.THRESHOLD)
    assert not any(r[0] in (103, 104) for r in got) and not any(r[1] == item for r in got)

    def masked(t):
        marks = bytearray(len(t))
        for _, a, b in brute_spans(t):
            marks[a:b] = b"\1" * (b - a)
        return re.sub("\0+", "[SECRET]", "".join("\0" if m else c for c, m in zip(t, marks, strict=True)))

    got = Counter(rows_of(pipeline.secret_scan(spark, docs, root)))
    assert got == Counter((r[0], masked(r[1]) if r[1] else r[1], r[2], r[3], len(masked(r[1])) if r[1] and masked(r[1]) != r[1] else r[4]) for r in given)

    mixed = pipeline.mix(spark, docs, root).collect()
    assert Counter((r.doc_id, r.text) for r in mixed for _ in range(r.take_words)) == brute_mix(given)
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)


def test_run_and_empty_tables(spark, sf, tmp_path):
    root, _ = sf
    out = pipeline.run(spark, root).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {100, 101, 102, 103, 104, 106, 107, 108} and {105, 111} <= ids
    assert all("password" not in r.text for r in out if r.doc_id == 105)
    empty = str(tmp_path)
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{root}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert pipeline.decontamination(spark, docs, empty).count() == docs.count()
    assert secrets.BASE_KINDS == ("assign", "access", "hex")
