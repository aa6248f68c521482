"""Mixing and license scans against brute force."""

import random
import re

import duckdb
import pandas as pd

from tests.llm.helpers import AWKWARD, LONG, frame
from vellum.llm import licenses, mixing
from vellum.llm.registry import OP9_SQL


def mixed(spark, rows):
    sizes = mixing.sized(frame(spark, rows)).cache()
    return sizes, mixing.assign_positions(sizes)


def test_mix_matches_sql_and_targets(spark):
    rows = [(i, "w " * (i % 37 + 1), None, f"s{i % 5}" if i % 7 else None) for i in range(400)]
    _, assigned = mixed(spark, rows)
    got = {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in assigned.collect()}
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"])  # noqa: F841
    want = {r[0]: (r[1], r[2], round(r[3], 6), r[4]) for r in duckdb.sql(OP9_SQL).fetchall()}
    assert got == want
    by = {}
    for r in assigned.collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert abs(sum(t for t, _ in by.values()) - 1.5 * sum(g[0] for g in got.values())) < 1e-6


def test_capped_source_is_reshared(spark):
    rows = [(1, "a " * 10, None, "a"), (2, "b " * 1000, None, "b"), (3, "c " * 1000, None, "c")]
    _, assigned = mixed(spark, rows)
    t = {r.source: r.target for r in assigned.collect()}
    assert t["a"] == 20.0 and abs(t["b"] - (3015 - 20) / 3) < 1e-9 and abs(t["c"] - 2 * (3015 - 20) / 3) < 1e-9


def test_positions_follow_schedule_and_mix_is_sorted(spark):
    rows = [(i, "w " * 10, None, "abc"[i % 3]) for i in range(300)]
    sizes, assigned = mixed(spark, rows)
    out = [r for part in mixing.mix(frame(spark, rows), assigned, 3).rdd.glom().collect() for r in part]
    places = [r.position for r in out]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    # The first source's weight falls with time, the third's rises.
    mean = lambda s: sum(r.position for r in out if r.source == s) / sum(r.source == s for r in out)
    assert mean("a") < mean("b") < mean("c")
    assert sum(r.take_words for r in out) == sum(r.taken for r in assigned.collect())


def test_mix_awkward_and_empty(spark):
    _, assigned = mixed(spark, AWKWARD)
    rows = assigned.collect()
    assert len(rows) == len(AWKWARD) and {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(frame(spark, AWKWARD), assigned).count() > 0
    assert mixed(spark, [])[1].count() == 0


def brute_base(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_match_brute_force(spark):
    texts = [
        "Released under the MIT License. Also CC-BY 4.0, cc by!",
        "GNU General Public License v2 or later; the Apache License, Version 2.0",
        "mit license mit license MIT\nLICENSE apache-license",
        "Kelvin K sign mit licenſe É",
        "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-clause license",
        LONG + " mit license",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in AWKWARD]
    got = licenses.digest(licenses.scan(frame(spark, rows).where("doc_id IS NOT NULL"))).collect()
    by_id = {}
    for i, t in rows:
        if i is not None:
            by_id.setdefault(i, set()).add(brute_base(t))
    assert len(got) == sum(1 for i, _ in rows if i is not None)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in by_id[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_rules_and_suppression(spark):
    assert len(licenses.rules()) > 200
    row = licenses.digest(licenses.scan(frame(spark, [(1, "Licensed under the GNU General Public License version 3 or later.")]))).first()
    assert "gpl-3-or-later" in row.labels.split(",") and "gpl" in row.labels.split(",")
    kept = licenses.scan(frame(spark, [(1, "the mozilla public license 2.0")])).first().kept
    assert [k.label for k in kept] == ["mpl-2.0"]
    assert licenses.scan(frame(spark, [])).count() == 0


def brute_kept(text):
    """Every rule's matches over the canonical words, then all pairs for suppression."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    canon = " ".join(["", *words, ""])
    found = []
    for order, label, _, regex, priority in licenses.rules():
        for m in re.finditer(regex, canon):
            found.append((priority, order, label, canon[: m.start()].count(" ") - 1, canon[: m.end()].count(" ")))

    def beats(e, d):
        inside, longer = e[3] <= d[3] and e[4] >= d[4], e[4] - e[3] > d[4] - d[3]
        return inside and (e[0] < d[0] or e[0] == d[0] and (longer or e[3:] == d[3:] and e[1] < d[1]))

    return sorted(d for d in found if not any(beats(e, d) for e in found))


def test_licenses_match_brute_force(spark):
    rnd = random.Random(8)
    parts = ["MIT", "License", "licence", "the", "GNU", "general", "public", "GPL", "v3", "2.0", "2", "1", "or later", "or any later version", "Apache", "CC-BY", "SA", "4.0", "creative commons", "attribution",
             "licensed under", "terms of", "bsd", "3-clause", "all rights reserved", "public domain", "\u0130", "\u212a", "É", "freebsd", "zlib", "mozilla", "x11", "expat", "copyright", "1999", "llama", "community license", "lesser", "affero"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["mit license " * 3000 + "under the gnu gpl v3 or later", "M\u0130T license", None, ""]
    got = licenses.scan(frame(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert sorted((k.priority, k.order, k.label, k.start, k.stop) for k in r.kept) == brute_kept(texts[r.doc_id]) if len(texts[r.doc_id] or "") < 5000 else len(r.base) == 3000


def test_coarse_gate_lets_every_rule_through():
    gate = licenses.coarse_gate()
    samples = {
        "gnu gpl 3": "gpl-3",
        "apache 2 0": "apache",
        "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
        "mozilla public license 2 0": "mpl-2.0",
        "redistribution and use in source and binary forms with or without modification": "bsd",
        "all rights reserved": "proprietary",
        "freebsd": "bsd-2-clause",
        "simplified bsd": "bsd-2-clause",
        "mit x11": "x11",
        "licensed under the psf license": "python",
        "creativeml open rail m license": "openrail",
        "wtfpl": "wtfpl",
    }
    for text, label in samples.items():
        assert any(re.search(regex, f" {text} ") and keyword in f" {text} " for _, la, keyword, regex, _ in licenses.rules() if la == label), text
        assert any(g in f" {text} " for g in gate), text


def wordings(parsed):
    """A text for every choice of alternatives, optional parts and characters' first choice."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            options = [chr(arg)]
        elif name == "IN":
            options = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg]
        elif name == "BRANCH":
            options = [w for part in arg[1] for w in wordings(part)]
        elif name == "SUBPATTERN":
            options = wordings(arg[3])
        elif name == "MAX_REPEAT":
            low, _, part = arg
            options = [w * n for w in wordings(part) for n in (low, low + 1)] if low <= 1 else [w * low for w in wordings(part)[:1]]
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in dict.fromkeys(options)]
    return out


def test_gates_let_every_alternative_of_every_rule_through():
    gate, n = licenses.coarse_gate(), 0
    for _, label, keyword, regex, _ in licenses.rules():
        for text in wordings(re._parser.parse(re.fullmatch(r"\(\?<= \)(\(\?:.*\))\(\?= \)", regex)[1])):
            text, n = f" {text} ", n + 1
            assert re.search(regex, text) and keyword in text and any(g in text for g in gate), (label, text)
    assert n > 2 * len(licenses.rules())


def test_zero_clause_bsd_by_its_name(spark):
    row = licenses.digest(licenses.scan(frame(spark, [(1, "under the Zero-Clause BSD license"), (2, "see Zero Clause BSD")]))).orderBy("doc_id").collect()
    assert all("0bsd" in r.labels.split(",") for r in row)
