"""Scalar functions, sentences and structure kernels."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import fixed, scalars
from vellum.functions.sentences import split
from vellum.operators import normative, structure


@pytest.mark.parametrize(
    "text, expected",
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ("Use it (e.g. Here) now. Done.", ["Use it (e.g. Here) now.", "Done."]),
        ("Wait... Then go. Yes.", ["Wait... Then go.", "Yes."]),
        ("As J. Smith wrote it. Next.", ["As J. Smith wrote it.", "Next."]),
        ("See J. Smith. Next.", ["See J. Smith.", "Next."]),
        ("(It may change.) Note this.", ["(It may change.)", "Note this."]),
        ("Ends here.\nNew line starts. lower does not.", ["Ends here.", "New line starts. lower does not."]),
        ("wrapped line\ngoes on.", ["wrapped line\ngoes on."]),
        ("", []),
        ("  \n ", []),
    ],
)
def test_sentences(text, expected):
    found = split(text)
    assert [s.text for s in found] == expected
    assert all(text[s.start : s.end] == s.text for s in found)


def test_very_long_block_is_linear():
    assert len(split("It is so. " * 50000)) == 50000


def test_spans_of_astral_text(spark):
    row = spark.createDataFrame([("a😀bé",)], "t string").select(scalars.span_at("t", F.lit(2), F.lit(4)).alias("s")).first().s
    assert (row.byte_start, row.byte_end, row.char_start, row.char_end, row.codepoint_start, row.codepoint_end) == (5, 8, 3, 5, 2, 4)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(" a  b\t",)], "t string")
    assert df.select(scalars.collapse("t")).first()[0] == "a b"
    one = lambda c: spark.range(1).select(c).first()[0]
    quote = "The server MUST reply."
    want = hashlib.sha256(f"snp|blk|7|{hashlib.sha256(quote.encode()).hexdigest()[:32]}".encode()).hexdigest()[:24]
    assert one(scalars.citation_id(F.lit("snp"), F.lit("blk"), F.lit(7), F.lit(quote))) == "cit_" + want
    stable = hashlib.sha256(f"rfc9|1.2|{hashlib.sha256(quote.encode()).hexdigest()[:32]}|0".encode()).hexdigest()[:24]
    assert one(scalars.stable_citation_id(F.lit(9), F.lit("1.2"), F.lit(quote))) == "scit_" + stable
    assert [one(scalars.keyword_case(F.lit(k))) for k in ("must", "MUST", "Must", "Must Not", "mUST")] == ["lower", "upper", "title", "upper", "upper"]
    assert [one(scalars.errata_status(F.lit(x))) for x in ("Verified", "Held for Document Update", "held-for-document-update", "odd")] == ["verified", "held_for_document_update", "held_for_document_update", "unknown"]
    assert one(scalars.truncate_bytes(F.encode(F.lit("abcé"), "UTF-8"), 4)) == "abc" and one(scalars.truncate_bytes(F.encode(F.lit("abcé"), "UTF-8"), 5)) == "abcé"
    assert one(scalars.trim_url(F.lit("https://example.org/a(b)).,"))) == "https://example.org/a(b)"
    assert one(scalars.indent_width(F.lit(" \t x"))) == 10
    assert one(scalars.sanitize_snippet(F.lit("\x01a    b\x02"))) == "a  b"
    assert [(p.raw, p.at) for p in one(scalars.places(F.lit("é MUST x MUST\nNOT"), fixed.TERM_PATTERN))] == [("MUST", 2), ("MUST\nNOT", 9)]


def test_word_boundary_is_ascii(spark):
    assert spark.range(1).select(F.regexp_like(F.lit("éMUST"), F.lit(fixed.TERM_PATTERN))).first()[0]


RAW = """Network Working Group                                          A. Author
Request for Comments: 9999                                     Example Co
Category: Standards Track                                    January 2020


                          The Sample Protocol

Abstract

   This is a sample.

Table of Contents

   1. Introduction . . . . . . . . . . . . . . . . 2
   1.1. Terms  . . . . . . . . . . . . . . . . . . 2
   2. References . . . . . . . . . . . . . . . . . 3

1. Introduction

   The server MUST reply to each
Author                                                         [Page 1]
\f
RFC 9999                  Sample Protocol                   January 2020

   request. A client MUST not wait.

1.1. Terms

   - item one
   - item two

   +-----+-----+
   | a   | b   |
   +-----+-----+

Notes
-----

   Some notes with an é and 😀.

Appendix A. More

   More text here.

2. References

   [RFC2119]  Bradner, S., "Key words for use in RFCs", BCP 14, March 1997.

   [X] Example, E., "A title of some length", 2001.
""".encode()


def test_document_structure():
    sections, blocks, quality = structure.parse(9999, "snp_x", RAW)
    assert [(s["number"], s["kind"]) for s in sections] == [("", "front_matter"), ("Abstract", "status"), ("1", "body"), ("1.1", "body"), ("Notes", "body"), ("Appendix A", "appendix"), ("2", "references")]
    by = {s["number"]: s for s in sections}
    assert by["1.1"]["parent_id"] == by["1"]["id"] and by["1.1"]["path"] == ["1", "1", "Terms"] and by["1"]["furniture_lines"]
    for x in [*sections, *blocks]:
        assert RAW[x["byte_start"] : x["byte_end"]].decode() == x["text"]
        assert RAW.decode().encode("utf-16-le")[2 * x["char_start"] : 2 * x["char_end"]].decode("utf-16-le") == x["text"]
    assert [b["kind"] for b in blocks if b["section_id"] == by["2"]["id"]] == ["reference_entry", "reference_entry"]
    assert [b["kind"] for b in blocks if b["section_id"] == by["1.1"]["id"]] == ["list_item", "preformatted"]
    assert not any("---" in b["text"] for b in blocks if b["section_id"] == by["Notes"]["id"])
    assert quality["quality"] == "complete" and quality["warnings"] == []
    assert structure.parse(9999, "snp_x", RAW) == (sections, blocks, quality)


def test_source_warnings():
    _, _, q = structure.parse(1, "s", b"\xef\xbb\xbfplain \xff text")
    assert {"source_starts_with_bom", "source_contains_replacement_characters", "byte_offsets_approximate_invalid_utf8", "source_has_no_trailing_newline", "no_body_sections_detected"} <= set(q["warnings"]) and q["quality"] == "degraded"
    assert structure.parse(1, "s", b"")[0] == []


@pytest.mark.parametrize(
    "sentence, actor, condition, action, exception",
    [
        ("If it fails, the client MUST retry.", "the client", "If it fails", "retry.", None),
        ("The server MUST reply unless it is busy.", "The server", None, "reply", "unless it is busy."),
        ("- A node MUST stop.", "A node", None, "stop.", None),
        ("MUST go.", None, None, "go.", None),
    ],
)
def test_clauses(sentence, actor, condition, action, exception):
    assert normative.clause(sentence, sentence.index("MUST"), 4) == {"actor": actor, "condition": condition, "action": action, "exception": exception}


@pytest.mark.parametrize(
    "sentence, keyword, shape, role",
    [
        ("A client must send a message.", "must", "demand", "modal"),
        ("The recommended method for mail routing is old.", "recommended", "description", "non_modal"),
        ("Servers must do the following:", "must", "list_introducer", "modal"),
        ("Parsing may be slow.", "may", "description", "modal"),
        ("This document should be read first.", "should", "description", "modal"),
        ("That would be a problem and must be fine.", "must", "description", "modal"),
    ],
)
def test_shapes_and_roles(sentence, keyword, shape, role):
    found = next(k for k in normative.read_keywords(sentence) if k["normalised"] == keyword)
    assert (found["shape"], found["role"]) == (shape, role)
