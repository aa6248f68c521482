"""Text to structure: lines, headings, sections and blocks of plain-text standards documents.

`lines` is made of DataFrame functions alone. `parse_documents` runs one kernel a document in
Arrow batches: a document's lines become feature rows once, headings are chosen from the
features, sections are the ranges between headings, and blocks are runs of content lines. All
offsets are kept in bytes, UTF-16 units and code points, so that a slice of the source is the
section's or block's text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vellum.functions import fixed
from vellum.functions.scalars import js_trim, short_hash
from vellum.functions.sentences import fixed_space

PARSER_VERSION = "1.8.0"
#: Parsed documents go out in batches of so many bytes of source or documents.
OUT_BYTES, OUT_ROWS = 2 << 20, 256
#: Furniture by the end of a line: a bracket, an asterisk, or else a digit and white space.
FURNITURE = {end: [re.compile(p) for p in fixed.FURNITURE if next((e for e in "]*" if p.rstrip("$)").endswith("\\" + e)), "0") == end] for end in "]*0"}
RULE_ROW, COLUMN_GAP = re.compile(r"^\s*\+[-=+]{3,}\+?\s*$"), re.compile(r" {3,}\S")
ASSIGNMENT = re.compile(r"^\s*[\w.-]+(?:\s+[\w.-]+)*\s*=\s*[\[{]")
FORM_FEED = re.compile(r"^\f+\s*$")
SPACES, DIGITS = frozenset(fixed_space), frozenset("0123456789")
#: The first letters of headings without numbers, in all their cases, and the marks of a rule.
UNNUMBERED_LEADS, RULE_MARKS = frozenset("AaSsCcNnEeIiRrFfPp\u017f\u0130\u0131"), frozenset("-=*~+")


def lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, line (from 1), start, value, is_blank, is_furniture; a trailing \\r is not part of a value.

    A line's start is the sum of the lengths before it, each with its line end.
    """
    exploded = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "raw"))
    before = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    trimmed = js_trim("value")
    furniture = F.regexp_like(F.col("value"), F.lit(r"^\f+\s*$"))
    for pattern in fixed.FURNITURE:
        furniture = furniture | F.regexp_like(trimmed, F.lit(pattern))
    return (
        exploded.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)))
        .withColumn("value", F.regexp_replace("raw", r"\r$", ""))
        .select(*keys, (F.col("pos") + 1).alias("line"), "start", "value", (trimmed == "").alias("is_blank"), furniture.alias("is_furniture"))
    )


def clean_rendering(text, furniture_lines) -> F.Column:
    """A text with its furniture lines (numbers from 1) blanked out; the number of lines stays."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.array_contains(furniture_lines, i + 1), F.lit("")).otherwise(x)), "\n")


def furniture(value: str, trimmed: str) -> bool:
    """Whether a line is page furniture; every pattern ends in a bracket, an asterisk or a digit, white space aside."""
    if value[:1] == "\f" and FORM_FEED.match(value):
        return True
    last = trimmed[-1:]
    patterns = FURNITURE[last] if last in FURNITURE else FURNITURE["0"] if last.isdecimal() or last.isspace() else ()
    return any([p.search(trimmed) for p in patterns])


class Line:
    __slots__ = ("number", "start", "value", "trimmed", "indented", "furniture", "content", "numbered", "ghost")

    def __init__(self, number: int, start: int, value: str):
        self.number, self.start, self.value, self.ghost = number, start, value, False
        if not value:
            self.trimmed, self.indented, self.furniture, self.content, self.numbered = "", False, False, False, None
            return
        trimmed = self.trimmed = value.strip(fixed_space)
        self.indented = value[0] in SPACES
        self.furniture = furniture(value, trimmed)
        self.content = bool(trimmed) and not self.furniture
        #: The match of a numbered heading; it begins with a digit.
        self.numbered = fixed.NUMBERED.match(trimmed) if trimmed[:1] in DIGITS else None

    @property
    def end(self) -> int:
        return self.start + len(self.value)

    @property
    def indent(self) -> int:
        return len(self.value) - len(self.value.lstrip(fixed_space))


def split_lines(text: str) -> list[Line]:
    out, at = [], 0
    for i, raw in enumerate(text.split("\n"), 1):
        out.append(Line(i, at, raw[:-1] if raw.endswith("\r") else raw))
        at += len(raw) + 1
    return out


def appendix(trimmed: str) -> re.Match | None:
    return fixed.APPENDIX.match(trimmed) if trimmed[:1] in ("A", "a") else None


def title_like(text: str) -> bool:
    """Short, unpunctuated and not the start of a requirement."""
    t = text.strip(fixed_space)
    return bool(t) and len(t) <= fixed.HEADING_CHARS and not ("," in t or ";" in t or t[-1] == "." or "..." in t) and len(t.split()) <= fixed.HEADING_WORDS and not fixed.KEYWORD_LEAD.match(t)


@dataclass
class Heading:
    line: int
    rule: int | None
    number: str
    title: str
    kind: str


class Document:
    """The features of one document's lines, and what follows from them."""

    def __init__(self, text: str):
        self.lines = split_lines(text)
        n = len(self.lines)
        self.next_content: list[Line | None] = [None] * n
        later = None
        for i in range(n - 1, -1, -1):
            self.next_content[i] = later
            if self.lines[i].content:
                later = self.lines[i]
        self.warnings: list[str] = []
        self.toc_start, self.toc_end, self.promised = self._contents()
        self.numbered = self._numbers_sections()
        self.rejected = 0
        self.headings = self._headings()

    def _contents(self) -> tuple[float, float, set[str]]:
        """Where the table of contents is and which numbers it promises; it ends at the first heading in column one."""
        start = next((x.number for x in self.lines if len(x.trimmed) == 17 and x.trimmed.lower() == "table of contents"), None)
        if start is None:
            self.warnings.append("table_of_contents_header_not_found")
            return float("inf"), float("inf"), set()
        numbers, end = set(), start
        for x in self.lines[start:]:
            end = x.number
            if not x.indented:
                if self._opens_body(x.trimmed):
                    break
                continue
            entry = re.sub(r"\.{2,}", " ", x.value.lstrip(fixed_space)).strip(fixed_space)
            if m := fixed.APPENDIX.match(entry):
                numbers.add(f"Appendix {m[1]}")
            elif m := fixed.NUMBERED.match(entry):
                title = re.sub(r"\s+\d+$", "", m[2]).strip(fixed_space)
                if title and len(title) <= fixed.HEADING_CHARS:
                    numbers.add(m[1])
        if end <= start:
            self.warnings.append("toc_unterminated")
        return start, end, numbers

    @staticmethod
    def _opens_body(t: str) -> bool:
        if fixed.APPENDIX.match(t):
            return True
        m = fixed.NUMBERED.match(t)
        return title_like(m[2]) if m else bool(fixed.UNNUMBERED.match(t))

    def _numbers_sections(self) -> bool:
        if self.promised:
            return True
        for x in self.lines:
            if x.content:
                if not x.indented and appendix(x.trimmed):
                    return True
                m = x.numbered
                if m and ("." in m[1] or (m[1] == "1" and not x.indented)):
                    return True
        return False

    def _is_address(self, number: str, trimmed: str) -> bool:
        return number in self.promised or self.numbered or "." in number or bool(re.match(r"^\d+\.(?:\s|$)", trimmed))

    def _rule_below(self, x: Line) -> int | None:
        """The line of dashes under a typeset title: at least three long and three fifths of the title."""
        below = self.next_content[x.number - 1]
        if below is None or below.trimmed[0] not in RULE_MARKS or not fixed.UNDERLINE.match(below.trimmed):
            return None
        t = x.trimmed
        if not t or len(t) > fixed.HEADING_CHARS or not any(c.isalpha() for c in t) or t[-1] in ".,;":
            return None
        size = len(below.trimmed)
        return below.number if size >= 3 and size * 5 >= len(t) * 3 else None

    def _headings(self) -> list[Heading]:
        accepted = lambda m, t: self._is_address(m[1], t) and (m[1] in self.promised or title_like(m[2]))
        top = {m[1] for x in self.lines if x.content and not x.indented and (m := x.numbered) and accepted(m, x.trimmed)}
        out: list[Heading] = []
        for x in self.lines:
            if not x.content:
                continue
            t, rule, numbered = x.trimmed, self._rule_below(x), x.numbered
            named = t[0] in UNNUMBERED_LEADS and len(t) <= 60 and bool(fixed.UNNUMBERED.match(t))
            nested = bool(numbered and x.indented) and not self.toc_start < x.number <= self.toc_end and self._nested(x, numbered, top)
            if x.indented and not named and not nested and rule is None:
                continue
            if (m := appendix(t)) and (title := self._appendix_title(x, m)):
                out.append(Heading(x.number, rule, f"Appendix {m[1]}", title, "appendix"))
            elif numbered:
                if accepted(numbered, t):
                    title = numbered[2].strip(fixed_space)
                    out.append(Heading(x.number, rule, numbered[1], title, section_kind(numbered[1], title)))
                else:
                    self.rejected += 1
            elif rule is not None or named:
                out.append(Heading(x.number, rule, t, t, section_kind("", t)))
        return out

    def _nested(self, x: Line, m: re.Match, top: set[str]) -> bool:
        below = self.next_content[x.number - 1]
        return "." in m[1] and m[1].split(".")[0] in top and title_like(m[2]) and below is not None and below.indent > x.indent

    def _appendix_title(self, x: Line, m: re.Match) -> str:
        title = (m[2] or "").strip(fixed_space)
        if not title and x.number < len(self.lines):
            below = self.lines[x.number]
            title = below.trimmed if below.indented and not fixed.UNDERLINE.match(below.trimmed) else ""
        return title if title and title_like(title) else ""


def section_kind(number: str, title: str) -> str:
    t = title.lower()
    if number.startswith("Appendix"):
        return "appendix"
    if t in ("references", "normative references", "informative references"):
        return "references"
    if t == "index":
        return "index"
    if t.startswith("author") or t == "contributors":
        return "authors"
    return "status" if t in fixed.STATUS_TITLES or t.startswith("status of") else "body"


def section_path(number: str, title: str) -> list[str]:
    if number in ("", title):
        return [title]
    return [*(number.split() if number.startswith("Appendix") else number.split(".")), title]


def _width(value: str) -> int:
    lead = value[: len(value) - len(value.lstrip(" \t"))]
    return len(lead) + 7 * lead.count("\t")


def right_margin(values: list[str]) -> int | None:
    """The common right edge of a two-column masthead: most frequent, at least twice and three fifths."""
    if len(values) < 2 or any(re.search(r"[|+]", v) or fixed.UNDERLINE.match(v.strip(fixed_space)) for v in values):
        return None
    gaps = [len(re.findall(r" {3,}(?=\S)", v)) for v in values]
    if max(gaps) > 1:
        return None
    edges = Counter(len(v.rstrip(fixed_space)) for v, g in zip(values, gaps, strict=True) if g)
    if sum(edges.values()) < 2:
        return None
    edge, count = edges.most_common(1)[0]
    return edge if count >= 2 and count * 5 >= sum(edges.values()) * 3 else None


def is_notation(chunk: list[Line]) -> bool:
    """Tables, diagrams, assignments and mostly quoted text rather than prose."""
    values = [x.value for x in chunk]
    text = " ".join([x.trimmed for x in chunk if x.trimmed])
    if not text:
        return True
    if len(values) > 1 and right_margin([v for v in values if v.strip(fixed_space)]) is not None:
        return False
    share = lambda test: sum([bool(test(v)) for v in values]) / len(values)
    columnar = lambda v: "|" in v or ("+" in v and RULE_ROW.match(v)) or ("   " in v and COLUMN_GAP.search(v.strip(fixed_space)))
    if share(columnar) > 0.4 or share(lambda v: "=" in v and ASSIGNMENT.match(v)) > 0.25:
        return True
    return ('"' in text and len(" ".join(re.findall(r'"[^"]*"', text))) / len(text) > 0.35) or (not text.isascii() and bool(re.search("[┌┐└┘├┤─│]", text)))


def is_prose(chunk: list[Line]) -> bool:
    text = " ".join(x.trimmed for x in chunk if x.trimmed)
    if not text or is_notation(chunk):
        return False
    if not re.search(r"[.!?](?:\s|$)", text) and not (re.match("[A-Z]", text) and chunk[-1].trimmed.endswith(":")):
        return False
    words = text.split()
    return sum(bool(re.match(r"^[A-Za-z][A-Za-z'-]*[.,;:)]?$", w)) for w in words) / len(words) >= 0.5


def is_citation(chunk: list[Line]) -> bool:
    if not fixed.CITATION_TAG.match(chunk[0].value):
        return False
    text = "\n".join(x.value for x in chunk)
    signs = (r'"[^"]{8,}"', r"\b[A-Z][A-Za-z'-]+,\s+[A-Z]\.", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\s*,")
    return any(re.search(p, text) for p in signs) or any(re.search(r"\b(?:19|20)\d{2}\)?\.?\s*$", x.value) for x in chunk)


def is_centred_title(chunk: list[Line], margin: int) -> bool:
    """Indented, unpunctuated lines that stand in the middle of the masthead's width."""
    values = [x.value for x in chunk if x.trimmed]
    bad = lambda v: not v[0].isspace() or re.search(r"[|+]", v) or fixed.UNDERLINE.match(v.strip()) or re.search(r" {3,}(?=\S)", v.strip()) or re.search(r"[.!?]\s*$", v) or fixed.LIST_ITEM.match(v)
    if not values or any(bad(v) for v in values):
        return False
    if len(values) > 1 and len({len(v.rstrip()) for v in values}) == 1:
        return False
    left = _width(values[0])
    return left >= 4 and abs(left - (margin - len(values[0].strip())) / 2) <= 2 and any(c.isalpha() for v in values for c in v)


def block_kind(chunk: list[Line], section: str, citations: bool, title: bool) -> str:
    first = chunk[0].value
    if (citations or section in fixed.BIBLIOGRAPHY_SECTIONS) and is_citation(chunk):
        return "reference_entry"
    if title:
        return "heading"
    if fixed.LIST_ITEM.match(first):
        return "list_item"
    if all([x.value.lstrip().startswith("|") for x in chunk]):
        return "table"
    if is_notation(chunk):
        return "table" if all("|" in x.value or re.search(r" {2,}\S", x.trimmed) for x in chunk) else "preformatted"
    if min([_width(x.value) for x in chunk]) >= 6:
        return "paragraph" if is_prose(chunk) else "preformatted"
    return "paragraph"


def chunks(content: list[Line]) -> list[list[Line]]:
    """Runs of lines that are not blank; a dropped furniture line is blank."""
    out: list[list[Line]] = []
    run = None
    for x in content:
        if x.ghost or not x.trimmed:
            run = None
        elif run is None:
            out.append(run := [x])
        else:
            run.append(x)
    return out


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


class Offsets:
    """Byte and UTF-16 offsets of code point offsets of one text, by prefix sums over it."""

    def __init__(self, text: str):
        self.ascii = text.isascii()
        if not self.ascii:
            self.byte, self.unit = [0], [0]
            for c in text:
                o = ord(c)
                self.byte.append(self.byte[-1] + (1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4))
                self.unit.append(self.unit[-1] + (2 if o >= 0x10000 else 1))

    def places(self, start: int, end: int, first: int, last: int) -> tuple[int, ...]:
        """Bytes, UTF-16 units, code points and lines, as SPAN names them."""
        if self.ascii:
            return start, end, start, end, start, end, first, last
        return self.byte[start], self.byte[end], self.unit[start], self.unit[end], start, end, first, last

    def span(self, start: int, end: int, first: int, last: int) -> dict:
        return dict(zip(SPAN, self.places(start, end, first, last), strict=True))


def regions(doc: Document) -> list[tuple[str, Heading, str | None, int, int]]:
    """(key, heading, parent's key, first line, last line) of the sections; a key and the snapshot make the section's id."""
    found = doc.headings
    first = found[0].line if found else len(doc.lines) + 1
    out: list[tuple[str, Heading, str | None, int, int]] = [] if first == 1 else [("0|front", Heading(0, None, "", "Front Matter", "front_matter"), None, 1, first - 1)]
    last_of: dict[str, str] = {}
    for i, h in enumerate(found):
        parent, key = None, f"{i + 1}|{h.number}|{h.line}"
        if h.number not in ("", h.title) and not h.number.startswith("Appendix"):
            parts = h.number.split(".")
            parent = next((last_of[p] for k in range(len(parts) - 1, 0, -1) if (p := ".".join(parts[:k])) in last_of), None)
        last_of[h.number] = key
        out.append((key, h, parent, h.line, found[i + 1].line - 1 if i + 1 < len(found) else len(doc.lines)))
    return out


def read_sections(doc: Document) -> Iterator[tuple[int, str, Heading, str | None, Line, Line, list[Line]]]:
    """(ordinal, key, heading, parent's key, first and last line of content, kept lines) of the sections that have any content."""
    for ordinal, (key, h, parent, low, high) in enumerate(regions(doc)):
        kept = []
        for x in doc.lines[low - 1 : high]:
            if not doc.toc_start <= x.number <= doc.toc_end and x.number not in (h.line, h.rule):
                x.ghost = x.furniture
                kept.append(x)
        content = [x for x in kept if x.content] or ([doc.lines[h.line - 1]] if h.line else [])
        if content:
            yield ordinal, key, h, parent, content[0], content[-1], kept


def read_blocks(h: Heading, kept: list[Line]) -> Iterator[tuple[int, Line, Line, str]]:
    """(place in the section, first line, last line, kind) of a section's blocks."""
    groups = chunks(kept)
    tagged = sum("[" in g[0].value and bool(fixed.CITATION_TAG.match(g[0].value)) for g in groups) >= 2
    title = None
    if h.kind == "front_matter":
        margins = [right_margin([x.value for x in g if x.trimmed]) for g in groups]
        at = next((i for i, m in enumerate(margins) if m is not None), None)
        if at is not None:
            title = next((i for i in range(at + 1, len(groups)) if is_centred_title(groups[i], margins[at])), None)
    for i, g in enumerate(groups):
        yield i, g[0], g[-1], block_kind(g, h.kind, tagged, i == title)


def parse(rfc: int, snapshot: str, raw: bytes) -> tuple[list[dict], list[dict], dict]:
    """(sections, blocks, quality) of one document's bytes."""
    text = raw.decode("utf-8", "replace")
    warnings = [
        name
        for name, test in (
            ("source_starts_with_bom", text.startswith("﻿")),
            ("source_contains_replacement_characters", "�" in text),
            ("byte_offsets_approximate_invalid_utf8", text.encode() != raw),
            ("source_has_no_trailing_newline", not text.endswith("\n")),
        )
        if test
    ]
    doc, offsets = Document(text), Offsets(text)
    warnings += doc.warnings
    if missing := sorted(doc.promised - {h.number for h in doc.headings}):
        warnings.append("toc_entries_without_heading:" + ",".join(missing[:20]))
    if doc.rejected:
        warnings.append(f"column_one_items_not_sections:{doc.rejected}")
    section_id = lambda key: "sec_" + _sha(f"{snapshot}|{key}")[:24]
    sections, blocks = [], []
    for ordinal, key, h, parent, a, b, kept in read_sections(doc):
        sid, body = section_id(key), text[a.start : b.end]
        common = {"rfc": rfc, "snapshot_id": snapshot}
        sections.append(
            {"id": sid, **common, "number": h.number, "title": h.title, "kind": h.kind, "parent_id": section_id(parent) if parent else None, "ordinal": ordinal, "path": section_path(h.number, h.title), "text": body, "text_sha256": _sha(body)}
            | {"furniture_lines": [x.number for x in kept if x.furniture]}
            | offsets.span(a.start, b.end, a.number, b.number)
        )
        for i, first, last, kind in read_blocks(h, kept):
            body = text[first.start : last.end]
            bid = "blk_" + _sha(f"{snapshot}|{sid}|{i}|{first.start}")[:24]
            blocks.append({"id": bid, **common, "section_id": sid, "ordinal": len(blocks), "kind": kind, "text": body, "text_sha256": _sha(body)} | offsets.span(first.start, last.end, first.number, last.number))
    if not any(s["kind"] == "body" for s in sections):
        warnings.append("no_body_sections_detected")
    degraded = any(w.startswith("no_") or w == "toc_unterminated" for w in warnings)
    return sections, blocks, {"quality": "degraded" if degraded else "complete", "warnings": warnings, "text_length": len(text)}


SPAN = ("byte_start", "byte_end", "char_start", "char_end", "codepoint_start", "codepoint_end", "line_start", "line_end")
_SPAN = [T.StructField(n, T.LongType()) for n in SPAN]
_S, _L = T.StringType(), T.LongType()
SECTION = T.StructType(
    [T.StructField(n, t) for n, t in (("id", _S), ("rfc", _L), ("snapshot_id", _S), ("number", _S), ("title", _S), ("kind", _S), ("parent_id", _S), ("ordinal", _L), ("path", T.ArrayType(_S)), ("text", _S), ("text_sha256", _S), ("furniture_lines", T.ArrayType(_L)))] + _SPAN
)
BLOCK = T.StructType([T.StructField(n, t) for n, t in (("id", _S), ("rfc", _L), ("snapshot_id", _S), ("section_id", _S), ("ordinal", _L), ("kind", _S), ("text", _S), ("text_sha256", _S))] + _SPAN)
PARSED = T.StructType(
    [T.StructField("rfc", _L), T.StructField("snapshot_id", _S), T.StructField("quality", _S), T.StructField("warnings", T.ArrayType(_S)), T.StructField("text_length", _L)]
    + [T.StructField("sections", T.ArrayType(SECTION)), T.StructField("blocks", T.ArrayType(BLOCK))]
)


def parse_documents(docs: DataFrame) -> DataFrame:
    """One row a document of (rfc, snapshot_id, raw): quality, warnings, and nested sections and blocks.

    Store it once (plans.store does) and explode what is wanted; the kernel runs a single time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for rfc, snapshot, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sections, blocks, quality = parse(rfc, snapshot, raw or b"")
                rows.append({"rfc": rfc, "snapshot_id": snapshot, **quality, "sections": sections, "blocks": blocks})
                size += len(raw or b"")
                if size > OUT_BYTES or len(rows) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col("rfc").cast("long"), "snapshot_id", F.col("raw").cast("binary")).mapInArrow(run, PARSED)


def sections(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("sections").alias("s")).select("s.*")


def blocks(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("blocks").alias("b")).select("b.*")


def _flat(docs: DataFrame, rows_of: Callable[[Document, str, Offsets], Iterator[tuple]], fields: list[T.StructField]) -> DataFrame:
    """rfc, snapshot_id and the fields: one row for each tuple that rows_of gives of a document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("rfc", _L), T.StructField("snapshot_id", _S), *fields])
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for rfc, snapshot, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                rows += [(rfc, snapshot, *r) for r in rows_of(Document(text), text, Offsets(text))]
                size += len(text)
                if rows and size > OUT_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("rfc").cast("long"), "snapshot_id", F.col("raw").cast("binary")).mapInArrow(run, schema)


def _hashed(prefix: str, *parts: str) -> F.Column:
    """An id of the snapshot and the parts; null if the first part is."""
    return F.when(F.col(parts[0]).isNotNull(), F.concat(F.lit(prefix), short_hash(F.concat_ws("|", "snapshot_id", *[F.col(p).cast("string") for p in parts]))))


def section_rows(docs: DataFrame) -> DataFrame:
    """The rows of `sections`, made anew from (rfc, snapshot_id, raw): nothing is stored, and hashes that no one reads are not made."""

    def rows_of(doc: Document, text: str, offsets: Offsets) -> Iterator[tuple]:
        for ordinal, key, h, parent, a, b, kept in read_sections(doc):
            furniture_lines = [x.number for x in kept if x.furniture]
            yield key, parent, h.number, h.title, h.kind, ordinal, section_path(h.number, h.title), text[a.start : b.end], furniture_lines, *offsets.places(a.start, b.end, a.number, b.number)

    own = [T.StructField(n, _S) for n in ("key", "parent", "number", "title", "kind")] + [T.StructField("ordinal", _L), T.StructField("path", T.ArrayType(_S)), T.StructField("text", _S), T.StructField("furniture_lines", T.ArrayType(_L))]
    rows = _flat(docs, rows_of, own + _SPAN)
    return rows.withColumns({"id": _hashed("sec_", "key"), "parent_id": _hashed("sec_", "parent"), "text_sha256": F.sha2("text", 256)}).select(*SECTION.names)


#: What `block_rows` says of a block's section.
PLACED = ("section_kind", "section_title", "section_number", "section_titles")


def block_rows(docs: DataFrame) -> DataFrame:
    """The rows of `blocks` with their section's kind, title and number beside them, made anew from (rfc, snapshot_id, raw).

    Entries of a list of references also have section_titles, the lower-case titles of their section and of all above it.
    """

    def rows_of(doc: Document, text: str, offsets: Offsets) -> Iterator[tuple]:
        n, above = 0, {}
        for key, h, parent, _, _ in regions(doc):
            above[key] = [h.title.lower(), *above.get(parent, ())]
        for _, key, h, _, _, _, kept in read_sections(doc):
            for i, first, last, kind in read_blocks(h, kept):
                titles = above[key] if kind == "reference_entry" else None
                yield key, i, n, kind, text[first.start : last.end], h.kind, h.title, h.number, titles, *offsets.places(first.start, last.end, first.number, last.number)
                n += 1

    own = [T.StructField("key", _S), T.StructField("place", _L), T.StructField("ordinal", _L)] + [T.StructField(n, _S) for n in ("kind", "text", "section_kind", "section_title", "section_number")] + [T.StructField("section_titles", T.ArrayType(_S))]
    rows = _flat(docs, rows_of, own + _SPAN).withColumn("section_id", _hashed("sec_", "key"))
    rows = rows.withColumns({"id": _hashed("blk_", "section_id", "place", "codepoint_start"), "text_sha256": F.sha2("text", 256)})
    return rows.select(*BLOCK.names, *PLACED)
