"""XML outlines: a budgeted parser without document types or entities, and the section tree as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import fixed
from vellum.operators.structure import section_kind

# Budgets.
MAX_DEPTH, MAX_NODES, MAX_TEXT, MAX_ATTRIBUTE = 128, 500_000, 64 << 20, 8192
BLOCKS = frozenset("t li dt dd figure artwork table sourcecode".split())
KINDS = {"t": "paragraph", "li": "list_item", "sourcecode": "preformatted", "artwork": "preformatted", "table": "table", "figure": "figure", "reference": "reference_entry"}
#: MAY NOT is not among the outline's terms.
TERMS = re.compile(r"\b(" + "|".join(t for t in sorted(fixed.TERMS, key=len, reverse=True) if t != "MAY NOT") + r")\b", re.A)


class XmlError(ValueError):
    pass


class Node:
    __slots__ = ("local", "attrs", "children", "texts", "start", "end")

    def __init__(self, local: str, attrs: dict, start: int):
        self.local, self.attrs, self.children, self.texts, self.start, self.end = local, attrs, [], [], start, start

    def text(self) -> str:
        return "".join(t if isinstance(t, str) else t.text() for t in self.texts)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += n.children


def parse(data: bytes) -> Node:
    """The root element. Document types, entity declarations and anything over a budget are errors."""
    parser = expat.ParserCreate()
    stack: list[Node] = []
    root: list[Node] = []
    used = {"nodes": 0, "text": 0}

    def refuse(*_):
        raise XmlError("document types and entities are not accepted")

    def start(name: str, attrs: dict):
        used["nodes"] += 1
        if used["nodes"] > MAX_NODES or len(stack) >= MAX_DEPTH or any(len(v) > MAX_ATTRIBUTE for v in attrs.values()):
            raise XmlError("over a budget of nodes, depth or attribute size")
        node = Node(name.split(":")[-1], attrs, parser.CurrentByteIndex)
        if stack:
            stack[-1].children.append(node)
            stack[-1].texts.append(node)
        else:
            root.append(node)
        stack.append(node)

    def end(_):
        node = stack.pop()
        node.end = parser.CurrentByteIndex

    def text(data: str):
        used["text"] += len(data)
        if used["text"] > MAX_TEXT:
            raise XmlError("over the budget of text")
        if stack:
            stack[-1].texts.append(data)

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise XmlError(str(e)) from e
    return root[0]


def page_number(name: str | None) -> str | None:
    """section-1.2 -> 1.2, section-appendix.a.1 -> Appendix A.1."""
    if m := re.fullmatch(r"section-appendix\.([a-z])((?:\.[0-9]+)*)", name or "", re.I):
        return f"Appendix {m[1].upper()}{m[2]}"
    m = re.fullmatch(r"section-([0-9]+(?:\.[0-9]+)*)", name or "")
    return m[1] if m else None


def block_count(nodes: list[Node]) -> int:
    return sum(1 if n.local in BLOCKS else block_count(n.children) for n in nodes)


def _flat(node: Node | None) -> str:
    return " ".join(node.text().split()) if node else ""


def rows(node: Node, parent: str | None = None, depth: int = 0) -> Iterator[dict]:
    """A section and those below it, parents first."""
    child = lambda local: next((c for c in node.children if c.local == local), None)
    a = node.attrs
    anchor = a.get("anchor") or a.get("slug") or (f"pn-{a['pn']}" if a.get("pn") else "")
    name = _flat(child("name"))
    title = _flat(child("title")) if child("title") else name
    number = a.get("number") or page_number(a.get("pn")) or name or None
    text = node.text()
    cited = set(re.findall(fixed.CITATION_SITE, text)) | {n.attrs["target"] for n in node.walk() if n.local == "xref" and n.attrs.get("target")}
    kind = "references" if node.local == "references" else section_kind(number or "", title)
    yield {
        "anchor": anchor,
        "parent_anchor": parent,
        "depth": depth,
        "number": number,
        "title": title,
        "kind": kind,
        "block_count": block_count([c for c in node.children if c.local not in ("section", "references", "title", "name")]),
        "normative_terms": sorted(set(TERMS.findall(text))),
        "references": sorted(cited),
        "byte_start": node.start,
        "byte_end": node.end,
    }
    for c in node.children:
        if c.local in ("section", "references"):
            yield from rows(c, anchor, depth + 1)


FIELDS = (("anchor", T.StringType()), ("parent_anchor", T.StringType()), ("depth", T.IntegerType()), ("number", T.StringType()), ("title", T.StringType()), ("kind", T.StringType()), ("block_count", T.IntegerType()), ("normative_terms", T.ArrayType(T.StringType())), ("references", T.ArrayType(T.StringType())), ("byte_start", T.LongType()), ("byte_end", T.LongType()))
OUTLINE = T.StructType([T.StructField("rfc", T.LongType()), T.StructField("error", T.StringType()), T.StructField("ordinal", T.IntegerType()), *[T.StructField(n, t) for n, t in FIELDS]])


def outline(docs: DataFrame) -> DataFrame:
    """Section rows of (rfc, raw) XML documents; one that is refused gives a row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(OUTLINE)

    def one(rfc, raw) -> list[dict]:
        try:
            root = parse(raw or b"")
        except XmlError as e:
            return [{"rfc": rfc, "error": str(e)}]
        tops = [c for part in root.children if part.local in ("middle", "back", "front") for c in part.children if c.local in ("section", "references", "abstract")]
        found = [r for t in tops or [root] for r in rows(t)]
        return [{"rfc": rfc, "ordinal": i, **r} for i, r in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for rfc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += one(rfc, raw)
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return docs.select(F.col("rfc").cast("long"), F.col("raw").cast("binary")).mapInArrow(run, OUTLINE)
