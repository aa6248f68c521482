"""Scalar Column functions: hashes, offsets, white space, ids and classifications."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import fixed

C = str | Column
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(fixed.SPACE_CLASS, c))


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_hash(x: C) -> Column:
    """The first 24 hex digits of SHA-256."""
    return F.substring(F.sha2(col(x), 256), 1, 24)


def utf8_size(x: C) -> Column:
    return F.octet_length(col(x)).cast("long")


def utf16_size(x: C) -> Column:
    return (F.octet_length(F.encode(col(x), "UTF-16BE")) / 2).cast("long")


def span_at(text: C, start: C, end: C) -> Column:
    """struct of byte, UTF-16 and code point offsets of the code point range [start, end) of a text."""
    low, high = F.substr(col(text), F.lit(1), col(start)), F.substr(col(text), F.lit(1), col(end))
    return F.struct(
        utf8_size(low).alias("byte_start"),
        utf8_size(high).alias("byte_end"),
        utf16_size(low).alias("char_start"),
        utf16_size(high).alias("char_end"),
        col(start).cast("long").alias("codepoint_start"),
        col(end).cast("long").alias("codepoint_end"),
    )


def js_trim(x: C) -> Column:
    """White space as JavaScript has it, off both ends."""
    return F.btrim(col(x), F.lit(SPACES))


def collapse(x: C) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(col(x), f"{fixed.SPACE_CLASS}+", " "))


def sanitize_snippet(x: C) -> Column:
    """Control characters to spaces, three or more spaces to two, trimmed."""
    return js_trim(F.regexp_replace(F.regexp_replace(col(x), r"[\x00-\x1F\x7F]", " "), " {3,}", "  "))


def context_around(text: C, start: C, length: C, radius: int = 160) -> Column:
    """`radius` characters to either side of a match, white space collapsed but not trimmed."""
    low = F.greatest(col(start) - radius, F.lit(0))
    high = F.least(col(start) + col(length) + radius, F.length(col(text)))
    return F.regexp_replace(F.substr(col(text), low + 1, high - low), f"{fixed.SPACE_CLASS}+", " ")


def truncate_bytes(raw: C, limit: int) -> Column:
    """The first `limit` bytes as text without a split character; a multi-byte character at the very end is dropped even if whole."""
    data = col(raw).cast("binary")
    head = F.substring(data, 1, limit)
    # Continuation bytes at the end and the lead byte before them go.
    digits = F.regexp_replace(F.hex(head), "(?:[CDEF][0-9A-F])(?:[89AB][0-9A-F])*$", "")
    even = F.when(F.length(digits) % 2 == 0, digits).otherwise(F.hex(head))
    return F.when(F.octet_length(data) <= limit, F.decode(data, "UTF-8")).otherwise(F.decode(F.unhex(even), "UTF-8"))


def citation_id(snapshot: C, block: C, offset: C, quote: C) -> Column:
    """cit_: hash of snapshot, block, character offset and the quote's hash, joined by pipes."""
    return F.concat(F.lit("cit_"), short_hash(F.concat_ws("|", col(snapshot), col(block), col(offset).cast("string"), F.substring(F.sha2(col(quote), 256), 1, 32))))


def stable_citation_id(rfc: C, section: C, quote: C, occurrence: C | None = None) -> Column:
    """scit_: hash of document, section number, quote and occurrence; independent of snapshots."""
    n = F.lit(0) if occurrence is None else col(occurrence)
    return F.concat(F.lit("scit_"), short_hash(F.concat_ws("|", F.concat(F.lit("rfc"), col(rfc).cast("string")), F.coalesce(col(section), F.lit("")), F.substring(F.sha2(col(quote), 256), 1, 32), n.cast("string"))))


def citation_kind(x: C) -> Column:
    return F.when(F.regexp_like(col(x), F.lit("^scit_[0-9a-f]{24}$")), F.lit("stable")).when(F.regexp_like(col(x), F.lit("^cit_[0-9a-f]{24}$")), F.lit("snapshot_scoped")).otherwise(F.lit("unrecognized"))


def snapshot_id(rfc: C, raw: C, metadata_hash: C, parser: str, extractor: str, form: str = "txt") -> Column:
    """snp_: what a derived version depends on."""
    return F.concat(F.lit("snp_"), short_hash(F.concat_ws("|", F.concat(F.lit("rfc"), col(rfc).cast("string")), F.lit(form), F.sha2(col(raw), 256), col(metadata_hash), F.lit(parser), F.lit(extractor))))


def keyword_case(x: C) -> Column:
    """lower, upper or title; any other mixture counts as upper."""
    k = col(x)
    title = F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.substr(k, F.lit(2))))
    return F.when(k == F.lower(k), F.lit("lower")).when(k == F.upper(k), F.lit("upper")).when(k == title, F.lit("title")).otherwise(F.lit("upper"))


def normalise_term(x: C) -> Column:
    return F.regexp_replace(col(x), f"{fixed.SPACE_CLASS}+", " ")


def term_meta(term: C, which: int) -> Column:
    """A term's strength (0) or polarity (1), null for other words."""
    table = F.create_map(*[F.lit(v) for t, meta in fixed.TERMS.items() for v in (t, meta[which])])
    return F.try_element_at(table, col(term))


ERRATA_STATUSES = ("verified", "reported", "held_for_document_update", "rejected")


def errata_status(x: C) -> Column:
    """Lower case with underscores; anything unknown is `unknown`."""
    slug = F.regexp_replace(F.lower(F.trim(col(x))), r"[\s-]+", "_")
    return F.when(slug.isin(*ERRATA_STATUSES), slug).otherwise(F.lit("unknown"))


def trim_url(x: C) -> Column:
    """Trailing punctuation off; closing brackets off as far as they have no opening one."""
    bare = F.regexp_replace(col(x), r"[.,;:]+$", "")
    opens, closes = F.regexp_count(bare, F.lit(r"\(")), F.regexp_count(bare, F.lit(r"\)"))
    trailing = F.length(bare) - F.length(F.regexp_replace(bare, r"\)+$", ""))
    cut = F.greatest(F.lit(0), F.least(trailing, closes - opens))
    out = F.substr(bare, F.lit(1), F.length(bare) - cut)
    return F.when(F.length(out) > len("https://") + 4, out)


def indent_width(x: C) -> Column:
    """Leading spaces count 1, tabs 8."""
    lead = F.regexp_extract(col(x), r"^[ \t]*", 0)
    return F.length(lead) + 7 * F.regexp_count(lead, F.lit(r"\t"))


def places(text: C, pattern: str, group: int = 0) -> Column:
    """array<struct<raw, group, at>>: a pattern's matches with their offsets, from the lengths of what stands between them."""
    t = col(text)
    raw = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else raw
    zipped = F.arrays_zip(raw.alias("raw"), inner.alias("inner"), F.slice(F.split(t, pattern, -1), 1, F.size(raw)).alias("gap"))
    empty = F.array().cast("array<struct<raw:string,inner:string,at:int>>")
    walk = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("n"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["n"] + F.length(x["gap"]) + F.length(x["raw"])).alias("n"),
            F.concat(acc["out"], F.array(F.struct(x["raw"].alias("raw"), x["inner"].alias("inner"), (acc["n"] + F.length(x["gap"])).alias("at")))).alias("out"),
        ),
    )
    return walk["out"]


def stable_json(value) -> str:
    """Sorted keys, no space, nulls kept, non-ASCII as it is; missing values are to be left out by the caller."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
