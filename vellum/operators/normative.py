"""Statements of requirement: mentions, requirements, candidates, declaratives and coverage.

`sentences` turns blocks into sentence rows once (one Arrow kernel); everything that a Column
expression can say about a sentence is said in Spark, and the clause and shape readings, which
depend on word order, run in Arrow batches over the few sentences that need them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vellum.functions import fixed, scalars
from vellum.functions import sentences as sentence_functions

EXTRACTOR_VERSION = "1.7.1"
RADIUS = 160


def mapped(df: DataFrame, f: Callable, column: str, kind: T.DataType, arrow: pa.DataType, *inputs: str) -> DataFrame:
    """df with a column computed by a Python function of other columns, in Arrow batches.

    Only the inputs go to Python, and nothing is computed if no one reads the column. It counts as
    not deterministic, so that a filter on the column does not compute it a second time.
    """

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*r) for r in zip(*(c.to_pylist() for c in columns), strict=True)], arrow)

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    # Spark reads the kind of function off its arguments.
    udf = F.arrow_udf((one, two, three)[len(inputs) - 1], kind).asNondeterministic()
    return df.withColumn(column, udf(*[F.col(c) for c in inputs]))


PIECE = [T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType())]
PLACES = T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("at", T.IntegerType())]))
PIECES, TERM_PIECES = T.ArrayType(T.StructType(PIECE)), T.ArrayType(T.StructType([*PIECE, T.StructField("places", PLACES)]))
ARROW_PIECE = [("text", pa.string()), ("start", pa.int32())]
ARROW_PLACES = pa.list_(pa.struct([("raw", pa.string()), ("at", pa.int32())]))
TERM = re.compile(fixed.TERM_PATTERN)


def _pieces(text: str | None) -> list[dict]:
    return [{"text": s.text, "start": s.start} for s in sentence_functions.split(text or "")]


def _term_pieces(text: str | None) -> list[dict]:
    return [{"text": s.text, "start": s.start, "places": [{"raw": m[0], "at": m.start()} for m in TERM.finditer(s.text)]} for s in sentence_functions.split(text or "")]


def sentences(blocks: DataFrame, text: str = "text", terms: bool = False, outer: bool = False) -> DataFrame:
    """blocks' columns with sentence, sentence_no and sentence_start (code points in the block); with terms, also the places of its terms.

    With outer, a block without sentences stays, with nulls.
    """
    if terms:
        cut = mapped(blocks, _term_pieces, "_pieces", TERM_PIECES, pa.list_(pa.struct([*ARROW_PIECE, ("places", ARROW_PLACES)])), text)
    else:
        cut = mapped(blocks, _pieces, "_pieces", PIECES, pa.list_(pa.struct(ARROW_PIECE)), text)
    out = cut.select(*blocks.columns, (F.posexplode_outer if outer else F.posexplode)("_pieces").alias("sentence_no", "_p"))
    return out.select(*blocks.columns, "sentence_no", F.col("_p.text").alias("sentence"), F.col("_p.start").alias("sentence_start"), *(["_p.places"] if terms else []))


def with_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """blocks with their section's kind (unknown if there is none), title and number; `structure.block_rows` has them already."""
    if "section_kind" in blocks.columns:
        return blocks.withColumn("section_resolved", F.lit(True))
    named = sections.select("snapshot_id", F.col("id").alias("section_id"), F.col("kind").alias("section_kind"), F.col("title").alias("section_title"), F.col("number").alias("section_number"), F.lit(True).alias("_has"))
    out = blocks.join(named, ["snapshot_id", "section_id"], "left")
    return out.withColumns({"section_resolved": F.coalesce("_has", F.lit(False)), "section_kind": F.coalesce("section_kind", F.lit("unknown")), "section_title": F.coalesce("section_title", F.lit(""))}).drop("_has")


def in_scope() -> Column:
    return F.col("kind").isin(*fixed.PROSE_KINDS) & ~F.col("section_kind").isin(*fixed.SKIPPED_SECTIONS)


_QUOTED = r"(?i)[\"'`]\s*(?<![A-Za-z0-9_])(?:" + "|".join(fixed.TERMS) + r")\s*[\"'`]"
_META = "(?i)" + fixed.META_DISCUSSION.pattern
_TITLE = "(?i)" + fixed.DEFINITION_TITLE.pattern


def mentions(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per term occurrence in the prose blocks, with disposition, flags, span, context and ids."""
    prose = with_sections(blocks, sections).where(in_scope())
    found = sentences(prose.where(F.regexp_like("text", F.lit(fixed.TERM_PATTERN))), terms=True).where(F.size("places") > 0)
    distinct = F.size(F.array_distinct(F.transform("places", lambda p: scalars.normalise_term(p["raw"]))))
    rows = found.withColumns(
        {
            "enumerates": (distinct >= 3) | F.regexp_like("sentence", F.lit(_META)),
            "n_terms": F.size("places"),
        }
    ).withColumn("defines", F.col("enumerates") | F.regexp_like("sentence", F.lit(_QUOTED)) | F.regexp_like(scalars.js_trim("section_title"), F.lit(_TITLE)))
    rows = rows.select("*", F.posexplode("places").alias("term_no", "place")).withColumns({"raw": F.col("place.raw"), "at": F.col("place.at")})
    positive = scalars.normalise_term("raw")
    after = F.substr("sentence", F.col("at") + F.length("raw") + 1)
    before = F.substr("sentence", F.lit(1), F.col("at"))
    negated = F.regexp_like(after, F.lit(rf"^[ \t\r\n\f]*(?i:not|no){fixed.AFTER}"))
    folded = F.concat(positive, F.lit(" NOT"))
    fold = negated & (scalars.term_meta(positive, 1) == "positive") & scalars.term_meta(folded, 0).isNotNull()
    rows = rows.withColumns({"term": F.when(fold, folded).otherwise(positive), "_negated": negated, "quoted": F.regexp_like(before, F.lit(r"[\"'`](?:\s|\(\s*)$")) & F.regexp_like(after, F.lit(r"^(?:\s|\s*\))[\"'`]"))})
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(F.col("_negated") & (scalars.term_meta("term", 1) == "negative") & ~F.endswith("raw", F.lit(" NOT")), "negation_case_not_upper"),
            flag(F.col("quoted"), "term_quoted"),
            flag(F.col("enumerates"), "keyword_enumeration"),
            flag(F.col("defines") & ~F.col("quoted") & ~F.col("enumerates"), "definition_section"),
            flag(F.col("n_terms") > 1, "multiple_terms_in_sentence"),
            flag(F.col("section_kind") == "appendix", "in_appendix"),
            flag(F.col("section_kind").isin("front_matter", "status"), "in_front_matter"),
            flag(F.contains(F.lower("section_title"), F.lit("requirements notation")), "requirements_notation_section"),
            flag(~F.col("section_resolved"), "section_unresolved"),
        )
    )
    start = F.col("char_start") + F.col("sentence_start") + F.col("at")
    mention = scalars.citation_id("snapshot_id", "id", start, "raw")
    return rows.select(
        F.concat(F.lit("men_"), F.substring(mention, 5, 16)).alias("id"),
        "snapshot_id",
        "rfc",
        "section_id",
        "section_number",
        F.col("id").alias("block_id"),
        "sentence_no",
        "term_no",
        "term",
        "raw",
        "at",
        scalars.term_meta("term", 0).alias("strength"),
        scalars.term_meta("term", 1).alias("polarity"),
        F.col("sentence").alias("exact_text"),
        start.alias("char_start"),
        (start + F.length("raw")).alias("char_end"),
        (F.col("char_start") + F.col("sentence_start")).alias("sentence_start"),
        (F.col("byte_start") + scalars.utf8_size(F.substr("text", F.lit(1), F.col("sentence_start") + F.col("at")))).alias("byte_start"),
        scalars.context_around("sentence", "at", F.length("raw"), RADIUS).alias("context"),
        F.when(F.col("quoted") | F.col("defines"), F.lit("definition")).otherwise(F.lit("requirement")).alias("disposition"),
        "defines",
        "quoted",
        flags.alias("flags"),
        scalars.citation_id("snapshot_id", "id", start, "sentence").alias("citation_id"),
        scalars.stable_citation_id("rfc", "section_number", "sentence").alias("stable_id"),
    )


def strip_marker(text: str) -> str:
    rest = fixed.LIST_MARKER.sub("", text, count=1).lstrip()
    return rest or text.lstrip()


def _clean(text: str | None) -> str | None:
    return strip_marker(" ".join(text.split())) or None if text is not None else None


def separator(text: str) -> int:
    """The first comma or semicolon outside brackets, or -1."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c in ",;" and depth == 0:
            return i
    return -1


def clause(text: str, at: int, size: int) -> dict:
    """Who (actor) is to do what (action), under which condition and with which exception."""
    lead, tail = strip_marker(text[:at].rstrip()), text[at + size :]
    condition = early = None
    if m := fixed.CONDITION_LEAD.match(lead):
        rest = lead[m.end() :]
        if (cut := separator(rest)) >= 0:
            condition, lead = (m[0] + rest[:cut]).strip(), rest[cut + 1 :]
    if marks := list(fixed.EARLY_EXCEPTION.finditer(lead)):
        early, lead = lead[: marks[-1].start()].strip() or None, lead[marks[-1].end() :]
    actor = fixed.ACTOR.search(lead)
    action, exception = tail.strip(), None
    if m := fixed.LATE_EXCEPTION.search(tail):
        action, exception = tail[: m.start()].strip(), _clean(m[1])
    return {"actor": _clean(actor[1]) if actor else None, "condition": condition or early, "action": _clean(re.sub(r"[;:,]$", "", action)) if action else None, "exception": exception}


CLAUSE = T.StructType([T.StructField(n, T.StringType()) for n in ("actor", "condition", "action", "exception")])
ARROW_CLAUSE = pa.struct([(n, pa.string()) for n in CLAUSE.names])


def requirements(found: DataFrame) -> DataFrame:
    """One row per sentence that states something: its first unquoted term leads, all its terms are listed.

    found: the rows of `mentions`. As in the source of these rules, the clause is read around
    the first match that is spelled like the leading term; a folded or line-wrapped one is read
    from the sentence's start.
    """
    by = ["snapshot_id", "rfc", "block_id", "sentence_no"]
    listed = F.array_sort(F.collect_list(F.struct("term_no", "term", "strength", "polarity", "char_start", "char_end", "raw", "at", "quoted")))
    of_lead = lambda c: F.min_by(c, F.when(~F.col("quoted"), F.col("term_no"))).alias(f"lead_{c}")
    one = found.where(~F.col("defines")).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("section_id", "section_number", "exact_text", "sentence_start")], listed.alias("terms"), of_lead("flags"), of_lead("context"))
    lead = F.get(F.filter("terms", lambda t: ~t["quoted"]), F.lit(0))
    one = one.withColumn("lead", lead).where(F.col("lead").isNotNull())
    spelled = F.get(F.filter("terms", lambda t: t["raw"] == F.col("lead.term")), F.lit(0))["at"]
    one = one.withColumns({"term": F.col("lead.term"), "clause_at": F.coalesce(spelled, F.lit(0))}).withColumn("term_size", F.length("term"))
    read = mapped(one, clause, "clause", CLAUSE, ARROW_CLAUSE, "exact_text", "clause_at", "term_size")
    flag = lambda c, name: F.when(c, F.lit(name))
    lead_text = F.substr("exact_text", F.lit(1), F.col("clause_at"))
    more = F.array_compact(
        F.array(
            flag(F.regexp_like(lead_text, F.lit(fixed.LIST_MARKER.pattern)), "list_marker_stripped_from_clause"),
            flag(F.regexp_like(F.substr("exact_text", F.lit(1), F.col("clause_at") + 200), F.lit(r"(?i)\bexcept that\b")), "exception_before_keyword"),
            flag(F.size("terms") > 1, "keywords_collapsed_to_one_row"),
            flag(F.col("clause.actor").isNull(), "actor_not_explicit"),
            flag(F.col("clause.action").isNull(), "action_not_explicit"),
        )
    )
    complete = F.col("clause.actor").isNotNull() & F.col("clause.action").isNotNull()
    cit = scalars.citation_id("snapshot_id", "block_id", "sentence_start", "exact_text")
    return read.select(
        F.concat(F.lit("req_"), F.substring(cit, 5, 16)).alias("id"),
        "snapshot_id",
        "rfc",
        "section_id",
        "section_number",
        "block_id",
        "term",
        F.col("lead.strength").alias("strength"),
        F.col("lead.polarity").alias("polarity"),
        F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["strength"].alias("strength"), t["polarity"].alias("polarity"), t["char_start"].alias("char_start"), t["char_end"].alias("char_end"))).alias("keywords"),
        "exact_text",
        F.col("sentence_start").alias("char_start"),
        (F.col("sentence_start") + F.length("exact_text")).alias("char_end"),
        F.col("lead_context").alias("context"),
        "clause",
        F.when(complete, F.lit("complete")).otherwise(F.lit("partial")).alias("parse_status"),
        F.when(complete, F.lit(0.9)).otherwise(F.lit(0.7)).alias("confidence"),
        F.concat("lead_flags", more).alias("flags"),
        cit.alias("citation_id"),
        scalars.stable_citation_id("rfc", "section_number", "exact_text").alias("stable_id"),
    )


def coverage(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Per snapshot: blocks scanned and not, the latter with terms, and by kind (a skipped section's kind wins)."""
    rows = with_sections(blocks, sections)
    scanned = in_scope()
    bucket = F.when(F.col("section_kind").isin(*fixed.SKIPPED_SECTIONS), F.concat(F.lit("section:"), "section_kind")).otherwise(F.col("kind"))
    # The counts by kind come of one list of kinds a document, so that the blocks are read once.
    totals = rows.groupBy("snapshot_id").agg(
        F.count("*").alias("block_count"),
        F.count_if(scanned).alias("scanned"),
        F.count_if(~scanned).alias("unscanned"),
        F.count_if(~scanned & F.regexp_like("text", F.lit(fixed.TERM_PATTERN))).alias("unscanned_with_term"),
        F.collect_list(F.when(~scanned, bucket)).alias("_buckets"),
    )
    count = lambda k: F.struct(k.alias("bucket"), F.size(F.filter("_buckets", lambda x: x == k)).cast("long").alias("count"))
    kinds = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("_buckets")), count))
    return totals.withColumn("unscanned_kinds", F.when(F.size("_buckets") > 0, kinds)).drop("_buckets")


def completeness(totals: DataFrame, n_fragments: Column | None = None, n_requirements: Column | None = None, has_stance: Column | None = None) -> DataFrame:
    """unknown, partial or complete: whether the list of requirements can be taken for all of them."""
    may_hold = F.exists(F.map_keys(F.coalesce("unscanned_kinds", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))), lambda k: ~F.startswith(k, F.lit("section:")) & (k != "heading"))
    partial = may_hold | (F.col("unscanned_with_term") > 0)
    if n_fragments is not None:
        partial = partial | (n_fragments > 0)
    if n_requirements is not None:
        partial = partial | ((n_requirements == 0) & ~(has_stance if has_stance is not None else F.lit(False)))
    unknown = F.col("scanned").isNull() | (F.col("scanned") + F.col("unscanned") != F.col("block_count"))
    return totals.withColumn("completeness", F.when(unknown, F.lit("unknown")).when(partial, F.lit("partial")).otherwise(F.lit("complete")))


ANY_CASE = re.compile(r"\b(?:" + "|".join(t.replace(" ", r"\s+") for t in sorted(fixed.TERMS, key=len, reverse=True)) + r")\b", re.I | re.A)
WORD = re.compile(r"[A-Za-z']+")
SUBJECT_END = re.compile(r"[;:,]|\b(?:is|are|was|were|be|been|has|have|had|do|does|did|can|could|will|would|may|might|shall|should)\b", re.A)


def role(sentence: str, at: int, keyword: str) -> str:
    """modal, non_modal (an adjective or noun of the same spelling) or unknown (nothing before it)."""
    before = sentence[max(0, at - 40) : at]
    if keyword in fixed.NON_MODAL and fixed.NON_MODAL[keyword].search(before):
        return "non_modal"
    if not re.sub(r"^[\s,;:.]+", "", sentence[at + len(keyword) :]).strip():
        return "non_modal"
    return "modal" if before.strip() else "unknown"


def states_obligation(left: str, right: str) -> bool:
    """Whether a modal between these two sides of a sentence can tell anyone to do something."""
    words = [w.lower() for w in WORD.findall(left)]
    after = [w.lower() for w in WORD.findall(right)]
    governor = sentence_functions.last_word(left)
    noun_phrase = governor in fixed.GOVERNORS and bool(after) and not fixed.is_verb(after[0]) and after[0] not in fixed.ADVERBS
    opener = max((i for i, w in enumerate(words) if w in fixed.OPENERS), default=None)
    complement = opener is not None and not any(fixed.is_verb(w) for w in words[opener + 1 :])
    end = SUBJECT_END.search(left)
    subject = WORD.findall(left[: end.start()] if end else left)
    gerund = bool(subject) and bool(re.fullmatch("[A-Za-z]?[a-z]+ing", subject[0].lower())) and subject[0].lower() not in fixed.ING_NOUNS
    document = any(w.lower() in fixed.DOCUMENT_NOUNS for w in subject)
    reported = fixed.ATTRIBUTION.search(left) or fixed.ATTRIBUTION.search(right)
    return not (noun_phrase or complement or gerund or document or fixed.EVALUATIVE.search(right) or reported)


def shape(governed: str, keyword: str, sentence: str, at: int) -> str:
    """demand, description, list_introducer or indeterminate, for the words a keyword governs."""
    governed = governed.strip()
    if not governed:
        return "indeterminate"
    if governed.endswith(":"):
        return "list_introducer"
    first = keyword.split()[0]
    left, right = sentence[:at], sentence[at + len(first) :]
    if sentence_functions.INNER_CUT.search(right):
        return "indeterminate"
    if not states_obligation(left, right):
        return "description"
    words = [w.lower() for w in WORD.findall(governed)]
    if not words:
        return "indeterminate"
    own = set(keyword.split())
    return "demand" if any(fixed.is_verb(w) for w in words if w not in own) else "description"


READING = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("keyword", "normalised", "role", "shape")] + [T.StructField("at", T.IntegerType()), T.StructField("keyword_case", T.StringType())]))
ARROW_READING = pa.list_(pa.struct([*((n, pa.string()) for n in ("keyword", "normalised", "role", "shape")), ("at", pa.int32()), ("keyword_case", pa.string())]))


def keyword_case(keyword: str) -> str:
    """As scalars.keyword_case, for the ASCII words of a match."""
    if keyword == keyword.lower():
        return "lower"
    return "title" if keyword != keyword.upper() and keyword == keyword[:1].upper() + keyword[1:].lower() else "upper"


def read_keywords(sentence: str, upper: bool = True) -> list[dict]:
    """The keywords of a sentence and how they are used; those in upper case only if they are wanted."""
    out = []
    for m in ANY_CASE.finditer(sentence):
        case = keyword_case(m[0])
        if case == "upper" and not upper:
            continue
        keyword = " ".join(m[0].split()).lower()
        out.append({"keyword": m[0], "normalised": keyword, "role": role(sentence, m.start(), keyword), "shape": shape(sentence[m.end() :].split(";")[0], keyword, sentence, m.start()), "at": m.start(), "keyword_case": case})
    return out


#: The first two words of each; few sentences begin with any of them.
_BOILERPLATE_LEAD = f"^{fixed.SPACE_CLASS}*(?:" + "|".join(f"{fixed.SPACE_CLASS}+".join(p.pattern[1:].split(" ")[:2]) for p in fixed.BOILERPLATE) + ")"


def boilerplate(sentence: Column) -> Column:
    text, out = scalars.collapse(sentence), F.lit(False)
    for p in fixed.BOILERPLATE:
        out = out | F.regexp_like(text, F.lit(p.pattern))
    return F.when(F.regexp_like(sentence, F.lit(_BOILERPLATE_LEAD)), out).otherwise(F.lit(False))


def ends_open(text: str) -> Column:
    """Whether a text, white space at its end aside, does not end a sentence."""
    return ~F.regexp_like(text, F.lit(rf"[.!?][\")'\]”’]*\s*\x85?{fixed.SPACE_CLASS}*\z"))


def candidates(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per sentence with a keyword in any case that was not promoted to a requirement.

    A block continues the one before it (of those scanned, in document order) if that one did
    not end a sentence and this one begins in lower case.
    """
    rows = with_sections(blocks, sections).where(~F.col("section_kind").isin(*fixed.SKIPPED_SECTIONS) & (F.col("kind") != "reference_entry"))
    # What the window needs of a text is two flags; texts without a keyword stay behind.
    flags = {"_open": ends_open("text"), "_lower": F.regexp_like("text", F.lit(r"^\s*[a-z]")), "_named": F.regexp_like("text", F.lit("(?i)" + fixed.TERM_PATTERN))}
    rows = rows.withColumns(flags).withColumn("text", F.when(F.col("_named"), F.col("text")))
    open_before = F.lag("_open").over(W.partitionBy("snapshot_id").orderBy("ordinal"))
    rows = rows.withColumn("continues", F.coalesce(open_before, F.lit(False)) & F.col("_lower"))
    found = sentences(rows.where("_named").drop(*flags)).where(~boilerplate(F.col("sentence")))
    reason = F.when(~F.col("kind").isin(*fixed.PROSE_KINDS), F.lit("non_prose_block")).when(F.regexp_like(scalars.js_trim("section_title"), F.lit(_TITLE)), F.lit("definition_section"))
    found = found.withColumn("reason", reason).withColumn("_upper", F.col("reason").isNotNull())
    found = mapped(found, read_keywords, "words", READING, ARROW_READING, "sentence", "_upper").where(F.size("words") > 0)
    start = F.col("char_start") + F.col("sentence_start")
    cit = scalars.citation_id("snapshot_id", "id", start, "sentence")
    lead = F.get("words", F.lit(0))
    first_content = F.length("text") - F.length(F.regexp_replace("text", f"^{fixed.SPACE_CLASS}+", ""))
    return found.select(
        F.concat(F.lit("cnd_"), F.substring(cit, 5, 16)).alias("id"),
        "snapshot_id",
        "rfc",
        "section_id",
        "section_number",
        F.col("id").alias("block_id"),
        F.col("words").alias("keywords"),
        *[lead[n].alias(n) for n in ("keyword", "keyword_case", "role", "shape")],
        "reason",
        (F.col("continues") & (F.col("sentence_start") == first_content)).alias("continues_previous_block"),
        start.alias("char_start"),
        F.col("sentence").alias("exact_text"),
        scalars.context_around("sentence", lead["at"], F.length(lead["keyword"]), RADIUS).alias("context"),
        cit.alias("citation_id"),
    )


def rank_candidates(rows: DataFrame) -> DataFrame:
    """rank_score and rank per snapshot: demands before introducers, modals first, lower case before title, then place."""
    points = lambda c, values: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col(c)), F.lit(0))
    score = points("shape", {"demand": 8, "list_introducer": 3}) + points("role", {"modal": 4, "unknown": 1}) + points("keyword_case", {"lower": 2, "title": 1})
    return rows.withColumn("rank_score", score).withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("rank_score"), "char_start", "id")))


def histogram(rows: DataFrame, by: str) -> DataFrame:
    """Counts by the lead's value; by keyword, every keyword of a row counts."""
    if by == "keyword":
        return rows.select("snapshot_id", F.explode("keywords.normalised").alias("value")).groupBy("snapshot_id", "value").count()
    return rows.where(F.col(by).isNotNull()).groupBy("snapshot_id", F.col(by).alias("value")).count()


def histograms(rows: DataFrame, *axes: str) -> DataFrame:
    """(axis, value, n) over all snapshots: the sums of `histogram` for each axis, with the rows read once."""
    named = lambda axis, value: F.struct(F.lit(axis).alias("axis"), value.alias("value"))
    parts = [F.transform("keywords", lambda k: named("keyword", k["normalised"])) if axis == "keyword" else F.array(named(axis, F.col(axis))) for axis in axes]
    return rows.select(F.explode(F.concat(*parts)).alias("h")).where("h.value IS NOT NULL").groupBy("h.axis", "h.value").agg(F.count("*").alias("n"))


def declaratives(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per keyword-free sentence that sets a bound, a definition or a default, or why it is excluded."""
    rows = with_sections(blocks, sections)
    outside = F.when(~in_scope(), F.lit("blocks_out_of_scope")).when(F.regexp_like(scalars.js_trim("section_title"), F.lit(_TITLE)), F.lit("definition_section")).when(F.regexp_like("text", F.lit(fixed.LIST_MARKER.pattern)), F.lit("list_item"))
    rows = rows.withColumn("excluded", outside.when(~F.regexp_like("text", F.lit(fixed.DECLARATIVE_GATE)), F.lit("no_quantity_or_definition")))
    kept = rows.where("excluded IS NULL")
    order = W.partitionBy("snapshot_id").orderBy("ordinal")
    open_before = F.lag(ends_open("text")).over(order)
    kept = sentences(kept.withColumn("_open", F.coalesce(open_before, F.lit(False))))
    first_content = F.length("text") - F.length(F.regexp_replace("text", f"^{fixed.SPACE_CLASS}+", ""))
    like = lambda p: F.regexp_like("sentence", F.lit(("(?i)" if p.flags & re.I else "") + p.pattern))
    reason = (
        F.when(boilerplate(F.col("sentence")), F.lit("fixed_boilerplate"))
        .when(F.col("_open") & (F.col("sentence_start") == first_content) & F.regexp_like("text", F.lit(r"^[ \t]*[a-z]")), F.lit("page_break_fragment"))
        .when(F.regexp_like("sentence", F.lit("(?i)" + fixed.TERM_PATTERN)), F.lit("has_keyword"))
        .when(like(fixed.CAPTION), F.lit("caption_or_figure_label"))
        .when(like(fixed.CROSS_REFERENCE), F.lit("cross_reference"))
        .when(like(fixed.BIBLIOGRAPHY_ENTRY), F.lit("bibliography_entry"))
    )
    basis = F.lit(None).cast("string")
    for name, pattern in reversed(fixed.DECLARATIVE):
        basis = F.when(like(pattern), F.lit(name)).otherwise(basis)
    start = F.col("char_start") + F.col("sentence_start")
    cit = scalars.citation_id("snapshot_id", "id", start, "sentence")
    inner = kept.withColumn("excluded", reason).withColumn("basis", F.when(F.col("excluded").isNull(), basis)).where("excluded IS NOT NULL OR basis IS NOT NULL")
    shaped = inner.select(F.concat(F.lit("dec_"), F.substring(cit, 5, 16)).alias("id"), "snapshot_id", "rfc", "section_id", "section_number", F.col("id").alias("block_id"), F.col("sentence").alias("exact_text"), "basis", "excluded", start.alias("char_start"), cit.alias("citation_id"))
    dropped = rows.where("excluded IS NOT NULL").select(F.lit(None).cast("string").alias("id"), "snapshot_id", "rfc", "section_id", "section_number", F.col("id").alias("block_id"), F.lit(None).cast("string").alias("exact_text"), F.lit(None).cast("string").alias("basis"), "excluded", F.col("char_start"), F.lit(None).cast("string").alias("citation_id"))
    return shaped.unionByName(dropped)


def keyword_usage(blocks: DataFrame, limit: int = 5) -> DataFrame:
    """The first notes per snapshot that disclaim or adopt the keywords; the first decides the stance."""
    found = sentences(blocks.where(F.regexp_like("text", F.lit("(?i)key ?word|must|shall|should|may|required|recommended|optional"))))
    stance = F.when(F.regexp_like("sentence", F.lit("(?i)" + fixed.DISCLAIMS.pattern)), F.lit("disclaims")).when(F.regexp_like("sentence", F.lit("(?i)" + fixed.ADOPTS.pattern)), F.lit("adopts"))
    notes = found.withColumn("stance", stance).where("stance IS NOT NULL")
    n = F.row_number().over(W.partitionBy("snapshot_id").orderBy("ordinal", "sentence_no"))
    return notes.withColumn("note_no", n).where(F.col("note_no") <= limit).select("snapshot_id", "rfc", F.col("id").alias("block_id"), "note_no", "stance", F.col("sentence").alias("exact_text"))
