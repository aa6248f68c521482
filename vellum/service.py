"""The public operations over a store: each checks its inputs and returns a DataFrame, or a small dict of facts.

Errors that a caller can expect are ServiceError with a code; `batch` isolates them by item.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import scalars
from vellum.operators import citations, diffs, normative, references, search
from vellum.operators.references import MAX_EDGES
from vellum.operators.structure import clean_rendering
from vellum.plans.store import Store

# Limits and the codes that may be retried.
PAGE = {"search": 20, "page": 200, "relations": 100, "citations": 20}
READ_BYTES = (64, 16 << 10, 4 << 20)
SOURCE_BYTES = 2 << 20
BATCH, CANDIDATES, DECLARATIVES, ENSURED, DEPTH = 10, 2000, 2000, 20, 3
RETRYABLE = ("UPSTREAM_UNAVAILABLE", "UPSTREAM_TIMEOUT", "RATE_LIMITED", "STORE_BUSY")


class ServiceError(Exception):
    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.details, self.retryable = code, details, code in RETRYABLE


def check(given: dict, **accepted: Callable) -> dict:
    """The inputs with defaults; an unknown name is an error that lists the accepted ones."""
    if unknown := set(given) - set(accepted):
        raise ServiceError("INVALID_ARGUMENT", f"unknown {sorted(unknown)}; accepted: {sorted(accepted)}")
    out = {}
    for name, test in accepted.items():
        try:
            out[name] = test(given.get(name))
        except (TypeError, ValueError) as e:
            raise ServiceError("INVALID_ARGUMENT", f"{name}: {e}") from e
    return out


def number(low: int, high: int, default: int | None = None) -> Callable:
    def test(v):
        if v is None:
            return default
        if isinstance(v, bool) or not isinstance(v, int):
            raise TypeError("takes an integer")
        return max(low, min(high, v))

    return test


def one_of(*values: str, default: str | None = None) -> Callable:
    def test(v):
        if v is None:
            return default
        if v not in values:
            raise ValueError(f"takes one of {', '.join(values)}")
        return v

    return test


def anything(v):
    return v


def selector(value) -> int:
    """A document's number from a number, rfc123, rfc-123, rfc://123 or a URL that ends in one."""
    if isinstance(value, int) and not isinstance(value, bool) and 1 <= value <= 99999:
        return value
    m = re.search(r"^(?:rfc[-:/ ]*)?(\d{1,5})$|rfc(\d{1,5})/?(?:\.txt)?$", str(value).lower())
    if not m or not 1 <= int(m[1] or m[2]) <= 99999:
        raise ServiceError("INVALID_ARGUMENT", f"no document number in {value!r}")
    return int(m[1] or m[2])


def cursor(secret: str, generation: int, query: dict, offset: int) -> str:
    """A page token bound to the store's generation and the query."""
    body = json.dumps({"g": generation, "q": hashlib.sha256(scalars.stable_json(query).encode()).hexdigest()[:16], "o": offset}, sort_keys=True)
    mac = hashlib.sha256(f"{secret}\n{body}".encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(f"{body}|{mac}".encode()).decode().rstrip("=")


def read_cursor(token: str | None, secret: str, generation: int, query: dict) -> int:
    if not token:
        return 0
    try:
        body, mac = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode().rsplit("|", 1)
        fields = json.loads(body)
    except ValueError as e:
        raise ServiceError("CURSOR_INVALID", "not a page token") from e
    if mac != hashlib.sha256(f"{secret}\n{body}".encode()).hexdigest()[:16]:
        raise ServiceError("CURSOR_INVALID", "a page token of another store")
    if fields["g"] != generation or fields["q"] != hashlib.sha256(scalars.stable_json(query).encode()).hexdigest()[:16]:
        raise ServiceError("CURSOR_STALE", "the store or the query has changed")
    return fields["o"]


@dataclass
class Service:
    spark: SparkSession
    store: Store
    secret: str = "local"
    catalog: DataFrame | None = None
    errata_table: DataFrame | None = None
    history_table: DataFrame | None = None
    relation_table: DataFrame | None = None
    assets: DataFrame | None = None
    failures: list = field(default_factory=list)
    #: Of document numbers, their (rfc, raw, metadata_hash); how they are fetched is the caller's matter.
    fetch: Callable[[list[int]], DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise ServiceError("NOT_FOUND", "the store is empty")
        return df

    def snapshot(self, rfc) -> tuple[int, str]:
        n = selector(rfc)
        row = self.table("snapshots").where(F.col("rfc") == n).select("id").first()
        if row is None:
            raise ServiceError("NOT_FOUND", f"RFC {n} is not stored")
        return n, row["id"]

    def own(self, name: str, rfc) -> DataFrame:
        return self.table(name).where(F.col("snapshot_id") == self.snapshot(rfc)[1])

    def capabilities(self) -> dict:
        return {"operations": [n for n in OPERATIONS], "limits": PAGE | {"batch": BATCH, "read_bytes": READ_BYTES[2]}, "terms": list(normative.fixed.TERMS)}

    def resolve(self, rfc) -> DataFrame:
        n, snap = self.snapshot(rfc)
        return self.table("counters").where(F.col("snapshot_id") == snap).withColumn("rfc", F.lit(n))

    def metadata(self, rfc) -> DataFrame:
        if self.catalog is None:
            raise ServiceError("NOT_FOUND", "no catalog")
        rows = self.catalog.where(F.col("rfc") == selector(rfc))
        titles = self.catalog.select(F.col("rfc").alias("other"), F.col("title").alias("other_title"))
        named = rows.select("rfc", F.explode(F.concat("obsoletes", "updates", "obsoleted_by", "updated_by")).alias("other")).distinct().join(titles, "other", "left")
        title = F.coalesce("other_title", F.concat(F.lit("RFC "), F.col("other").cast("string")))
        return rows.join(named.groupBy("rfc").agg(F.map_from_entries(F.collect_list(F.struct("other", title))).alias("titles")), "rfc", "left")

    def read(self, rfc, target: str = "outline", section: str | None = None, max_bytes: int | None = None, clean: bool = False) -> DataFrame:
        """outline: sections without text; section: one section's text (the first of its number); blocks and raw_slice: bytes of it."""
        limit = number(READ_BYTES[0], READ_BYTES[2], READ_BYTES[1])(max_bytes)
        one_of("outline", "section", "blocks", "raw_slice")(target)
        rows = self.own("sections", rfc)
        if target == "outline":
            return rows.drop("text", "furniture_lines").orderBy("ordinal")
        if section is not None:
            rows = rows.where(F.col("number") == section).orderBy("ordinal").limit(1)
        if target == "section":
            text = clean_rendering(F.col("text"), F.transform("furniture_lines", lambda n: (n - F.col("line_start") + 1).cast("int"))) if clean else F.col("text")
            return rows.select("id", "number", "title", scalars.truncate_bytes(F.encode(text, "UTF-8"), limit).alias("text"), (F.octet_length(text) > limit).alias("truncated"), "byte_start", "byte_end")
        low, high = rows.agg(F.min("byte_start"), F.max("byte_end")).first()
        raw = self.table("snapshots").where(F.col("id") == self.snapshot(rfc)[1])
        piece = F.substring("raw", (low or 0) + 1, min((high or 0) - (low or 0), limit))
        return raw.select("rfc", F.lit(low or 0).alias("byte_start"), piece.alias("raw"), scalars.truncate_bytes(piece, limit).alias("text"))

    def ensure(self, rfcs: list[int]) -> list[int]:
        """Ingest the documents that are not stored yet, through `fetch`; those that are stored afterwards."""
        wanted = list(dict.fromkeys(selector(r) for r in rfcs))[:ENSURED]
        stored = lambda: {r["rfc"] for r in self.store.read("snapshots").where(F.col("rfc").isin(*wanted)).select("rfc").collect()} if self.store.generation() else set()
        missing = sorted(set(wanted) - stored())
        if missing and self.fetch is not None:
            self.store.ingest(self.fetch(missing))
        here = stored()
        self.failures += [{"rfc": r, "code": "NOT_FOUND", "message": "could not be ensured"} for r in missing if r not in here]
        return [r for r in wanted if r in here]

    def search(self, query: str, scope: str = "auto", max_results: int = 20, page: str | None = None, block_kinds: list[str] | None = None, ensure_rfcs: list[int] | None = None, ensure_top_catalog_hits: int = 0) -> DataFrame:
        """Ranked hits. auto: the catalog if it holds a match or the query has no word to find, else the text.

        Documents named in ensure_rfcs, and so many of the catalog's best hits, are ingested first.
        """
        if not 2 <= len(query) <= search.MAX_LENGTH:
            raise ServiceError("INVALID_ARGUMENT", "a query has 2 to 2000 characters")
        one_of("auto", "catalog", "text")(scope)
        limit = number(1, PAGE["search"], PAGE["search"])(max_results)
        try:
            parsed = search.parse_query(query)
            if ensure_rfcs:
                self.ensure(ensure_rfcs)
            if ensure_top_catalog_hits > 0 and self.catalog is not None:
                best = search.search_catalog(self.catalog, query, min(ensure_top_catalog_hits, ENSURED), 0)
                self.ensure([r["rfc"] for r in best.select("rfc").collect()])
            offset = read_cursor(page, self.secret, self.store.generation(), {"query": query, "scope": scope})
            if scope == "auto":
                positive = bool(parsed.groups or parsed.required)
                scope = "catalog" if self.catalog is not None and (not positive or not search.search_catalog(self.catalog, query, 1, 0).isEmpty()) else "text"
            if scope == "catalog":
                if self.catalog is None:
                    raise ServiceError("NOT_FOUND", "no catalog")
                return search.search_catalog(self.catalog, query, limit, offset)
            titles = self.catalog if self.catalog is not None else self.table("snapshots").select("rfc", F.lit(None).cast("string").alias("title"))
            relation, linked = parsed.filters.get("relation"), None
            if relation:
                ids = self.table("references").where(F.col("relation").isin(*relation)).select(F.col("id").alias("reference_id"))
                linked = self.table("citations").join(ids, "reference_id", "left_semi")
            sizes = self.table("lengths").agg(F.sum("n_blocks").alias("n_docs"), (F.sum("n_tokens") / F.sum("n_blocks")).alias("mean_length"))
            return search.search_blocks(self.table("blocks"), self.table("sections"), titles, query, block_kinds, linked, self.table("snapshots"), limit, offset, self.table("postings"), sizes)
        except search.QueryError as e:
            raise ServiceError("INVALID_ARGUMENT", str(e)) from e

    def explain_empty(self, query: str, scope: str) -> dict:
        """Why a search found nothing: which filters did not apply, and what would help."""
        q = search.parse_query(query)
        idle = [f for f in q.filters if (scope == "text" and f in ("status", "stream")) or (scope == "catalog" and f in ("section", "relation"))]
        consultable = self.store.generation() > 0 or scope == "catalog" and self.catalog is not None
        reason = "store_empty" if not consultable else "no_positive_term" if not q.groups and not q.required else "filters_exclude" if q.filters else "no_match"
        return {"consultable": consultable, "reason": reason, "inapplicable_filters": idle, "remedy": {"store_empty": "ingest documents first", "no_positive_term": "add a word that must occur", "filters_exclude": "drop a filter", "no_match": "use fewer or other words"}[reason]}

    def requirements(self, rfc, scope: str | None = None, term: str | None = None, keyword: str | None = None, offset: int = 0, limit: int = 200) -> DataFrame:
        """A page of statements; the keyword is looked for within the page, as counts of all rows ignore it."""
        rows = self.own("requirements", rfc)
        if scope:
            rows = rows.where(search.section_prefix("section_number", scope))
        if term:
            rows = rows.where(F.col("term") == term.upper())
        page = rows.orderBy("char_start", "id").offset(offset).limit(number(1, PAGE["page"], PAGE["page"])(limit))
        return page.where(F.contains(F.lower("exact_text"), F.lit(keyword.lower()))) if keyword else page

    def candidates(self, rfc, scope: str | None = None, role: str | None = None, shape: str | None = None, limit: int = 500) -> DataFrame:
        rows = normative.rank_candidates(normative.candidates(self.own("blocks", rfc), self.own("sections", rfc)))
        if scope:
            rows = rows.where((F.col("section_number") == scope) | F.startswith("section_number", F.lit(scope + ".")))
        for name, value in (("role", role), ("shape", shape)):
            if value:
                rows = rows.where(F.col(name) == value)
        return rows.orderBy("rank").limit(number(1, CANDIDATES, 500)(limit))

    def declaratives(self, rfc, limit: int = 200) -> DataFrame:
        rows = normative.declaratives(self.own("blocks", rfc), self.own("sections", rfc)).where("basis IS NOT NULL")
        return rows.orderBy("char_start", "id").limit(number(1, DECLARATIVES, 200)(limit))

    def provisional(self, rfc) -> DataFrame:
        """Requirements, and candidates that make demands beside them with a confidence of 0.6 or 0.3."""
        own = self.requirements(rfc).select("id", "term", "exact_text", "char_start", "confidence", F.lit("requirement").alias("origin"))
        more = self.candidates(rfc, role="modal", shape="demand")
        more = more.select("id", F.upper("keyword").alias("term"), "exact_text", "char_start", F.when(F.col("reason").isNull(), F.lit(0.6)).otherwise(F.lit(0.3)).alias("confidence"), F.lit("candidate").alias("origin"))
        return own.unionByName(more)

    def coverage(self, rfc) -> DataFrame:
        snap = self.snapshot(rfc)[1]
        n = self.table("requirements").where(F.col("snapshot_id") == snap).count()
        notes = normative.keyword_usage(self.own("blocks", rfc))
        return normative.completeness(self.table("counters").where(F.col("snapshot_id") == snap), n_requirements=F.lit(n), has_stance=F.lit(not notes.isEmpty()))

    def references(self, rfc, relation: str | None = None, resolution: str | None = None, label: str | None = None) -> DataFrame:
        rows = self.own("references", rfc)
        for name, value in (("relation", relation), ("resolution", resolution), ("label", label)):
            if value:
                rows = rows.where(F.col(name) == value)
        if self.catalog is not None:
            rows = rows.join(self.catalog.select(F.col("rfc").cast("int").alias("target_rfc"), F.col("title").alias("target_title")), "target_rfc", "left")
        return rows.orderBy("ordinal", "id").limit(PAGE["page"])

    def dependencies(self, rfc, direction: str = "outgoing", depth: int = 1, max_edges: int = MAX_EDGES) -> DataFrame:
        """Typed edges within `depth` steps of a document, each with the depth it was met at; DEPTH steps at most.

        Steps beyond the first follow the documents that the store holds.
        """
        one_of("outgoing", "incoming", "both")(direction)
        n, steps = selector(rfc), number(1, DEPTH, 1)(depth)
        self.snapshot(n)
        none = F.array().cast("array<bigint>")
        names = ("obsoletes", "obsoleted_by", "updates", "updated_by")
        at, seen, out = [n], {n}, None
        for step in range(1, steps + 1):
            refs = self.table("references").where(F.col("rfc").isin(*at))
            given = self.spark.createDataFrame([(r,) for r in at], "rfc long")
            meta = given.join(self.catalog.select("rfc", *names), "rfc") if self.catalog is not None else given.select("rfc", *[none.alias(c) for c in names])
            inbound = self.relation_table if self.relation_table is not None and direction != "outgoing" else self.spark.createDataFrame([], "rfc long, source_rfc long, relation string")
            found = references.edges(refs, meta, inbound.where(F.col("rfc").isin(*at)), max_edges).withColumn("depth", F.lit(step))
            out = found if out is None else out.unionByName(found)
            if step < steps:
                # At most max_edges numbers a document: the page's own bound, not the corpus's.
                ends = found.select(F.regexp_extract("destination", r"^doc:rfc-(\d+)$", 1).alias("r")).where("r <> ''").distinct().orderBy("r").limit(max_edges).collect()
                at = sorted({int(e["r"]) for e in ends} - seen)
                seen |= set(at)
                if not at:
                    break
        return out

    def diff(self, left, right, mode: str = "requirements", max_changes: int = diffs.MAX_CHANGES) -> DataFrame:
        one_of("structure", "text", "requirements", "metadata", "references")(mode)
        pair = lambda name, rfc: self.own(name, rfc).withColumn("pair_id", F.lit(0).cast("long"))
        if mode == "text":
            a, b = (self.table("snapshots").where(F.col("id") == self.snapshot(r)[1]).select(F.lit(0).cast("long").alias("pair_id"), F.decode("raw", "UTF-8").alias(n)) for r, n in ((left, "before"), (right, "after")))
            return diffs.text(a.join(b, "pair_id"))
        if mode == "metadata":
            rows = [self.catalog.where(F.col("rfc") == selector(r)).withColumn("pair_id", F.lit(0).cast("long")) for r in (left, right)]
            return diffs.capped(diffs.metadata(*rows, [c for c in self.catalog.columns if c not in ("rfc", "document_id", "observed_at", "content_hash")]), max_changes)
        name, f = {"structure": ("sections", diffs.structure), "requirements": ("requirements", diffs.requirements), "references": ("references", diffs.references)}[mode]
        return diffs.capped(f(pair(name, left), pair(name, right)), max_changes)

    def errata(self, rfc, status: str | None = None) -> DataFrame:
        rows = self.errata_table.where(F.col("rfc") == selector(rfc))
        if status not in (None, "any"):
            rows = rows.where(F.col("status") == scalars.errata_status(F.lit(status)))
        return rows.orderBy("errata_id")

    def history(self, rfc, offset: int = 0, limit: int = 200) -> DataFrame:
        return self.history_table.where(F.col("rfc") == selector(rfc)).orderBy(F.desc("published_at"), "id").offset(offset).limit(number(1, PAGE["page"], PAGE["page"])(limit))

    def source(self, rfc, form: str = "txt") -> DataFrame:
        rows = self.table("snapshots").where(F.col("rfc") == selector(rfc)).select("rfc", "raw", "raw_sha256") if form == "txt" or self.assets is None else self.assets.where((F.col("rfc") == selector(rfc)) & (F.col("form") == form))
        return rows.withColumn("text", scalars.truncate_bytes("raw", SOURCE_BYTES))

    def verify_citation(self, citation_id: str, rfc=None, section: str | None = None) -> DataFrame:
        ids = self.spark.createDataFrame([(citation_id,)], "citation_id string")
        if re.fullmatch("scit_[0-9a-f]{24}", citation_id):
            if rfc is None or section is None:
                raise ServiceError("INVALID_ARGUMENT", "a stable id needs its document and section")
            given = self.spark.createDataFrame([(citation_id, selector(rfc), section)], "stable_id string, rfc long, section_number string")
            return citations.verify_stable(given, self.own("blocks", rfc), self.own("sections", rfc))
        if not re.fullmatch("cit_[0-9a-f]{24}", citation_id):
            raise ServiceError("INVALID_ARGUMENT", "not a citation id")
        known = citations.known_citations(self.table("requirements"), self.table("mentions"))
        out = citations.verify(ids, known, self.table("blocks"), self.table("snapshots"))
        if rfc is None or out.where("status <> 'not_found'").count():
            return out
        blocks = self.own("blocks", rfc)
        traced = citations.derive(ids, blocks).withColumn("stable_id", F.lit(None).cast("string"))
        return citations.verify(ids, traced, blocks, self.table("snapshots"))

    def status(self) -> dict:
        if not self.store.generation():
            return {"generation": 0, "documents": 0, "stale": 0, "failures": self.failures[-50:]}
        counts = self.table("counters").agg(F.countDistinct("snapshot_id").alias("documents"), F.sum("block_count").alias("blocks"), F.sum("scanned").alias("scanned")).first()
        return {"generation": self.store.generation(), "stale": 0, "failures": self.failures[-50:], **counts.asDict(), "requirements": self.table("requirements").count(), "references": self.table("references").count()}

    def batch(self, calls: list[tuple[str, dict]]) -> list[dict]:
        """Up to ten calls one after another; a call that fails does not stop the others, and none may be a batch."""
        if len(calls) > BATCH:
            raise ServiceError("LIMIT_EXCEEDED", f"a batch has at most {BATCH} calls")
        out = []
        for name, arguments in calls:
            try:
                if name == "batch" or name not in OPERATIONS:
                    raise ServiceError("INVALID_ARGUMENT", f"no operation {name} in a batch")
                out.append({"ok": True, "result": getattr(self, name)(**arguments)})
            except (ServiceError, TypeError) as e:
                out.append({"ok": False, "code": getattr(e, "code", "INVALID_ARGUMENT"), "message": str(e)})
        return out


OPERATIONS = ("capabilities", "resolve", "metadata", "read", "search", "requirements", "references", "dependencies", "diff", "errata", "history", "source", "verify_citation", "status", "batch")
