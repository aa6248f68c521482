"""References: entries and their targets, citation sites in the text, and typed edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vellum.functions import fixed, scalars
from vellum.operators.normative import mapped

MAX_DEPTH = 16
MAX_NODES, MAX_EDGES = 100, 200


def ancestor_titles(sections: DataFrame) -> DataFrame:
    """(snapshot_id, id, titles): the lower-case titles of a section and all above it, by repeated joins to the parents."""
    parents = sections.select("snapshot_id", F.col("id").alias("up"), F.lower("title").alias("up_title"), F.col("parent_id").alias("up_parent"))
    rows = sections.select("snapshot_id", "id", F.array(F.lower("title")).alias("titles"), F.col("parent_id").alias("up"))
    done = rows.where("up IS NULL").drop("up")
    rows = rows.where("up IS NOT NULL")
    for _ in range(MAX_DEPTH):
        if rows.isEmpty():
            break
        joined = rows.join(parents, ["snapshot_id", "up"], "left")
        rows = joined.select("snapshot_id", "id", F.when(F.col("up_title").isNull(), F.col("titles")).otherwise(F.array_append("titles", F.col("up_title"))).alias("titles"), F.col("up_parent").alias("up"))
        done = done.unionByName(rows.where("up IS NULL").drop("up"))
        rows = rows.where("up IS NOT NULL")
    return done


def _external(text: str | None) -> dict | None:
    """The external standard a text names: of overlapping finds the longer, else the earlier; or its URL."""
    best = None
    for pattern, form, publisher in fixed.EXTERNAL:
        m = re.search(pattern, text or "", re.I | re.A)
        if not m:
            continue
        first = m[1] if m.lastindex or (m.re.groups and m[1]) else None
        name = form.format(first) if first else form.replace("-{0}", "")
        year = re.search(r":(\d{4})$", first or "") if publisher == "ISO" else None
        dated = int(year[1]) if year else int(m[2]) if m.re.groups > 1 and m[2] else int(first) if publisher == "ANSI" and first else None
        overlaps = best is not None and m.start() < best[1] and best[0] < m.end()
        if best is None or (overlaps and m.end() - m.start() > best[1] - best[0]) or (not overlaps and m.start() < best[0]):
            best = (m.start(), m.end(), {"kind": "standard", "id": name, "publisher": publisher, "year": dated})
    if best:
        return best[2]
    url = _url(text or "")
    return {"kind": "url", "id": url, "publisher": None, "year": None} if url else None


def trim_url(url: str) -> str | None:
    out = url.rstrip(".,;:")
    while out.endswith(")") and out.count("(") < out.count(")"):
        out = out[:-1]
    return out if len(out) > len("https://") + 4 else None


def _url(text: str) -> str | None:
    """A URL in angle brackets, joined across line breaks, or else a bare one."""
    if m := re.search(r"<(https?://+[^>]+)>", text):
        joined = re.sub(r"\s+", "", re.sub(r"(?i)-\s+(?=[a-z0-9/._~:])", "", m[1]))
        if out := trim_url(joined):
            return out
    m = re.search(r"(https?://+[^\s<>)\]]+)", text)
    return trim_url(m[1]) if m else None


EXTERNAL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("publisher", T.StringType()), T.StructField("year", T.IntegerType())])


def resolve_targets(rows: DataFrame, label: str = "label", text: str = "raw_text") -> DataFrame:
    """rows with target_kind, target, target_rfc, resolution and external; precedence label, series in text, external."""
    import pyarrow as pa

    tidy = F.trim(F.regexp_replace(F.col(label), r"\s+", " "))
    prefix = F.upper(F.regexp_extract(tidy, fixed.LABEL_NUMBER, 1))
    digits = lambda c: F.when(c != "", c.cast("int"))
    number = digits(F.regexp_extract(tidy, fixed.LABEL_NUMBER, 2))
    in_text = {k: digits(F.regexp_extract(F.col(text), p, 1)) for k, p in fixed.SERIES_IN_TEXT.items()}
    sub = prefix.isin("BCP", "STD", "FYI")
    cases = [
        (prefix == "RFC", "rfc", F.concat(F.lit("rfc-"), number.cast("string")), number, F.lit("exact")),
        (sub, "subseries", F.concat(F.lower(prefix), F.lit("-"), number.cast("string")), in_text["rfc"], F.when(in_text["rfc"].isNull(), F.lit("ambiguous")).otherwise(F.lit("exact"))),
        (in_text["rfc"].isNotNull(), "rfc", F.concat(F.lit("rfc-"), in_text["rfc"].cast("string")), in_text["rfc"], F.lit("exact")),
        *[(in_text[k].isNotNull(), "subseries", F.concat(F.lit(f"{k}-"), in_text[k].cast("string")), F.lit(None).cast("int"), F.lit("exact")) for k in ("bcp", "std", "fyi")],
    ]
    found = F.lit(None).cast("struct<kind:string,target:string,rfc:int,resolution:string>")
    for test, kind, target, rfc, resolution in reversed(cases):
        found = F.when(test, F.struct(F.lit(kind).alias("kind"), target.alias("target"), rfc.alias("rfc"), resolution.alias("resolution"))).otherwise(found)
    rows = rows.withColumn("_t", found).withColumn("_open", F.when(F.col("_t").isNull(), F.col(text)))
    arrow = pa.struct([("kind", pa.string()), ("id", pa.string()), ("publisher", pa.string()), ("year", pa.int32())])
    rows = mapped(rows, lambda t: _external(t) if t is not None else None, "external", EXTERNAL, arrow, "_open")
    outside = F.col("external").isNotNull()
    return rows.withColumns(
        {
            "target_kind": F.coalesce("_t.kind", F.when(outside, F.lit("external")).otherwise(F.lit("other"))),
            "target": F.coalesce("_t.target", "external.id"),
            "target_rfc": F.col("_t.rfc"),
            "resolution": F.coalesce("_t.resolution", F.when(outside, F.lit("external")).otherwise(F.lit("unresolved"))),
        }
    ).drop("_t", "_open")


def entries(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """The listed references, normative or informative by the titles above them; others are dropped."""
    rows = blocks.where("kind = 'reference_entry'")
    if "section_titles" in blocks.columns:
        rows = rows.withColumnRenamed("section_titles", "titles")
    else:
        above = ancestor_titles(sections).join(sections.select("snapshot_id", "id", F.col("kind").alias("section_kind")), ["snapshot_id", "id"]).withColumnRenamed("id", "section_id")
        rows = rows.join(above, ["snapshot_id", "section_id"])
    which = F.filter("titles", lambda t: t.isin("normative references", "informative references"))
    relation = F.when(F.size(which) > 0, F.split(F.get(which, F.lit(0)), " ")[0]).when(F.col("section_kind") == "references", F.lit("informative"))
    rows = rows.withColumn("relation", relation).withColumn("label", F.trim(F.regexp_extract("text", fixed.ENTRY_LABEL, 1)))
    rows = rows.where("relation IS NOT NULL AND label <> ''").withColumnRenamed("ordinal", "block_ordinal")
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("snapshot_id").orderBy("block_ordinal")) - 1)
    kept = rows.select("snapshot_id", "rfc", "section_id", "ordinal", "label", F.col("text").alias("raw_text"), "relation")
    return resolve_targets(kept).withColumn("id", F.concat(F.lit("ref_"), scalars.short_hash(F.concat_ws("|", "snapshot_id", "label", F.col("ordinal").cast("string")))))


def sites(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Where the text cites a label: block, offset and label, outside the lists of references."""
    rows = blocks.where("kind <> 'reference_entry'")
    if "section_kind" not in blocks.columns:
        rows = rows.join(sections.select("snapshot_id", F.col("id").alias("section_id"), F.col("kind").alias("section_kind")), ["snapshot_id", "section_id"], "left")
    rows = rows.where("section_kind IS NULL OR section_kind NOT IN ('references', 'authors', 'index')")
    found = rows.where(F.contains("text", F.lit("["))).select("*", F.posexplode(scalars.places("text", fixed.CITATION_SITE, 1)).alias("site_no", "p"))
    near = F.substr("text", F.col("p.at") + 1, F.length("p.inner") + 4)
    around = F.substr("text", F.greatest(F.col("p.at") - 40, F.lit(0)) + 1, F.least(F.col("p.at"), F.lit(40)) + 80)
    return found.select("snapshot_id", "rfc", F.col("id").alias("block_id"), "section_id", "ordinal", "site_no", F.col("p.inner").alias("label"), (F.col("char_start") + F.col("p.at")).alias("offset"), near.alias("near"), F.trim(around).alias("around"))


def cited(listed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, citations): sites joined to the last entry of their label, others resolved on their own.

    A site that no entry covers becomes an in-body reference if it has a target; the first one
    with an RFC number stands for all later sites of its label, while a target without a number
    makes a reference of every site.
    """
    by_label = listed.groupBy("snapshot_id", F.lower("label").alias("key")).agg(F.max_by("id", "ordinal").alias("entry_id"))
    placed = found.withColumn("key", F.lower("label")).join(by_label, ["snapshot_id", "key"], "left")
    direct = placed.where("entry_id IS NOT NULL").select("snapshot_id", F.col("entry_id").alias("reference_id"), "block_id", "section_id", "offset")
    rest = resolve_targets(placed.where("entry_id IS NULL"), "label", "near").where("target IS NOT NULL")
    per = W.partitionBy("snapshot_id", "key").orderBy("ordinal", "site_no")
    # All sites of a label with a number share the first one's record; the others stand alone.
    first = F.first("offset").over(per)
    rest = rest.withColumn("stands_at", F.when(F.col("target_rfc").isNotNull(), first).otherwise(F.col("offset")))
    heads = rest.where("stands_at = offset").withColumn("n", F.row_number().over(W.partitionBy("snapshot_id").orderBy("ordinal", "site_no")))
    count = listed.groupBy("snapshot_id").agg(F.count("*").alias("n_listed"))
    heads = heads.join(count, "snapshot_id", "left").withColumn("ref_ordinal", F.coalesce("n_listed", F.lit(0)) + F.col("n") - 1)
    own_id = F.concat(F.lit("ref_"), scalars.short_hash(F.concat_ws("|", "snapshot_id", F.lit("inbody"), "label", F.col("ref_ordinal").cast("string"))))
    in_body = heads.select("snapshot_id", "rfc", "section_id", F.col("ref_ordinal").cast("int").alias("ordinal"), "label", F.col("around").alias("raw_text"), F.lit("in_body").alias("relation"), "external", "target_kind", "target", "target_rfc", "resolution", own_id.alias("id"), "key", "stands_at")
    indirect = rest.join(in_body.select("snapshot_id", "key", "stands_at", F.col("id").alias("reference_id")), ["snapshot_id", "key", "stands_at"]).select("snapshot_id", "reference_id", "block_id", "section_id", "offset")
    references = listed.unionByName(in_body.drop("key", "stands_at"), allowMissingColumns=True)
    return references, direct.unionByName(indirect).dropDuplicates(["snapshot_id", "reference_id", "block_id", "offset"])


def edges(references: DataFrame, metadata: DataFrame, inbound: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Typed edges per document: cited, then obsoletes/updates from the catalog, then inbound; first of equal ids wins.

    references: (rfc, relation, label, target_kind, target, target_rfc, ordinal); metadata:
    (rfc, obsoletes, obsoleted_by, updates, updated_by); inbound: (rfc, source_rfc, relation).
    """
    doc = lambda c: F.concat(F.lit("doc:rfc-"), c.cast("string"))
    kind = F.when(F.col("target_kind") == "external", F.lit("cites_external")).when(F.col("relation") == "normative", F.lit("cites_normative")).otherwise(F.lit("cites_informative"))
    to = F.coalesce(doc(F.col("target_rfc")), F.concat(F.lit("label:"), F.coalesce("target", "label")))
    out = [references.where("relation <> 'in_body'").select("rfc", doc(F.col("rfc")).alias("source"), to.alias("destination"), kind.alias("type"), F.col("label").alias("relation"), F.lit(0).alias("phase"), F.col("ordinal").cast("long").alias("place"))]
    for i, name in enumerate(("obsoletes", "obsoleted_by", "updates", "updated_by"), 1):
        out.append(metadata.select("rfc", F.posexplode(name).alias("place", "other")).select("rfc", doc(F.col("rfc")).alias("source"), doc(F.col("other")).alias("destination"), F.lit(name).alias("type"), F.lit(name).alias("relation"), F.lit(i).alias("phase"), F.col("place").cast("long")))
    out.append(inbound.where("source_rfc <> rfc").select("rfc", doc(F.col("source_rfc")).alias("source"), doc(F.col("rfc")).alias("destination"), F.lit("cites_normative").alias("type"), "relation", F.lit(9).alias("phase"), F.col("source_rfc").cast("long").alias("place")))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("id", F.concat(F.lit("edge_"), scalars.short_hash(F.concat_ws("|", "source", "destination", "type", "relation"))))
    first = W.partitionBy("rfc", "id").orderBy("phase", "place")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return rows.withColumn("edge_no", F.row_number().over(W.partitionBy("rfc").orderBy("phase", "place", "id"))).where(F.col("edge_no") <= max_edges)


def nodes(edge_rows: DataFrame, titles: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The documents that a graph's edges touch, its own first, with the catalog's titles where known."""
    root = edge_rows.select("rfc", F.concat(F.lit("doc:rfc-"), F.col("rfc").cast("string")).alias("node"), F.lit(0).alias("place"))
    ends = edge_rows.select("rfc", F.explode(F.array("source", "destination")).alias("node"), F.col("edge_no").alias("place")).where(F.startswith("node", F.lit("doc:")))
    one = root.unionByName(ends).groupBy("rfc", "node").agg(F.min("place").alias("place"))
    number = F.regexp_extract("node", r"(\d+)$", 1).cast("long")
    named = one.withColumn("number", number).join(titles.select(F.col("rfc").cast("long").alias("number"), "title"), "number", "left")
    return named.withColumn("node_no", F.row_number().over(W.partitionBy("rfc").orderBy("place", "node"))).where(F.col("node_no") <= max_nodes)


def reachable(edge_rows: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): documents within `depth` edges, by repeated joins (an extension; the graph itself has depth 1)."""
    step = edge_rows.select(F.col("source").alias("node"), F.col("destination").alias("to")).distinct()
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(step, "node").select("root", F.col("to").alias("node")).distinct().join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen
