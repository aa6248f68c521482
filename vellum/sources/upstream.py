"""Sources: the publisher's JSON, text, XML and feed files as DataFrames of the catalog's shapes.

Files are read by Spark from a folder that a fetcher keeps up to date; nothing here opens a
network connection. Missing and odd fields follow one rule: a value of the wrong kind is as if
it were missing, lists lose such members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
NAMED = T.StructType([T.StructField(n, _S) for n in ("name", "slug", "description", "acronym", "type")])
AUTHOR = T.StructType([T.StructField(n, _S) for n in ("titlepage_name", "name", "fullname", "affiliation", "organization", "role")] + [T.StructField("is_editor", T.BooleanType())])
COMMON = T.StructType(
    [T.StructField("number", _L), T.StructField("title", _S), T.StructField("abstract", _S), T.StructField("published", _S), T.StructField("pages", _L)]
    + [T.StructField(n, NAMED) for n in ("status", "stream", "area", "group")]
    + [T.StructField("keywords", T.ArrayType(_S)), T.StructField("authors", T.ArrayType(AUTHOR))]
    + [T.StructField(n, T.ArrayType(_L)) for n in ("obsoletes", "obsoleted_by", "updates", "updated_by")]
    + [T.StructField("subseries", T.ArrayType(T.StructType([T.StructField("type", _S), T.StructField("number", _L)]))), T.StructField("identifiers", T.ArrayType(T.StructType([T.StructField("type", _S), T.StructField("value", _S)])))]
    + [T.StructField("formats", T.ArrayType(T.StructType([T.StructField("format", _S)]))), T.StructField("doi", _S)]
)
INDEX = T.StructType([T.StructField("miniIndex", T.ArrayType(T.StructType([T.StructField("number", _L), T.StructField("title", _S), T.StructField("formats", T.ArrayType(_S))])))])
ERRATA = T.StructType([T.StructField("errataList", T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("errata_id", "doc_id", "errata_status_code", "errata_type_code", "section", "orig_text", "correct_text", "notes", "submit_date")])))])
RELATED = T.StructType([T.StructField("objects", T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("source", "target", "relationship")])))])

# The sizes up to which a rendition is read, in bytes.
LIMITS = {"txt": 16 << 20, "xml": 16 << 20, "html": 16 << 20, "pdf": 32 << 20}
TYPES = {"xml": ("application/rfc+xml", "application/xml", "text/xml"), "pdf": ("application/pdf",), "html": ("text/html", "application/xhtml+xml"), "txt": ("", "text/plain")}


def catalog_index(spark: SparkSession, path: str) -> DataFrame:
    """(rfc, title, formats) of the index file."""
    rows = spark.read.schema(INDEX).option("multiLine", True).json(path).select(F.explode("miniIndex").alias("m")).select("m.*")
    formats = F.array_sort(F.array_distinct(F.transform("formats", lambda f: F.replace(F.lower(f), F.lit("text"), F.lit("txt")))))
    return rows.where("number IS NOT NULL").select(F.col("number").alias("rfc"), F.coalesce("title", F.concat(F.lit("RFC "), F.col("number").cast("string"))).alias("title"), F.coalesce(formats, F.array().cast("array<string>")).alias("formats"))


def _numbers(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(name, F.array().cast("array<bigint>")), lambda n: n > 0)))


def catalog_record(rows: DataFrame) -> DataFrame:
    """Catalog records of common-metadata rows."""
    doi = F.get(F.filter("identifiers", lambda i: F.lower(i["type"]) == "doi"), F.lit(0))["value"]
    authors = F.transform("authors", lambda a: F.struct(F.coalesce(a["titlepage_name"], a["name"], a["fullname"]).alias("titlepage_name"), F.coalesce(a["affiliation"], a["organization"]).alias("affiliation"), (F.coalesce(a["is_editor"], F.lit(False)) | F.coalesce(a["role"] == "editor", F.lit(False))).alias("is_editor")))
    none = F.array().cast("array<string>")
    return rows.where("number IS NOT NULL").select(
        F.concat(F.lit("rfc-"), F.col("number").cast("string")).alias("document_id"),
        F.col("number").alias("rfc"),
        F.coalesce("title", F.concat(F.lit("RFC "), F.col("number").cast("string"))).alias("title"),
        "abstract",
        "published",
        "pages",
        *("status", "stream", "area", "group"),
        F.coalesce(F.filter("keywords", lambda k: F.trim(k) != ""), none).alias("keywords"),
        F.coalesce(F.filter(authors, lambda a: a["titlepage_name"].isNotNull()), F.array().cast("array<struct<titlepage_name:string,affiliation:string,is_editor:boolean>>")).alias("authors"),
        *[_numbers(n).alias(n) for n in ("obsoletes", "obsoleted_by", "updates", "updated_by")],
        F.filter("subseries", lambda s: s["type"].isNotNull() & s["number"].isNotNull()).alias("subseries"),
        F.filter("identifiers", lambda i: i["type"].isNotNull() & i["value"].isNotNull()).alias("identifiers"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("formats", lambda f: F.lower(f["format"])))), none).alias("formats"),
        F.coalesce(doi, F.col("doi")).alias("doi"),
    )


def content_hash(record: DataFrame) -> DataFrame:
    """record with a hash of all fields but the time of observation."""
    fields = [c for c in record.columns if c not in ("observed_at", "content_hash")]
    return record.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256))


def common_metadata(spark: SparkSession, path: str) -> DataFrame:
    return content_hash(catalog_record(spark.read.schema(COMMON).option("multiLine", True).json(path)))


def with_fallback(records: DataFrame, fallback: DataFrame, fields: tuple[str, ...] = ("abstract", "group", "status", "keywords", "authors")) -> DataFrame:
    """Fields that are null, or lists that are empty, from a second source."""
    f = fallback.select("rfc", *[F.col(c).alias(f"_{c}") for c in fields])
    kinds = dict(records.dtypes)
    pick = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"_{c}", c)) if kinds[c].startswith("array") else F.coalesce(c, f"_{c}")
    return records.join(f, "rfc", "left").select(*[pick(c).alias(c) if c in fields else F.col(c) for c in records.columns])


def sniff(content: Column) -> Column:
    """text, markup or binary by the first 512 bytes; a byte order mark means text, a NUL byte binary."""
    head = F.substring(content, 1, 512)
    digits = F.hex(head)
    nul = F.regexp_like(digits, F.lit("^(?:..)*?00"))
    bom = F.startswith(digits, F.lit("EFBBBF")) | F.startswith(digits, F.lit("FFFE")) | F.startswith(digits, F.lit("FEFF"))
    text = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^[\s\x00\xA0]+", "")
    html = F.regexp_like(text, F.lit(r"(?i)^<(?:!doctype\s+html|html\b|head\b|body\b|title\b|meta\b|\?xml\b)"))
    json_like = F.regexp_like(text, F.lit(r"^[\[{][^\n]{0,2000}[\"'][a-z-]+[\"']\s*:"))
    return F.when(F.length(digits) == 0, F.lit("text")).when(nul, F.lit("binary")).when(bom, F.lit("text")).when(html | json_like, F.lit("markup")).otherwise(F.lit("text"))


def accepts(form: Column, content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    out = F.lit(False)
    for f, types in TYPES.items():
        out = out | ((form == f) & kind.isin(*types))
    return out


def publications(spark: SparkSession, path: str) -> DataFrame:
    """(rfc, form, raw, size, verdict) of renditions named rfc<number>.<form>; oversized and wrong ones are marked, not read on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    rows = files.select(F.regexp_extract(name, r"rfc(\d+)", 1).alias("n"), F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("form"), F.col("length").alias("size"), F.col("content").alias("raw")).where("n <> ''")
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv]), F.col("form"))
    found = sniff(F.col("raw"))
    verdict = F.when(limit.isNull(), F.lit("unknown_format")).when(F.col("size") > limit, F.lit("too_large")).when((F.col("form") == "txt") & (found != "text"), F.lit("contract")).otherwise(F.lit("accepted"))
    return rows.select(F.col("n").cast("long").alias("rfc"), "form", "raw", "size", verdict.alias("verdict"))


def errata(spark: SparkSession, path: str) -> DataFrame:
    from vellum.functions.scalars import errata_status

    rows = spark.read.schema(ERRATA).option("multiLine", True).json(path).select(F.explode("errataList").alias("e")).select("e.*")
    return rows.where("errata_id IS NOT NULL").select(F.regexp_extract("doc_id", r"(\d{1,5})", 1).alias("_n"), "errata_id", errata_status("errata_status_code").alias("status"), F.col("errata_type_code").alias("type"), "section", "orig_text", "correct_text", "notes", "submit_date").select(
        F.when(F.col("_n") != "", F.col("_n").cast("long")).alias("rfc"), "errata_id", "status", "type", "section", "orig_text", "correct_text", "notes", "submit_date"
    )


def relations(spark: SparkSession, path: str) -> DataFrame:
    """(source_rfc, rfc, relation) of related documents whose names are of RFCs."""
    rows = spark.read.schema(RELATED).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")
    number = lambda c: F.regexp_extract(F.regexp_extract(c, r"([^/]+)/?$", 1), r"^(?:draft-.*-|rfc)(\d+)$", 1)
    slug = F.regexp_extract("relationship", r"([^/]+)/?$", 1)
    out = rows.select(number(F.col("source")).alias("s"), number(F.col("target")).alias("t"), slug.alias("relation")).where("s <> '' AND t <> ''")
    return out.select(F.col("s").cast("long").alias("source_rfc"), F.col("t").cast("long").alias("rfc"), "relation")


def history(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """(id, title, published_at, summary) of an Atom feed, newest first."""
    schema = T.StructType([T.StructField(n, _S) for n in ("id", "title", "updated", "published", "summary")])
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.select("id", "title", F.coalesce("published", "updated").alias("published_at"), "summary").orderBy(F.desc("published_at"), "id").limit(limit)


def bibtex(records: DataFrame) -> DataFrame:
    """(rfc, bibtex): an entry made from the catalog's own fields."""
    names = F.array_join(F.transform("authors", lambda a: a["titlepage_name"]), " and ")
    entry = F.concat(F.lit("@misc{rfc"), F.col("rfc").cast("string"), F.lit(",\n  series = {Request for Comments},\n  number = "), F.col("rfc").cast("string"), F.lit(",\n  author = {"), names, F.lit("},\n  title = {{"), F.col("title"), F.lit("}},\n  pagetotal = "), F.coalesce(F.col("pages").cast("string"), F.lit("0")), F.lit(",\n}"))
    return records.select("rfc", entry.alias("bibtex"))


def fetch_state(responses: DataFrame, ttl_seconds: int = 86400) -> DataFrame:
    """What a fetcher would do with cached responses (url, status, etag, fetched_at, now): fresh, revalidate, retry, absent or stale.

    Not-found answers are cached like others; 5xx and 429 answers may be served stale.
    """
    age = F.unix_timestamp("now") - F.unix_timestamp("fetched_at")
    state = F.when(F.col("status") == 404, F.when(age < ttl_seconds, F.lit("absent")).otherwise(F.lit("retry"))).when((F.col("status") >= 500) | (F.col("status") == 429), F.lit("stale")).when(age < ttl_seconds, F.lit("fresh")).when(F.col("etag").isNotNull(), F.lit("revalidate")).otherwise(F.lit("retry"))
    return responses.withColumn("state", state)
