"""The ten opN_ queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import ann, decontaminate, langid, licenses, mixing, neardup, repeats, secrets, urls, warc
from vellum.plans.runtime import Scratch, table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), Scratch(spark, "ann"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def _op2_sql() -> str:
    """Match lengths and the lengths between matches give the places, for each kind."""
    patterns = [
        ("assign", "(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 8),
        *[(kind, pattern.replace("[0-9a-f]{8}[0-9a-f]*", "[0-9a-f]+"), 0, least) for kind, pattern, _, least in secrets.RULES[1:]],
    ]
    parts = [
        f"""SELECT doc_id, row_id, {k} AS k, '{kind}' AS kind, m, v, (list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in a[1:i-1]]), 0))::BIGINT AS s FROM (
SELECT doc_id, row_id, p, a, unnest(a) AS m, unnest(g) AS v, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, row_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS a, regexp_extract_all(text, '{pattern}', {group}) AS g FROM d)) WHERE length(v) >= {least}"""
        for k, (kind, pattern, group, least) in enumerate(patterns)
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
f AS ({" UNION ALL ".join(parts)}),
c AS (SELECT row_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) AS spans FROM f GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (row_id)"""


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, n_passages) of the contaminated documents."""
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))
    return rows.where("contaminated").select("doc_id", "item_id", "score", "n_passages")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = langid.predict(docs, langid.train(docs, floors=False))
    return predicted.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "warc"), zip64=True)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner IS NULL OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "neardup"), words=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, and the documents that can be reached through links.
OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS MATERIALIZED (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
walk AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT walk.a, both_ways.b FROM walk JOIN both_ways ON walk.b = both_ways.a),
least AS (SELECT a, min(doc_id) AS m FROM walk JOIN d ON d.r = walk.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(doc_id = coalesce(m, doc_id), false) AS kept FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN least ON least.a = d.r"""


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "repeats"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    sizes = scratch.save(mixing.sized(table(spark, sf_dir, "documents")), "sizes")
    assigned = scratch.finish(mixing.assign_positions(sizes))
    first = F.get("occurrences", F.lit(0))["position"]
    ordered = assigned.repartitionByRange(first.asc_nulls_last(), "doc_id").sortWithinPartitions(first.asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM s),
r AS (SELECT *, ((SELECT sum(source_size)::BIGINT FROM s) * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level, row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, i)),
l AS (SELECT arg_min(level, place) AS level FROM r WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN l.level IS NULL OR cap <= l.level * weight THEN cap::DOUBLE ELSE l.level * weight END AS target FROM r, l),
c AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(greatest(floor(target + 0.5)::BIGINT - upto, 0), size) + least(greatest(floor(target + 0.5)::BIGINT - source_size - upto, 0), size))::BIGINT AS taken FROM c
"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def _op10_sql() -> str:
    """Words stand between double spaces, so that a match may take one at either end; places follow from the spaces before."""
    double = lambda regex: regex.replace(" ?", "(?:_)?").replace(" ", "_").replace("_", "  ")  # noqa: E731
    rows = []
    for order, label, keyword, regex, priority in licenses.rules():
        inner = regex.removeprefix("(?<= )").removesuffix("(?= )")
        rows.append(f"({order}, '{label}', '{double(keyword)}', ' {double(inner)} ', {priority})")
    base = ", ".join(f"({-i}, '{label}', ' {double(phrase)} ', ' {double(phrase)} ', 0)" for i, (phrase, label) in enumerate(licenses.BASE, 1))
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"  # noqa: E731
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, doc_id, len(w)::BIGINT AS n_words, '  ' || array_to_string(w, '  ') || '  ' AS t FROM d),
rules(ord, label, keyword, pattern, priority) AS (VALUES {base}, {", ".join(rows)}),
m AS (SELECT r, ord, label, priority, regexp_extract_all(t, pattern) AS a, string_split_regex(t, pattern) AS p FROM t JOIN rules ON contains(t, keyword)),
u AS (SELECT r, ord, label, priority, a, p, unnest(range(1, len(a) + 1)) AS i FROM m),
f AS MATERIALIZED (SELECT r, ord, label, priority, (list_sum([{spaces("x")} for x in p[1:i]]) + coalesce(list_sum([{spaces("x")} for x in a[1:i-1]]), 0) - 1) // 2 AS b, {spaces("a[i]")} // 2 AS n FROM u),
g AS (SELECT r, ord, label, priority, b::BIGINT AS b, (b + n)::BIGINT AS e FROM f),
kept AS (SELECT * FROM g x WHERE ord >= 0 AND NOT EXISTS (SELECT 1 FROM g y WHERE y.r = x.r AND y.ord >= 0 AND y.b <= x.b AND y.e >= x.e AND (y.priority < x.priority OR y.priority = x.priority AND (y.e - y.b > x.e - x.b OR y.b = x.b AND y.e = x.e AND y.ord < x.ord)))),
z AS (SELECT r, label, 3 AS priority, b, true AS base FROM g WHERE ord < 0 UNION ALL SELECT r, label, priority, b, false FROM kept),
o AS (SELECT r, count(*) FILTER (base) AS n_base, min(b) FILTER (base) AS first_word, max(b) FILTER (base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, (7 - min(priority)) / 6.0::DOUBLE AS score FROM z GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM t LEFT JOIN o USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neighbours": op1_neighbours,
        "op2_secrets": op2_secrets,
        "op3_contamination": op3_contamination,
        "op4_language": op4_language,
        "op5_warc": op5_warc,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_repeats": op7_repeats,
        "op8_urls": op8_urls,
        "op9_mixing": op9_mixing,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": _op2_sql(), "op5_warc": OP5_SQL, "op6_near_duplicates": OP6_SQL, "op9_mixing": OP9_SQL, "op10_licenses": _op10_sql()}
