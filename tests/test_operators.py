"""Operators over the rendered documents' kind of text, references, diffs, search, store and service."""

import pytest
from pyspark.sql import functions as F

from tests.test_functions import RAW
from vellum.functions import scalars
from vellum.operators import citations, diffs, evaluation, normative, outline, references, search, structure
from vellum.plans.store import Store, StoreBusy, add_redirects, failures, replace_by, upsert
from vellum.service import Service, ServiceError, cursor, read_cursor, selector
from vellum.sources import upstream
from vellum.streaming import ingest


@pytest.fixture(scope="module")
def derived(spark):
    docs = spark.createDataFrame([(9999, "snp_x", bytearray(RAW))], "rfc long, snapshot_id string, raw binary")
    parsed = structure.parse_documents(docs).cache()
    return structure.sections(parsed), structure.blocks(parsed)


def text_blocks(spark, texts, kind="paragraph"):
    rows = [("snp", 1, "sec", f"b{i}", i, kind, t, i * 1000, i * 1000) for i, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "snapshot_id string, rfc long, section_id string, id string, ordinal long, kind string, text string, char_start long, byte_start long").withColumn("byte_end", F.col("byte_start") + F.octet_length("text"))
    sections = spark.createDataFrame([("snp", 1, "sec", "1", "Body", "body", None, 0)], "snapshot_id string, rfc long, id string, number string, title string, kind string, parent_id string, ordinal long")
    return blocks, sections


def test_lines_match_kernel(spark):
    df = spark.createDataFrame([(1, RAW.decode())], "doc_id long, text string")
    got = [(r.line, r.start, r.value, r.is_blank, r.is_furniture) for r in structure.lines(df).orderBy("line").collect()]
    want = [(x.number, x.start, x.value, not x.trimmed, x.furniture) for x in structure.split_lines(RAW.decode())]
    assert got == want and sum(w[4] for w in want) == 3


def test_mentions_and_requirements(spark):
    blocks, sections = text_blocks(spark, ["The server MUST reply. A client MUST not wait; it MAY\nNOT go.", 'The words MUST, SHOULD and MAY are listed. Say "MUST" here.', "é The node SHALL stop.", "éMUST stop"])
    found = normative.mentions(blocks, sections)
    rows = {(r.block_id, r.sentence_no, r.term_no): r for r in found.collect()}
    assert rows["b0", 1, 0].term == "MUST NOT" and "negation_case_not_upper" in rows["b0", 1, 0].flags and rows["b0", 1, 1].term == "MAY NOT"
    assert rows["b1", 0, 0].disposition == rows["b1", 1, 0].disposition == "definition"
    assert rows["b2", 0, 0].byte_start == 2000 + len("é The node ".encode()) and rows["b3", 0, 0].term == "MUST"
    own = {(r.block_id, r.term): r for r in normative.requirements(found).collect()}
    assert set(own) == {("b0", "MUST"), ("b0", "MUST NOT"), ("b2", "SHALL"), ("b3", "MUST")}
    assert own["b0", "MUST"].clause.actor == "The server" and own["b0", "MUST"].confidence == 0.9 and len(own["b0", "MUST NOT"].keywords) == 2


def test_candidates_and_continuation(spark):
    blocks, sections = text_blocks(spark, ["The client should wait for", "replies and must log them. It MUST stop."])
    rows = normative.rank_candidates(normative.candidates(blocks, sections)).orderBy("char_start").collect()
    assert [(r.keyword, r.continues_previous_block) for r in rows] == [("should", False), ("must", True)]


def test_declaratives_and_usage(spark):
    blocks, sections = text_blocks(spark, ["The header is 20 octets long. The value defaults to zero. A field is defined as a list. It must be 5 bytes.", "Figure 2: 10 bytes of data.", "This document does not use the key words MUST and SHOULD."])
    rows = normative.declaratives(blocks, sections).collect()
    assert sorted(r.basis for r in rows if r.basis) == ["copula-definition", "field-default", "numeric-bound"]
    assert {r.excluded for r in rows if r.excluded} >= {"has_keyword", "caption_or_figure_label"}
    assert [r.stance for r in normative.keyword_usage(blocks).collect()] == ["disclaims"]


def test_references(spark, derived):
    sections, blocks = derived
    rows = {r.label: r for r in references.entries(blocks, sections).collect()}
    assert rows["RFC2119"].target_rfc == 2119 and rows["RFC2119"].relation == "informative" and rows["X"].resolution == "unresolved"
    given = [("RFC 12", "t", "rfc-12"), ("BCP14", "see RFC 2119", "bcp-14"), ("a", "in STD 7 text", "std-7"), ("b", "ISO/IEC 10646:2003 text", "ISO/IEC 10646:2003"), ("c", "at <https://example.org/x-\n y>.", "https://example.org/xy"), ("d", "nothing", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in given], "label string, raw_text string")
    assert [r.target for r in references.resolve_targets(df).collect()] == [t for _, _, t in given]


def test_in_body_sites(spark):
    blocks, sections = text_blocks(spark, ["See [RFC10] and [RFC10] again, [BCP5], [BCP5], [nope]."])
    listed = references.entries(blocks, sections)
    refs, cited = references.cited(listed, references.sites(blocks, sections))
    assert sorted(r.label for r in refs.collect()) == ["BCP5", "BCP5", "RFC10"] and cited.count() == 4


def test_diffs(spark):
    side = lambda rows: spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(rows)], "pair_id long, ordinal long, number string, title string")
    got = {(r.kind, r.key) for r in diffs.structure(side([("1", "A"), ("2", "B"), ("3", "C"), ("4", "D")]), side([("1", "A"), ("2", "B2"), ("5", "C"), ("6", "E")])).collect()}
    assert got == {("renamed", "2"), ("moved", "3"), ("removed", "4"), ("added", "6")}
    hunks = diffs.text(spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "x\n" * 3000, "y")], "pair_id long, before string, after string")).collect()
    assert [h.lines for h in hunks if h.pair_id == 1] == [["-b", "+x"], ["+d"]] and [h.fallback for h in hunks if h.pair_id == 2] == [True]


@pytest.mark.parametrize("text, fits", [("quick fox", True), ('"fox quick"', False), ("slow OR fox", True), ("quick NOT fox", False), ("NOT fox", False), ("Café", True), ('"quick-brown"', True), ("quick-brown", True), ('"fox-quick"', True)])
def test_query_grammar(spark, text, fits):
    df = spark.createDataFrame([("The quick brown fox at the CAFÉ",)], "t string")
    assert df.select(search.matches(search.parse_query(text), search.token_string("t"))).first()[0] is fits


@pytest.mark.parametrize("text", ['"open', "rfc:x", "section:", "relation:odd", "a NOT", "x" * 2001, "w " * 65])
def test_query_errors(text):
    with pytest.raises(search.QueryError):
        search.parse_query(text)


def test_evaluation(spark):
    rows = spark.createDataFrame([(i, "s", i) for i in range(16)], "id long, g string, v long")
    assert sorted(r.id for r in evaluation.stratified(rows, "g", "v").collect()) == [2, 4, 6, 8, 10, 12, 14]
    d = spark.createDataFrame([(1, "a b  c d e f g"), (2, "x")], "doc_id long, row string")
    p = spark.createDataFrame([(1, "b c d e f"), (2, "x"), (3, "zz")], "item_id long, probe string")
    assert {(r.item_id, r.doc_id) for r in evaluation.bounded_match(d, p, "doc_id", "item_id").collect()} == {(1, 1), (2, 2)}
    s = spark.createDataFrame([("a", "1", "must go"), ("b", "1", "no such")], "id string, section string, text string")
    c = {"requirement": spark.createDataFrame([("1", "x must  go y")], "section string, text string")}
    assert {r.id: r.channel for r in evaluation.conservation(s, c).collect()} == {"a": "requirement", "b": "unreached"}


XML = b"""<rfc number="7"><front><abstract><t>x</t></abstract></front><middle><section anchor="intro" pn="section-1"><name>Intro</name><t>It MUST [A1] go <xref target="RFC9"/>.</t>
<section pn="section-1.1"><name>Sub</name><figure><artwork>x</artwork></figure></section></section></middle><back><references><name>Refs</name></references><section pn="section-appendix.a.1"><name>More</name></section></back></rfc>"""


def test_xml_outline(spark):
    docs = spark.createDataFrame([(7, bytearray(XML)), (8, bytearray(b"<!DOCTYPE html><html/>")), (9, bytearray(b"<a><b></a>"))], "rfc long, raw binary")
    rows = outline.outline(docs).collect()
    assert [(r.number, r.kind, r.block_count) for r in rows if r.rfc == 7] == [(None, "body", 1), ("1", "body", 1), ("1.1", "body", 1), ("Refs", "references", 0), ("Appendix A.1", "appendix", 0)]
    intro = next(r for r in rows if r.anchor == "intro")
    assert intro.normative_terms == ["MUST"] and intro.references == ["A1", "RFC9"]
    assert all(r.error for r in rows if r.rfc in (8, 9))
    with pytest.raises(outline.XmlError):
        outline.parse(b"<a>" * 200 + b"</a>" * 200)


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"number": 5, "title": "T", "status": {"slug": "std", "name": "Standard"}, "keywords": ["k", " "], "authors": [{"titlepage_name": "A"}, {"is_editor": true}], "obsoletes": [3, 3, 1], "identifiers": [{"type": "DOI", "value": "10/x"}]}')
    r = upstream.common_metadata(spark, str(tmp_path / "c.json")).first()
    assert (r.rfc, r.keywords, len(r.authors), r.obsoletes, r.doi) == (5, ["k"], 1, [1, 3], "10/x") and len(r.content_hash) == 64
    bodies = [b"plain", b"", b"\xef\xbb\xbf<html>", b"a\x00b", b"  <!DOCTYPE html>", b'{"error": "x"}', b"[RFC1] text"]
    got = [x[0] for x in spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i long, b binary").orderBy("i").select(upstream.sniff(F.col("b"))).collect()]
    assert got == ["text", "text", "text", "binary", "markup", "markup", "text"]
    (tmp_path / "feed.xml").write_text("<feed><entry><id>1</id><title>a</title><updated>2020</updated></entry><entry><id>2</id><title>b</title><updated>2021</updated></entry></feed>")
    assert [r.id for r in upstream.history(spark, str(tmp_path / "feed.xml")).collect()] == ["2", "1"]
    (tmp_path / "e.json").write_text('{"errataList": [{"errata_id": "7", "doc_id": "RFC5", "errata_status_code": "Held for Document Update"}]}')
    assert [(r.rfc, r.status) for r in upstream.errata(spark, str(tmp_path / "e.json")).collect()] == [(5, "held_for_document_update")]


def test_store_rules(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "old_id string, new_id string")
    assert {(r.old_id, r.new_id) for r in add_redirects(pairs([("a", "b")]), pairs([("b", "c")])).collect()} == {("a", "c"), ("b", "c")}
    rows = lambda r: spark.createDataFrame(r, "rfc long, content_hash string, v string")
    merged, counts = upsert(rows([(1, "x", "old"), (2, "y", "old")]), rows([(2, "z", "new"), (3, "w", "new"), (1, "x", "ignored")]), "rfc", "content_hash")
    assert {r.rfc: r.v for r in merged.collect()} == {1: "old", 2: "new", 3: "new"} and {r._state: r.n for r in counts.collect()} == {"unchanged": 1, "updated": 1, "inserted": 1}
    assert replace_by(rows([(1, "a", ""), (2, "b", "")]), rows([(1, "c", "")])).count() == 2
    f = spark.createDataFrame([(i, i, "m" * 900) for i in range(60)], "id long, at long, message string")
    kept = failures(f.limit(0), f).collect()
    assert len(kept) == 50 and max(len(r.message) for r in kept) == 500


def test_service_end_to_end(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = lambda raw: spark.createDataFrame([(9999, bytearray(raw), "m")], "rfc long, raw binary, metadata_hash string")
    assert Service(spark, store).status()["generation"] == 0
    assert store.ingest(docs(RAW)) == 1 and store.ingest(docs(RAW)) is None
    service = Service(spark, store)
    own = service.requirements("rfc9999").collect()
    assert [r.term for r in own] == ["MUST", "MUST NOT"]
    assert service.verify_citation(own[1].citation_id).first().status == "verified"
    assert service.verify_citation("cit_" + "0" * 24).first().status == "not_found"
    assert service.verify_citation(own[1].stable_id, 9999, "1").first().status == "verified"
    assert [r.number for r in service.read(9999).collect()][2:4] == ["1", "1.1"]
    assert service.read(9999, "section", "1.1").first().text.lstrip().startswith("- item")
    assert [h.section_number for h in service.search("client wait", scope="text").collect()] == ["1"]
    assert service.references(9999).count() >= 2 and service.dependencies(9999).count() >= 1
    assert service.coverage(9999).first().completeness == "partial"
    assert store.ingest(docs(RAW.replace(b"A client MUST not wait", b"A client SHOULD wait"))) == 2
    later = Service(spark, store)
    assert later.verify_citation(own[1].citation_id).first().status == "not_found"
    assert later.verify_citation(own[1].stable_id, 9999, "1").first().status == "stale"
    assert store.read("redirects").count() == 1 and later.status()["documents"] == 1
    out = later.batch([("requirements", {"rfc": 9999}), ("resolve", {"rfc": 1}), ("batch", {}), ("read", {"nope": 1})])
    assert [o["ok"] for o in out] == [True, False, False, False]
    with pytest.raises(ServiceError):
        later.requirements("not a number")


def test_store_appends_revives_and_vacuums(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = lambda *rows: spark.createDataFrame([(n, bytearray(raw), "m") for n, raw in rows], "rfc long, raw binary, metadata_hash string")
    second = RAW.replace(b"A client MUST not wait", b"A client SHOULD wait")
    assert store.vacuum() is None and store.reanalyze() is None and store.reindex() is None
    assert store.ingest(docs((9999, RAW), (8888, RAW))) == 1
    first = {r.id for r in store.read("snapshots").where("rfc = 9999").collect()}
    assert store.ingest(docs((9999, second))) == 2
    # Only the new document was written; the one that retired is left out.
    assert len(store.manifest()["blocks"]) == 2 and store.read("snapshots").count() == 2
    assert not first & {r.id for r in store.read("snapshots").collect()}
    assert store.read("blocks").select("snapshot_id").distinct().count() == 2
    # The retired snapshot comes back without a second copy of its rows, and no redirect leads away from it.
    assert store.ingest(docs((9999, RAW))) == 3
    assert first <= {r.id for r in store.read("snapshots").collect()} and store.read("snapshots").count() == 2
    assert not first & {r.old_id for r in store.read("redirects").collect()}
    assert store.reanalyze() is None and store.reindex() == 4
    before = {name: store.read(name).count() for name in store.manifest() if name != "retired"}
    assert store.vacuum() == 5 and {name: store.read(name).count() for name in before} == before
    assert all(len(folders) == 1 for folders in store.manifest().values()) and store.read("retired").count() == 0
    assert sorted(p.name for p in (tmp_path / "store/blocks").iterdir()) == [store.manifest()["blocks"][0][0].split("/")[1]]
    with pytest.raises(StoreBusy):
        store.commit({"retired": store.read("retired")}, base=4)
    assert store.generation() == 5
    # A folder of an earlier layout lacks columns; they read as their defaults.
    store.read("counters").drop("warnings").write.parquet(f"{store.root}/counters/old")
    assert store._folders("counters", [("counters/old", 1), store.manifest()["counters"][0]]).where("warnings IS NULL").count() == 2


def test_search_ensures_and_follows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    other = b"Other Matters\n\n1. Scope\n\n   See [RFC9999]. A router MUST forward.\n\nNormative References\n\n   [RFC9999] Editor, A., \"T\", RFC 9999, March 1999.\n"
    raw = {9999: RAW, 8888: other}
    fetch = lambda ns: spark.createDataFrame([(n, bytearray(raw[n]), "m") for n in ns if n in raw], "rfc long, raw binary, metadata_hash string")
    names = "rfc long, title string, abstract string, keywords array<string>, authors array<struct<titlepage_name:string>>, status struct<slug:string,name:string>, stream struct<slug:string,name:string>, obsoletes array<bigint>, obsoleted_by array<bigint>, updates array<bigint>, updated_by array<bigint>"
    catalog = spark.createDataFrame([(8888, "Other Matters", "routers", [], [], ("std", "Std"), ("ietf", "IETF"), [], [], [], []), (9999, "Waiting", "clients", [], [], ("std", "Std"), ("ietf", "IETF"), [77], [], [], [])], names)
    service = Service(spark, store, catalog=catalog, fetch=fetch)
    assert service.ensure([8888, 7777]) == [8888] and service.failures[-1]["rfc"] == 7777
    assert [r.rfc for r in service.search("waiting", ensure_top_catalog_hits=3).collect()] == [9999]
    assert store.read("snapshots").count() == 2
    assert [r.rfc for r in service.search("router forward", ensure_rfcs=[9999]).collect()] == [8888]  # not in the catalog: the text
    assert [h.rfc for h in service.search("client wait", scope="text").collect()] == [9999]
    one, two = service.dependencies(8888), service.dependencies(8888, depth=2)
    assert {r.destination for r in one.collect()} == {"doc:rfc-9999"}
    assert {(r.destination, r.depth) for r in two.collect()} >= {("doc:rfc-9999", 1), ("doc:rfc-77", 2)}


def test_polarity_fidelity_finds_a_wrong_row(spark):
    schema = "term string, polarity string, exact_text string, char_start long, keywords array<struct<char_start:long,char_end:long>>"
    rows = [("MUST", "positive", "It MUST go.", 10, [(13, 17)]), ("MUST", "positive", "It MUST not go.", 0, [(3, 7)]), ("MUST NOT", "negative", "It MUST NOT go.", 0, [(3, 11)]), ("MAY", "negative", "It MAY  not go.", 0, [(0, 0)])]
    r = evaluation.polarity_fidelity(spark.createDataFrame(rows, schema)).first()
    assert (r.checked, r.by_search, r.disagreements, r.agreement_pct, r.may_not) == (4, 1, 1, 75.0, 0)


def test_tokens_and_selectors():
    q = {"query": "x"}
    token = cursor("s", 3, q, 40)
    assert read_cursor(token, "s", 3, q) == 40 and read_cursor(None, "s", 3, q) == 0
    for secret, generation, query in (("t", 3, q), ("s", 4, q), ("s", 3, {"query": "y"})):
        with pytest.raises(ServiceError):
            read_cursor(token, secret, generation, query)
    assert [selector(x) for x in (5, "rfc7", "RFC 8", "rfc://9", "https://h/rfc10.txt")] == [5, 7, 8, 9, 10]


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/rfc9999.txt").write_bytes(RAW)
    store = Store(spark, f"file://{tmp_path}/store")
    ingest.start(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.generation() == 1 and store.read("snapshots").count() == 1


def test_derived_citation(spark):
    blocks, _ = text_blocks(spark, ["It goes. The server MUST reply."])
    wanted = blocks.select(scalars.citation_id("snapshot_id", "id", F.lit(9 + 11), F.lit("The server MUST reply.")).alias("citation_id"))
    assert [(r.char_start, r.quote) for r in citations.derive(wanted, blocks).collect()] == [(20, "The server MUST reply.")]
