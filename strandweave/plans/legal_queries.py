"""Queries over instruments, their relations and provisions, graph projections and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal, text
from ..operators import answers, chunking, graph, graphviews, provisions, registry, resolver
from ..session import cut
from ..sources.tables import table
from . import text_queries

DAY = "2016-06-30"
#: How metadata fields are promoted into the graph: field, type of the entity, relationship.
PROMOTED = (("department", "Department", "belongs_to"), ("owner", "Owner", "owned_by"), ("project_code", "Project", "part_of"), ("location", None, "located_in"), ("remark", None, None))


def _instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments with their family and their role among its editions: the newest consolidation of a family is the latest."""
    i = table(spark, sf, "legal_instruments")
    key = legal.family_key(F.col("display_title"))
    return i.withColumn("family", key).withColumn("version_role", F.when((F.col("document_class") == "consolidated") & F.contains(F.lower(F.coalesce("display_title", F.lit(""))), F.lit("latest")), "latest_consolidated").otherwise(F.col("document_class")))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): for every amendment the latest main or consolidated text of its corpus not younger than it, or where all are younger the oldest."""
    i = table(spark, sf, "legal_instruments").filter("version_date IS NOT NULL")
    a = i.filter("document_class = 'amendment'").select(F.col("instrument_id").alias("src"), "knowledge_base_id", "version_date", "doc_id", F.col("status").alias("src_status"))
    m = i.filter("document_class IN ('main', 'consolidated')").select("knowledge_base_id", F.col("version_date").alias("main_date"), F.col("instrument_id").alias("dst"))
    return registry.as_of_or_any(a, m, "knowledge_base_id", "version_date", "main_date", "dst")


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of instruments: amendments to their texts, over the first provision their own document refers to."""
    d = table(spark, sf, "documents").select("doc_id", legal.first_provision(F.col("text"))["number"].alias("target_provision"))
    t = _targets(spark, sf).filter("dst IS NOT NULL").join(d, "doc_id", "left")
    kind = F.when(F.col("src_status") == "repealed", "REPEALS").when(F.col("src_status") == "superseded", "SUPERSEDES").otherwise("AMENDS")
    return t.select("knowledge_base_id", "src", "dst", kind.alias("relation"), "target_provision", F.when(F.col("src_status") == "unknown", "suggested").otherwise("verified").alias("review_status"), "version_date")


def version_targets(spark: SparkSession, sf: str) -> DataFrame:
    """For every amendment the text it changes, with the way that text was found."""
    t = _targets(spark, sf)
    return t.select("src", "dst", F.when(F.col("as_of_day").isNull(), "none").when(F.col("as_of_day") > F.col("version_date"), "any").otherwise("as_of").alias("found"))


def provision_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """What changed each of several provisions in every corpus."""
    bases = table(spark, sf, "knowledge_bases").select("knowledge_base_id", F.explode(F.array(*[F.lit(n) for n in ("1", "2", "5", "15", "30")])).alias("number"))
    return provisions.provenance(bases, _relations(spark, sf), "knowledge_base_id").select("knowledge_base_id", "number", "src", "relation", "target", "role", "position")


def amendment_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """The newest verified act that amends each of several provisions, by corpus."""
    bases = table(spark, sf, "knowledge_bases").select("knowledge_base_id", F.explode(F.array(*[F.lit(n) for n in ("1", "2", "5", "15", "30")])).alias("number"))
    r = _relations(spark, sf).filter("relation = 'AMENDS' AND review_status = 'verified'")
    r = r.join(table(spark, sf, "legal_instruments").select(F.col("instrument_id").alias("src"), "created_at"), "src")
    return provisions.latest_amendment(bases, r, "knowledge_base_id").select("knowledge_base_id", "number", "src")


def instrument_details(spark: SparkSession, sf: str) -> DataFrame:
    """Every instrument with the size of its family and its relations."""
    return provisions.detail(_instruments(spark, sf), _relations(spark, sf))


def registry_list(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the registry: consolidated or main texts that are in force or amended, by authority and date."""
    i = table(spark, sf, "legal_instruments").filter("document_class IN ('main', 'consolidated') AND status IN ('in_force', 'amended')")
    return i.orderBy(F.desc("authority_level"), F.desc_nulls_last("effective_from"), "instrument_id").limit(100).select("instrument_id", "authority_level", "effective_from", "status")


def numbered_versions(spark: SparkSession, sf: str) -> DataFrame:
    """In each corpus the newest consolidation, if its title says it is the latest."""
    w = _instruments(spark, sf).filter("version_role = 'latest_consolidated'").groupBy("knowledge_base_id")
    return w.agg(F.max_by("instrument_id", F.struct(F.coalesce("version_date", F.lit("0001-01-01").cast("date")), "created_at", "instrument_id")).alias("instrument_id"), F.count("*").alias("n"))


def _own_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("document_type = 'legal' AND status = 'completed'")
    return chunking.section_chunks(d, "text", 800, 120, "doc_id")


def commencements(spark: SparkSession, sf: str) -> DataFrame:
    """Sections two and three of the documents of all amendments."""
    a = table(spark, sf, "legal_instruments").filter("document_class = 'amendment' AND doc_id IS NOT NULL")
    return provisions.commencement_clauses(_own_chunks(spark, sf), a).select("doc_id", "chunk_index", "section_kind", "section_number")


def provision_history(spark: SparkSession, sf: str) -> DataFrame:
    """Editions of every family that have a fifth section."""
    return provisions.history(_instruments(spark, sf), _own_chunks(spark, sf), "5")


def current_provisions(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that answer for section five in every legal document, by how many of some words they hold."""
    c = _own_chunks(spark, sf).filter(legal.same_provision(F.lit("5"), F.col("section_number"))).withColumn("sub_work", F.lit("unknown"))
    score = F.size(F.filter(F.array(*[F.lit(w) for w in ("ทั้งนี้", "ห้าม", "ค่าธรรมเนียม")]), lambda w: F.contains("content", w)))
    return provisions.current_provision(c, F.col("section_kind") == "มาตรา", score, "doc_id").select("doc_id", "place", "chunk_index", "section_kind")


def body_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Sections one to three of all legal documents, from the first chapter on."""
    c = _own_chunks(spark, sf)
    hits = c.filter(F.col("section_number").isin("1", "2", "3")).select("doc_id", "section_number", "chunk_index")
    return provisions.body_occurrence(hits, c.select("doc_id", "section_kind", "chunk_index"), "ส่วนที่")


def version_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments of one family as evidence for one provision: what stays, and the warnings."""
    i = _instruments(spark, sf).filter("family IS NOT NULL AND doc_id IS NOT NULL")
    d = table(spark, sf, "documents").select("doc_id", legal.first_provision(F.col("text")).alias("r"))
    e = i.join(d, "doc_id").select(F.lit(1).alias("q"), F.col("instrument_id").alias("position"), "doc_id", "instrument_id", "family", F.col("r.kind").alias("section_kind"), F.col("r.number").alias("section_number"), "status", (F.col("status") == "in_force").alias("current"))
    stays, warnings = provisions.version_conflicts(e, _relations(spark, sf), ["q"])
    return stays.select("position", F.lit("KEPT").alias("code")).unionByName(warnings.select("position", "code"))


def question_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that name the families of amendments, with the instruments they are about: documents by role."""
    i = _instruments(spark, sf).withColumn("version", legal.version_number(F.col("display_title"))).withColumn("base_title", F.col("family"))
    asked = i.filter("document_class = 'amendment' AND family IS NOT NULL").select(F.col("instrument_id").alias("q"), F.concat(F.lit("ข้อ 5 ของ "), "family").alias("question"), F.lit(DAY).cast("date").alias("as_of"), F.lit(False).alias("historical"))
    p = table(spark, sf, "knowledge_entities").filter("entity_type = 'Provision' AND deleted_at IS NULL").limit(0).select(F.lit(0).cast("long").alias("doc_id"), F.col("name").alias("number"))
    roles, flags = resolver.resolve(cut(asked, "asked"), i, p, cut(_relations(spark, sf), "relations"))
    n = roles.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("q").alias("n_questions"))
    return n.unionByName(flags.groupBy().agg(F.count_if("ambiguous").alias("n"), F.count("*").alias("n_questions")).select(F.lit("ambiguous").alias("role"), "n", "n_questions"))


def _promoted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "document_metadata_values").groupBy("value_id").agg(F.max_by(F.struct("knowledge_base_id", "doc_id", "field_key", "value_text"), "loaded_at").alias("v")).select("v.*")
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("title", F.lit("-")).alias("title"))
    v = v.join(d, "doc_id").select(F.col("knowledge_base_id").alias("base"), "doc_id", "title", "field_key", F.col("value_text").alias("value"))
    f = spark.createDataFrame([(k, k, t, r) for k, t, r in PROMOTED], "field_key string, label string, entity_type string, relationship string")
    return graphviews.promoted(v, f)


def metadata_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from documents to the entities their mapped metadata names."""
    return _promoted(spark, sf)[1].select("base", "source", "target", "relationship", "source_count")


def metadata_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Those entities, by type and base."""
    e = _promoted(spark, sf)[0]
    return e.groupBy("base", "entity_type").agg(F.count("*").alias("n"), F.sum("source_count").alias("n_sources"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "entity_sources").filter("entity_id IS NOT NULL AND doc_id IS NOT NULL")
    return s.select("source_id", "entity_id", "doc_id", "knowledge_base_id").distinct()


def cascade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence edges that fall with the deleted entities and documents."""
    e = _evidence(spark, sf).select(F.col("entity_id").alias("src"), F.concat(F.lit("doc-"), "doc_id").alias("dst")).distinct()
    gone = table(spark, sf, "knowledge_entities").filter("deleted_at IS NOT NULL").select(F.col("entity_id").alias("node")).unionByName(table(spark, sf, "documents").filter("status = 'deleted'").select(F.concat(F.lit("doc-"), "doc_id").alias("node")))
    return graphviews.without_ends(e, gone, "node").groupBy("deleted").agg(F.count("*").alias("n"))


def recounted_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by origin after their sources were counted anew: how many are gone."""
    e = table(spark, sf, "knowledge_entities").select("entity_id", "origin", F.col("deleted_at").isNotNull().alias("deleted"))
    out = graphviews.recounted(e, _evidence(spark, sf), "entity_id", "source_id")
    return out.groupBy("origin").agg(F.count("*").alias("n"), F.count_if("gone").alias("n_gone"), F.sum("found").alias("n_sources"))


def upserted_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities after all names were handed in again under their documents: outcomes by type."""
    e = table(spark, sf, "knowledge_entities")
    held = e.groupBy(F.col("knowledge_base_id").alias("base"), text.identity_key(F.col("name")).alias("identity_key"), "entity_type").agg(F.min("name").alias("name"), F.min(F.col("deleted_at").isNotNull()).alias("deleted"), F.max("source_count").alias("source_count"))
    given = _evidence(spark, sf).join(e.select("entity_id", "name", "entity_type"), "entity_id").select(F.col("knowledge_base_id").alias("base"), text.identity_key(F.col("name")).alias("identity_key"), "entity_type", "name", "doc_id", F.col("source_id").alias("excerpt"), F.col("source_id").alias("at"))
    return graphviews.upserted(held, given).groupBy("entity_type", "outcome").agg(F.count("*").alias("n"), F.sum("source_count").alias("n_sources"))


def evidence_of_bases(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty pieces of evidence of every base, from completed documents."""
    s = _evidence(spark, sf)
    edges = s.select("knowledge_base_id", F.concat_ws("|", "entity_id", F.col("doc_id").cast("string")).alias("edge_id")).distinct()
    sources = s.select(F.concat_ws("|", "entity_id", F.col("doc_id").cast("string")).alias("edge_id"), "source_id", "doc_id")
    d = table(spark, sf, "documents").filter("status = 'completed'")
    return graphviews.edge_sources(edges, sources, d, 20, "knowledge_base_id").select("knowledge_base_id", "rank", "source_id", "doc_id", "relevance")


def map_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Entities as internal items and instruments as registry items, counted for the map."""
    e = table(spark, sf, "knowledge_entities").select(F.col("entity_id").alias("edge_id"), "is_legal", "review_status", "origin")
    r = _relations(spark, sf).select(F.col("src").alias("edge_id"), "review_status", F.lit("legal_schema").alias("origin"))
    return graphviews.summary(e, r)


def instrument_members(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of every document and the edges between those that share another document, at most 1,500 counted."""
    s = _evidence(spark, sf)
    members = s.select(F.col("doc_id").alias("owner"), F.col("entity_id").alias("node"))
    edges = table(spark, sf, "knowledge_entities").select("knowledge_base_id", "entity_id").groupBy("knowledge_base_id").agg(F.min("entity_id").alias("src")).join(table(spark, sf, "knowledge_entities").select("knowledge_base_id", F.col("entity_id").alias("dst")), "knowledge_base_id").filter("src <> dst").select("src", "dst")
    return graphviews.of_instruments(edges, members, 1500)


def graph_views(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence edges by view of their entity."""
    e = _evidence(spark, sf).join(table(spark, sf, "knowledge_entities").select("entity_id", "review_status", "origin"), "entity_id").select("entity_id", "doc_id", "review_status", "origin").distinct()
    rows = [graphviews.in_view(e, v).groupBy().agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "n") for v in ("verified", "suggested", "manual", "all")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def entity_inspector(spark: SparkSession, sf: str) -> DataFrame:
    """What stands around every entity and document: neighbours by direction and pieces of evidence."""
    s = _evidence(spark, sf)
    e = s.select(F.col("entity_id").alias("src"), F.concat(F.lit("doc-"), "doc_id").alias("dst")).distinct()
    return graphviews.neighbours(e, s.select(F.col("entity_id").alias("node")))


def ring_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best connected nodes laid out in rings."""
    e = _evidence(spark, sf).select(F.col("entity_id").alias("src"), F.concat(F.lit("doc-"), "doc_id").alias("dst")).distinct()
    top = graph.degrees(e).orderBy(F.desc("degree"), "node").limit(100)
    return graphviews.ring(top, [F.desc("degree"), F.col("node")]).select("node", "ring", "x", "y")


def question_shortcuts(spark: SparkSession, sf: str) -> DataFrame:
    """How titles, names, questions and values would be answered if they were asked."""
    q = table(spark, sf, "documents").select("title").unionByName(table(spark, sf, "golden_items").select(F.col("question").alias("title"))).unionByName(table(spark, sf, "document_metadata_values").select(F.col("value_text").alias("title"))).unionByName(table(spark, sf, "legal_instruments").select(F.concat(F.coalesce("display_title", F.lit("")), F.lit(" ฉบับล่าสุด เอกสารใด")).alias("title")))
    return q.groupBy(F.coalesce(answers.shortcut(F.col("title")), F.lit("retrieval")).alias("path"), answers.inventory_scope(F.col("title")).alias("scope")).agg(F.count("*").alias("n"))


def template_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of each of three templates, those without one by their type."""
    r = table(spark, sf, "ingest_requests").dropDuplicates(["request_id"])
    rows = [answers.with_template(r, t, p).groupBy().agg(F.count("*").alias("n")).select(F.lit(t).alias("template"), "n") for t, p in (("tpl-02", "legal"), ("tpl-04", "policy"), ("tpl-12", "general"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def scoped_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls of users as tokens: which are allowed."""
    e = table(spark, sf, "events")
    calls = e.select("event_id", F.col("user_id").alias("token"), F.col("event_type").alias("tool"), F.array(F.concat(F.lit("kb-"), F.lpad((F.col("event_id") % 24 + 1).cast("string"), 2, "0"))).alias("asked"))
    tokens = e.select("user_id").distinct().select(F.col("user_id").alias("token"), F.when(F.col("user_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("view"), F.lit("click"))).alias("tools"), F.array(*[F.concat(F.lit("kb-"), F.lpad(((F.col("user_id") + i) % 24 + 1).cast("string"), 2, "0")) for i in (0, 7, 13)]).alias("bases"))
    return answers.in_scope(calls, tokens).groupBy("tool", "allowed").agg(F.count("*").alias("n"))


def court_material(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any completed document is a court's."""
    d = table(spark, sf, "documents").filter("status = 'completed'")
    return answers.any_row(d, F.contains("title", F.lit("คำพิพากษา")) | F.contains(F.lower("document_type"), F.lit("judgment")))


def request_senders(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by the first filled of three keys of their metadata."""
    r = table(spark, sf, "ingest_requests").groupBy("request_id").agg(F.min("metadata_json").alias("m"))
    return r.groupBy(answers.first_of_json(F.col("m"), "author", "sender", "batch").alias("sender")).agg(F.count("*").alias("n"))


def vector_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by what is wrong with their vector."""
    c = table(spark, sf, "document_chunks").groupBy("chunk_id").agg(F.first("embedding").alias("embedding"))
    return c.groupBy(F.coalesce(answers.vector_fault(F.col("embedding"), 64), F.lit("OK")).alias("fault")).agg(F.count("*").alias("n"))


def page_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each base in one pass: how many, how many are being worked on, and whether any failed or was deleted."""
    s = F.col("status")
    return table(spark, sf, "documents").groupBy("knowledge_base_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(s.isin("queued", "running"), F.col("doc_id"))).alias("n_processing"), F.max(s == "failed").alias("any_failed"), F.max(s == "deleted").alias("any_deleted"))


def kind_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments by the label of their class."""
    labels = {"main": "กฎหมายหลัก", "consolidated": "ฉบับรวม/ฉบับปรับปรุง", "amendment": "ฉบับแก้ไขเพิ่มเติม"}
    return table(spark, sf, "legal_instruments").groupBy(answers.labelled(F.col("document_class"), labels).alias("label")).agg(F.count("*").alias("n"))


def answered_questions(spark: SparkSession, sf: str) -> DataFrame:
    """All held-out questions answered from the chunks of their words: text and graph channels, validity, fusion with the registry, citations; chunks are scanned once."""
    day = F.lit(DAY).cast("date")
    q = table(spark, sf, "golden_items").select(F.col("item_id").alias("q"), "question")
    words = q.select("q", F.explode(F.array_distinct(text.tokens(F.col("question")))).alias("word"))
    i = table(spark, sf, "legal_instruments").filter("doc_id IS NOT NULL")
    live = table(spark, sf, "documents").filter("status = 'completed'").select("doc_id")
    ended = i.filter(~legal.valid_on(day, F.col("status"), F.col("effective_from"), F.col("effective_to"))).select("doc_id").distinct()
    chunks = table(spark, sf, "document_chunks").select("doc_id", "chunk_id", F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("word"))
    met = chunks.join(words, "word").groupBy("q", "doc_id", "chunk_id").agg(F.countDistinct("word").alias("n"))
    met = met.join(live, "doc_id", "left_semi").join(ended, "doc_id", "left_anti")
    first = F.row_number().over(_by("q", F.desc("n"), F.col("doc_id"), F.col("chunk_id")))
    texts = met.withColumn("rank", first).filter("rank <= 20").select("q", "doc_id", F.col("chunk_id").cast("string").alias("chunk_id"), "rank", F.lit(0).alias("ord"))
    named = table(spark, sf, "knowledge_entities").filter("deleted_at IS NULL AND (NOT is_legal OR review_status = 'verified')").select("entity_id", F.explode(F.array_distinct(text.tokens(F.col("name")))).alias("word"))
    about = named.join(words, "word").groupBy("q", "entity_id").agg(F.count("*").alias("n"))
    found = about.join(_evidence(spark, sf).select("entity_id", "source_id", "doc_id"), "entity_id").groupBy("q", "doc_id", "source_id").agg(F.max("n").alias("n"))
    found = found.join(live, "doc_id", "left_semi").join(ended, "doc_id", "left_anti")
    place = F.row_number().over(_by("q", F.desc("n"), F.col("source_id")))
    graphs = found.withColumn("rank", place).filter("rank <= 20").select("q", "doc_id", F.col("source_id").alias("chunk_id"), "rank", F.lit(1).alias("ord"))
    ranked = cut(texts.unionByName(graphs), "answered")
    meta = i.groupBy("doc_id").agg(F.min_by(F.struct("authority_level", "status"), "instrument_id").alias("m"))
    fused = ranked.groupBy("q", "doc_id", "chunk_id").agg(F.sum(1 / (60 + F.col("rank"))).alias("s"), F.min(F.col("ord") * 1000 + F.col("rank")).alias("first")).join(meta, "doc_id", "left")
    score = F.round(F.col("s") * (1 + F.coalesce(0.3 * F.col("m.authority_level") / 100 + 0.35 * legal.status_factor(F.col("m.status")), F.lit(0.0))), 6)
    last = fused.withColumn("score", score).withColumn("position", F.row_number().over(_by("q", F.desc("score"), F.col("first"), F.col("doc_id"), F.col("chunk_id"))))
    return last.filter("position <= 5").select("q", "position", F.concat(F.lit("S"), "position").alias("citation_id"), "doc_id", "chunk_id", "score")


def _by(key: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


_FAMILY = rf"""
fam1 AS (SELECT *, regexp_replace(trim(display_title), '{legal.VERSION}', '') AS t1 FROM legal_instruments),
fam AS (SELECT *, CASE WHEN display_title IS NOT NULL THEN lower(trim(regexp_replace(CASE WHEN regexp_matches(t1, '{legal.BUDDHIST_YEAR}') THEN regexp_replace(t1, '{legal.BUDDHIST_YEAR}', '') ELSE regexp_replace(t1, '{legal.COMMON_YEAR}', '') END, '\s+', ' ', 'g'))) END AS family,
  CASE WHEN document_class = 'consolidated' AND contains(lower(coalesce(display_title, '')), 'latest') THEN 'latest_consolidated' ELSE document_class END AS version_role FROM fam1)"""
_TARGETS = """
am AS (SELECT instrument_id AS src, knowledge_base_id, version_date, doc_id, status AS src_status FROM legal_instruments WHERE document_class = 'amendment' AND version_date IS NOT NULL),
mn AS (SELECT knowledge_base_id, version_date AS d, max(instrument_id) AS dst FROM legal_instruments WHERE document_class IN ('main', 'consolidated') AND version_date IS NOT NULL GROUP BY 1, 2),
fb AS (SELECT knowledge_base_id, min(d) AS d1, arg_min(dst, d) AS dst1 FROM mn GROUP BY 1),
tg AS (SELECT am.*, coalesce(mn.dst, fb.dst1) AS dst, coalesce(mn.d, fb.d1) AS as_of_day FROM am ASOF LEFT JOIN mn ON am.knowledge_base_id = mn.knowledge_base_id AND am.version_date >= mn.d LEFT JOIN fb ON am.knowledge_base_id = fb.knowledge_base_id)"""
_DIGITS = "translate({}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"
_REL = f"""{_TARGETS},
rf AS (SELECT doc_id, regexp_extract(text, '{legal.REFERENCE}', 0) AS raw, regexp_extract(text, '{legal.REFERENCE}', 1) AS k, {_DIGITS.format(f"regexp_extract(text, '{legal.REFERENCE}', 2)")} || CASE WHEN regexp_extract(text, '{legal.REFERENCE}', 3) <> '' THEN ' ' || regexp_extract(text, '{legal.REFERENCE}', 3) ELSE '' END AS number FROM documents),
rel AS (SELECT knowledge_base_id, src, dst, CASE src_status WHEN 'repealed' THEN 'REPEALS' WHEN 'superseded' THEN 'SUPERSEDES' ELSE 'AMENDS' END AS relation, CASE WHEN raw <> '' THEN number END AS target_provision, CASE WHEN src_status = 'unknown' THEN 'suggested' ELSE 'verified' END AS review_status, version_date
  FROM tg LEFT JOIN rf USING (doc_id) WHERE dst IS NOT NULL)"""


def _number(x: str) -> str:
    out = f"lower(regexp_replace(trim({x}), '\\s+', '', 'g'))"
    for n, w in enumerate(legal.ORDINALS, 1):
        out = f"regexp_replace({out}, '([0-9]+){w}$', '\\1/{n}')"
    return out


_CUT = f"""{text_queries.SECTIONS_SQL}, flat AS (SELECT doc_id, section_no, section_kind, section_number, {text_queries.squeeze_sql("body")} AS t FROM sections WHERE length({text_queries.squeeze_sql("body")}) > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE status = 'completed')),
{text_queries.CHUNKS_SQL.format(keys="doc_id, section_no, section_kind, section_number")},
cut AS (SELECT doc_id, section_kind, section_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, chunk_index) - 1 AS INT) AS chunk_index, trim(substr(t, s + 1, e - s)) AS content FROM walk)"""
_EV = "ev AS (SELECT DISTINCT source_id, entity_id, doc_id, knowledge_base_id FROM entity_sources WHERE entity_id IS NOT NULL AND doc_id IS NOT NULL)"
_WANTED = "nums AS (SELECT knowledge_base_id, unnest(['1', '2', '5', '15', '30']) AS number FROM knowledge_bases)"


def _canon(x: str) -> str:
    return f"lower({text_queries.squeeze_sql(x)})"


_PROMOTED = f"""
fields AS (SELECT * FROM (VALUES ('department', 'Department', 'BELONGS_TO'), ('owner', 'Owner', 'OWNED_BY'), ('project_code', 'Project', 'PART_OF')) t(field_key, entity_type, relationship)),
v AS (SELECT DISTINCT value_id, knowledge_base_id AS base, doc_id, field_key, left(trim(value_text), 500) AS value FROM document_metadata_values WHERE length(trim(value_text)) > 0),
p AS (SELECT base, 'metadata:document:' || doc_id AS source, 'metadata:' || lower(entity_type) || ':' || {_canon("value")} AS target, entity_type, relationship, field_key || ': ' || value AS said FROM v JOIN fields USING (field_key) JOIN (SELECT doc_id FROM documents) USING (doc_id))"""
_TOK = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_-]+'), lambda t: length(t) > 1)"


def _says(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_Q, _N = "lower(trim(coalesce(title, '')))", f"regexp_extract(coalesce(title, ''), '{answers.AMENDMENT}', 1) <> ''"
_REFS, _NOW = f"regexp_matches(coalesce(title, ''), '{legal.REFERENCE}')", f"(NOT {_N} AND NOT regexp_matches({_Q}, '{answers.YEAR}'))"
SQL = {
    "version_targets": f"WITH {_TARGETS} SELECT src, dst, CASE WHEN as_of_day IS NULL THEN 'none' WHEN as_of_day > version_date THEN 'any' ELSE 'as_of' END AS found FROM tg",
    "provision_provenance": f"""
WITH {_REL}, {_WANTED}, m AS (SELECT DISTINCT nums.knowledge_base_id, number, src, relation, dst, version_date FROM nums JOIN rel USING (knowledge_base_id) WHERE review_status = 'verified' AND {_number("target_provision")} = number),
o AS (SELECT *, relation <> 'AMENDS' AS e, max(relation <> 'AMENDS') OVER (PARTITION BY knowledge_base_id, number) AS any_ FROM m), r AS (SELECT *, CASE WHEN e THEN 'ends' WHEN any_ THEN 'note' ELSE 'changes' END AS role FROM o)
SELECT knowledge_base_id, number, src, relation, dst AS target, coalesce(role, 'unknown') AS role, CAST(CASE WHEN role IS NOT NULL THEN row_number() OVER (PARTITION BY knowledge_base_id, number ORDER BY role = 'note', version_date DESC NULLS LAST, src, relation) END AS INT) AS position FROM nums LEFT JOIN r USING (knowledge_base_id, number)""",
    "amendment_attribution": f"""
WITH {_REL}, {_WANTED} SELECT nums.knowledge_base_id, number, src FROM nums JOIN rel USING (knowledge_base_id) JOIN (SELECT instrument_id AS src, created_at FROM legal_instruments) USING (src)
WHERE relation = 'AMENDS' AND review_status = 'verified' AND {_number("target_provision")} = number QUALIFY row_number() OVER (PARTITION BY nums.knowledge_base_id, number ORDER BY coalesce(version_date, DATE '0001-01-01') DESC, created_at DESC, src DESC) = 1""",
    "instrument_details": f"""
WITH {_FAMILY}, {_REL}, o AS (SELECT src AS instrument_id, count(*) AS n_out FROM rel GROUP BY 1), n AS (SELECT dst AS instrument_id, count(*) AS n_in, count(*) FILTER (relation = 'AMENDS' AND review_status = 'verified') AS amended_by FROM rel GROUP BY 1)
SELECT instrument_id, CASE WHEN family IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY family) END AS family_size, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(amended_by, 0) AS amended_by FROM fam LEFT JOIN o USING (instrument_id) LEFT JOIN n USING (instrument_id)""",
    "registry_list": "SELECT instrument_id, authority_level, effective_from, status FROM legal_instruments WHERE document_class IN ('main', 'consolidated') AND status IN ('in_force', 'amended') ORDER BY authority_level DESC, effective_from DESC NULLS LAST, instrument_id LIMIT 100",
    "numbered_versions": f"WITH {_FAMILY} SELECT knowledge_base_id, (list(instrument_id ORDER BY coalesce(version_date, DATE '0001-01-01') DESC, created_at DESC, instrument_id DESC))[1] AS instrument_id, count(*) AS n FROM fam WHERE version_role = 'latest_consolidated' GROUP BY 1",
    "commencements": f"WITH RECURSIVE {_CUT} SELECT doc_id, chunk_index, section_kind, section_number FROM cut WHERE section_number IN ('2', '3') AND doc_id IN (SELECT doc_id FROM legal_instruments WHERE document_class = 'amendment')",
    "provision_history": f"""
WITH RECURSIVE {_CUT}, {_FAMILY}, h AS (SELECT doc_id, min(chunk_index) AS chunk_index FROM cut WHERE {_number("section_number")} = '5' GROUP BY 1)
SELECT family, instrument_id, doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY family ORDER BY effective_from NULLS FIRST, instrument_id) AS INT) AS edition FROM fam JOIN h USING (doc_id) WHERE family IS NOT NULL""",
    "current_provisions": f"""
WITH RECURSIVE {_CUT}, m AS (SELECT *, CAST(contains(content, 'ทั้งนี้') AS INT) + CAST(contains(content, 'ห้าม') AS INT) + CAST(contains(content, 'ค่าธรรมเนียม') AS INT) AS sc FROM cut WHERE {_number("section_number")} = '5'),
k AS (SELECT * FROM m QUALIFY section_kind = 'มาตรา' OR NOT max(section_kind = 'มาตรา') OVER (PARTITION BY doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, chunk_index) AS rk FROM k),
t AS (SELECT DISTINCT doc_id, section_number FROM r WHERE rk <= 2), p AS (SELECT r.doc_id, chunk_index, section_kind, row_number() OVER (PARTITION BY r.doc_id ORDER BY chunk_index) AS place FROM r JOIN t USING (doc_id, section_number))
SELECT doc_id, CAST(place AS INT) AS place, chunk_index, section_kind FROM p WHERE place <= 4""",
    "body_occurrences": f"""
WITH RECURSIVE {_CUT}, st AS (SELECT doc_id, min(chunk_index) AS s0 FROM cut WHERE section_kind = 'ส่วนที่' GROUP BY 1), h AS (SELECT doc_id, section_number, chunk_index, s0 FROM cut LEFT JOIN st USING (doc_id) WHERE section_number IN ('1', '2', '3'))
SELECT doc_id, section_number, chunk_index FROM h QUALIFY s0 IS NULL OR chunk_index = min(CASE WHEN chunk_index >= s0 THEN chunk_index END) OVER (PARTITION BY doc_id, section_number)""",
    "version_conflicts": f"""
WITH {_FAMILY}, {_REL}, e AS (SELECT instrument_id AS position, doc_id, instrument_id, family, CASE WHEN raw <> '' THEN CASE lower(k) WHEN 'section' THEN 'มาตรา' WHEN 'article' THEN 'มาตรา' WHEN 'clause' THEN 'ข้อ' ELSE k END END AS kind_, CASE WHEN raw <> '' THEN number END AS number, status, coalesce(status = 'in_force', false) AS cur FROM fam JOIN rf USING (doc_id) WHERE family IS NOT NULL),
h AS (SELECT e.position, max(relation <> 'AMENDS') AS ends FROM e JOIN rel ON rel.dst = e.instrument_id AND review_status = 'verified' AND {_number("target_provision")} = {_number("e.number")} GROUP BY 1),
g AS (SELECT e.*, h.ends, h.position IS NOT NULL AS over_ FROM e LEFT JOIN h USING (position)),
c AS (SELECT *, CASE WHEN number IS NULL THEN 1 ELSE (SELECT count(DISTINCT x.doc_id) FROM g x WHERE x.family = g.family AND x.kind_ = g.kind_ AND x.number = g.number) END AS docs, (SELECT count(DISTINCT x.doc_id) FROM g x WHERE x.family = g.family AND x.kind_ IS NOT DISTINCT FROM g.kind_ AND x.number IS NOT DISTINCT FROM g.number AND x.cur) AS curs, sum(CAST(over_ AS INT)) OVER w AS n_over, count(*) OVER w AS n_all FROM g WINDOW w AS (PARTITION BY family, kind_, number)),
d AS (SELECT *, n_over > 0 AND n_over < n_all AS by_rel, curs > 0 AND curs < docs AS by_cur FROM c), b AS (SELECT *, min(CASE WHEN CASE WHEN by_rel THEN NOT over_ WHEN by_cur THEN cur ELSE false END THEN position END) OVER (PARTITION BY family, kind_, number) AS best FROM d),
l AS (SELECT *, docs > 1 AND (by_rel OR by_cur) AND position <> best AS lost FROM b)
SELECT position, 'KEPT' AS code FROM l WHERE NOT lost UNION ALL SELECT position, 'SUPERSEDED_VERSION_REMOVED' FROM l WHERE lost UNION ALL SELECT position, CASE WHEN ends THEN 'PROVISION_REPEALED' ELSE 'PROVISION_AMENDED' END FROM l WHERE NOT lost AND over_ AND number IS NOT NULL UNION ALL SELECT position, 'UNVERIFIED_VALIDITY' FROM l WHERE NOT lost AND status = 'unknown'""",
    "metadata_graph": f"WITH {_PROMOTED} SELECT base, source, target, relationship, count(DISTINCT said) AS source_count FROM p GROUP BY 1, 2, 3, 4",
    "metadata_entities": f"WITH {_PROMOTED}, e AS (SELECT base, source AS k, 'Document' AS entity_type FROM p UNION ALL SELECT base, target, entity_type FROM p), g AS (SELECT base, k, entity_type, count(*) AS c FROM e GROUP BY 1, 2, 3) SELECT base, entity_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS n_sources FROM g GROUP BY 1, 2",
    "cascade_edges": f"WITH {_EV}, e AS (SELECT DISTINCT entity_id, doc_id FROM ev) SELECT entity_id IN (SELECT entity_id FROM knowledge_entities WHERE deleted_at IS NOT NULL) OR doc_id IN (SELECT doc_id FROM documents WHERE status = 'deleted') AS deleted, count(*) AS n FROM e GROUP BY 1",
    "recounted_entities": f"WITH {_EV}, n AS (SELECT entity_id, count(DISTINCT source_id) AS f FROM ev GROUP BY 1) SELECT origin, count(*) AS n, count(*) FILTER (deleted_at IS NOT NULL OR (coalesce(f, 0) = 0 AND origin <> 'manual')) AS n_gone, CAST(sum(coalesce(f, 0)) AS BIGINT) AS n_sources FROM knowledge_entities LEFT JOIN n USING (entity_id) GROUP BY 1",
    "upserted_entities": f"""
WITH {_EV}, k AS (SELECT entity_id, knowledge_base_id AS base, 'generic:' || {_canon("name")} AS ik, entity_type, deleted_at, source_count FROM knowledge_entities), held AS (SELECT base, ik, entity_type, bool_and(deleted_at IS NOT NULL) AS deleted, max(source_count) AS sc FROM k GROUP BY 1, 2, 3),
g AS (SELECT ev.knowledge_base_id AS base, ik, entity_type, count(DISTINCT (ev.doc_id, source_id)) AS more FROM ev JOIN k USING (entity_id) GROUP BY 1, 2, 3), b AS (SELECT coalesce(held.entity_type, g.entity_type) AS entity_type, sc, more, CASE WHEN held.ik IS NULL THEN 'created' WHEN deleted AND more IS NOT NULL THEN 'revived' WHEN more IS NOT NULL THEN 'seen' ELSE 'untouched' END AS outcome FROM held FULL JOIN g ON held.base = g.base AND held.ik = g.ik AND held.entity_type = g.entity_type)
SELECT entity_type, outcome, count(*) AS n, CAST(sum(coalesce(sc, 0) + coalesce(more, 0)) AS BIGINT) AS n_sources FROM b GROUP BY 1, 2""",
    "evidence_of_bases": f"""
WITH {_EV}, r AS (SELECT e.knowledge_base_id, ev.source_id, ev.doc_id, row_number() OVER (PARTITION BY e.knowledge_base_id ORDER BY ev.entity_id || '|' || ev.doc_id, ev.source_id) AS rank FROM (SELECT DISTINCT knowledge_base_id, entity_id, doc_id FROM ev) e JOIN ev USING (entity_id, doc_id) WHERE ev.doc_id IN (SELECT doc_id FROM documents WHERE status = 'completed'))
SELECT knowledge_base_id, CAST(rank AS INT) AS rank, source_id, doc_id, round(1 / rank, 6) AS relevance FROM r WHERE rank <= 20""",
    "map_summary": f"""
WITH {_REL}, x AS (SELECT review_status, origin, 'internal' AS b FROM knowledge_entities WHERE is_legal UNION ALL SELECT review_status, 'legal_schema', 'cross_document' FROM rel WHERE src NOT IN (SELECT entity_id FROM knowledge_entities WHERE is_legal) UNION ALL SELECT NULL, origin, 'loose' FROM knowledge_entities WHERE NOT is_legal AND origin = 'manual')
SELECT count(*) FILTER (review_status = 'verified') AS verified, count(*) FILTER (review_status = 'suggested') AS suggested, count(*) FILTER (review_status = 'rejected') AS rejected, count(*) FILTER (origin = 'manual') AS manual, count(*) FILTER (b = 'internal') AS internal, count(*) FILTER (b = 'cross_document') AS cross_document FROM x""",
    "instrument_members": f"""
WITH {_EV}, m AS (SELECT DISTINCT doc_id AS owner, entity_id AS node FROM ev), f AS (SELECT knowledge_base_id, min(entity_id) AS src FROM knowledge_entities GROUP BY 1), e AS (SELECT src, entity_id AS dst FROM f JOIN knowledge_entities USING (knowledge_base_id) WHERE src <> entity_id),
i AS (SELECT a.owner, count(*) AS n FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst AND a.owner = b.owner GROUP BY 1) SELECT owner, count(*) AS n_entities, least(coalesce(any_value(n), 0), 1500) AS n_edges FROM m LEFT JOIN i USING (owner) GROUP BY 1""",
    "graph_views": f"WITH {_EV}, e AS (SELECT DISTINCT entity_id, doc_id, review_status, origin FROM ev JOIN knowledge_entities USING (entity_id)) SELECT 'verified' AS view, count(*) FILTER (review_status = 'verified') AS n FROM e UNION ALL SELECT 'suggested', count(*) FILTER (review_status = 'suggested') FROM e UNION ALL SELECT 'manual', count(*) FILTER (origin = 'manual') FROM e UNION ALL SELECT 'all', count(*) FROM e",
    "entity_inspector": f"""
WITH {_EV}, e AS (SELECT DISTINCT entity_id AS s, 'doc-' || doc_id AS d FROM ev), b AS (SELECT s AS node, d AS other, 'out' AS way FROM e UNION ALL SELECT d, s, 'in' FROM e), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY way, other) <= 200),
n AS (SELECT node, count(*) FILTER (way = 'out') AS n_out, count(*) FILTER (way = 'in') AS n_in, count(DISTINCT other) AS n_neighbours FROM f GROUP BY 1) SELECT n.*, coalesce(c, 0) AS n_evidence FROM n LEFT JOIN (SELECT entity_id AS node, count(*) AS c FROM ev GROUP BY 1) USING (node)""",
    "ring_layout": f"""
WITH {_EV}, e AS (SELECT DISTINCT entity_id AS s, 'doc-' || doc_id AS d FROM ev), b AS (SELECT s AS node FROM e UNION ALL SELECT d FROM e), g AS (SELECT node, count(*) AS degree FROM b GROUP BY 1 ORDER BY degree DESC, node LIMIT 100), r AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) - 1 AS k FROM g),
a AS (SELECT *, CAST(CASE WHEN k = 0 THEN 0 ELSE ceil((sqrt(1 + k) - 1) / 2) END AS INT) AS ring FROM r), t AS (SELECT *, 2 * 3.141592653589793::DOUBLE * (k - (2 * ring - 1) * (2 * ring - 1)) / greatest(8 * ring, 1) AS an FROM a) SELECT node, ring, round(100 * ring * cos(an), 3) + 0.0 AS x, round(100 * ring * sin(an), 3) + 0.0 AS y FROM t""",
    "question_shortcuts": f"""
WITH q AS (SELECT title FROM documents UNION ALL SELECT question FROM golden_items UNION ALL SELECT value_text FROM document_metadata_values UNION ALL SELECT coalesce(display_title, '') || ' ฉบับล่าสุด เอกสารใด' FROM legal_instruments)
SELECT CASE WHEN {_says(_Q, answers.SUBJECT)} AND NOT ({_says(_Q, answers.ACTION)} AND NOT {_says(_Q, answers.STILL_COUNT)}) AND ({_says(_Q, answers.COUNT)} OR ({_says(_Q, answers.TYPE)} AND contains({_Q}, 'แบ่ง'))) THEN 'inventory'
 WHEN {_NOW} AND ((contains({_Q}, 'ฉบับล่าสุด') AND {_says(_Q, ("เอกสาร", "ชุดข้อมูล", "วันที่ในผัง", "ฉบับใด"))}) OR ({_N} AND {_says(_Q, answers.LOOKUP)})) THEN 'metadata' WHEN {_says(_Q, ("คำพิพากษา", "ฎีกา"))} THEN 'court_gap' WHEN {_NOW} AND contains({_Q}, 'เริ่มใช้บังคับ') THEN 'commencement'
 WHEN {_NOW} AND {_says(_Q, ("โฉนดที่ดิน", "หนังสือรับรองการทำประโยชน์"))} AND {_says(_Q, ("กี่ฉบับ", "ใครเก็บ", "ต้นฉบับ", "จัดเก็บ"))} THEN 'copies' WHEN {_N} AND {_says(_Q, answers.IN_FORCE_FROM)} THEN 'effective_rule' WHEN {_REFS} AND {_says(_Q, answers.CHANGED_BY)} THEN 'provenance' WHEN {_NOW} AND {_REFS} THEN 'current_provision'
 WHEN {_NOW} AND {_says(_Q, ("ปัจจุบัน", "ล่าสุด"))} AND {_says(_Q, ("กฎหมาย", "หลักเกณฑ์", "ค่าธรรมเนียม", "สิทธิ", "หน้าที่"))} THEN 'current_law' ELSE 'retrieval' END AS path, CASE WHEN {_says("lower(coalesce(title, ''))", answers.CURRENT)} THEN 'current' ELSE 'all' END AS scope, count(*) AS n FROM q GROUP BY 1, 2""",
    "template_documents": "WITH r AS (SELECT request_id, min(template_id) AS t, min(document_type) AS d FROM ingest_requests GROUP BY 1) SELECT 'tpl-02' AS template, count(*) FILTER (t = 'tpl-02' OR (t IS NULL AND d = 'legal')) AS n FROM r UNION ALL SELECT 'tpl-04', count(*) FILTER (t = 'tpl-04' OR (t IS NULL AND d = 'policy')) FROM r UNION ALL SELECT 'tpl-12', count(*) FILTER (t = 'tpl-12' OR (t IS NULL AND d = 'general')) FROM r",
    "scoped_calls": "SELECT event_type AS tool, user_id % 5 <> 0 AND event_type IN ('view', 'click') AND event_id % 24 IN (user_id % 24, (user_id + 7) % 24, (user_id + 13) % 24) AS allowed, count(*) AS n FROM events GROUP BY 1, 2",
    "court_material": "SELECT count(*) > 0 AS found FROM documents WHERE status = 'completed' AND (contains(title, 'คำพิพากษา') OR contains(lower(document_type), 'judgment'))",
    "request_senders": "WITH r AS (SELECT request_id, min(metadata_json) AS m FROM ingest_requests GROUP BY 1) SELECT coalesce(nullif(trim(m->>'$.author'), ''), nullif(trim(m->>'$.sender'), ''), nullif(trim(m->>'$.batch'), '')) AS sender, count(*) AS n FROM r GROUP BY 1",
    "vector_faults": "WITH c AS (SELECT chunk_id, min(embedding) AS v FROM document_chunks GROUP BY 1) SELECT CASE WHEN v IS NULL THEN 'MISSING' WHEN len(v) <> 64 THEN 'WRONG_SIZE' WHEN len(list_filter(v, lambda x: isnan(x) OR x IS NULL)) > 0 THEN 'NOT_A_NUMBER' ELSE 'OK' END AS fault, count(*) AS n FROM c GROUP BY 1",
    "page_totals": "SELECT knowledge_base_id, count(*) AS n, count(DISTINCT doc_id) FILTER (status IN ('queued', 'running')) AS n_processing, max(status = 'failed') AS any_failed, max(status = 'deleted') AS any_deleted FROM documents GROUP BY 1",
    "kind_labels": "SELECT CASE document_class WHEN 'main' THEN 'กฎหมายหลัก' WHEN 'consolidated' THEN 'ฉบับรวม/ฉบับปรับปรุง' WHEN 'amendment' THEN 'ฉบับแก้ไขเพิ่มเติม' ELSE document_class END AS label, count(*) AS n FROM legal_instruments GROUP BY 1",
    "answered_questions": f"""
WITH {_EV}, w AS (SELECT DISTINCT item_id AS q, unnest({_TOK.format("question")}) AS word FROM golden_items), i AS (SELECT * FROM legal_instruments WHERE doc_id IS NOT NULL),
ok AS (SELECT doc_id FROM documents WHERE status = 'completed' AND doc_id NOT IN (SELECT doc_id FROM i WHERE NOT ((effective_from IS NULL OR effective_from <= DATE '{DAY}') AND (effective_to IS NULL OR effective_to > DATE '{DAY}') AND (coalesce(status NOT IN ('repealed', 'superseded'), true) OR effective_to IS NOT NULL)))),
c AS (SELECT DISTINCT doc_id, chunk_id, unnest({_TOK.format("content")}) AS word FROM document_chunks), m AS (SELECT q, doc_id, chunk_id, count(DISTINCT word) AS n FROM c JOIN w USING (word) WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY 1, 2, 3),
t AS (SELECT q, doc_id, CAST(chunk_id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY q ORDER BY n DESC, doc_id, m.chunk_id) AS rank, 0 AS ord FROM m QUALIFY rank <= 20),
e AS (SELECT DISTINCT entity_id, unnest({_TOK.format("name")}) AS word FROM knowledge_entities WHERE deleted_at IS NULL AND (NOT is_legal OR review_status = 'verified')), a AS (SELECT q, entity_id, count(*) AS n FROM e JOIN w USING (word) GROUP BY 1, 2),
f AS (SELECT q, doc_id, source_id, max(n) AS n FROM a JOIN ev USING (entity_id) WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY 1, 2, 3), g AS (SELECT q, doc_id, source_id AS chunk_id, row_number() OVER (PARTITION BY q ORDER BY n DESC, source_id) AS rank, 1 AS ord FROM f QUALIFY rank <= 20),
u AS (SELECT q, doc_id, chunk_id, sum(1 / (60 + rank)) AS s, min(ord * 1000 + rank) AS first FROM (SELECT * FROM t UNION ALL SELECT * FROM g) GROUP BY 1, 2, 3), meta AS (SELECT doc_id, (list(authority_level ORDER BY instrument_id))[1] AS al, (list(status ORDER BY instrument_id))[1] AS st FROM i GROUP BY 1),
z AS (SELECT q, doc_id, chunk_id, first, round(s * (1 + coalesce(0.3 * al / 100 + 0.35 * CASE st WHEN 'in_force' THEN 1.0 WHEN 'amended' THEN 0.85 WHEN 'not_yet_effective' THEN 0.3 WHEN 'superseded' THEN 0.1 WHEN 'repealed' THEN 0.1 ELSE 0.5 END, 0)), 6) AS score FROM u LEFT JOIN meta USING (doc_id))
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, first, doc_id, chunk_id) AS INT) AS position, 'S' || row_number() OVER (PARTITION BY q ORDER BY score DESC, first, doc_id, chunk_id) AS citation_id, doc_id, chunk_id, score FROM z QUALIFY position <= 5""",
}

QUERIES = {f.__name__: f for f in (
    version_targets, provision_provenance, amendment_attribution, instrument_details, registry_list, numbered_versions, commencements, provision_history, current_provisions, body_occurrences, version_conflicts, question_contexts,
    metadata_graph, metadata_entities, cascade_edges, recounted_entities, upserted_entities, evidence_of_bases, map_summary, instrument_members, graph_views, entity_inspector, ring_layout, question_shortcuts, template_documents, scoped_calls,
    court_material, request_senders, vector_faults, page_totals, kind_labels, answered_questions,
)}
