"""Queries over headers, change clauses, logs and views that join them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corpus, legal, text
from ..operators import chunking, evidence, graph, metadata
from ..sources.tables import table


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_chunks").dropDuplicates(["chunk_id"])


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers written from the registry, read back: titles, dates, classes and works."""
    i = table(spark, sf, "legal_instruments")
    word = F.when(F.col("document_class") == "amendment", " ฉบับแก้ไข").when(F.col("document_class") == "consolidated", " ฉบับรวมล่าสุด").when(F.col("document_class") == "main", " ฉบับหลัก").otherwise("")
    t = F.concat(F.lit("หัวเรื่อง\nชื่อในผัง:  "), F.coalesce("display_title", F.lit("")), word, F.lit("\nรหัสฉบับ: "), F.coalesce("official_number", F.lit("")), F.lit("\nวันที่ในผัง: "), F.coalesce(F.col("version_date").cast("string"), F.lit("")), F.lit("\n\nเนื้อหา: x"))
    h = i.select("instrument_id", corpus.header(t).alias("h"))
    return h.select("instrument_id", "h.source_reference", "h.version_date", "h.version_role")


def change_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Change clauses of all documents, by action."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(corpus.change_events(F.col("text"))).alias("e"))
    return d.groupBy("e.action", "e.provision_kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def code_page_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose whole text comes back in Thai through another code page."""
    d = table(spark, sf, "documents").select("doc_id", corpus.recovered_layer(F.col("text")).alias("again"))
    return d.filter("again IS NOT NULL").select("doc_id", F.length("again").alias("n_chars"))


def log_window(spark: SparkSession, sf: str) -> DataFrame:
    """Log entries of a kind and a number in their properties, within an inclusive window and before an exclusive cursor."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_type") == "click"))
    before = F.col("ts") < F.lit("2024-01-19 12:00:00").cast("timestamp_ntz")
    return e.filter(before & (k >= 10) & (k < 60)).select("event_id", "user_id", k.alias("k"))


def trace_search(spark: SparkSession, sf: str) -> DataFrame:
    """Entities one of whose texts contains a term."""
    e = table(spark, sf, "knowledge_entities")
    return evidence.contains_any(e, "harbour", "name", "description", "entity_type", "origin").select("entity_id", "name")


def template_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by template; those without one count for the profile of their type."""
    r = table(spark, sf, "ingest_requests").dropDuplicates(["request_id"])
    return r.groupBy(F.coalesce("template_id", F.concat(F.lit("system:"), "document_type")).alias("template")).agg(F.count("*").alias("n"))


def current_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are current: not in the registry, or in it and in force, amended or unknown."""
    i = table(spark, sf, "legal_instruments").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("status").alias("st"))
    d = table(spark, sf, "documents").select("doc_id", "document_type").join(i, "doc_id", "left")
    return d.filter(F.col("st").isNull() | F.col("st").isin("in_force", "amended", "unknown")).groupBy("document_type").agg(F.count("*").alias("n"))


def documents_with_instrument(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the instrument they hold, if any."""
    i = table(spark, sf, "legal_instruments").select("doc_id", "instrument_id", "authority_level", "status")
    return evidence.with_latest(table(spark, sf, "documents").select("doc_id"), i.filter("doc_id IS NOT NULL"), "doc_id", [F.desc("authority_level"), F.col("instrument_id")], "instrument_id", "status")


def first_execution(spark: SparkSession, sf: str) -> DataFrame:
    """Users with the oldest event whose properties name their number."""
    e = table(spark, sf, "events")
    u = e.select((F.col("user_id") % 100).cast("int").alias("k")).distinct()
    log = e.select(F.get_json_object("props", "$.k").cast("int").alias("k"), "ts", "event_id")
    return evidence.with_oldest(u, log, "k", "ts", "event_id").select("k", "event_id")


def provision_links(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions referred to in requests' corpora, with the sections of documents that carry their number."""
    d = table(spark, sf, "documents").filter("document_type = 'legal'")
    s = chunking.sections(d, "text", "doc_id").filter("section_number IS NOT NULL").select("doc_id", "section_no", "section_number")
    p = d.select("doc_id", F.explode(F.array(F.lit("มาตรา ๑"), F.lit("1"), F.lit("ข้อ 5"), F.lit("มาตรา 16 ทวิ"), F.lit("16/1"))).alias("provision"))
    out = evidence.provision_chunks(p, s, "doc_id", "provision", "section_number", "section_no")
    return out.filter("chunk_ids IS NOT NULL").groupBy("provision").agg(F.count("*").alias("n_docs"), F.sum(F.size("chunk_ids")).alias("n_sections"))


def title_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Amendments with the main text of their corpus whose number or title they name."""
    i = table(spark, sf, "legal_instruments").select("instrument_id", "knowledge_base_id", "display_title", "official_number", "version_date", "document_class")
    refs = i.filter("document_class = 'amendment'").select("instrument_id", "knowledge_base_id", "display_title", "official_number", "version_date")
    main = i.filter("document_class IN ('main', 'consolidated')")
    out = evidence.title_match(refs, main, "knowledge_base_id", "display_title", "official_number", "display_title", "official_number", "version_date", "instrument_id", F.col("version_date"))
    return out.select("instrument_id", "match", "score")


def clause_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The first six distinct texts of the first sections."""
    c = _chunks(spark, sf).filter("section_kind IS NOT NULL")
    return evidence.clause_rows(c.select("doc_id", "chunk_index", "chunk_id", "content"), "content", 6, F.col("doc_id"), F.col("chunk_index"), F.col("chunk_id")).select("doc_id", "chunk_index", "chunk_id")


def lexical_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by how many phrases of a question they contain."""
    c = evidence.lexical_rank(_chunks(spark, sf), "content", "Which tenant of the orchard shall register?", ("orchard", "tenant"))
    return c.groupBy("score").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of instruments, ends before changes."""
    i = table(spark, sf, "legal_instruments").filter("display_title IS NOT NULL")
    r = i.select(legal.family_key(F.col("display_title")).alias("family"), "instrument_id", F.when(F.col("status") == "repealed", "REPEALS").when(F.col("status") == "superseded", "SUPERSEDES").otherwise("AMENDS").alias("relation"))
    return evidence.terminal_first(r, "family", "relation", ("REPEALS", "SUPERSEDES"), "instrument_id").select("instrument_id", "relation", "role", "position")


def tenant_labels(spark: SparkSession, sf: str) -> DataFrame:
    """References by the marker of their tenant; one that stands inside a segment does not count."""
    s = table(spark, sf, "entity_sources").dropDuplicates(["source_id"])
    label = F.concat(F.when(F.substring("source_id", -1, 1) == "7", "x").otherwise("/files/"), F.lit("tenant="), "knowledge_base_id", F.lit("/"), "source_id")
    return evidence.marked_only(s.select("source_id", label.alias("label")), "label", "tenant=", "kb-03").select("source_id")


def edges_inside(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence edges both ends of which belong to one corpus' graph."""
    s = table(spark, sf, "entity_sources").filter("entity_id IS NOT NULL AND doc_id IS NOT NULL")
    e = s.select(F.col("entity_id").alias("src"), F.concat(F.lit("doc-"), "doc_id").alias("dst")).distinct()
    ents = table(spark, sf, "knowledge_entities").filter("review_status = 'verified' OR NOT is_legal").select(F.col("entity_id").alias("node"))
    docs = table(spark, sf, "documents").filter("status = 'completed'").select(F.concat(F.lit("doc-"), "doc_id").alias("node"))
    return evidence.edges_within(e, ents.unionByName(docs)).groupBy("dst").agg(F.count("*").alias("n"))


def verified_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the graph views: all, verified, suggested, manual."""
    e = table(spark, sf, "knowledge_entities").filter("deleted_at IS NULL")
    return e.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == "verified").alias("verified"), F.count_if(F.col("review_status") == "suggested").alias("suggested"), F.count_if(F.col("origin") == "manual").alias("manual"))


def neighbour_view(spark: SparkSession, sf: str) -> DataFrame:
    """The entities found in the same documents as each person, by name."""
    s = table(spark, sf, "entity_sources").filter("entity_id IS NOT NULL AND doc_id IS NOT NULL").select("entity_id", "doc_id").distinct()
    p = table(spark, sf, "knowledge_entities").filter("entity_type = 'Person' AND deleted_at IS NULL").select(F.col("entity_id").alias("person"))
    of = s.join(p, F.col("entity_id") == F.col("person"), "left_semi").select(F.col("entity_id").alias("person"), "doc_id")
    near = of.join(s.withColumnRenamed("entity_id", "other"), "doc_id").filter("person <> other")
    return near.groupBy("person").agg(F.countDistinct("other").alias("n_neighbours"), F.countDistinct("doc_id").alias("n_shared"))


def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Identity keys of metadata values and how many documents share each."""
    v = metadata.latest_of(table(spark, sf, "document_metadata_values"), ["value_id"], F.desc("loaded_at"))
    key = F.concat_ws(":", F.lit("metadata"), "field_key", text.canonical_name(F.col("value_text")))
    return v.filter("value_text IS NOT NULL").groupBy(key.alias("identity")).agg(F.countDistinct("doc_id").alias("n_docs"))


def late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each corpus that were loaded more than a day after they were made."""
    late = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")) > 86_400_000_000
    return table(spark, sf, "documents").groupBy("knowledge_base_id").agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"))


def region_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers, nations and regions within two hops of each region."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    starts = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.reach(n.unionByName(s), starts, 2).groupBy("start", "distance").agg(F.count("*").alias("n"))


_SPACES = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ONCE = "c AS (SELECT chunk_id, min(doc_id) AS doc_id, min(chunk_index) AS chunk_index, min(content) AS content, min(section_kind) AS section_kind FROM document_chunks GROUP BY 1)"
_EDGES = "e AS (SELECT DISTINCT entity_id AS src, 'doc-' || doc_id AS dst FROM entity_sources WHERE entity_id IS NOT NULL AND doc_id IS NOT NULL)"
_FAM = rf"lower(trim(regexp_replace(CASE WHEN regexp_matches(t1, '{legal.BUDDHIST_YEAR}') THEN regexp_replace(t1, '{legal.BUDDHIST_YEAR}', '') ELSE regexp_replace(t1, '{legal.COMMON_YEAR}', '') END, '\s+', ' ', 'g')))"

SQL = {
    "headers": """
WITH t AS (SELECT instrument_id, official_number AS source_reference, version_date, lower(coalesce(display_title, '') || CASE document_class WHEN 'amendment' THEN ' ฉบับแก้ไข' WHEN 'consolidated' THEN ' ฉบับรวมล่าสุด' WHEN 'main' THEN ' ฉบับหลัก' ELSE '' END) AS t FROM legal_instruments)
SELECT instrument_id, source_reference, version_date, CASE WHEN contains(t, 'ฉบับหลัก') THEN 'main' WHEN contains(t, 'ฉบับปรับปรุงล่าสุด') OR contains(t, 'ฉบับรวมล่าสุด') THEN 'latest_consolidated' WHEN contains(t, 'รวม') OR contains(t, 'ฉบับปรับปรุง') THEN 'consolidated'
  WHEN contains(t, 'ฉบับแก้ไข') OR contains(t, 'แก้ไขเพิ่มเติม') THEN 'amendment' ELSE 'unknown' END AS version_role FROM t""",
    "log_window": "SELECT event_id, user_id, CAST(props->>'$.k' AS INT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-19 12:00:00' AND event_type = 'click' AND CAST(props->>'$.k' AS INT) >= 10 AND CAST(props->>'$.k' AS INT) < 60",
    "trace_search": "SELECT entity_id, name FROM knowledge_entities WHERE contains(lower(name), 'harbour') OR contains(lower(description), 'harbour') OR contains(lower(entity_type), 'harbour') OR contains(lower(origin), 'harbour')",
    "template_usage": "SELECT coalesce(t, 'system:' || d) AS template, count(*) AS n FROM (SELECT request_id, min(template_id) AS t, min(document_type) AS d FROM ingest_requests GROUP BY 1) GROUP BY 1",
    "current_inventory": "SELECT document_type, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, min(status) AS st FROM legal_instruments WHERE doc_id IS NOT NULL GROUP BY 1) USING (doc_id) WHERE st IS NULL OR st IN ('in_force', 'amended', 'unknown') GROUP BY 1",
    "documents_with_instrument": "SELECT doc_id, instrument_id, i.status FROM documents LEFT JOIN (SELECT * FROM legal_instruments WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY authority_level DESC, instrument_id) = 1) i USING (doc_id)",
    "first_execution": "WITH u AS (SELECT DISTINCT CAST(user_id % 100 AS INT) AS k FROM events), f AS (SELECT CAST(props->>'$.k' AS INT) AS k, event_id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(props->>'$.k' AS INT) ORDER BY ts, event_id) = 1) SELECT k, event_id FROM u LEFT JOIN f USING (k)",
    "title_matches": """
WITH a AS (SELECT * FROM legal_instruments WHERE document_class = 'amendment'), m AS (SELECT * FROM legal_instruments WHERE document_class IN ('main', 'consolidated')),
s AS (SELECT a.instrument_id, m.instrument_id AS mid, m.version_date AS d, CASE WHEN a.official_number = m.official_number THEN 100 ELSE 0 END
  + CASE WHEN coalesce(length(trim(a.display_title)) > 0 AND length(trim(m.display_title)) > 0 AND (contains(lower(trim(a.display_title)), lower(trim(m.display_title))) OR contains(lower(trim(m.display_title)), lower(trim(a.display_title)))), false) THEN 50 ELSE 0 END
  - CASE WHEN coalesce(a.version_date < m.version_date, false) THEN 20 ELSE 0 END AS score FROM a JOIN m USING (knowledge_base_id)),
b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY score DESC, d DESC NULLS LAST, mid DESC) = 1)
SELECT a.instrument_id, mid AS match, score FROM a LEFT JOIN b USING (instrument_id)""",
    "clause_texts": f"WITH {_ONCE}, f AS (SELECT * FROM c WHERE section_kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, chunk_index, chunk_id) = 1) SELECT doc_id, chunk_index, chunk_id FROM f ORDER BY doc_id, chunk_index, chunk_id LIMIT 6",
    "lexical_chunks": f"WITH {_ONCE}, w AS (SELECT unnest(['which', 'tenant', 'the', 'orchard', 'shall', 'register']) AS t), s AS (SELECT chunk_id, count(*) AS score FROM c JOIN w ON contains(lower(content), t) GROUP BY 1) SELECT CAST(score AS INT) AS score, count(*) AS n, min(chunk_id) AS first_id FROM s GROUP BY 1",
    "provenance": f"WITH f AS (SELECT instrument_id, status, regexp_replace(trim(display_title), '{legal.VERSION}', '') AS t1 FROM legal_instruments WHERE display_title IS NOT NULL), r AS (SELECT {_FAM} AS family, instrument_id, CASE status WHEN 'repealed' THEN 'REPEALS' WHEN 'superseded' THEN 'SUPERSEDES' ELSE 'AMENDS' END AS relation FROM f) SELECT instrument_id, relation, CASE WHEN relation <> 'AMENDS' THEN 'ends' WHEN max(relation <> 'AMENDS') OVER (PARTITION BY family) THEN 'note' ELSE 'changes' END AS role, CAST(row_number() OVER (PARTITION BY family ORDER BY relation <> 'AMENDS' DESC, instrument_id) AS INT) AS position FROM r",
    "tenant_labels": "SELECT DISTINCT source_id FROM entity_sources WHERE knowledge_base_id = 'kb-03' AND right(source_id, 1) <> '7'",
    "edges_inside": f"WITH {_EDGES}, n AS (SELECT entity_id AS node FROM knowledge_entities WHERE review_status = 'verified' OR NOT is_legal UNION SELECT 'doc-' || doc_id FROM documents WHERE status = 'completed') SELECT dst, count(*) AS n FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) GROUP BY 1",
    "verified_graph": "SELECT entity_type, count(*) AS n, count(*) FILTER (review_status = 'verified') AS verified, count(*) FILTER (review_status = 'suggested') AS suggested, count(*) FILTER (origin = 'manual') AS manual FROM knowledge_entities WHERE deleted_at IS NULL GROUP BY 1",
    "neighbour_view": "WITH s AS (SELECT DISTINCT entity_id, doc_id FROM entity_sources WHERE entity_id IS NOT NULL AND doc_id IS NOT NULL), p AS (SELECT entity_id AS person, doc_id FROM s WHERE entity_id IN (SELECT entity_id FROM knowledge_entities WHERE entity_type = 'Person' AND deleted_at IS NULL)) SELECT person, count(DISTINCT entity_id) AS n_neighbours, count(DISTINCT doc_id) AS n_shared FROM p JOIN s USING (doc_id) WHERE entity_id <> person GROUP BY 1",
    "identifiers": f"SELECT 'metadata:' || field_key || ':' || lower(trim(regexp_replace(value_text, '{_SPACES}+', ' ', 'g'))) AS identity, count(DISTINCT doc_id) AS n_docs FROM document_metadata_values WHERE value_text IS NOT NULL GROUP BY 1",
    "late_rows": "SELECT knowledge_base_id, count(*) AS n, count(*) FILTER (loaded_at - created_at > INTERVAL 1 DAY) AS n_late FROM documents GROUP BY 1",
    "region_walk": "WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k FROM nation), s AS (SELECT r, s_suppkey FROM n JOIN supplier ON s_nationkey = k) SELECT 'r' || r_regionkey AS start, 0 AS distance, 1 AS n FROM region UNION ALL SELECT 'r' || r, 1, count(*) FROM n GROUP BY r UNION ALL SELECT 'r' || r, 2, count(*) FROM s GROUP BY r",
}

QUERIES = {f.__name__: f for f in (
    headers, change_clauses, code_page_recovery, log_window, trace_search, template_usage, current_inventory, documents_with_instrument, first_execution, provision_links, title_matches, clause_texts, lexical_chunks, provenance, tenant_labels,
    edges_inside, verified_graph, neighbour_view, identifiers, late_rows, region_walk,
)}
