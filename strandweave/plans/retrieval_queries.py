"""Queries over ranked evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, containment, metadata, retrieval
from ..session import cut
from ..sources.tables import table
from . import planner, text_queries

QUESTION = "tenant applicant register"
NEEDLE = "in accordance with"
THAI_NEEDLE = "ทั้งนี้"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as delivered; channels make their narrow rows distinct."""
    return table(spark, sf, "document_chunks")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks once each: those delivered twice are alike but for their time of loading."""
    c = table(spark, sf, "document_chunks")
    return c.dropDuplicates(["chunk_id"])


def _probe(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: the first of the embeddings."""
    row = table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row["embedding"]] if row else []


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 vectors nearest to the first."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.vector_channel(e, "embedding", _probe(spark, sf), 20).select("chunk_id", "relevance", "rank")


def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The 12 chunks nearest to the first embedding, of documents published within a window."""
    docs = metadata.published_between(table(spark, sf, "documents").filter("status = 'completed'"), "published_at", "2015-01-01", "2022-01-01").select("doc_id")
    c = _raw(spark, sf).join(docs, "doc_id", "left_semi")
    return retrieval.vector_channel(c, "embedding", _probe(spark, sf), 12)


def keyword_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best chunks that hold every word of a question."""
    return retrieval.keyword_channel(_raw(spark, sf), "content", QUESTION, 20)


def keyword_any(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best chunks by any word, where none holds all of them."""
    return retrieval.keyword_channel(_raw(spark, sf), "content", "quarry zzqx harbour", 20)


def exact_passage(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 chunks that contain a phrase."""
    return retrieval.exact_channel(_raw(spark, sf), "content", NEEDLE, 25)


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    c = _raw(spark, sf)
    ranked = retrieval.fan_in({
        "exact_document": retrieval.exact_channel(c, "content", NEEDLE, 20),
        "vector": retrieval.vector_channel(c, "embedding", _probe(spark, sf), 20),
        "full_text": retrieval.keyword_channel(c, "content", QUESTION, 20),
    })
    return cut(ranked, "ranked")  # sixty rows, named several times by the fusion


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "legal_instruments").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("authority_level", "status", "effective_from"), "instrument_id").alias("m")).select("doc_id", "m.*")


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Three channels fused by reciprocal rank."""
    return retrieval.fuse(_ranked(spark, sf)).select("doc_id", "chunk_id", "channel", "score")


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """The same, raised by authority, status and recency."""
    return retrieval.fuse(_ranked(spark, sf), _meta(spark, sf), 0.5, 0.3, 0.2).select("doc_id", "chunk_id", "channel", "score")


def hybrid_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Cited evidence for a question: channels, fusion, citation ids, and where each passage comes from."""
    cited = retrieval.cite(retrieval.fuse(_ranked(spark, sf), _meta(spark, sf), 0.5, 0.3, 0.2), 12)
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "title")
    return cited.join(d, "doc_id", "left").select("citation_id", "position", "doc_id", "chunk_id", "channel", "score", "lang", "source", "title")


def current_guarantee(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten of the fused evidence, in which every current instrument that was ranked has a place."""
    current = table(spark, sf, "legal_instruments").filter("status = 'in_force' AND doc_id IS NOT NULL").select("doc_id")
    return retrieval.guarantee_current(retrieval.fuse(_ranked(spark, sf)), current, 10)


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the legal documents as this library cuts them, each with its section."""
    d = table(spark, sf, "documents").filter("document_type = 'legal' AND status = 'completed'")
    return chunking.section_chunks(d, "text", 800, 120, "doc_id")


def section_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the exact hits as whole texts: document, kind and number name a section."""
    c = _sections(spark, sf).filter("section_number IS NOT NULL").withColumnRenamed("chunk_index", "chunk_id").withColumn("chunk_index", F.col("chunk_id"))
    hits = c.join(retrieval.exact_channel(c, "content", THAI_NEEDLE, 15), ["doc_id", "chunk_id"], "left_semi").select("doc_id", "section_kind", "section_number")
    return retrieval.expand_sections(hits, c).select("doc_id", "section_kind", "section_number", "n_chunks", F.length("excerpt").alias("n_chars"), F.sha2("excerpt", 256).alias("digest"))


def citation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Answers held to their sources: which cited ids exist, and what happens to the answer."""
    e = table(spark, sf, "events").filter("event_type = 'view'")
    n = F.col("event_id") % 7
    answer = F.concat(F.lit("See [S"), (n + 1).cast("string"), F.lit("] and [S"), (n + 9).cast("string"), F.lit("], also [S"), (n + 1).cast("string"), F.lit("]."))
    cited = text.citations(F.when(n == 6, F.lit("no source")).otherwise(answer))
    known = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("S"), i.cast("string")))
    valid = F.array_intersect(cited, known)
    action = F.when(F.size(valid) == 0, "DROP_ANSWER").when(F.size(valid) < F.size(cited), "DROP_ANSWER_NARROW").otherwise("NARROW")
    return e.select("event_id", F.array_join(cited, ",").alias("cited"), F.array_join(valid, ",").alias("valid"), action.alias("action"))


def evidence_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all instruments as they stand beside evidence; an unknown status is left out."""
    i = table(spark, sf, "legal_instruments")
    status = F.when(F.col("status") != "unknown", F.col("status"))
    return i.select("instrument_id", F.concat_ws(" | ", "display_title", "official_number", status, F.col("effective_from").cast("string")).alias("label"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every name, every alias and the first word of every name, as they may be asked for."""
    e = table(spark, sf, "knowledge_entities")
    name = F.col("name")
    said = e.select(F.explode(F.concat(F.array(name, F.element_at(F.split(text.squeeze(name), " "), 1)), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t"))
    return said.select(text.canonical_name(F.col("t")).alias("asked")).filter(F.length("asked") > 0).distinct()


def entity_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """For everything that may be asked the entity it resolves to: the same canonical name, else one whose name contains it, else an alias; the least id within a step."""
    live = table(spark, sf, "knowledge_entities").filter("deleted_at IS NULL").select("entity_id", text.canonical_name(F.col("name")).alias("canon"), F.lower("name").alias("name"), "aliases")
    return metadata.resolve(_asked(spark, sf), "asked", live, "entity_id", "canon", "name", "aliases")


def intents(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of every held-out question."""
    q = table(spark, sf, "golden_items").select("item_id", "question")
    p = planner.plan(q, "question", planner.meet([planner.Policy(), planner.Policy(maximum_graph_depth=2, default_top_k=10)]))
    return p.select("item_id", "intent", F.array_join("channels", ",").alias("channels"), "graph_scope", "graph_depth", "max_sources")


def title_intents(spark: SparkSession, sf: str) -> DataFrame:
    """Intents by the first rule that holds, counted over the titles and names of all tables."""
    q = table(spark, sf, "documents").select(F.coalesce("title", F.lit("")).alias("q")).unionByName(table(spark, sf, "knowledge_entities").select(F.col("name").alias("q"))).unionByName(table(spark, sf, "document_metadata_values").select(F.coalesce("value_text", F.lit("")).alias("q")))
    return planner.with_intent(q, "q").select("intent", F.size("entity_ids").alias("n_ids")).groupBy("intent").agg(F.count("*").alias("n"), F.sum("n_ids").alias("n_ids"))


_CHUNKS_SQL = "chunks AS (SELECT chunk_id, min(doc_id) AS doc_id, min(chunk_index) AS chunk_index, min(content) AS content, min(section_kind) AS section_kind, min(embedding) AS embedding FROM document_chunks GROUP BY 1)"
_PROBE_SQL = "probe AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)"
_VECTOR = "SELECT doc_id, chunk_id, cos, row_number() OVER (ORDER BY round(cos, 6) DESC, doc_id, chunk_id) AS rank FROM (SELECT doc_id, chunk_id, {cos} AS cos FROM {src}, probe WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0)"
_KEY = """SELECT doc_id, chunk_id, n, tf, row_number() OVER (ORDER BY (n = {all}) DESC, n DESC, tf DESC, doc_id, chunk_id) AS rank
  FROM (SELECT doc_id, chunk_id, len(list_distinct(h)) AS n, len(h) AS tf FROM (SELECT doc_id, chunk_id, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_-]+'), lambda t: t IN ({words})) AS h FROM chunks) WHERE len(h) > 0)"""
_WORDS = "'tenant', 'applicant', 'register'"
_KEY3 = _KEY.format(all=3, words=_WORDS)
_CHANNELS = f"""
{_CHUNKS_SQL}, {_PROBE_SQL},
exact0 AS (SELECT doc_id, chunk_id, row_number() OVER (ORDER BY doc_id, chunk_id) AS rank FROM chunks WHERE contains(lower(content), '{NEEDLE}')),
vector0 AS ({_VECTOR.format(cos=_COS, src="chunks")}),
key0 AS ({_KEY3}), key1 AS (SELECT * FROM key0 WHERE rank <= 20), key2 AS (SELECT * FROM key1 WHERE n = 3 OR (SELECT max(n) FROM key1) < 3),
ranked AS (
  SELECT doc_id, chunk_id, rank, round(1 / rank, 6) AS relevance, 'exact_document' AS channel, 0 AS ord FROM exact0 WHERE rank <= 20
  UNION ALL SELECT doc_id, chunk_id, rank, round(greatest(0, cos), 6), 'vector', 1 FROM vector0 WHERE rank <= 20
  UNION ALL SELECT doc_id, chunk_id, rank, round(1 / rank, 6), 'full_text', 2 FROM key2),
fused AS (SELECT doc_id, chunk_id, sum(1 / (60 + rank)) AS score, (list(channel ORDER BY relevance DESC, ord, rank))[1] AS channel, min(ord * 1000 + rank) AS first FROM ranked GROUP BY 1, 2)"""
_META_SQL = """
meta AS (SELECT doc_id, (list(authority_level ORDER BY instrument_id))[1] AS authority_level, (list(status ORDER BY instrument_id))[1] AS status, (list(effective_from ORDER BY instrument_id))[1] AS effective_from FROM legal_instruments WHERE doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM fused) GROUP BY 1),
ages AS (SELECT doc_id, 1 - (row_number() OVER (ORDER BY effective_from DESC, doc_id) - 1) / greatest(count(*) OVER () - 1, 1) AS age FROM meta WHERE effective_from IS NOT NULL),
weighted AS (SELECT f.doc_id, f.chunk_id, f.channel, f.first, round(f.score * (1 + coalesce(0.5 * m.authority_level / 100 + 0.3 * CASE m.status WHEN 'in_force' THEN 1.0 WHEN 'amended' THEN 0.85 WHEN 'not_yet_effective' THEN 0.3 WHEN 'superseded' THEN 0.1 WHEN 'repealed' THEN 0.1 ELSE 0.5 END + 0.2 * coalesce(a.age, 0.5), 0)), 6) AS score
  FROM fused f LEFT JOIN meta m USING (doc_id) LEFT JOIN ages a USING (doc_id))"""


def _intent_sql(q: str) -> str:
    low = f"lower(trim({q}))"
    any_ = lambda ws: "(" + " OR ".join(f"contains({low}, '{w}')" for w in ws) + ")"
    # RE2 takes only ASCII for word characters, so the boundaries are written out.
    whole = lambda p: r"(?:^|[^\p{L}\p{N}_])" + p.replace(r"\b", "") + r"(?:$|[^\p{L}\p{N}_])"
    docs = f"regexp_extract_all({q}, '{whole(planner.DOCUMENT_ID)}', 1)"
    ents = f"list_filter(regexp_extract_all({q}, '{whole(planner.ENTITY_ID)}', 1), lambda e: len(list_filter({docs}, lambda d: contains(d, e))) = 0)"
    month = "(" + " OR ".join(f"contains(lower({q}), '{w}')" for ws in planner.MONTHS.values() for w in ws) + f") AND regexp_matches(lower({q}), '\\b20\\d{{2}}\\b')"
    return f"""CASE WHEN len({docs}) > 0 THEN 'document_exact' WHEN {any_(planner.IMPACT)} THEN 'impact_analysis' WHEN {any_(planner.NEWS)} AND {month} THEN 'news_by_date'
 WHEN {any_(planner.OVERVIEW)} AND {any_(planner.RELATED)} THEN 'graph_global' WHEN {any_(planner.CAUSE)} THEN 'semantic_global' WHEN len({ents}) > 0 AND {any_(planner.CONNECT)} THEN 'relationship_local'
 WHEN regexp_matches({low}, '{planner.PROVISION}') THEN 'legal_provision' WHEN {any_(planner.HOW)} THEN 'how_to' WHEN len({ents}) > 0 THEN 'entity_lookup' ELSE 'semantic_hybrid' END""", ents


def _canon(column: str) -> str:
    return "lower(trim(regexp_replace(" + column + r", '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')))"


_SECTION_CHUNKS = f"""{text_queries.SECTIONS_SQL}, flat AS (SELECT doc_id, section_no, section_kind, section_number, {text_queries.squeeze_sql("body")} AS t FROM sections WHERE length({text_queries.squeeze_sql("body")}) > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE status = 'completed')),
{text_queries.CHUNKS_SQL.format(keys="doc_id, section_no, section_kind, section_number")},
cut AS (SELECT doc_id, section_kind, section_number, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, chunk_index) - 1 AS chunk_index, trim(substr(t, s + 1, e - s)) AS content FROM walk)"""
_PLANS = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{','.join(c for c in v[0] if planner.Policy().allows(c))}'" for k, v in planner.CHANNELS.items()) + " END"

SQL = {
    "vector_topk": f"WITH {_PROBE_SQL} SELECT chunk_id, round(greatest(0, cos), 6) AS relevance, CAST(rank AS INT) AS rank FROM ({_VECTOR.format(cos=_COS, src='(SELECT vec_id AS doc_id, vec_id AS chunk_id, embedding FROM embeddings) e')}) WHERE rank <= 20",
    "vector_topk_filtered": f"WITH {_CHUNKS_SQL}, {_PROBE_SQL}, live AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE status = 'completed' AND published_at >= DATE '2015-01-01' AND published_at < DATE '2022-01-01')) SELECT doc_id, chunk_id, round(greatest(0, cos), 6) AS relevance, CAST(rank AS INT) AS rank FROM ({_VECTOR.format(cos=_COS, src='live')}) WHERE rank <= 12",
    "keyword_chunks": f"WITH {_CHUNKS_SQL}, k AS ({_KEY3}), t AS (SELECT * FROM k WHERE rank <= 20) SELECT doc_id, chunk_id, round(1 / rank, 6) AS relevance, CAST(rank AS INT) AS rank FROM t WHERE n = 3 OR (SELECT max(n) FROM t) < 3",
    "keyword_any": f"WITH {_CHUNKS_SQL}, k AS ({_KEY.format(all=3, words=chr(39) + 'quarry' + chr(39) + ', ' + chr(39) + 'zzqx' + chr(39) + ', ' + chr(39) + 'harbour' + chr(39))}) SELECT doc_id, chunk_id, round(1 / rank, 6) AS relevance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 20",
    "exact_passage": f"WITH {_CHUNKS_SQL}, e AS (SELECT doc_id, chunk_id, row_number() OVER (ORDER BY doc_id, chunk_id) AS rank FROM chunks WHERE contains(lower(content), '{NEEDLE}')) SELECT doc_id, chunk_id, round(1 / rank, 6) AS relevance, CAST(rank AS INT) AS rank FROM e WHERE rank <= 25",
    "rrf_fusion": f"WITH {_CHANNELS} SELECT doc_id, chunk_id, channel, round(score, 6) AS score FROM fused",
    "rrf_weighted": f"WITH {_CHANNELS}, {_META_SQL} SELECT doc_id, chunk_id, channel, score FROM weighted",
    "hybrid_evidence": f"WITH {_CHANNELS}, {_META_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, first, doc_id, chunk_id) AS position FROM weighted) SELECT 'S' || position AS citation_id, CAST(position AS INT) AS position, doc_id, chunk_id, channel, score, lang, source, title FROM p LEFT JOIN documents USING (doc_id) WHERE position <= 12",
    "current_guarantee": f"""WITH {_CHANNELS}, pool AS (SELECT doc_id, chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id, chunk_id) AS position FROM fused),
cur AS (SELECT DISTINCT doc_id FROM legal_instruments WHERE status = 'in_force' AND doc_id IS NOT NULL),
fill AS (SELECT * FROM pool WHERE doc_id IN (SELECT doc_id FROM cur) AND doc_id NOT IN (SELECT doc_id FROM pool WHERE position <= 10) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY position) = 1 ORDER BY position LIMIT 10),
both_ AS (SELECT *, false AS backfilled FROM pool WHERE position <= 10 - (SELECT count(*) FROM fill) UNION ALL SELECT *, true FROM fill)
SELECT CAST(row_number() OVER (ORDER BY backfilled, position) AS INT) AS place, doc_id, chunk_id, score, backfilled FROM both_""",
    "section_expand": f"""WITH RECURSIVE {_SECTION_CHUNKS}, c AS (SELECT * FROM cut WHERE section_number IS NOT NULL), h AS (SELECT DISTINCT doc_id, section_kind, section_number FROM (SELECT * FROM c WHERE contains(lower(content), '{THAI_NEEDLE}') ORDER BY doc_id, chunk_index LIMIT 15)),
w AS (SELECT doc_id, section_kind, section_number, count(*) AS n, left(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), 12000) AS x FROM c JOIN h USING (doc_id, section_kind, section_number) GROUP BY 1, 2, 3)
SELECT doc_id, section_kind, section_number, CAST(n AS INT) AS n_chunks, CAST(length(x) AS INT) AS n_chars, sha256(x) AS digest FROM w""",
    "citation_gate": """
WITH e AS (SELECT event_id, event_id % 7 AS n FROM events WHERE event_type = 'view')
SELECT event_id, CASE WHEN n = 6 THEN '' ELSE 'S' || (n + 1) || ',S' || (n + 9) END AS cited, CASE WHEN n = 6 THEN '' WHEN n + 9 <= 12 THEN 'S' || (n + 1) || ',S' || (n + 9) ELSE 'S' || (n + 1) END AS valid,
  CASE WHEN n = 6 THEN 'DROP_ANSWER' WHEN n + 9 > 12 THEN 'DROP_ANSWER_NARROW' ELSE 'NARROW' END AS action FROM e""",
    "evidence_labels": "SELECT instrument_id, concat_ws(' | ', display_title, official_number, CASE WHEN status <> 'unknown' THEN status END, CAST(effective_from AS VARCHAR)) AS label FROM legal_instruments",
    "entity_cascade": f"""
WITH live AS (SELECT entity_id, {_canon("name")} AS canon, lower(name) AS low, aliases FROM knowledge_entities WHERE deleted_at IS NULL),
said AS (SELECT name AS t FROM knowledge_entities UNION ALL SELECT string_split({_canon("name")}, ' ')[1] FROM knowledge_entities UNION ALL SELECT unnest(aliases) FROM knowledge_entities),
asked AS (SELECT DISTINCT {_canon("t")} AS asked FROM said WHERE length({_canon("t")}) > 0), al AS (SELECT entity_id, {_canon("a")} AS canon FROM (SELECT entity_id, unnest(aliases) AS a FROM live)),
hits AS (SELECT asked, 1 AS step, entity_id FROM asked JOIN live ON asked = canon UNION ALL SELECT asked, 2, entity_id FROM asked JOIN live ON contains(low, asked) UNION ALL SELECT asked, 3, entity_id FROM asked JOIN al ON asked = canon)
SELECT asked, step, entity_id FROM hits QUALIFY row_number() OVER (PARTITION BY asked ORDER BY step, entity_id) = 1""",
    "intents": f"WITH q AS (SELECT item_id, {_intent_sql('question')[0]} AS intent FROM golden_items) SELECT item_id, intent, {_PLANS} AS channels, CASE WHEN intent IN ('relationship_local', 'entity_lookup', 'impact_analysis', 'legal_provision') THEN 'local' WHEN intent IN ('semantic_global', 'graph_global') THEN 'global' ELSE 'none' END AS graph_scope, CASE WHEN intent = 'impact_analysis' THEN 2 ELSE 1 END AS graph_depth, 10 AS max_sources FROM q",
    "title_intents": f"WITH q AS (SELECT coalesce(title, '') AS q FROM documents UNION ALL SELECT name FROM knowledge_entities UNION ALL SELECT coalesce(value_text, '') FROM document_metadata_values), i AS (SELECT {_intent_sql('q')[0]} AS intent, len({_intent_sql('q')[1]}) AS n_ids FROM q) SELECT intent, count(*) AS n, CAST(sum(n_ids) AS BIGINT) AS n_ids FROM i GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (
    hybrid_evidence, vector_topk, vector_topk_filtered, keyword_chunks, keyword_any, exact_passage, rrf_fusion, rrf_weighted, current_guarantee, section_expand, citation_gate, evidence_labels, entity_cascade, intents, title_intents,
)}
