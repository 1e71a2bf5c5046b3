"""Queries over texts, names and titles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal, text
from ..operators import chunking
from ..sources import documents as docs
from ..sources.tables import table

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeeze_sql(column: str) -> str:
    return "trim(regexp_replace(" + column + ", '" + _SPACE + "+', ' ', 'g'))"


_CANON = f"lower(trim(regexp_replace(name, '{_SPACE}+', ' ', 'g')))"


def normalize_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical names, identity keys and fingerprints of all entities."""
    e = table(spark, sf, "knowledge_entities")
    return e.select("entity_id", text.canonical_name(F.col("name")).alias("canonical"), text.identity_key(F.col("name")).alias("identity"), text.fingerprint(F.col("name")).alias("fingerprint"))


def script_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of Thai and of non-ASCII signs, and what each text layer is good for."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.round(text.thai_share(t), 6).alias("thai_share"), F.round(text.non_ascii_share(t), 6).alias("non_ascii_share"), text.text_layer_state(t).alias("state"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words, content hash and excerpt of all chunks."""
    c = table(spark, sf, "document_chunks").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", text.token_count(F.col("content")).alias("n_words"), F.sha2("content", 256).alias("content_sha256"), F.left("content", F.lit(500)).alias("excerpt"))


def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most frequent words of all documents."""
    words = table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


def injection_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose text looks like instructions, and the length of every fenced text."""
    r = table(spark, sf, "ingest_requests").groupBy("request_id").agg(F.min("text").alias("text"))
    return r.select("request_id", text.injection_suspected(F.col("text")).alias("suspected"), F.length(text.fenced(F.col("text"))).alias("n_fenced"))


def secret_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Event details as they may be stored: cut at secrets and to a length."""
    raw = F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" Bearer "), "props")).when(F.col("event_id") % 7 == 0, F.concat(F.lit("\nkey sk-or-"), "props")).otherwise(F.concat(F.lit(" "), "props")))
    return table(spark, sf, "events").select("event_id", text.redacted(raw).alias("detail"))


def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by route, identifiers made equal."""
    hex_ = F.lower(F.lpad(F.hex(F.col("user_id")), 8, "0"))
    path = F.concat(F.lit("/api/"), "event_type", F.lit("/"), hex_, F.lit("-0000-4000-8000-"), F.lpad(hex_, 12, "0"))
    return table(spark, sf, "events").groupBy(text.route(path).alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def file_stems(spark: SparkSession, sf: str) -> DataFrame:
    """File names for the titles of all requests."""
    r = table(spark, sf, "ingest_requests").groupBy("request_id").agg(F.min("title").alias("title"))
    return r.select("request_id", text.file_stem(F.coalesce("title", F.lit(""))).alias("stem"))


def instrument_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, authority, edition and year that every title names."""
    i = table(spark, sf, "legal_instruments")
    kind = legal.kind_of(F.coalesce("display_title", F.lit("")), F.col("kind"))
    return i.select("instrument_id", kind.alias("kind"), legal.authority_of(kind).alias("authority"), legal.version_number(F.col("display_title")).alias("version"), legal.enacted_year(F.col("display_title")).alias("year"))


def instrument_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families of editions: how many share a title without edition and year."""
    i = table(spark, sf, "legal_instruments").filter("display_title IS NOT NULL")
    return i.groupBy(legal.family_key(F.col("display_title")).alias("family")).agg(F.count("*").alias("n"), F.min("instrument_id").alias("first_id"))


def provision_references(spark: SparkSession, sf: str) -> DataFrame:
    """How often each provision is referred to in all excerpts."""
    e = table(spark, sf, "entity_sources").groupBy("source_id").agg(F.min("excerpt").alias("excerpt"))
    refs = e.select(F.explode(legal.provision_refs(F.col("excerpt"))).alias("r"))
    return refs.groupBy("r.kind", "r.number").agg(F.count("*").alias("n"))


def provision_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Sections compared as numbers: how many chunk headings name the same provision as another spelling."""
    c = table(spark, sf, "documents").filter("document_type = 'legal'")
    heads = chunking.sections(c, "text", "doc_id").filter("section_number IS NOT NULL")
    return heads.groupBy(legal.provision_number(F.col("section_label")).alias("provision")).agg(F.count("*").alias("n"), F.countDistinct("section_number").alias("n_spellings"))


def written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written out in Thai and in ISO, read back."""
    i = table(spark, sf, "legal_instruments").filter("effective_from IS NOT NULL")
    d = F.col("effective_from")
    month = F.element_at(F.array(*[F.lit(m) for m in legal.MONTHS]), F.month(d))
    thai = F.concat(F.lit("ณ วันที่ "), F.translate(F.dayofmonth(d).cast("string"), text.ARABIC_DIGITS, text.THAI_DIGITS), F.lit(" "), month, F.lit(" "), (F.year(d) + 543).cast("string"))
    return i.select("instrument_id", legal.written_date(thai).alias("from_thai"), legal.written_date(F.concat(d.cast("string"), F.lit("T00:00"))).alias("from_iso"), legal.written_date(F.lit("31 กุมภาพันธ์ 2560")).alias("never"))


def word_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut at word boundaries: spans, words and hashes."""
    c = chunking.chunk(table(spark, sf, "documents"), "text", 800, 120, "doc_id")
    return c.select("doc_id", "chunk_index", "char_start", "char_end", text.token_count(F.col("content")).alias("n_words"), F.sha2("content", 256).alias("content_sha256"))


def legal_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all legal documents with their labels and lengths."""
    d = table(spark, sf, "documents").filter("document_type = 'legal'")
    return chunking.sections(d, "text", "doc_id").select("doc_id", "section_no", "section_kind", "section_number", "section_label", F.length("body").alias("n_chars"))


def legal_section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all legal documents, each with its section and its place in the document."""
    d = table(spark, sf, "documents").filter("document_type = 'legal'")
    c = chunking.section_chunks(d, "text", 800, 120, "doc_id")
    return c.select("doc_id", "chunk_index", "section_kind", "section_number", "section_label", "char_start", "char_end", F.sha2("content", 256).alias("content_sha256"))


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all corpora, numbered where two would be equal."""
    from pyspark.sql import Window

    k = table(spark, sf, "knowledge_bases").select("knowledge_base_id", text.slug(F.col("name")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("knowledge_base_id"))
    return k.select("knowledge_base_id", F.when(n > 1, F.concat("slug", F.lit("-"), n.cast("string"))).otherwise(F.col("slug")).alias("code"))


def html_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as HTML and read back: text and table rows."""
    d = table(spark, sf, "documents")
    esc = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><style>p{}</style></head><body><h1>"), F.coalesce(esc, F.lit("-")), F.lit("</h1><!-- x --><script>var a=1;</script><table><tr><th>lang</th><th>kind</th></tr><tr><td>"), F.coalesce("lang", F.lit("?")), F.lit("</td><td>"), F.col("document_type"), F.lit("</td></tr></table></body></html>"))
    return d.select("doc_id", F.element_at(F.split(docs.html_text(html), "\n"), 1).alias("heading"), docs.table_rows(html).alias("rows"))


def intake_states(spark: SparkSession, sf: str) -> DataFrame:
    """How many requests are taken in or rejected, and why; items fail one by one."""
    r = docs.accepted(table(spark, sf, "ingest_requests").dropDuplicates(["request_id"]), "text")
    return r.groupBy(F.coalesce("rejection", F.lit("ACCEPTED")).alias("state")).agg(F.count("*").alias("n"))


def live_content(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are the first with their content in their corpus."""
    d = docs.live_once(table(spark, sf, "documents"), "knowledge_base_id", text="text", order=[F.col("created_at"), F.col("doc_id")])
    return d.select("doc_id", "knowledge_base_id", "sha256")


def fallback_values(spark: SparkSession, sf: str) -> DataFrame:
    """The first filled of several descriptions of every entity."""
    e = table(spark, sf, "knowledge_entities")
    return e.select("entity_id", text.first_filled(F.col("description"), F.get("aliases", F.lit(0)), F.col("name")).alias("label"))


def retry_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting times and failure codes of an event log."""
    e = table(spark, sf, "events")
    detail = F.when(F.col("event_type") == "error", F.lit("HTTP 402 Payment Required")).otherwise(F.col("props"))
    attempt = (F.col("event_id") % 9).cast("int")
    code = text.failure_code(detail)
    return e.select("event_id", text.retry_delay(attempt, code == "RETRIEVAL_ENGINE_BUDGET_EXHAUSTED").alias("delay"), code.alias("code"))


def _kinds_sql() -> str:
    thai = " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in legal.THAI_KINDS.items())
    english = " ".join(f"WHEN regexp_matches(lower(t), '\\b(?:{'|'.join(ws)})\\b') THEN '{k}'" for k, ws in legal.ENGLISH_KINDS.items())
    known = ", ".join(f"'{k}'" for k in legal.AUTHORITY)
    return f"CASE {thai} {english} WHEN replace(lower(trim(hint)), ' ', '_') IN ({known}) THEN replace(lower(trim(hint)), ' ', '_') ELSE 'other' END"


_AUTHORITY_SQL = "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in legal.AUTHORITY.items()) + " END"
_DIGITS = "translate({}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"
_HEAD = chunking.HEADING
SECTIONS_SQL = rf"""
parts AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(57384), ''), '{_HEAD}', chr(57384) || '\0', 'g'), chr(57384)) AS p FROM documents WHERE document_type = 'legal'),
raw AS (SELECT doc_id, i - 1 AS section_no, p[i] AS body FROM parts, range(1, len(p) + 1) r(i)),
sections AS (
  SELECT doc_id, CAST(section_no AS INT) AS section_no, body,
    CASE WHEN section_no = 0 THEN 'preamble' ELSE nullif(regexp_extract(body, '{_HEAD}', 1), '') END AS section_kind,
    CASE WHEN section_no > 0 THEN {_DIGITS.format(f"nullif(regexp_extract(body, '{_HEAD}', 2), '')")} || coalesce(' ' || nullif(regexp_extract(body, '{_HEAD}', 3), ''), '') END AS section_number
  FROM raw WHERE length(body) > 0)"""
CHUNKS_SQL = """
walk AS (
  SELECT {keys}, t, 0 AS chunk_index, 0 AS s, CASE WHEN length(t) > 800 THEN 800 - coalesce(nullif(instr(reverse(substr(t, 401, 400)), ' '), 0), 0) ELSE length(t) END AS e FROM flat
  UNION ALL
  SELECT {keys}, t, chunk_index + 1, n, CASE WHEN n + 800 < length(t) THEN n + 800 - coalesce(nullif(instr(reverse(substr(t, n + 401, 400)), ' '), 0), 0) ELSE length(t) END
  FROM (SELECT {keys}, t, chunk_index, greatest(e - 120, s + 1) AS n FROM walk WHERE e < length(t)))"""

SQL = {
    "normalize_identity": f"SELECT entity_id, {_CANON} AS canonical, 'generic:' || {_CANON} AS identity, left(sha256({_CANON}), 24) AS fingerprint FROM knowledge_entities",
    "script_shares": r"""
SELECT doc_id, round(thai, 6) AS thai_share, round(other, 6) AS non_ascii_share,
  CASE WHEN n < 200 THEN CASE WHEN word >= 20 THEN 'short' ELSE 'blank' END WHEN thai < 0.02 AND other >= 0.30 THEN 'unreadable' ELSE 'usable' END AS state
FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS word,
  coalesce(length(regexp_replace(text, '[^\x{0E00}-\x{0E7F}]', '', 'g')) / nullif(length(text), 0), 0.0) AS thai,
  coalesce(length(regexp_replace(text, '[\x20-\x7e\n\t]', '', 'g')) / nullif(length(text), 0), 0.0) AS other FROM documents)""",
    "token_counts": r"""
SELECT chunk_id, CAST(len(regexp_extract_all(content, '[^\s\x0b]+')) AS INT) AS n_words, sha256(content) AS content_sha256, left(content, 500) AS excerpt
FROM (SELECT DISTINCT chunk_id, content FROM document_chunks)""",
    "top_terms": r"""
SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')) AS term FROM documents) WHERE length(term) > 1
GROUP BY term ORDER BY n DESC, term LIMIT 50""",
    "injection_guard": r"""
WITH r AS (SELECT request_id, min(text) AS text FROM ingest_requests GROUP BY 1),
s AS (SELECT request_id, trim(replace(text, chr(0), '')) AS b, regexp_matches(text, '(?i)\b(ignore|disregard|override)\b.{0,80}\b(instruction|prompt|previous)\b|\b(system\s+message|developer\s+message|jailbreak)\b') AS hit FROM r)
SELECT request_id, hit AS suspected, CAST(length(b) + CASE WHEN hit THEN 124 ELSE 0 END AS INT) AS n_fenced FROM s""",
    "secret_redaction": r"""
WITH raw AS (SELECT event_id, replace(event_type || CASE WHEN event_id % 3 = 0 THEN ' Bearer ' || props WHEN event_id % 7 = 0 THEN chr(10) || 'key sk-or-' || props ELSE ' ' || props END, chr(10), ' ') AS d FROM events)
SELECT event_id, left(CASE WHEN contains(d, 'Bearer ') THEN split_part(d, 'Bearer ', 1) || '[redacted]' WHEN contains(d, 'sk-or-') THEN split_part(d, 'sk-or-', 1) || '[redacted]' ELSE d END, 240) AS detail FROM raw""",
    "route_counts": "SELECT '/api/' || event_type || '/:id' AS route, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "file_stems": r"""
SELECT request_id, left(CASE WHEN length(s) > 0 THEN s ELSE 'document' END, 120) AS stem
FROM (SELECT request_id, trim(regexp_replace(coalesce(min(title), ''), '[^\p{L}\p{Nd}\p{Nl}\p{No}\-_ .()]', '_', 'g')) AS s FROM ingest_requests GROUP BY 1)""",
    "instrument_kinds": f"""
WITH k AS (SELECT instrument_id, coalesce(display_title, '') AS t, display_title AS title, kind AS hint FROM legal_instruments),
n AS (SELECT *, {_kinds_sql()} AS k, regexp_replace(title, '\\(\\s*ฉบับที่\\s*[0-9๐-๙]+\\s*\\)', '', 'g') AS body FROM k)
SELECT instrument_id, k AS kind, {_AUTHORITY_SQL} AS authority, nullif({_DIGITS.format("regexp_extract(title, '\\(\\s*ฉบับที่\\s*([0-9๐-๙]+)\\s*\\)', 1)")}, '') AS version,
  CASE WHEN regexp_extract(body, '{legal.BUDDHIST_YEAR}', 1) <> '' THEN CAST({_DIGITS.format(f"regexp_extract(body, '{legal.BUDDHIST_YEAR}', 1)")} AS INT) - 543
       WHEN regexp_extract(body, '{legal.COMMON_YEAR}', 1) <> '' THEN CAST({_DIGITS.format(f"regexp_extract(body, '{legal.COMMON_YEAR}', 1)")} AS INT) END AS year
FROM n""",
    "instrument_families": f"""
WITH a AS (SELECT instrument_id, regexp_replace(trim(display_title), '{legal.VERSION}', '') AS t FROM legal_instruments WHERE display_title IS NOT NULL),
b AS (SELECT instrument_id, CASE WHEN regexp_matches(t, '{legal.BUDDHIST_YEAR}') THEN regexp_replace(t, '{legal.BUDDHIST_YEAR}', '') ELSE regexp_replace(t, '{legal.COMMON_YEAR}', '') END AS t FROM a)
SELECT lower({squeeze_sql("t")}) AS family, count(*) AS n, min(instrument_id) AS first_id FROM b GROUP BY 1""",
    "provision_references": f"""
WITH e AS (SELECT source_id, min(excerpt) AS t FROM entity_sources GROUP BY 1),
r AS (SELECT unnest(regexp_extract_all(t, '{legal.REFERENCE}', 1)) AS k, unnest(regexp_extract_all(t, '{legal.REFERENCE}', 2)) AS n, unnest(regexp_extract_all(t, '{legal.REFERENCE}', 3)) AS s FROM e)
SELECT CASE lower(k) WHEN 'section' THEN 'มาตรา' WHEN 'article' THEN 'มาตรา' WHEN 'clause' THEN 'ข้อ' ELSE k END AS kind, {_DIGITS.format("n")} || CASE WHEN s <> '' THEN ' ' || s ELSE '' END AS number, count(*) AS n
FROM r GROUP BY 1, 2""",
    "word_chunks": f"""
WITH RECURSIVE flat AS (SELECT doc_id, {squeeze_sql("text")} AS t FROM documents WHERE length({squeeze_sql("text")}) > 0), {CHUNKS_SQL.format(keys="doc_id")}
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end, CAST(len(regexp_extract_all(trim(substr(t, s + 1, e - s)), '[^\\s\\x0b]+')) AS INT) AS n_words, sha256(trim(substr(t, s + 1, e - s))) AS content_sha256
FROM walk""",
    "legal_sections": f"WITH {SECTIONS_SQL} SELECT doc_id, section_no, section_kind, section_number, CASE WHEN section_no > 0 THEN concat_ws(' ', section_kind, section_number) END AS section_label, CAST(length(body) AS INT) AS n_chars FROM sections",
    "legal_section_chunks": f"""
WITH RECURSIVE {SECTIONS_SQL}, places AS (SELECT *, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY section_no) - length(body) AS off FROM sections),
flat AS (SELECT doc_id, section_no, section_kind, section_number, off, {squeeze_sql("body")} AS t FROM places WHERE length({squeeze_sql("body")}) > 0), {CHUNKS_SQL.format(keys="doc_id, section_no, section_kind, section_number, off")}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, chunk_index) - 1 AS INT) AS chunk_index, section_kind, section_number, CASE WHEN section_no > 0 THEN concat_ws(' ', section_kind, section_number) END AS section_label,
  CAST(off + s AS INT) AS char_start, CAST(off + e AS INT) AS char_end, sha256(trim(substr(t, s + 1, e - s))) AS content_sha256 FROM walk""",
    "slugs": r"""
WITH s AS (SELECT knowledge_base_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM knowledge_bases),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY knowledge_base_id) AS n FROM s)
SELECT knowledge_base_id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS code FROM n""",
    "written_dates": "SELECT instrument_id, effective_from AS from_thai, effective_from AS from_iso, CAST(NULL AS DATE) AS never FROM legal_instruments WHERE effective_from IS NOT NULL",
    "html_round_trip": f"SELECT doc_id, coalesce({squeeze_sql('title')}, '-') AS heading, 'lang | kind' || chr(10) || coalesce(lang, '?') || ' | ' || document_type AS rows FROM documents",
    "intake_states": "SELECT CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'BLANK_TEXT' WHEN strlen(text) > 20971520 THEN 'TEXT_TOO_LARGE' ELSE 'ACCEPTED' END AS state, count(*) AS n FROM (SELECT request_id, min(text) AS text FROM ingest_requests GROUP BY 1) GROUP BY 1",
    "live_content": "SELECT doc_id, knowledge_base_id, sha256(text) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY knowledge_base_id, sha256(text) ORDER BY created_at, doc_id) = 1",
    "fallback_values": "SELECT entity_id, coalesce(nullif(trim(description), ''), nullif(trim(aliases[1]), ''), nullif(trim(name), '')) AS label FROM knowledge_entities",
    "retry_delays": """
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 60 ELSE least(60, power(2, least(6, greatest(1, event_id % 9)))) END AS INT) AS delay,
  CASE WHEN event_type = 'error' THEN 'RETRIEVAL_ENGINE_BUDGET_EXHAUSTED' WHEN contains(props, '402') THEN 'RETRIEVAL_ENGINE_BUDGET_EXHAUSTED' ELSE 'RETRIEVAL_ENGINE_REJECTED' END AS code FROM events""",
}

QUERIES = {f.__name__: f for f in (
    normalize_identity, script_shares, token_counts, top_terms, injection_guard, secret_redaction, route_counts, file_stems, instrument_kinds, instrument_families, provision_references,
    provision_matches, written_dates, word_chunks, legal_sections, legal_section_chunks, slugs, html_round_trip, intake_states, live_content, fallback_values, retry_delays,
)}
