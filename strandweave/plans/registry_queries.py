"""Queries over metadata, versions, graphs, logs and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import legal
from ..operators import graph, metadata, observe, registry
from ..sources.tables import table
from ..streaming import flows

DAY = "2016-06-30"


def publication_window(spark: SparkSession, sf: str) -> DataFrame:
    """Documents published within a half-open window."""
    return metadata.published_between(table(spark, sf, "documents"), "published_at", "2018-01-01", "2021-01-01").select("doc_id", "published_at", "document_type")


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_metadata_values").dropDuplicates(["value_id"])


def metadata_division(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that carry every one of several values."""
    return metadata.having_all(_values(spark, sf), "doc_id", "field_key", "value_text", {"classification": "restricted", "budget_year": "2561"}).unionByName(
        metadata.having_all(_values(spark, sf), "doc_id", "field_key", "value_text", {"classification": "ลับ"})).distinct()


def metadata_search_text(spark: SparkSession, sf: str) -> DataFrame:
    """The searchable text of every document's metadata, in field order."""
    return metadata.search_text(_values(spark, sf), "doc_id", "field_key", "value_text")


def metadata_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata values by kind of field: how many fit."""
    kind = F.when(F.col("field_key") == "budget_year", "number").otherwise("text")
    v = _values(spark, sf)
    return v.groupBy("field_key").agg(F.count("*").alias("n"), F.count(metadata.checked(F.translate("value_text", "๐๑๒๓๔๕๖๗๘๙", "0123456789"), kind)).alias("n_valid"))


def inventory_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents counted by type, kind, class and status in one pass."""
    i = table(spark, sf, "legal_instruments").select("doc_id", F.col("kind").alias("legal_kind"), "document_class", F.col("status").alias("legal_status")).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    d = table(spark, sf, "documents").select("doc_id", "document_type").join(i, "doc_id", "left")
    return metadata.inventory(d, "document_type", "legal_kind", "document_class", "legal_status")


def inventory_members(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each type and corpus: how many, the first and last id, and a check sum of the ids; no group is gathered."""
    d = table(spark, sf, "documents").groupBy("knowledge_base_id", "document_type")
    return d.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum(F.pmod(F.col("doc_id") * 7919, F.lit(1_000_003))).alias("check_sum"))


def metadata_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose title or metadata contains a term, ignoring case; the term's wildcards stand for themselves."""
    d = table(spark, sf, "documents").select("doc_id", "title")
    s = metadata.search_text(_values(spark, sf), "doc_id", "field_key", "value_text")
    hit = lambda c: F.contains(F.lower(c), F.lit("office"))
    return d.join(s, "doc_id", "left").filter(F.coalesce(hit("title"), F.lit(False)) | F.coalesce(hit("search_text"), F.lit(False))).select("doc_id")


def visible_corpora(spark: SparkSession, sf: str) -> DataFrame:
    """Documents within reach of a set of active corpora, and those without."""
    active = table(spark, sf, "knowledge_bases").filter("status = 'active'").select("knowledge_base_id")
    d = table(spark, sf, "documents").select("doc_id", "knowledge_base_id")
    inside = d.join(active, "knowledge_base_id", "left_semi").groupBy().agg(F.count("*").alias("n")).select(F.lit("visible").alias("scope"), "n")
    return inside.unionByName(d.join(active, "knowledge_base_id", "left_anti").groupBy().agg(F.count("*").alias("n")).select(F.lit("hidden").alias("scope"), "n"))


def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Events by state, in one pass."""
    t = F.col("event_type")
    return observe.status_counts(table(spark, sf, "events"), "event_type", errors=t == "error", clicks=t == "click", queued=t.isin("view", "click"), large=F.col("value") > 50)


def error_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent codes in the properties of error events."""
    e = table(spark, sf, "events").filter("event_type = 'error'").select(F.get_json_object("props", "$.k").alias("code"))
    return observe.top_codes(e, "code", 10)


def latest_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of every user."""
    return metadata.latest_of(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of events, newest first."""
    return metadata.page(table(spark, sf, "events"), 2, 50, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type", "value")


def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty events before a time, and one more that tells there are more."""
    return metadata.after(table(spark, sf, "events"), F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz"), 50, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type", "value")


def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and durations by kind of event."""
    return observe.request_metrics(table(spark, sf, "events"), ["event_type"], F.col("value"))


def offered_load(spark: SparkSession, sf: str) -> DataFrame:
    """The most events a user offered within an hour."""
    o = observe.offered_load(table(spark, sf, "events"), "user_id", "ts", 3600)
    return o.groupBy("user_id").agg(F.max("offered").alias("peak"))


def admitted_load(spark: SparkSession, sf: str) -> DataFrame:
    """Events admitted under a sliding limit of two within six hours, by user."""
    return observe.admitted(table(spark, sf, "events"), "user_id", "ts", 21_600, 2)


def anchored_load(spark: SparkSession, sf: str) -> DataFrame:
    """Events admitted by windows of six hours that open at their first event and count rejected events too, by user."""
    return observe.admitted_anchored(table(spark, sf, "events"), "user_id", "ts", 21_600, 2)


def retention_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and spans kept after the old ones are dropped."""
    e = table(spark, sf, "events")
    runs = e.groupBy("user_id").agg(F.max("ts").alias("ts"))
    kept, spans = observe.retained(runs, e.select("user_id", "event_id"), "user_id", "ts", "2024-01-29")
    return kept.agg(F.lit("runs").alias("what"), F.count("*").alias("n")).unionByName(spans.agg(F.lit("spans").alias("what"), F.count("*").alias("n")))


def span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of spans, those without an offset put after what ended last."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 > 0, (F.col("value") * 100).cast("long")).alias("off"), (F.col("event_id") % 50).alias("dur"))
    return observe.span_offsets(e, "user_id", "event_id", "off", "dur").groupBy("user_id").agg(F.max(F.col("start_at") + F.col("dur")).alias("duration"), F.sum("start_at").alias("sum_start"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users with pauses below six hours."""
    s = observe.sessions(table(spark, sf, "events"), "user_id", "ts", 360)
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of events as exposition lines."""
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return observe.prometheus(n, "events_total", ["event_type"], "n")


def holding_instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments that held on a day."""
    return registry.holding(table(spark, sf, "legal_instruments"), DAY).select("instrument_id", "status", "effective_from", "effective_to")


def amended_editions(spark: SparkSession, sf: str) -> DataFrame:
    """For every amendment the latest main or consolidated text of its corpus not younger than it."""
    i = table(spark, sf, "legal_instruments").filter("version_date IS NOT NULL")
    a = i.filter("document_class = 'amendment'").select("instrument_id", "knowledge_base_id", "version_date")
    m = i.filter("document_class IN ('main', 'consolidated')").select("knowledge_base_id", F.col("version_date").alias("main_date"), F.col("instrument_id").alias("target_id"))
    return registry.as_of(a, m, "knowledge_base_id", "version_date", "main_date", "target_id").select("instrument_id", "target_id", "as_of_day")


def order_prices(spark: SparkSession, sf: str) -> DataFrame:
    """For every order the latest order of the same customer group before its day: an as-of join over hot keys."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("g"), "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    left = o.select("g", F.col("o_orderkey").alias("id"), F.date_sub("d", 1).alias("day"))
    right = o.groupBy("g", "d").agg(F.max("o_orderkey").alias("prior"))
    out = registry.as_of(left, right, "g", "day", "d", "prior")
    return out.groupBy("g").agg(F.count("*").alias("n"), F.count("prior").alias("n_prior"), F.sum("prior").alias("sum_prior"))


def _statuses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    i = table(spark, sf, "legal_instruments")
    n = F.substring("instrument_id", -4, 4).cast("int")
    inst = i.select(F.col("instrument_id").alias("id"), legal.family_key(F.col("display_title")).alias("family"), "status", F.when(n % 11 == 0, "manual").otherwise("resolver").alias("status_source"), "effective_from", F.lit(None).cast("date").alias("effective_to"), "enacted_year", legal.version_number(F.col("display_title")).alias("version"), "knowledge_base_id", n.alias("_n"))
    pairs = inst.select("knowledge_base_id", F.col("id").alias("src"), "_n", "family").withColumn("dst", F.lead("src").over(Window.partitionBy("knowledge_base_id").orderBy("src"))).filter("dst IS NOT NULL AND _n % 4 = 0")
    rel = F.when(F.col("_n") % 12 == 0, "REPEALS").when(F.col("_n") % 8 == 0, "SUPERSEDES").otherwise("AMENDS")
    return inst, pairs.select("src", "dst", rel.alias("relation"), F.when(F.col("_n") % 20 == 0, "มาตรา 5").alias("target_provision"), F.when(F.col("_n") % 28 == 0, "suggested").otherwise("verified").alias("review_status"))


def version_status(spark: SparkSession, sf: str) -> DataFrame:
    """The status of every instrument after dates, verified relations and families."""
    return registry.resolve_status(*_statuses(spark, sf), DAY)


def conflict_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence on one title from several instruments: what stays and what is warned of."""
    i = table(spark, sf, "legal_instruments").filter("display_title IS NOT NULL AND doc_id IS NOT NULL")
    e = i.select("doc_id", "instrument_id", legal.family_key(F.col("display_title")).alias("family"), "status")
    return registry.conflicts(e, ["family"], F.col("status") == "in_force").select("instrument_id", "kept", "warning")


def worklist(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps every instrument from being ready."""
    i = table(spark, sf, "legal_instruments")
    r = registry.reasons(missing_title=F.col("display_title").isNull(), missing_issuer=F.col("issuer").isNull(), missing_number=F.col("official_number").isNull(), missing_date=F.col("effective_from").isNull(), unknown_status=F.col("status") == "unknown")
    return i.select("instrument_id", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("ready"))


def filter_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """In each corpus the instruments in force, or all where none is."""
    i = table(spark, sf, "legal_instruments").select("instrument_id", "knowledge_base_id", "status", "kind")
    return registry.filter_or_keep(i, (F.col("status") == "in_force") & (F.col("kind") == "ประกาศ"), "knowledge_base_id").select("instrument_id", "status")


def sole_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The settings, if there is exactly one row of them."""
    return registry.sole(table(spark, sf, "app_settings"))


def sub_works(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by the part of a legal document they stand in."""
    c = table(spark, sf, "document_chunks").dropDuplicates(["chunk_id"]).filter("section_kind IS NOT NULL")
    s = registry.sub_works(c, "doc_id", "chunk_index", F.contains("content", F.lit("for the purpose of")), F.contains("content", F.lit("at the expense of")))
    return s.groupBy("sub_work").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _evidence_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and the documents they were found in, as edges."""
    s = table(spark, sf, "entity_sources").filter("entity_id IS NOT NULL AND doc_id IS NOT NULL")
    return s.select(F.col("entity_id").alias("src"), F.concat(F.lit("doc-"), "doc_id").alias("dst")).distinct()


def bfs_depth3(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes within three hops of the first entities of every corpus."""
    starts = table(spark, sf, "knowledge_entities").groupBy("knowledge_base_id").agg(F.min("entity_id").alias("node")).select("node")
    return graph.reach(_evidence_edges(spark, sf), starts, 3).groupBy("start", "distance").agg(F.count("*").alias("n"), F.min("node").alias("first_node"))


def impact_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Everything within three hops of the entity found most often, with the least shortest way."""
    top = table(spark, sf, "entity_sources").filter("entity_id IS NOT NULL").groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").first()
    return graph.impact(_evidence_edges(spark, sf), top["entity_id"] if top else "", 3)


def evidence_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of entities and documents, by size."""
    c = graph.components(_evidence_edges(spark, sf))
    return c.groupBy("component").agg(F.count("*").alias("n"))


def component_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty edges, the heaviest of each component first."""
    e = table(spark, sf, "entity_sources").filter("entity_id IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("entity_id").alias("src"), F.concat(F.lit("doc-"), "doc_id").alias("dst")).agg(F.countDistinct("source_id").alias("weight"))
    return graph.representatives(e, "weight", 30)


def degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty best connected nodes."""
    d = graph.degrees(_evidence_edges(spark, sf)).orderBy(F.desc("degree"), "node").limit(50)
    return d.select("node", "degree", F.row_number().over(Window.orderBy(F.desc("degree"), "node")).alias("rank"))


def source_recount(spark: SparkSession, sf: str) -> DataFrame:
    """Entities whose stored number of sources is not what their evidence says."""
    n = table(spark, sf, "entity_sources").groupBy("entity_id").agg(F.countDistinct("source_id").alias("found"))
    e = table(spark, sf, "knowledge_entities").select("entity_id", "source_count").join(n, "entity_id", "left")
    return e.select("entity_id", "source_count", F.coalesce("found", F.lit(0)).alias("found")).filter("source_count <> found")


def reindex_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a chunk that has no vector."""
    c = table(spark, sf, "document_chunks").groupBy("doc_id").agg(F.max(F.col("embedding").isNull()).alias("missing"))
    return c.filter("missing").select("doc_id")


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Lines shipped until a day, by flag and status."""
    x = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.count("*").alias("n"))


def nation_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and revenue by nation and region: small dimensions meet the fact side last."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("t"), 2).alias("revenue"))


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Events of every day and kind, counted as a stream."""
    s = flows.tumbling(flows.event_time(flows.file_stream(spark, f"{sf}/events.parquet"), "ts", "1 day"), "ts", "1 day", "event_type")
    return flows.run_once(s, _name(sf, "daily"), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as a stream, those sent again taken once."""
    s = flows.event_time(flows.file_stream(spark, f"{sf}/ingest_requests.parquet"), "received_at", "3650 days")
    once = flows.first_seen(s.select("request_id", "knowledge_base_id", "received_at"), "request_id")
    return flows.run_once(once, _name(sf, "first"), "append").groupBy("knowledge_base_id").agg(F.count("*").alias("n"))


def _name(sf: str, what: str) -> str:
    import uuid

    return f"{what}_{uuid.uuid4().hex[:12]}"


_EDGES = "edges AS (SELECT DISTINCT entity_id AS a, 'doc-' || doc_id AS b FROM entity_sources WHERE entity_id IS NOT NULL AND doc_id IS NOT NULL), links AS (SELECT a AS s, b AS d FROM edges UNION SELECT b, a FROM edges)"
_FAMILY = rf"""
fam1 AS (SELECT *, regexp_replace(trim(display_title), '{legal.VERSION}', '') AS t1 FROM legal_instruments),
fam2 AS (SELECT *, lower(trim(regexp_replace(CASE WHEN regexp_matches(t1, '{legal.BUDDHIST_YEAR}') THEN regexp_replace(t1, '{legal.BUDDHIST_YEAR}', '') ELSE regexp_replace(t1, '{legal.COMMON_YEAR}', '') END, '\s+', ' ', 'g'))) AS family FROM fam1)"""

SQL = {
    "publication_window": "SELECT doc_id, published_at, document_type FROM documents WHERE published_at >= DATE '2018-01-01' AND published_at < DATE '2021-01-01'",
    "metadata_division": "WITH v AS (SELECT DISTINCT value_id, doc_id, field_key, value_text FROM document_metadata_values) SELECT doc_id FROM v WHERE (field_key = 'classification' AND value_text = 'restricted') OR (field_key = 'budget_year' AND value_text = '2561') GROUP BY 1 HAVING count(DISTINCT field_key) = 2 UNION SELECT doc_id FROM v WHERE field_key = 'classification' AND value_text = 'ลับ'",
    "metadata_search_text": "WITH v AS (SELECT DISTINCT value_id, doc_id, field_key, value_text FROM document_metadata_values WHERE value_text IS NOT NULL) SELECT doc_id, left(string_agg(value_text, ' ' ORDER BY field_key, value_text), 10000) AS search_text FROM v GROUP BY 1",
    "metadata_checked": "WITH v AS (SELECT DISTINCT value_id, field_key, value_text FROM document_metadata_values) SELECT field_key, count(*) AS n, count(CASE WHEN field_key <> 'budget_year' THEN value_text WHEN regexp_full_match(translate(value_text, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[+-]?[0-9]+([.][0-9]+)?') THEN value_text END) AS n_valid FROM v GROUP BY 1",
    "inventory_counts": """
WITH i AS (SELECT doc_id, min(kind) AS legal_kind, min(document_class) AS document_class, min(status) AS legal_status FROM legal_instruments WHERE doc_id IS NOT NULL GROUP BY 1), d AS (SELECT document_type, legal_kind, document_class, legal_status FROM documents LEFT JOIN i USING (doc_id))
SELECT 'document_type' AS dimension, document_type AS key, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'legal_kind', legal_kind, count(*) FROM d WHERE legal_kind IS NOT NULL GROUP BY 2
UNION ALL SELECT 'document_class', document_class, count(*) FROM d WHERE document_class IS NOT NULL GROUP BY 2 UNION ALL SELECT 'legal_status', legal_status, count(*) FROM d WHERE legal_status IS NOT NULL GROUP BY 2""",
    "inventory_members": "SELECT knowledge_base_id, document_type, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(doc_id * 7919 % 1000003) AS BIGINT) AS check_sum FROM documents GROUP BY 1, 2",
    "metadata_contains": "SELECT doc_id FROM documents WHERE contains(lower(title), 'office') OR doc_id IN (SELECT doc_id FROM document_metadata_values WHERE contains(lower(value_text), 'office'))",
    "visible_corpora": "WITH d AS (SELECT knowledge_base_id IN (SELECT knowledge_base_id FROM knowledge_bases WHERE status = 'active') AS v FROM documents) SELECT 'visible' AS scope, count(*) FILTER (v) AS n FROM d UNION ALL SELECT 'hidden', count(*) FILTER (NOT v) FROM d",
    "dashboard": "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type IN ('view', 'click')) AS queued, count(*) FILTER (value > 50) AS large FROM events",
    "error_codes": "SELECT props->>'$.k' AS code, count(*) AS n FROM events WHERE event_type = 'error' AND props->>'$.k' IS NOT NULL GROUP BY 1 ORDER BY n DESC, code LIMIT 10",
    "latest_per_user": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "offset_page": "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100",
    "keyset_page": "SELECT event_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 51",
    "request_metrics": "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total_seconds, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1",
    "offered_load": "SELECT user_id, max(n) AS peak FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1",
    "admitted_load": """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE ts IS NOT NULL),
f AS (SELECT user_id, 0 AS k, CAST([] AS BIGINT[]) AS held, 0 AS n FROM events GROUP BY 1
  UNION ALL SELECT e.user_id, CAST(e.k AS INT), CASE WHEN len(list_filter(held, lambda x: x > t - 21600000000)) < 2 THEN list_append(list_filter(held, lambda x: x > t - 21600000000), t) ELSE list_filter(held, lambda x: x > t - 21600000000) END,
    n + CASE WHEN len(list_filter(held, lambda x: x > t - 21600000000)) < 2 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, CAST(max(k) AS BIGINT) AS offered, CAST(max(n) AS BIGINT) AS admitted FROM f GROUP BY 1""",
    "anchored_load": """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE ts IS NOT NULL),
f AS (SELECT user_id, 0 AS k, CAST(-1e18 AS BIGINT) AS anchor, 0 AS c, 0 AS n FROM events GROUP BY 1
  UNION ALL SELECT e.user_id, CAST(e.k AS INT), CASE WHEN t - anchor < 21600000000 THEN anchor ELSE t END, CASE WHEN t - anchor < 21600000000 THEN c + 1 ELSE 1 END, n + CASE WHEN (CASE WHEN t - anchor < 21600000000 THEN c + 1 ELSE 1 END) <= 2 THEN 1 ELSE 0 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, CAST(max(k) AS BIGINT) AS offered, CAST(max(n) AS BIGINT) AS admitted FROM f GROUP BY 1""",
    "retention_cut": "WITH r AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) SELECT 'runs' AS what, count(*) AS n FROM r WHERE ts >= TIMESTAMP '2024-01-29' UNION ALL SELECT 'spans', count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM r WHERE ts < TIMESTAMP '2024-01-29')",
    "span_offsets": """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 THEN CAST(trunc(value * 100) AS BIGINT) END AS off, event_id % 50 AS dur FROM events),
s AS (SELECT user_id, dur, coalesce(off, max(coalesce(off, 0) + dur) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM e)
SELECT user_id, max(st + dur) AS duration, CAST(sum(st) AS BIGINT) AS sum_start FROM s GROUP BY 1""",
    "user_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 360 MINUTES THEN 0 ELSE 1 END AS f, event_id FROM events),
s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY 1""",
    "metric_lines": "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type",
    "holding_instruments": f"SELECT instrument_id, status, effective_from, effective_to FROM legal_instruments WHERE (effective_from IS NULL OR effective_from <= DATE '{DAY}') AND (effective_to IS NULL OR effective_to > DATE '{DAY}') AND (coalesce(status NOT IN ('repealed', 'superseded'), true) OR effective_to IS NOT NULL)",
    "amended_editions": """
WITH m AS (SELECT knowledge_base_id, version_date AS d, max(instrument_id) AS target FROM legal_instruments WHERE document_class IN ('main', 'consolidated') AND version_date IS NOT NULL GROUP BY 1, 2)
SELECT a.instrument_id, m.target AS target_id, m.d AS as_of_day FROM (SELECT * FROM legal_instruments WHERE document_class = 'amendment' AND version_date IS NOT NULL) a ASOF LEFT JOIN m ON a.knowledge_base_id = m.knowledge_base_id AND a.version_date >= m.d""",
    "order_prices": """
WITH o AS (SELECT o_custkey % 25 AS g, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), l AS (SELECT g, o_orderkey AS id, d - 1 AS day FROM o), r AS (SELECT g, d, max(o_orderkey) AS prior FROM o GROUP BY 1, 2)
SELECT l.g, count(*) AS n, count(prior) AS n_prior, CAST(sum(prior) AS BIGINT) AS sum_prior FROM l ASOF LEFT JOIN r ON l.g = r.g AND l.day >= r.d GROUP BY 1""",
    "version_status": rf"""
WITH {_FAMILY},
i AS (SELECT instrument_id AS id, CASE WHEN display_title IS NOT NULL THEN family END AS family, status, CAST(right(instrument_id, 4) AS INT) AS n, effective_from, enacted_year, nullif(regexp_extract(display_title, '{legal.VERSION}', 1), '') AS version, knowledge_base_id FROM fam2),
p AS (SELECT id AS src, lead(id) OVER (PARTITION BY knowledge_base_id ORDER BY id) AS dst, n, effective_from AS sf FROM i),
rel AS (SELECT dst AS id, max(n % 12 = 0) AS rep, max(n % 12 <> 0 AND n % 8 = 0) AS sup, max(n % 12 <> 0 AND n % 8 <> 0) AS am, min(CASE WHEN n % 12 = 0 OR n % 8 = 0 THEN sf END) AS fin FROM p WHERE dst IS NOT NULL AND n % 4 = 0 AND n % 20 <> 0 AND n % 28 <> 0 GROUP BY 1),
s AS (SELECT i.*, n % 11 = 0 AS manual, fin AS t, CASE WHEN n % 11 = 0 THEN status WHEN rep THEN 'repealed' WHEN sup THEN 'superseded' WHEN am THEN 'amended' WHEN effective_from > DATE '{DAY}' THEN 'not_yet_effective' WHEN effective_from IS NOT NULL THEN 'in_force' ELSE 'unknown' END AS st,
  coalesce(effective_from, make_date(enacted_year, 1, 1), DATE '0001-01-01') AS age, version IS NULL AND family IS NOT NULL AND NOT coalesce(effective_from > DATE '{DAY}', false) AS begun FROM i LEFT JOIN rel USING (id)),
w AS (SELECT *, sum(CAST(begun AS INT)) OVER (PARTITION BY family) AS many, first_value(id) OVER f AS nid, first_value(effective_from) OVER f AS nef FROM s WINDOW f AS (PARTITION BY family ORDER BY begun DESC, age DESC, id DESC)),
o AS (SELECT *, begun AND many > 1 AND id <> nid AND NOT manual AND st NOT IN ('repealed', 'superseded') AS old FROM w)
SELECT id, CASE WHEN old THEN 'superseded' ELSE st END AS resolved_status, CASE WHEN old THEN coalesce(t, nef) ELSE t END AS resolved_to FROM o""",
    "conflict_validation": f"""
WITH {_FAMILY}, e AS (SELECT instrument_id, doc_id, family, status FROM fam2 WHERE display_title IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT family, count(DISTINCT doc_id) AS docs, max(coalesce(status = 'in_force', false)) AS has FROM e GROUP BY 1)
SELECT instrument_id, NOT (docs > 1 AND has) OR coalesce(status = 'in_force', false) AS kept, CASE WHEN docs > 1 AND has AND NOT coalesce(status = 'in_force', false) THEN 'SUPERSEDED_VERSION_REMOVED' WHEN docs > 1 AND NOT has THEN 'UNVERIFIED_VALIDITY' END AS warning FROM e JOIN g USING (family)""",
    "worklist": "WITH r AS (SELECT instrument_id, concat_ws(',', CASE WHEN display_title IS NULL THEN 'missing_title' END, CASE WHEN issuer IS NULL THEN 'missing_issuer' END, CASE WHEN official_number IS NULL THEN 'missing_number' END, CASE WHEN effective_from IS NULL THEN 'missing_date' END, CASE WHEN status = 'unknown' THEN 'unknown_status' END) AS reasons FROM legal_instruments) SELECT instrument_id, reasons, reasons = '' AS ready FROM r",
    "filter_cascade": "WITH k AS (SELECT *, coalesce(status = 'in_force' AND kind = 'ประกาศ', false) AS h FROM legal_instruments) SELECT instrument_id, status FROM k QUALIFY h OR NOT max(h) OVER (PARTITION BY knowledge_base_id)",
    "sole_settings": "SELECT * FROM app_settings WHERE (SELECT count(*) FROM app_settings) = 1",
    "sub_works": """
WITH c AS (SELECT DISTINCT chunk_id, doc_id, chunk_index, content FROM document_chunks WHERE section_kind IS NOT NULL), f AS (SELECT doc_id, chunk_index, contains(content, 'for the purpose of') AS o, contains(content, 'at the expense of') AS m FROM c),
g AS (SELECT *, max(o) OVER w AS opened, coalesce(max(o) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was, max(o) OVER (PARTITION BY doc_id) AS any_ FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, max(m AND was) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS note FROM g)
SELECT CASE WHEN NOT any_ THEN 'unknown' WHEN note THEN 'amendment_note' WHEN opened THEN 'code_body' ELSE 'enabling_act' END AS sub_work, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY 1""",
    "bfs_depth3": f"""
WITH RECURSIVE {_EDGES}, starts AS (SELECT min(entity_id) AS start FROM knowledge_entities GROUP BY knowledge_base_id),
walk AS (SELECT start, start AS node, 0 AS h FROM starts UNION SELECT start, d, h + 1 FROM walk JOIN links ON s = node WHERE h < 3),
m AS (SELECT start, node, min(h) AS distance FROM walk GROUP BY 1, 2) SELECT start, distance, count(*) AS n, min(node) AS first_node FROM m GROUP BY 1, 2""",
    "impact_paths": f"""
WITH RECURSIVE {_EDGES}, top AS (SELECT entity_id FROM entity_sources WHERE entity_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1),
walk AS (SELECT entity_id AS node, 0 AS h, [entity_id] AS p FROM top UNION SELECT d, h + 1, list_append(p, d) FROM walk JOIN links ON s = node WHERE h < 3 AND NOT list_contains(p, d)),
m AS (SELECT node, h, p FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY h, p) = 1) SELECT node, CAST(h AS INT) AS distance, array_to_string(p, ' > ') AS path, h = 1 AS direct FROM m WHERE h > 0""",
    "degree_rank": f"WITH {_EDGES}, d AS (SELECT s AS node, count(*) AS degree FROM links GROUP BY 1) SELECT node, degree, CAST(row_number() OVER (ORDER BY degree DESC, node) AS INT) AS rank FROM d ORDER BY degree DESC, node LIMIT 50",
    "source_recount": "SELECT entity_id, source_count, coalesce(n, 0) AS found FROM knowledge_entities LEFT JOIN (SELECT entity_id, count(DISTINCT source_id) AS n FROM entity_sources GROUP BY 1) USING (entity_id) WHERE source_count <> coalesce(n, 0)",
    "reindex_queue": "SELECT DISTINCT doc_id FROM document_chunks WHERE embedding IS NULL",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "nation_revenue": "SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
    "stream_daily": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_first_seen": "SELECT knowledge_base_id, count(DISTINCT request_id) AS n FROM ingest_requests GROUP BY 1",
}
SQL["evidence_components"] = f"""
WITH RECURSIVE {_EDGES}, walk AS (SELECT DISTINCT s AS root, s AS node FROM links UNION SELECT root, d FROM walk JOIN links ON s = node WHERE root < d)
SELECT component, count(*) AS n FROM (SELECT node, min(root) AS component FROM walk GROUP BY 1) GROUP BY 1"""

QUERIES = {f.__name__: f for f in (
    publication_window, metadata_division, metadata_search_text, metadata_checked, inventory_counts, inventory_members, metadata_contains, visible_corpora, dashboard, error_codes, latest_per_user, offset_page, keyset_page,
    request_metrics, offered_load, admitted_load, anchored_load, retention_cut, span_offsets, user_sessions, metric_lines, holding_instruments, amended_editions, order_prices, version_status, conflict_validation, worklist, filter_cascade,
    sole_settings, sub_works, bfs_depth3, impact_paths, evidence_components, component_leads, degree_rank, source_recount, reindex_queue, pricing_summary, nation_revenue, stream_daily, stream_first_seen,
)}
