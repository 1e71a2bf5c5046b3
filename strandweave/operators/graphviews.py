"""Writing to a graph kept in tables, and views of it: upserts that revive, cascades, evidence of edges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name, identity_key


def promoted(values: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) from metadata values whose field is mapped into the graph.

    values: base, doc_id, title, field_key, value. fields: field_key, label, entity_type,
    relationship (upper-cased); a field without a type or relationship is not mapped, and
    neither is a blank value. Each document is an anchor; an entity is named by its type
    and canonical value, so equal values of a base are one.
    """
    mapped = fields.filter("entity_type IS NOT NULL AND relationship IS NOT NULL")
    v = values.filter(F.length(F.trim("value")) > 0).join(mapped, "field_key").withColumn("value", F.left(F.trim("value"), F.lit(500)))
    target = F.concat_ws(":", F.lit("metadata"), F.lower("entity_type"), canonical_name(F.col("value")))
    v = v.withColumn("source", F.concat(F.lit("metadata:document:"), F.col("doc_id").cast("string"))).withColumn("target", target)
    anchors = v.select("base", F.col("source").alias("identity_key"), F.lit("Document").alias("entity_type"), F.col("title").alias("name"))
    ends = v.select("base", F.col("target").alias("identity_key"), "entity_type", F.col("value").alias("name"))
    entities = anchors.unionByName(ends).groupBy("base", "identity_key", "entity_type").agg(F.min("name").alias("name"), F.count("*").alias("source_count"))
    said = F.concat(F.coalesce("label", "field_key"), F.lit(": "), "value")
    edges = v.groupBy("base", "source", "target", F.upper("relationship").alias("relationship")).agg(F.min(F.left(said, F.lit(5000))).alias("excerpt"), F.countDistinct(said).alias("source_count"))
    return entities, edges


def materialised(graph: DataFrame, marker: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of an external graph that carry a marker in their file path.

    graph: base, nodes array<struct<id, name, entity_type, description, file_path>>, edges
    array<struct<source, target, description, file_path>>. Nodes are met again by external
    id, named by their canonical name, and of the type Concept where none is given; edges
    with an end outside, or from an entity to itself, fall away; repeats are one.
    """
    of = lambda c: graph.select("base", F.explode(c).alias("x")).filter(F.contains(F.coalesce("x.file_path", F.lit("")), marker))
    n = of("nodes").select("base", F.col("x.id").alias("id"), F.trim("x.name").alias("name"), F.coalesce(F.nullif(F.trim("x.entity_type"), F.lit("")), F.lit("Concept")).alias("entity_type"), F.coalesce("x.description", "x.name").alias("excerpt")).filter(F.length("name") > 0)
    n = n.withColumn("identity_key", identity_key(F.col("name")))
    entities = n.groupBy("base", "identity_key", "entity_type").agg(F.min("name").alias("name"), F.countDistinct("excerpt").alias("source_count"))
    local = n.select("base", "id", F.concat_ws("|", "identity_key", "entity_type").alias("node")).groupBy("base", "id").agg(F.min("node").alias("node"))
    e = of("edges").select("base", F.col("x.source").alias("s"), F.col("x.target").alias("t"), "x.description")
    e = e.join(local.select("base", F.col("id").alias("s"), F.col("node").alias("source")), ["base", "s"]).join(local.select("base", F.col("id").alias("t"), F.col("node").alias("target")), ["base", "t"])
    edges = e.filter("source <> target").groupBy("base", "source", "target").agg(F.countDistinct(F.coalesce("description", F.lit(""))).alias("source_count"))
    return entities, edges


def upserted(held: DataFrame, given: DataFrame) -> DataFrame:
    """(base, identity_key, entity_type, name, deleted, source_count, outcome) after entities were handed in.

    held: base, identity_key, entity_type, name, deleted (boolean), source_count. given: the
    same key, name, doc_id, excerpt, at. New ones are created with the first name given; a
    deleted one is revived with the last; one that lives keeps its name. Each new
    (document, excerpt) counts as a source.
    """
    key = ["base", "identity_key", "entity_type"]
    news = given.groupBy(*key).agg(F.min_by("name", F.struct("at", "name")).alias("_first"), F.max_by("name", F.struct("at", "name")).alias("_last"), F.countDistinct(F.when(F.col("doc_id").isNotNull() & F.col("excerpt").isNotNull(), F.struct("doc_id", "excerpt"))).alias("_more"))
    both = held.withColumn("_held", F.lit(True)).join(news, key, "full_outer")
    new, revived = F.col("_held").isNull(), F.coalesce("deleted", F.lit(False)) & F.col("_more").isNotNull()
    outcome = F.when(new, "created").when(revived, "revived").when(F.col("_more").isNotNull(), "seen").otherwise("untouched")
    name = F.when(new, F.col("_first")).when(revived, F.col("_last")).otherwise(F.col("name"))
    count = F.coalesce("source_count", F.lit(0)) + F.coalesce("_more", F.lit(0))
    return both.select(*key, name.alias("name"), (F.coalesce("deleted", F.lit(False)) & ~revived).alias("deleted"), count.alias("source_count"), outcome.alias("outcome"))


def recounted(entities: DataFrame, sources: DataFrame, key: str, source: str) -> DataFrame:
    """Entities with the number of their sources counted anew; one without any is deleted unless it was made by hand."""
    n = sources.groupBy(key).agg(F.countDistinct(source).alias("found"))
    out = entities.join(n, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("gone", F.col("deleted") | ((F.col("found") == 0) & (F.col("origin") != "manual")))


def without_ends(edges: DataFrame, gone: DataFrame, node: str) -> DataFrame:
    """Adds ``deleted`` to edges: whether an end is among the deleted nodes. Two joins on equality, no join on either end."""
    ids = gone.select(F.col(node).alias("_g")).distinct()
    left = edges.join(ids.withColumn("_l", F.lit(True)), F.col("src") == F.col("_g"), "left").drop("_g")
    both = left.join(ids.withColumn("_r", F.lit(True)), F.col("dst") == F.col("_g"), "left").drop("_g")
    return both.withColumn("deleted", F.coalesce("_l", "_r", F.lit(False))).drop("_l", "_r")


def edge_sources(edges: DataFrame, sources: DataFrame, documents: DataFrame, k: int, *group: str) -> DataFrame:
    """The first k pieces of evidence of edges of each group, ranked, with relevance 1/rank; only documents that are completed and not deleted.

    edges: ``group``, edge_id. sources: edge_id, source_id, doc_id, excerpt. documents: doc_id, title.
    """
    rows = edges.join(sources, "edge_id").join(documents.select("doc_id", "title"), "doc_id")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("edge_id", "source_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("relevance", F.round(1 / F.col("rank"), 6))


def summary(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: edges by review, how many are by hand, internal, or known to the registry only.

    edges: edge_id, is_legal, review_status, origin. registry: edge_id, review_status,
    origin. A registry row whose edge exists is not counted again; edges by hand that are
    not legal count as manual only.
    """
    legal = edges.filter("is_legal").select("edge_id", "review_status", "origin", F.lit("internal").alias("bucket"))
    cross = registry.join(legal.select("edge_id"), "edge_id", "left_anti").select("edge_id", "review_status", "origin", F.lit("cross_document").alias("bucket"))
    loose = edges.filter("NOT is_legal AND origin = 'manual'").select("edge_id", F.lit(None).cast("string").alias("review_status"), "origin", F.lit("loose").alias("bucket"))
    rows = legal.unionByName(cross).unionByName(loose)
    is_ = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    return rows.agg(*[is_("review_status", v).alias(v) for v in ("verified", "suggested", "rejected")], is_("origin", "manual").alias("manual"), is_("bucket", "internal").alias("internal"), is_("bucket", "cross_document").alias("cross_document"))


def of_instruments(edges: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """(owner, n_entities, n_edges): entities of each owner and edges between them, at most ``cap`` counted.

    edges: src, dst. members: owner, node. An edge counts for an owner both its ends belong to.
    """
    m = members.select("owner", "node").distinct()
    inside = edges.join(m.select(F.col("node").alias("src"), "owner"), "src").join(m.select(F.col("node").alias("dst"), "owner"), ["dst", "owner"])
    n = inside.groupBy("owner").agg(F.count("*").alias("_n"))
    return m.groupBy("owner").agg(F.count("*").alias("n_entities")).join(n, "owner", "left").select("owner", "n_entities", F.least(F.coalesce("_n", F.lit(0)), F.lit(cap)).alias("n_edges"))


def in_view(edges: DataFrame, view: str) -> DataFrame:
    """Edges of a view: verified, suggested, manual or all."""
    tests = {"verified": F.col("review_status") == "verified", "suggested": F.col("review_status") == "suggested", "manual": F.col("origin") == "manual"}
    return edges.filter(tests[view]) if view in tests else edges


def neighbours(edges: DataFrame, evidence: DataFrame, most_edges: int = 200) -> DataFrame:
    """(node, n_out, n_in, n_neighbours, n_evidence): what stands around every node, by direction, of its first ``most_edges`` edges. edges: src, dst; evidence: node."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("way")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("way")))
    first = both.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("way", "other"))).filter(F.col("_r") <= most_edges)
    n = first.groupBy("node").agg(F.count_if(F.col("way") == "out").alias("n_out"), F.count_if(F.col("way") == "in").alias("n_in"), F.countDistinct("other").alias("n_neighbours"))
    said = evidence.groupBy("node").agg(F.count("*").alias("n_evidence"))
    return n.join(said, "node", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def ring(nodes: DataFrame, order: list[Column], width: float = 100.0) -> DataFrame:
    """Adds (ring, x, y): nodes laid out in rings of 8, 16, 24, ... by rank, the first in the middle."""
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    at = F.when(rank == 0, 0).otherwise(F.ceil((F.sqrt(1 + rank) - 1) / 2)).cast("int")
    out = nodes.withColumn("_rank", rank).withColumn("ring", at)
    angle = 2 * 3.141592653589793 * (F.col("_rank") - (2 * F.col("ring") - 1) * (2 * F.col("ring") - 1)) / F.greatest(8 * F.col("ring"), F.lit(1))
    return out.withColumn("x", F.round(width * F.col("ring") * F.cos(angle), 3) + 0.0).withColumn("y", F.round(width * F.col("ring") * F.sin(angle), 3) + 0.0).drop("_rank")
