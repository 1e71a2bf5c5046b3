"""The queries of the training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import garbling, leakage, lookalikes, namelinks, nearcopies, neighbours, packing, scans, splitting

SIZE, OVERLAP, CAPACITY, NEIGHBOURS = 800, 120, 2048, 5


def _settings(spark: SparkSession, sf: str) -> dict:
    """The one row of settings; what it leaves null has the platform's default."""
    row = table(spark, sf, "app_settings").first()
    got = row.asDict() if row else {}
    default = {"default_chunk_size": SIZE, "default_chunk_overlap": OVERLAP, "container_capacity_tokens": CAPACITY, "neighbour_count": NEIGHBOURS}
    return default | {k: v for k, v in got.items() if v is not None}


def _looks(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "knowledge_entities").select(F.lit("knowledge_entities").alias("record_table"), F.col("entity_id").alias("record_id"), F.col("name").alias("text"))
    values = table(spark, sf, "document_metadata_values").select(F.lit("document_metadata_values").alias("record_table"), F.col("value_id").alias("record_id"), F.col("value_text").alias("text"))
    return names.unionByName(values)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose text is not in the ordinary form."""
    return lookalikes.not_ordinary(_looks(spark, sf), "text", "record_table", "record_id").select("record_table", "record_id").distinct()


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of look-alike texts that have more than one spelling."""
    return lookalikes.classes(_looks(spark, sf), "text", "record_id")


def p1_ordinary(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its ordinary form and class."""
    return lookalikes.look_alike_class(_looks(spark, sf), "text").select("record_table", "record_id", "ordinary", "class_id").distinct()


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "ocr_pages")
    records = pages.select(F.lit("ocr_pages").alias("record_table"), F.col("page_id").alias("record_id"), F.col("markdown").alias("text"))
    excerpts = table(spark, sf, "entity_sources").select(F.lit("entity_sources").alias("record_table"), F.col("source_id").alias("record_id"), F.col("excerpt").alias("text"))
    return scans.restore(records, excerpts, "record_table", "record_id", "text", scans.file_headers(pages, "page_id", "file_id", "markdown"), "page_id")


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Every page and excerpt with the marks of scanning it bears and its text without them; one delivered twice is taken once."""
    return _scans(spark, sf).dropDuplicates(["record_table", "record_id"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and excerpts that bear at least one mark of scanning."""
    return _scans(spark, sf).filter(F.size("marks") > 0).select("record_table", "record_id").distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that are cut into more than one piece."""
    s = _settings(spark, sf)
    return splitting.oversized(table(spark, sf, "ingest_requests"), "text", s["default_chunk_size"], s["default_chunk_overlap"], "request_id")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every request; a request sent again counts once."""
    s = _settings(spark, sf)
    requests = table(spark, sf, "ingest_requests").groupBy("request_id").agg(F.min_by("text", F.struct("received_at", "text")).alias("text"))
    return splitting.split_oversized(requests, "text", s["default_chunk_size"], s["default_chunk_overlap"], "request_id")


def _excerpts(spark: SparkSession, sf: str) -> DataFrame:
    excerpts = table(spark, sf, "entity_sources").select(F.lit("entity_sources").alias("record_table"), F.col("source_id").alias("id"), F.col("excerpt").alias("text"))
    titles = table(spark, sf, "legal_instruments").select(F.lit("legal_instruments").alias("record_table"), F.col("instrument_id").alias("id"), F.col("display_title").alias("text"))
    return excerpts.unionByName(titles)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records of one table that share at least 70 % of their text."""
    return nearcopies.near_copies(_excerpts(spark, sf), "id", "text", "record_table", 0.7)


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its class of near copies and its text's number of links."""
    return nearcopies.near_copy_classes(_excerpts(spark, sf), "id", "text", "record_table", 0.7)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks with cosine of at least 0.9, one among the most similar of the other."""
    k = _settings(spark, sf)["neighbour_count"]
    found = neighbours.similar_vectors(table(spark, sf, "document_chunks"), "chunk_id", "embedding", k, 0.9)
    return found.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar chunks of every chunk whose id is divisible by 20, against all chunks."""
    k = _settings(spark, sf)["neighbour_count"]
    return neighbours.neighbours_of(table(spark, sf, "document_chunks"), "chunk_id", "embedding", F.pmod("chunk_id", F.lit(20)) == 0, k)


def _names(spark: SparkSession, sf: str) -> DataFrame:
    entities = table(spark, sf, "knowledge_entities").filter(F.col("entity_type").isin("Person", "Organization"))
    entities = entities.select(F.lit("knowledge_entities").alias("record_table"), F.col("entity_id").alias("id"), "name", (F.col("entity_type") == "Person").alias("person"))
    issuers = table(spark, sf, "legal_instruments").select(F.lit("legal_instruments").alias("record_table"), F.col("issuer").alias("id"), F.col("issuer").alias("name"), F.lit(False).alias("person"))
    return entities.unionByName(issuers.filter("id IS NOT NULL").distinct())


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of entities, and of issuers, that stand for the same person or body."""
    return namelinks.linked_records(_names(spark, sf), "id", "name", F.col("person"), "record_table")


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every named entity and every issuer with its cluster of spellings."""
    return namelinks.classes(_names(spark, sf), "id", "name", F.col("person"), "record_table").select("record_table", "id", F.hex("cluster").alias("class_id"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document or piece of one."""
    return packing.pack(table(spark, sf, "documents"), "doc_id", "text", _settings(spark, sf)["container_capacity_tokens"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least 60 consecutive signs of an item's passage."""
    return p8_leaks(spark, sf).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the longest run of signs that leaked."""
    return leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "golden_items"), "item_id", "passage", 60)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a wrongly decoded or lost character."""
    return garbling.garbled(table(spark, sf, "documents"), "doc_id", "text", "source").select("doc_id")


def p9_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The affected documents with their text restored."""
    return garbling.repaired(table(spark, sf, "documents"), "doc_id", "text", "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_ordinary, p2_found, p2_restored, p3_found, p3_pieces, p4_found, p4_classes, p5_found, p5_neighbours, p6_found, p6_classes, p7_containers, p8_found, p8_leaks, p9_found, p9_repaired)}
