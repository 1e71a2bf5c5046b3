"""Ranked channels, their fusion, and what is made of the fused evidence.

A channel is a table (doc_id, chunk_id, relevance, rank); the rank is data. Every order
has a total tiebreak, so a channel is the same on every run.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import status_factor
from ..functions.text import tokens
from .chunking import let

RRF = 60
#: Words of a query that are looked for one by one where no passage holds all of them.
FALLBACK_WORDS = 8


def top(df: DataFrame, score: Column, k: int, *ties: str) -> DataFrame:
    """The k rows with the highest score and their rank: a per-partition heap, then one merge of k rows a partition."""
    best = df.withColumn("_score", score).orderBy(F.desc_nulls_last("_score"), *ties).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("_score"), *ties))
    return best.withColumn("rank", rank).drop("_score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in doubles; null where a side is null or zero."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(wide(a), lambda x: x * x))) * F.sqrt(total(F.transform(wide(b), lambda x: x * x)))
    return dot / F.nullif(norm, F.lit(0.0))


def vector_channel(chunks: DataFrame, vector: str, query: list[float], k: int) -> DataFrame:
    """The k chunks nearest to a query vector; filters belong before this. A chunk delivered twice counts once: the narrow scored rows are made distinct, not the chunks."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.filter(F.col(vector).isNotNull()).select("doc_id", "chunk_id", cosine(F.col(vector), q).alias("_cos")).filter("_cos IS NOT NULL").groupBy("doc_id", "chunk_id").agg(F.max("_cos").alias("_cos"))
    return top(scored, F.round("_cos", 6), k, "doc_id", "chunk_id").select("doc_id", "chunk_id", F.round(F.greatest(F.lit(0.0), F.col("_cos")), 6).alias("relevance"), "rank")


def keyword_channel(chunks: DataFrame, content: str, query: str, k: int, metadata: str | None = None) -> DataFrame:
    """Chunks that hold every word of the query, or whose document's metadata text contains the query; where there is none, those that hold any of the first words.

    Ordered by distinct words matched, then by how often they stand there, then by key. A
    query without a usable word finds nothing. Only keys and counts leave the scan.
    """
    wanted = list(dict.fromkeys(w for w in re.findall(r"[\w-]+", query.lower()) if len(w) > 1))
    words, first = (F.array(*[F.lit(w) for w in ws]).cast("array<string>") for ws in (wanted, wanted[:FALLBACK_WORDS]))
    said = F.lit(False) if metadata is None or not wanted else F.coalesce(F.contains(F.lower(metadata), F.lit(query.lower())), F.lit(False))
    count = lambda h: F.struct(F.size(F.array_distinct(h)).alias("n"), F.size(h).alias("tf"), F.exists(h, lambda t: F.array_contains(first, t)).alias("some"))
    hits = let(F.filter(tokens(F.col(content)), lambda t: F.array_contains(words, t)), count)
    # Behind an explode a filter cannot be pushed to where it would take every text apart once more.
    seen = chunks.select("doc_id", "chunk_id", said.alias("_said"), F.explode_outer(F.array(hits)).alias("_h")).filter("_h.n > 0 OR _said")
    seen = seen.select("doc_id", "chunk_id", F.coalesce("_h.n", F.lit(0)).alias("_n"), F.coalesce("_h.tf", F.lit(0)).alias("_tf"), "_said", F.coalesce("_h.some", F.lit(False)).alias("_some"))
    seen = seen.withColumn("_whole", (F.col("_n") == len(wanted)) | F.col("_said")).filter("_whole OR _some")
    seen = seen.dropDuplicates(["doc_id", "chunk_id"])
    best = top(seen, F.struct(F.col("_whole").cast("int"), "_n", "_tf"), k, "doc_id", "chunk_id")
    any_ = F.max(F.col("_whole").cast("int")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = best.withColumn("_any", any_).filter((F.col("_any") == 0) | F.col("_whole"))
    return best.select("doc_id", "chunk_id", F.round(1 / F.col("rank"), 6).alias("relevance"), "rank")


def exact_channel(chunks: DataFrame, content: str, needle: str, k: int, *others: str) -> DataFrame:
    """Chunks that contain a passage or identifier, or whose document's title, file name or metadata does, ignoring case, in document order."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in (content, *others)])
    found = chunks.filter(hit).select("doc_id", "chunk_id").distinct()
    first = found.orderBy("doc_id", "chunk_id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("doc_id", "chunk_id")))
    return first.select("doc_id", "chunk_id", F.round(1 / F.col("rank"), 6).alias("relevance"), "rank")


def fan_in(channels: dict[str, DataFrame]) -> DataFrame:
    """The channels in their fixed order as one table with (channel, channel_ord)."""
    named = [df.select("doc_id", "chunk_id", "relevance", "rank", F.lit(name).alias("channel"), F.lit(n).alias("channel_ord")) for n, (name, df) in enumerate(channels.items())]
    return reduce(DataFrame.unionByName, named)


def fuse(ranked: DataFrame, meta: DataFrame | None = None, authority: float = 0.0, status: float = 0.0, recency: float = 0.0) -> DataFrame:
    """Reciprocal-rank fusion, one group a chunk, raised by what a registry says of the document.

    ``meta`` has (doc_id, authority_level, status, effective_from). Documents outside it
    are not raised. Ties keep the order in which they were first seen.
    """
    first = F.struct("channel_ord", "rank")
    fused = ranked.groupBy("doc_id", "chunk_id").agg(
        F.sum(1 / (RRF + F.col("rank"))).alias("score"),
        F.max_by("channel", F.struct("relevance", -F.col("channel_ord"), -F.col("rank"))).alias("channel"),
        F.min(first).alias("_first"),
    )
    if meta is not None:
        dated = Window.orderBy(F.desc("effective_from"), "doc_id")
        n = F.count("*").over(Window.partitionBy("_d"))
        near = meta.join(fused.select("doc_id").distinct(), "doc_id", "left_semi")
        ages = near.filter("effective_from IS NOT NULL").withColumn("_d", F.lit(1)).select("doc_id", (1 - (F.row_number().over(dated) - 1) / F.greatest(n - 1, F.lit(1))).alias("age"))
        boost = F.lit(authority) * F.col("authority_level") / 100 + F.lit(status) * status_factor(F.col("status")) + F.lit(recency) * F.coalesce("age", F.lit(0.5))
        weights = near.join(ages, "doc_id", "left").select("doc_id", boost.alias("_boost"))
        fused = fused.join(weights, "doc_id", "left").withColumn("score", F.col("score") * (1 + F.coalesce("_boost", F.lit(0.0)))).drop("_boost")
    return fused.withColumn("score", F.round("score", 6))


def cite(fused: DataFrame, k: int) -> DataFrame:
    """The first k of the fused evidence with citation ids S1, S2, ..."""
    order = [F.desc("score"), F.col("_first.channel_ord"), F.col("_first.rank"), F.col("doc_id"), F.col("chunk_id")]
    ranked = fused.orderBy(*order).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(F.concat(F.lit("S"), "position").alias("citation_id"), "position", "doc_id", "chunk_id", "channel", "score")


def guarantee_current(fused: DataFrame, current: DataFrame, k: int) -> DataFrame:
    """The first k, in which every current document that was ranked at all is present, k permitting: its best chunk takes a place from the end."""
    order = Window.orderBy(F.desc("score"), "doc_id", "chunk_id")
    pool = fused.withColumn("position", F.row_number().over(order))
    best = Window.partitionBy("doc_id").orderBy("position")
    marked = pool.join(current.select("doc_id").distinct().withColumn("_cur", F.lit(True)), "doc_id", "left").withColumn("_best", F.row_number().over(best))
    in_top = F.max((F.col("position") <= k).cast("int")).over(Window.partitionBy("doc_id"))
    marked = marked.withColumn("_fill", F.coalesce("_cur", F.lit(False)) & (F.col("_best") == 1) & (in_top == 0))
    fill = marked.filter("_fill").orderBy("position").limit(k)
    n = fill.agg(F.count("*").alias("_n"), F.lit(1).alias("_one"))
    kept = marked.filter(F.col("position") <= k).withColumn("_one", F.lit(1)).join(n, "_one").filter(F.col("position") <= k - F.col("_n"))
    both = kept.select("doc_id", "chunk_id", "score", "position", F.lit(False).alias("backfilled")).unionByName(fill.select("doc_id", "chunk_id", "score", "position", F.lit(True).alias("backfilled")))
    final = F.row_number().over(Window.orderBy("backfilled", "position"))
    return both.withColumn("place", final).select("place", "doc_id", "chunk_id", "score", "backfilled")


def expand_sections(hits: DataFrame, chunks: DataFrame, most: int = 12_000) -> DataFrame:
    """Each hit section (document, kind and number) once, as the text of all its chunks in order, cut at ``most`` signs."""
    keys = [c for c in ("doc_id", "section_kind", "section_number") if c in chunks.columns]
    wanted = hits.select(*keys).distinct()
    whole = chunks.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("_c"))
    text = F.array_join(F.transform("_c", lambda x: x["content"]), "\n\n")
    return whole.select(*keys, F.size("_c").alias("n_chunks"), F.left(text, F.lit(most)).alias("excerpt"))
