"""Joins and views that put registry, chunks and logs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import provision_number
from .containment import containing


def provision_chunks(provisions: DataFrame, chunks: DataFrame, doc: str, number: str, chunk_number: str, chunk_id: str) -> DataFrame:
    """Provisions with the ids of the chunks of their document that carry the same number, spelled in any way."""
    p = provisions.withColumn("_n", provision_number(F.col(number)))
    c = chunks.filter(F.col(chunk_number).isNotNull()).select(F.col(doc).alias("_d"), provision_number(F.col(chunk_number)).alias("_cn"), F.col(chunk_id).alias("_c"))
    ids = c.groupBy("_d", "_cn").agg(F.array_sort(F.collect_set("_c")).alias("chunk_ids"))
    return p.join(ids, (F.col(doc) == F.col("_d")) & (F.col("_n") == F.col("_cn")), "left").drop("_n", "_d", "_cn")


def title_match(references: DataFrame, instruments: DataFrame, by: str, wanted: str, number: str, title: str, own_number: str, day: str, pick: str, before: Column | None = None) -> DataFrame:
    """For each reference the instrument of its corpus it most likely means: 100 points for the number, 50 for a title that contains the other, 20 off if it is younger.

    Titles within titles meet by windows; references whose number agrees are met by number.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    left = references.withColumn("_row", F.monotonically_increasing_id())
    asked = left.select("_row", F.col(by).alias("_ab"), low(wanted).alias("_a"), F.col(number).alias("_an"), (F.lit(None) if before is None else before).alias("_before"))
    right = instruments.select(F.col(by).alias("_by"), low(title).alias("_t"), F.col(own_number).alias("_num"), F.col(day).alias("_day"), F.col(pick).alias("_pick"))
    near = F.col("_ab") == F.col("_by")
    pairs = asked.hint("merge").join(right, near & (F.col("_an") == F.col("_num")))
    pairs = pairs.unionByName(containing(asked, "_a", right, "_t", within=(("_ab", "_by"),))).unionByName(containing(right, "_t", asked, "_a", within=(("_by", "_ab"),)))
    contains = F.coalesce((F.length("_a") > 0) & (F.length("_t") > 0) & (F.contains(F.col("_a"), F.col("_t")) | F.contains(F.col("_t"), F.col("_a"))), F.lit(False))
    younger = F.coalesce(F.col("_before") < F.col("_day"), F.lit(False))
    score = F.when(F.col("_an") == F.col("_num"), 100).otherwise(0) + F.when(contains, 50).otherwise(0) - F.when(younger, 20).otherwise(0)
    both = pairs.withColumn("_s", score).filter("_s > 0")
    best = both.groupBy("_row").agg(F.max_by(F.struct("_pick", "_s"), F.struct("_s", "_day", "_pick")).alias("_b"))
    return left.join(best, "_row", "left").select(*references.columns, F.col("_b._pick").alias("match"), F.col("_b._s").alias("score"))


def with_latest(left: DataFrame, log: DataFrame, key: str, order: list[Column], *columns: str) -> DataFrame:
    """Rows with the latest entry a log has of them, columns null where it has none."""
    top = log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").select(key, *columns)
    return left.join(top, key, "left")


def with_oldest(left: DataFrame, log: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """Rows with the oldest entry a log has of them."""
    first = log.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(at, *columns)).alias("_f"))
    return left.join(first.select(key, "_f.*"), key, "left")


def edges_within(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges both ends of which are among the nodes: two semi-joins."""
    ids = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(ids, edges["src"] == ids["_n"], "left_semi").join(ids, edges["dst"] == ids["_n"], "left_semi")


def clause_rows(rows: DataFrame, text: str, k: int, *order: Column) -> DataFrame:
    """The first k rows in order, a text taken once."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(text).orderBy(*order))).filter("_r = 1").drop("_r")
    return first.orderBy(*order).limit(k)


def lexical_rank(chunks: DataFrame, text: str, query: str, concepts: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Chunks with the number of distinct phrases of a query they contain, those without any left out."""
    import re

    low = query.lower()
    terms = sorted({p for p in re.split(r"[\s?,.()ฯ]+", low) if len(p) >= least} | {c for c in concepts if c in low})
    if not terms:
        return chunks.limit(0).withColumn("score", F.lit(0))
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.col(text)), t))
    return chunks.withColumn("score", F.size(found)).filter("score > 0")


def terminal_first(relations: DataFrame, group: str, kind: str, terminal: tuple[str, ...], *order: str) -> DataFrame:
    """Relations of a provision in order: what ended it leads, amendments beside an end become notes."""
    ends = F.col(kind).isin(*terminal)
    has = F.max(ends.cast("int")).over(Window.partitionBy(group))
    role = F.when(ends, "ends").when(has == 1, "note").otherwise("changes")
    out = relations.withColumn("role", role)
    return out.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(ends.cast("int")), *order)))


def marked_only(df: DataFrame, label: str, marker: str, tenant: str) -> DataFrame:
    """References whose label carries the tenant's marker at the start of a segment."""
    found = F.regexp_extract(label, rf"(?:^|/){marker}([A-Za-z0-9-]+)", 1)
    return df.filter(found == tenant)


def contains_any(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows one of whose columns contains a term, ignoring case; nulls contain nothing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
    return df.filter(hit)
