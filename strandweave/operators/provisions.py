"""Answers about provisions: editions, clauses, histories, what changed what, and conflicts between versions in evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import provision_number, same_provision
from .registry import filter_or_keep

TERMINAL = ("REPEALS", "SUPERSEDES")


def edition(instruments: DataFrame, number: str | None = None) -> DataFrame:
    """The newest amendment of a number, or without one the newest latest consolidation: at most one row."""
    rows = instruments.filter("version_role = 'latest_consolidated'") if number is None else instruments.filter((F.col("version_role") == "amendment") & (F.col("official_number") == number))
    return rows.orderBy(F.desc_nulls_last("version_date"), F.desc("created_at"), "instrument_id").limit(1)


def commencement_clauses(chunks: DataFrame, docs: DataFrame, numbers: tuple[str, ...] = ("2", "3")) -> DataFrame:
    """Chunks of the sections in which an act says when it begins, in order; of the given documents only."""
    return chunks.filter(F.col("section_number").isin(*numbers)).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def sole_per(instruments: DataFrame, *group: str) -> DataFrame:
    """The latest consolidation of every group that has exactly one."""
    rows = instruments.filter("version_role = 'latest_consolidated'").groupBy(*group).agg(F.count("*").alias("_n"), F.min(F.struct("instrument_id", "doc_id")).alias("_i"))
    return rows.filter("_n = 1").select(*group, "_i.instrument_id", "_i.doc_id")


def containing_all(chunks: DataFrame, content: str, words: tuple[str, ...], doc: str, k: int) -> DataFrame:
    """The first k chunks of every document that hold all of some words, ignoring case."""
    hit = F.lit(True)
    for w in words:
        hit = hit & F.contains(F.lower(content), F.lit(w.lower()))
    return chunks.filter(hit).withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy("chunk_index"))).filter(F.col("_r") <= k).drop("_r")


def current_provision(matching: DataFrame, kinds: Column, score: Column, doc: str, most: int = 4) -> DataFrame:
    """The chunks that answer for a provision, by document.

    matching: chunks whose number was asked for, with section_kind, section_number,
    sub_work, chunk_index. Each filter is dropped where it would leave nothing: the kinds
    asked for, no amendment notes, the body. Of what stays the sections of the two best
    scores are given in reading order, ``most`` chunks at most.
    """
    rows = filter_or_keep(matching, kinds, doc)
    rows = filter_or_keep(rows, F.col("sub_work") != "amendment_note", doc)
    rows = filter_or_keep(rows, F.col("sub_work") == "code_body", doc)
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("_score"), "chunk_index"))
    ranked = rows.withColumn("_score", score).withColumn("_rank", rank)
    keep = ranked.filter("_rank <= 2").select(F.col(doc).alias("_d"), F.col("section_number").alias("_n")).distinct()
    picked = ranked.join(keep, (F.col(doc) == F.col("_d")) & F.col("section_number").eqNullSafe(F.col("_n"))).drop("_d", "_n")
    place = F.row_number().over(Window.partitionBy(doc).orderBy("chunk_index"))
    return picked.withColumn("place", place).filter(F.col("place") <= most).drop("_score", "_rank")


def latest_amendment(numbers: DataFrame, relations: DataFrame, by: str) -> DataFrame:
    """For every (``by``, number) the newest verified act that amends it: src, version_date; a paragraph of a provision counts for it.

    relations: ``by``, src, target_provision, version_date, created_at; amendments only.
    """
    key = F.regexp_extract(provision_number(F.col("target_provision")), r"^([^ว]*)", 1)
    n = numbers.withColumn("_k", F.regexp_extract(provision_number(F.col("number")), r"^([^ว]*)", 1))
    met = n.join(relations.withColumn("_k", key), [by, "_k"]).filter(same_provision(F.col("target_provision"), F.col("number")))
    best = met.groupBy(by, "number").agg(F.max_by("src", F.struct(F.coalesce("version_date", F.lit("0001-01-01").cast("date")), "created_at", "src")).alias("src"))
    return best


def provenance(refs: DataFrame, relations: DataFrame, by: str) -> DataFrame:
    """(by, number, src, relation, target, role, position): what changed each provision asked for.

    An act counts once for a provision; an end leads, and amendments beside an end are
    notes; provisions nothing is known of have one row of role ``unknown``.
    """
    key = lambda c: F.regexp_extract(provision_number(F.col(c)), r"^([^ว]*)", 1)
    asked = refs.withColumn("_k", key("number"))
    known = relations.filter("review_status = 'verified'").filter(F.col("relation").isin("AMENDS", *TERMINAL)).withColumn("_k", key("target_provision"))
    met = asked.join(known, [by, "_k"]).filter(same_provision(F.col("target_provision"), F.col("number")))
    once = Window.partitionBy(by, "number", "src", "target_provision").orderBy(F.desc_nulls_last("version_date"), "relation")
    met = met.withColumn("_o", F.row_number().over(once)).filter("_o = 1")
    ends = F.col("relation").isin(*TERMINAL)
    any_ = F.max(ends.cast("int")).over(Window.partitionBy(by, "number"))
    met = met.withColumn("role", F.when(ends, "ends").when(any_ == 1, "note").otherwise("changes"))
    order = Window.partitionBy(by, "number").orderBy((F.col("role") == "note").cast("int"), F.desc_nulls_last("version_date"), "src", "relation")
    told = met.select(by, "number", "src", "relation", F.col("dst").alias("target"), "role", F.row_number().over(order).alias("position"))
    return refs.select(by, "number").distinct().join(told, [by, "number"], "left").withColumn("role", F.coalesce("role", F.lit("unknown")))


def history(instruments: DataFrame, chunks: DataFrame, number: str) -> DataFrame:
    """Every edition of every family that has a provision, oldest first, with the chunk in which it begins."""
    hit = chunks.filter(same_provision(F.col("section_number"), F.lit(number))).groupBy("doc_id").agg(F.min("chunk_index").alias("chunk_index"))
    rows = instruments.filter("family IS NOT NULL").join(hit, "doc_id")
    order = Window.partitionBy("family").orderBy(F.asc_nulls_first("effective_from"), "instrument_id")
    return rows.select("family", "instrument_id", "doc_id", "chunk_index", F.row_number().over(order).alias("edition"))


def detail(instruments: DataFrame, relations: DataFrame) -> DataFrame:
    """(instrument_id, family_size, n_out, n_in, amended_by): an instrument among its family and its relations."""
    size = instruments.filter("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("family_size"))
    out = relations.groupBy(F.col("src").alias("instrument_id")).agg(F.count("*").alias("n_out"))
    into = relations.groupBy(F.col("dst").alias("instrument_id")).agg(F.count("*").alias("n_in"), F.count_if((F.col("relation") == "AMENDS") & (F.col("review_status") == "verified")).alias("amended_by"))
    i = instruments.select("instrument_id", "family").join(size, "family", "left").join(out, "instrument_id", "left").join(into, "instrument_id", "left")
    return i.select("instrument_id", F.coalesce("family_size", F.lit(1)).alias("family_size"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "n_in", "amended_by")])


def body_occurrence(hits: DataFrame, chunks: DataFrame, chapter: str) -> DataFrame:
    """Of every (doc_id, section_number) hit the earliest chunk at or behind the document's first chapter; documents without a chapter keep all hits."""
    start = chunks.filter(F.col("section_kind") == chapter).groupBy("doc_id").agg(F.min("chunk_index").alias("_start"))
    rows = hits.join(start, "doc_id", "left")
    own = F.col("chunk_index") >= F.col("_start")
    first = F.min(F.when(own, F.col("chunk_index"))).over(Window.partitionBy("doc_id", "section_number"))
    return rows.withColumn("_first", first).filter(F.col("_start").isNull() | (F.col("chunk_index") == F.col("_first"))).drop("_start", "_first")


def version_conflicts(evidence: DataFrame, relations: DataFrame, group: list[str], resolved: bool = True, historical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(evidence that stays, warnings).

    evidence: ``group``, position, doc_id, instrument_id, family, section_kind,
    section_number, status, current (boolean). relations: dst, relation, target_provision,
    review_status. One provision of one family in more than one document is a conflict,
    decided by the first of: sources no verified relation overrides, where that is some but
    not all; documents the resolver calls current, where that is some but not all; nothing,
    where a resolver looked and could not tell; else the first. The best-placed source of
    the winners stays. Warnings also tell provisions that were ended or amended, and
    instruments nobody confirmed. ``group`` keeps the evidence of several questions apart.
    """
    over = relations.filter((F.col("review_status") == "verified") & F.col("target_provision").isNotNull() & F.col("relation").isin("AMENDS", *TERMINAL))
    over = over.select(F.col("dst").alias("instrument_id"), "relation", "target_provision", F.regexp_extract(provision_number(F.col("target_provision")), r"^([^ว]*)", 1).alias("_k"))
    e = evidence.withColumn("_k", F.regexp_extract(provision_number(F.col("section_number")), r"^([^ว]*)", 1))
    hit = e.join(over, ["instrument_id", "_k"]).filter(same_provision(F.col("target_provision"), F.col("section_number")))
    hit = hit.groupBy(*group, "position").agg(F.max_by("relation", F.struct(F.col("relation").isin(*TERMINAL), "relation")).alias("_rel"))
    e = e.drop("_k").join(hit, [*group, "position"], "left")
    keyed = F.col("family").isNotNull() & F.col("section_number").isNotNull()
    w = Window.partitionBy(*group, "family", "section_kind", "section_number")
    current = F.coalesce("current", F.lit(False))
    e = e.withColumn("_docs", F.when(keyed, F.size(F.collect_set("doc_id").over(w))).otherwise(1)).withColumn("_over", F.sum(F.col("_rel").isNotNull().cast("int")).over(w)).withColumn("_all", F.count("*").over(w))
    e = e.withColumn("_cur", F.size(F.collect_set(F.when(current, F.col("doc_id"))).over(w)))
    by_relation = (F.col("_over") > 0) & (F.col("_over") < F.col("_all"))
    by_current = (F.col("_cur") > 0) & (F.col("_cur") < F.col("_docs"))
    winner = F.when(by_relation, F.col("_rel").isNull()).when(by_current, current).otherwise(not resolved)
    clash = (F.col("_docs") > 1) & (by_relation | by_current | (not resolved))
    best = F.min(F.when(winner, F.col("position"))).over(w)
    e = e.withColumn("_best", best).withColumn("_lost", clash & (F.col("position") != F.col("_best")))
    lost = e.filter("_lost")
    stays = e if historical else e.filter("NOT _lost")
    code = lambda rows, c: rows.select(*group, "position", "doc_id", "section_number", c.alias("code"))
    warnings = code(lost, F.lit("SUPERSEDED_VERSION_PRESENT" if historical else "SUPERSEDED_VERSION_REMOVED"))
    told = stays.filter("_rel IS NOT NULL AND section_number IS NOT NULL")
    warnings = warnings.unionByName(code(told, F.when(F.col("_rel").isin(*TERMINAL), "PROVISION_REPEALED").otherwise("PROVISION_AMENDED")))
    warnings = warnings.unionByName(code(stays.filter("status = 'unknown'"), F.lit("UNVERIFIED_VALIDITY")))
    return stays.select(*evidence.columns), warnings


def scope_gap(question: Column) -> Column:
    """What is missing where a question has no evidence: court decisions, notices, or official texts."""
    q = F.lower(F.coalesce(question, F.lit("")))
    any_ = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(q, w))
    return F.when(any_("คำพิพากษา", "ฎีกา"), "court_decisions").when(any_("ประกาศ", "ระเบียบ"), "notices").otherwise("official_texts")
