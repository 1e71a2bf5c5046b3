"""Versions of instruments in time: what holds, what was replaced, what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import valid_on


def holding(instruments: DataFrame, day: str) -> DataFrame:
    """Instruments valid on a day."""
    return instruments.filter(valid_on(F.lit(day).cast("date"), F.col("status"), F.col("effective_from"), F.col("effective_to")))


def resolve_status(instruments: DataFrame, relations: DataFrame, today: str) -> DataFrame:
    """(id, resolved_status, resolved_to): the status of every instrument, in three passes.

    1. By date: in the future, in force, or unknown. 2. Verified relations to the whole
    instrument: an end (REPEALS over SUPERSEDES) beats AMENDS; a null end is filled from
    the source's start. 3. Of the full editions of a family that have begun, all but the
    newest are superseded. Rows set by hand keep their status.

    instruments: id, family, status, status_source, effective_from, effective_to,
    enacted_year, version. relations: src, dst, relation, target_provision, review_status.
    """
    day = F.lit(today).cast("date")
    i = instruments
    manual = F.col("status_source") == "manual"
    by_date = F.when(F.col("effective_from") > day, "not_yet_effective").when(F.col("effective_from").isNotNull(), "in_force").otherwise("unknown")
    whole = relations.filter((F.col("review_status") == "verified") & F.col("target_provision").isNull())
    sources = i.select(F.col("id").alias("src"), F.col("effective_from").alias("_sf"))
    ends = F.col("relation").isin("REPEALS", "SUPERSEDES")
    effect = whole.join(sources, "src").groupBy(F.col("dst").alias("id")).agg(
        F.max((F.col("relation") == "REPEALS").cast("int")).alias("_rep"), F.max((F.col("relation") == "SUPERSEDES").cast("int")).alias("_sup"),
        F.max((F.col("relation") == "AMENDS").cast("int")).alias("_am"), F.min(F.when(ends, F.col("_sf"))).alias("_end"),
    )
    out = i.join(effect, "id", "left")
    status = F.when(F.col("_rep") == 1, "repealed").when(F.col("_sup") == 1, "superseded").when(F.col("_am") == 1, "amended").otherwise(by_date)
    out = out.withColumn("_st", F.when(manual, F.col("status")).otherwise(status)).withColumn("_to", F.coalesce("effective_to", "_end"))
    age = F.coalesce("effective_from", F.make_date("enacted_year", F.lit(1), F.lit(1)), F.lit("0001-01-01").cast("date"))
    full = F.col("version").isNull() & F.col("family").isNotNull()
    begun = full & ~F.coalesce(F.col("effective_from") > day, F.lit(False))
    out = out.withColumn("_age", age).withColumn("_begun", begun)
    family = Window.partitionBy("family")
    newest = F.max(F.when(F.col("_begun"), F.struct("_age", "id", "effective_from"))).over(family)
    many = F.sum(F.col("_begun").cast("int")).over(family)
    out = out.withColumn("_new", F.when(F.col("family").isNotNull(), newest)).withColumn("_many", many)
    old = F.col("_begun") & (F.col("_many") > 1) & (F.col("id") != F.col("_new.id")) & ~manual & ~F.col("_st").isin("repealed", "superseded")
    return out.select("id", F.when(old, "superseded").otherwise(F.col("_st")).alias("resolved_status"), F.when(old, F.coalesce("_to", F.col("_new.effective_from"))).otherwise(F.col("_to")).alias("resolved_to"))


def as_of(left: DataFrame, right: DataFrame, by: str, left_day: str, right_day: str, pick: str) -> DataFrame:
    """Each left row with the latest right row of its key not after its day (null: there is none).

    Keys are cut into months, so that one key may hold any share of the rows: the last
    right row of every month is found first (map-side combined) and carried over the
    months of its key; within a month both sides are laid in one order.
    """
    month = lambda c: F.trunc(F.col(c), "month")
    l_ = left.withColumn("_side", F.lit(1)).withColumn("_day", F.col(left_day)).withColumn("_month", month(left_day))
    r_ = right.filter(F.col(right_day).isNotNull()).select(F.col(by), F.lit(0).alias("_side"), F.col(right_day).alias("_day"), month(right_day).alias("_month"), F.col(pick).alias("_pick"))
    last = r_.groupBy(by, "_month").agg(F.max(F.struct("_day", "_pick")).alias("_last"))
    months = last.unionByName(l_.select(by, "_month").distinct(), allowMissingColumns=True).groupBy(by, "_month").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(by).orderBy(F.asc_nulls_first("_month")).rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(F.col(by).alias("_by"), F.col("_month").alias("_m"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    order = Window.partitionBy(by, "_month").orderBy(F.asc_nulls_first("_day"), "_side", F.asc_nulls_first("_pick")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_day", "_pick")), ignorenulls=True).over(order)
    held = both.withColumn("_seen", seen).filter("_side = 1").join(carried, F.col(by).eqNullSafe(F.col("_by")) & F.col("_month").eqNullSafe(F.col("_m")), "left")
    hit = F.when(F.col("_day").isNotNull(), F.coalesce("_seen", "_carry"))
    return held.withColumn("_hit", hit).select(*[F.col(c) for c in left.columns], F.col("_hit._pick").alias(pick), F.col("_hit._day").alias("as_of_day"))


def as_of_or_any(left: DataFrame, right: DataFrame, by: str, left_day: str, right_day: str, pick: str) -> DataFrame:
    """As ``as_of``; a left row whose key has right rows only after its day gets the earliest of them, so that none is left without where its key has any."""
    dated = right.filter(F.col(right_day).isNotNull()).groupBy(by, F.col(right_day).alias("_d1")).agg(F.max(pick).alias("_p1"))
    day0 = dated.groupBy(by).agg(F.min(F.struct("_d1", "_p1")).alias("_f")).select(by, "_f.*")
    out = as_of(left, right, by, left_day, right_day, pick).join(day0, by, "left")
    return out.select(*[F.col(c) for c in left.columns], F.coalesce(pick, "_p1").alias(pick), F.coalesce("as_of_day", "_d1").alias("as_of_day"))


def sole(df: DataFrame) -> DataFrame:
    """The row of a table that has exactly one, else none."""
    two = df.limit(2)
    return two.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).filter("_n = 1").drop("_n")


def filter_or_keep(df: DataFrame, keep: Column, *group: str) -> DataFrame:
    """Rows that meet a condition, or all rows of a group in which none does."""
    any_ = F.max(F.coalesce(keep, F.lit(False)).cast("int")).over(Window.partitionBy(*(group or [F.lit(1)])))
    return df.withColumn("_any", any_).filter(F.coalesce(keep, F.lit(False)) | (F.col("_any") == 0)).drop("_any")


def conflicts(evidence: DataFrame, group: list[str], current: Column) -> DataFrame:
    """Evidence of more than one document for one provision: rows that are not current go where a current one stands. Adds ``kept`` and ``warning``."""
    w = Window.partitionBy(*group)
    docs = F.size(F.collect_set("doc_id").over(w))
    has = F.max(F.coalesce(current, F.lit(False)).cast("int")).over(w)
    out = evidence.withColumn("_docs", docs).withColumn("_has", has)
    clash = (F.col("_docs") > 1) & (F.col("_has") == 1)
    kept = ~clash | F.coalesce(current, F.lit(False))
    return out.withColumn("kept", kept).withColumn("warning", F.when(clash & ~kept, "SUPERSEDED_VERSION_REMOVED").when((F.col("_docs") > 1) & (F.col("_has") == 0), "UNVERIFIED_VALIDITY")).drop("_docs", "_has")


def reasons(**tests: Column) -> Column:
    """Array of the names of the tests a row meets, in the order given."""
    return F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull())


def sub_works(chunks: DataFrame, doc: str, order: str, opens: Column, notes: Column) -> DataFrame:
    """Adds ``sub_work``: before the body, the body, or the notes after it; ``unknown`` where no body opens."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    body = F.max(opens.cast("int")).over(w)
    out = chunks.withColumn("_open", F.coalesce(body, F.lit(0))).withColumn("_was", F.coalesce(F.max(opens.cast("int")).over(before), F.lit(0)))
    note = F.max((notes & (F.col("_was") == 1)).cast("int")).over(w)
    out = out.withColumn("_note", F.coalesce(note, F.lit(0))).withColumn("_any", F.max("_open").over(Window.partitionBy(doc)))
    kind = F.when(F.col("_any") == 0, "unknown").when(F.col("_note") == 1, "amendment_note").when(F.col("_open") == 1, "code_body").otherwise("enabling_act")
    return out.withColumn("sub_work", kind).drop("_open", "_was", "_note", "_any")
