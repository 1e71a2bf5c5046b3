"""Which instruments a question is about, which of them hold on its day, and which documents must not be evidence for it.

Every step works on a whole column of questions: mentions are met by windows of signs,
everything else by equi-joins on question, family, document or instrument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import provision_refs, valid_on
from ..session import cut
from .containment import containing

# What a family's name may begin with, relations that lead one step further, and the shortest name that counts.
PREFIXES = ("พระราชบัญญัติ", "ประมวลกฎหมาย", "กฎหมาย", "ว่าด้วย")
NEXT_TO = ("ISSUED_UNDER", "IMPLEMENTS")
LEAST = 4


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def family_names(instruments: DataFrame) -> DataFrame:
    """(family, form, own): what a family is called: its key and title, each also without a legal prefix; ``own`` marks the key itself."""
    both = instruments.filter("family IS NOT NULL").select("family", F.explode(F.array(F.struct(compact(F.col("family")).alias("f"), F.lit(True).alias("own")), F.struct(compact(F.col("base_title")).alias("f"), F.lit(False).alias("own")))).alias("x"))
    short = F.filter(F.array(*[F.when(F.startswith("x.f", F.lit(p)) & (F.length("x.f") > len(p)), F.substr(F.col("x.f"), F.lit(len(p) + 1))) for p in PREFIXES]), lambda s: s.isNotNull())
    forms = F.concat(F.array(F.struct(F.col("x.f").alias("f"), F.col("x.own").alias("own"))), F.transform(short, lambda s: F.struct(s.alias("f"), F.lit(False).alias("own"))))
    return both.select("family", F.explode(forms).alias("y")).select("family", F.col("y.f").alias("form"), F.col("y.own").alias("own")).filter(F.length("form") >= LEAST).groupBy("family", "form").agg(F.max("own").alias("own"))


def resolve(questions: DataFrame, instruments: DataFrame, provisions: DataFrame, relations: DataFrame, exclude_invalid: bool = True) -> tuple[DataFrame, DataFrame]:
    """(roles, flags).

    roles: (q, doc_id, instrument_id, role), role one of matched, preferred, candidate,
    current, amending, excluded. flags: (q, ambiguous, reason, n_refs), one row a question.

    questions: q, question, as_of (date), historical (boolean). instruments: instrument_id,
    doc_id, family, base_title, official_number, version, document_class, version_role,
    status, effective_from, effective_to. provisions: doc_id, number. relations: src, dst,
    relation, review_status, of instruments. A question that names no family, number or
    provision matches nothing; what does not hold on its day is then excluded throughout.
    """
    # A family's name is a long expression that every step names again, so instruments are written once as well. Neither they nor
    # questions have a bound, and files are a fraction of what they hold in memory: their joins are merged, never broadcast.
    kept = lambda df, label: cut(df, f"resolver-{label}").hint("merge")
    i = kept(instruments.select("instrument_id", "doc_id", "family", "base_title", "official_number", "version", "document_class", "version_role", "status", "effective_from", "effective_to"), "instruments")
    q = questions.select("q", "question", compact(F.col("question")).alias("_c"), "as_of", F.coalesce("historical", F.lit(False)).alias("historical"), F.transform(provision_refs(F.col("question")), lambda r: compact(r["number"])).alias("refs"))
    names = kept(family_names(i), "names")
    said = containing(q.select("q", "_c"), "_c", names, "form", widths=(16, LEAST)).unionByName(containing(names, "form", q.select("q", "_c"), "_c", widths=(16, 1)).select("q", "_c", "family", "form", "own"))
    # Each step is named by several later ones, so it is written once.
    family = kept(said.groupBy("q", "family").agg(F.max("own").alias("own")), "families")
    numbered = containing(q.select("q", "question"), "question", i.filter(F.length("official_number") > 0).select("instrument_id", "official_number"), "official_number", widths=(5, 1)).select("q", "instrument_id").distinct()
    numbered = kept(numbered, "numbers")
    labelled = containing(q.select("q", F.lower("question").alias("_l")), "_l", i.filter(F.length("version") > 0).select(F.lower("version").alias("_v")).distinct(), "_v", widths=(1,)).select("q")
    version = numbered.select("q").unionByName(labelled).distinct().withColumn("versioned", F.lit(True))
    has_family = family.select("q").distinct().withColumn("named", F.lit(True))
    q = q.hint("merge").join(version, "q", "left").hint("merge").join(has_family, "q", "left")
    q = q.withColumn("family_only", F.coalesce("named", F.lit(False)) & F.coalesce(~F.col("versioned"), F.lit(True)))

    holds = valid_on(F.col("as_of"), F.col("status"), F.col("effective_from"), F.col("effective_to"))
    asked = kept(q.select("q", "as_of", "historical", "refs", "family_only", "named"), "questions")
    whole = kept(i.filter("document_class = 'consolidated'").join(family, "family").join(asked, "q").filter(holds), "editions")
    latest = F.coalesce(F.col("version_role") == "latest_consolidated", F.lit(False))

    def chosen(rows: DataFrame, *group: str) -> DataFrame:
        """The latest consolidations of a group, or all if none is marked so, with their number."""
        w = Window.partitionBy(*group)
        kept = rows.withColumn("_any", F.max(latest.cast("int")).over(w)).filter((F.col("_any") == 0) | latest)
        return kept.withColumn("n", F.count("*").over(w)).select("q", "instrument_id", "n")

    first = kept(chosen(whole.filter("family_only"), "q", "family"), "first")
    ambiguous1 = first.filter("n > 1").select("q").distinct()
    preferred1 = first.filter("n = 1").select("q", "instrument_id")
    open_ = asked.join(preferred1.select("q"), "q", "left_anti").join(ambiguous1, "q", "left_anti")
    explicit = i.join(family.filter("own"), "family").select("q", "instrument_id")
    fall = explicit.join(open_.filter("family_only").select("q"), "q", "left_semi")
    plain = explicit.unionByName(numbered).join(asked.filter("NOT family_only").select("q"), "q", "left_semi")
    matched = kept(preferred1.unionByName(fall).unionByName(plain).distinct(), "matched")

    # Nothing named: the provisions that carry the number, or the one current consolidation.
    bare = asked.filter(F.size("refs") > 0).join(matched.select("q"), "q", "left_anti").join(ambiguous1, "q", "left_anti")
    by_number = bare.select("q", F.explode("refs").alias("_n")).join(provisions.select("doc_id", compact(F.col("number")).alias("_n")), "_n").join(i.select("doc_id", "instrument_id"), "doc_id").select("q", "instrument_id").distinct()
    second = kept(chosen(whole.join(bare.filter("named").select("q"), "q", "left_semi"), "q"), "second")
    ambiguous2 = second.filter("n > 1").select("q").distinct()
    preferred2 = second.filter("n = 1").select("q", "instrument_id")
    by_number = by_number.join(second.select("q"), "q", "left_anti")
    matched = matched.unionByName(by_number).unionByName(preferred2)
    still = bare.join(by_number.select("q"), "q", "left_anti").join(second.select("q"), "q", "left_anti")
    days = still.select("as_of").distinct()
    sole = i.filter(latest).join(F.broadcast(days)).filter(holds).groupBy("as_of").agg(F.count("*").alias("_n"), F.min("instrument_id").alias("instrument_id")).filter("_n = 1")
    preferred3 = still.join(sole, "as_of").select("q", "instrument_id")
    matched = kept(matched.unionByName(preferred3).distinct(), "all")
    preferred = preferred1.unionByName(preferred2).unionByName(preferred3).distinct()

    hops = relations.filter("review_status = 'verified'")
    amending = matched.join(hops.filter("relation = 'AMENDS'").select(F.col("dst").alias("instrument_id"), "src"), "instrument_id").select("q", F.col("src").alias("instrument_id"))
    near = hops.filter(F.col("relation").isin(*NEXT_TO))
    beside = matched.join(near.select(F.col("src").alias("instrument_id"), F.col("dst").alias("_o")), "instrument_id").select("q", F.col("_o").alias("instrument_id"))
    beside = beside.unionByName(matched.join(near.select(F.col("dst").alias("instrument_id"), F.col("src").alias("_o")), "instrument_id").select("q", F.col("_o").alias("instrument_id")))
    facts = i.select("instrument_id", "doc_id", "family", "status", "effective_from", "effective_to")
    on = lambda rows: rows.distinct().join(facts, "instrument_id").join(asked, "q").withColumn("_holds", holds)
    visited, amends = on(matched.unionByName(beside)), on(amending).filter("_holds")
    role = lambda rows, name: rows.select("q", "doc_id", "instrument_id", F.lit(name).alias("role"))
    roles = role(on(matched), "matched").unionByName(role(on(preferred), "preferred")).unionByName(role(amends, "amending"))
    roles = roles.unionByName(role(on(first.filter("n > 1").unionByName(second.filter("n > 1")).select("q", "instrument_id")), "candidate"))
    roles = roles.unionByName(role(visited.filter("_holds"), "current")).unionByName(role(amends, "current"))
    if exclude_invalid:
        strict = asked.filter("NOT historical")
        swept = strict.join(matched.select("q"), "q", "left_anti").select("q", "as_of")
        # What holds is the same for all questions of one day: few days meet all instruments, then the questions join by day.
        ended = facts.join(F.broadcast(swept.select("as_of").distinct())).filter(~holds).select("as_of", "doc_id", "instrument_id")
        out = role(visited.filter("NOT _holds AND NOT historical"), "excluded").unionByName(role(swept.join(ended, "as_of"), "excluded"))
        old = family.join(preferred.select("q"), "q", "left_semi").join(facts, "family").join(strict, "q").filter(~holds)
        roles = roles.unionByName(out).unionByName(role(old, "excluded"))
    unclear = ambiguous1.withColumn("reason", F.lit("FAMILY")).unionByName(ambiguous2.withColumn("reason", F.lit("PROVISION"))).groupBy("q").agg(F.min("reason").alias("reason"))
    flags = asked.select("q", F.size("refs").alias("n_refs")).join(unclear, "q", "left").select("q", F.col("reason").isNotNull().alias("ambiguous"), "reason", "n_refs")
    return roles.filter("doc_id IS NOT NULL").distinct(), flags
