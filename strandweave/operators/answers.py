"""From ranked evidence to an answer: filters on evidence, reranking, citations, and the questions a registry answers by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import provision_refs, same_provision
from ..functions.text import arabic_digits, citations

# What questions about the holdings themselves are told by.
COUNT = ("กี่ฉบับ", "กี่เอกสาร", "จำนวน", "รายการ", "รายชื่อ", "แสดงรายการ", "มีอะไรบ้าง", "how many", "count", "list", "show", "what documents")
TYPE = ("ประเภท", "แบ่งกลุ่ม", "แบ่งเป็น", "category", "categories", "grouped")
SUBJECT = ("เอกสาร", "กฎหมาย", "knowledge base", "document", "law")
CURRENT = ("ปัจจุบัน", "ล่าสุด", "มีผลบังคับใช้", "ยังมีผล", "current", "latest", "in force")
ACTION = ("ลบ", "แก้ไข", "อัปโหลด", "อัพโหลด", "ดาวน์โหลด", "ย้าย", "เก็บ", "archive", "delete", "remove", "upload", "download", "move", "process", "reindex", "how do i", "อย่างไร", "ทำอย่างไร", "วิธี")
STILL_COUNT = ("กี่", "จำนวน", "how many", "count")
LOOKUP = ("วันที่ในผัง", "ฉบับล่าสุดในชุด", "เอกสารใด", "ต้องคืนเอกสาร", "ข้อความจากกฎหมายฉบับ")
CHANGED_BY = ("แก้ไขโดย", "แก้ไขเพิ่มเติมโดย", "ถูกเพิ่มโดย", "เพิ่มโดย", "ยกเลิกโดย", "ฉบับใด")
IN_FORCE_FROM = ("มีผลใช้บังคับ", "เริ่มใช้บังคับ", "กำหนดเวลา", "วันถัดจากวันประกาศ", "วันประกาศ")
AMENDMENT = r"(?i)ฉบับ(?:แก้ไข)?\s*(?:ครั้ง)?\s*ที่\s*([0-9๐-๙]+)"
YEAR = r"พ\.ศ\.?\s*[0-9๐-๙]{4}"


def says(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def amendment_asked(question: Column) -> Column:
    """The number of the amendment a question names, or null."""
    return F.nullif(arabic_digits(F.regexp_extract(question, AMENDMENT, 1)), F.lit(""))


def shortcut(question: Column, filtered: Column | bool = False) -> Column:
    """How a question is answered without retrieval: the first that holds of inventory, metadata, court_gap, commencement, copies, effective_rule, provenance, current_provision, current_law; null: by retrieval.

    ``filtered``: whether the caller set filters; only the inventory is then left.
    """
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    number, refs = amendment_asked(F.coalesce(question, F.lit(""))), F.size(provision_refs(F.coalesce(question, F.lit("")))) > 0
    free = ~(F.lit(filtered) if isinstance(filtered, bool) else F.coalesce(filtered, F.lit(False)))
    now = free & number.isNull() & ~q.rlike(YEAR)
    inventory = says(q, *SUBJECT) & ~(says(q, *ACTION) & ~says(q, *STILL_COUNT)) & (says(q, *COUNT) | (says(q, *TYPE) & says(q, "แบ่ง")))
    metadata = (says(q, "ฉบับล่าสุด") & says(q, "เอกสาร", "ชุดข้อมูล", "วันที่ในผัง", "ฉบับใด")) | (number.isNotNull() & says(q, *LOOKUP))
    return (
        F.when(inventory, "inventory")
        .when(now & metadata, "metadata")
        .when(free & says(q, "คำพิพากษา", "ฎีกา"), "court_gap")
        .when(now & says(q, "เริ่มใช้บังคับ"), "commencement")
        .when(now & says(q, "โฉนดที่ดิน", "หนังสือรับรองการทำประโยชน์") & says(q, "กี่ฉบับ", "ใครเก็บ", "ต้นฉบับ", "จัดเก็บ"), "copies")
        .when(free & number.isNotNull() & says(q, *IN_FORCE_FROM), "effective_rule")
        .when(free & refs & says(q, *CHANGED_BY), "provenance")
        .when(now & refs, "current_provision")
        .when(now & says(q, "ปัจจุบัน", "ล่าสุด") & says(q, "กฎหมาย", "หลักเกณฑ์", "ค่าธรรมเนียม", "สิทธิ", "หน้าที่"), "current_law")
    )


def inventory_scope(question: Column, historical: bool = False) -> Column:
    return F.lit("all") if historical else F.when(says(F.lower(F.coalesce(question, F.lit(""))), *CURRENT), "current").otherwise("all")


def within_scope(plans: DataFrame, filters: DataFrame) -> DataFrame:
    """Plans with what the caller asked for put over what the rules found: window, day, history. filters: q and those columns, null where not asked."""
    f = filters.select("q", *[F.col(c).alias(f"_{c}") for c in ("published_from", "published_to", "as_of", "historical")])
    out = plans.join(f, "q", "left")
    for c in ("published_from", "published_to", "as_of"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c) if c in plans.columns else F.col(f"_{c}"))
    return out.withColumn("historical", F.coalesce("_historical", F.lit(False))).drop("_published_from", "_published_to", "_as_of", "_historical")


def permitted(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Evidence of each question without its excluded documents; where a question prefers documents, only those. rows: q, doc_id, ...; roles: q, doc_id, role."""
    kept = rows.join(roles.filter("role = 'excluded'").select("q", "doc_id").distinct(), ["q", "doc_id"], "left_anti")
    liked = roles.filter("role = 'preferred'").select("q", "doc_id").distinct()
    choosy = liked.select("q").distinct().withColumn("_choosy", F.lit(True))
    marked = kept.join(choosy, "q", "left").join(liked.withColumn("_liked", F.lit(True)), ["q", "doc_id"], "left")
    return marked.filter(F.col("_choosy").isNull() | F.col("_liked").isNotNull()).drop("_choosy", "_liked")


def of_provisions(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Evidence whose section a question refers to; questions that refer to none keep all. rows: q, section_kind, section_number; refs: q, refs array<(kind, number)>."""
    out = rows.join(refs, "q", "left")
    hit = F.exists("refs", lambda r: same_provision(r["number"], F.col("section_number")) & (F.col("section_kind").isNull() | (F.col("section_kind") == r["kind"])))
    return out.filter(F.col("refs").isNull() | (F.size("refs") == 0) | F.coalesce(hit, F.lit(False))).drop("refs")


def with_template(documents: DataFrame, template: str, profile: str) -> DataFrame:
    """Documents of a template; those that name none count by their type."""
    return documents.filter((F.col("template_id") == template) | (F.col("template_id").isNull() & (F.col("document_type") == profile)))


def in_scope(calls: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``allowed``: whether a call's token has the tool and at least one of the bases asked for; an empty list of tools allows nothing. Adds ``bases``: those it may see."""
    t = tokens.select("token", "tools", F.col("bases").alias("_own"))
    out = calls.join(t, "token", "left").withColumn("bases", F.coalesce(F.array_intersect("asked", "_own"), F.array().cast("array<string>")))
    return out.withColumn("allowed", F.coalesce(F.array_contains("tools", F.col("tool")), F.lit(False)) & (F.size("bases") > 0)).drop("tools", "_own")


def any_row(df: DataFrame, condition: Column) -> DataFrame:
    """One row: whether any row meets a condition; the scan ends at the first."""
    one = df.filter(condition).select(F.lit(1).alias("_x")).limit(1)
    return one.agg((F.count("*") > 0).alias("found"))


def reranked(evidence: DataFrame, scores: DataFrame, limit: int, candidates: int = 20) -> DataFrame:
    """Evidence of each question in the order of scores from outside: of the first ``candidates`` those that were scored, ``limit`` at most; a question without scores keeps its order.

    evidence: q, position, ...; scores: q, index (from 0), relevance.
    """
    pool = evidence.filter(F.col("position") <= candidates).join(scores.select("q", (F.col("index") + 1).alias("position"), F.col("relevance").alias("_score")), ["q", "position"], "left")
    scored = F.max(F.col("_score").isNotNull().cast("int")).over(Window.partitionBy("q"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("_score"), "position"))
    rest = evidence.join(scores.select("q").distinct(), "q", "left_anti").withColumn("place", F.col("position"))
    out = pool.withColumn("_any", scored).filter("_any = 1 AND _score IS NOT NULL").withColumn("place", place).filter(F.col("place") <= limit).drop("_any", "_score")
    return out.unionByName(rest.select(*out.columns))


def narrowed(answers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence) after the citation gate: an answer that cites nothing known, or anything unknown, is dropped; evidence is narrowed to what was cited, unless nothing known was.

    answers: q, answer; evidence: q, citation_id, ....
    """
    cited = answers.filter(F.length(F.trim("answer")) > 0).select("q", F.explode(citations(F.col("answer"))).alias("citation_id"))
    known = cited.join(evidence.select("q", "citation_id"), ["q", "citation_id"], "left_semi")
    n = cited.groupBy("q").agg(F.count("*").alias("_said")).join(known.groupBy("q").agg(F.count("*").alias("_known")), "q", "left")
    out = answers.join(n, "q", "left").withColumn("_known", F.coalesce("_known", F.lit(0)))
    blank = F.coalesce(F.length(F.trim("answer")), F.lit(0)) == 0
    action = F.when(blank, "NONE").when(F.col("_known") == 0, "DROP_ANSWER").when(F.col("_known") < F.col("_said"), "DROP_ANSWER_NARROW").otherwise("NARROW")
    judged = out.withColumn("action", action)
    wide = judged.filter("action IN ('NONE', 'DROP_ANSWER')").select("q")
    kept = evidence.join(known, ["q", "citation_id"], "left_semi").unionByName(evidence.join(wide, "q", "left_semi"))
    return judged.select("q", F.when(F.col("action") == "NARROW", F.col("answer")).alias("answer"), "action"), kept


def composed(evidence: DataFrame) -> DataFrame:
    """(q, citations, details): per question its citation marks in order and a line for each source: mark, title, section, address. evidence: q, position, citation_id, title, section_label, uri."""
    line = F.concat(F.lit("["), "citation_id", F.lit("] "), F.concat_ws(", ", F.coalesce("title", F.lit("-")), "section_label"), F.coalesce(F.concat(F.lit(" — "), "uri"), F.lit("")))
    rows = evidence.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("["), "citation_id", F.lit("]")).alias("mark"), line.alias("line")))).alias("_l"))
    return rows.select("q", F.array_join(F.transform("_l", lambda x: x["mark"]), " ").alias("citations"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("details"))


def merged_fields(defaults: Column, own: Column) -> Column:
    """Fields of a profile with a template's own put over them by key: the profile's order first, new keys behind; of fields with one key the last holds. Arrays of structs with ``key``."""
    last = lambda fields: F.filter(fields, lambda f, i: (f["key"].isNotNull()) & ~F.exists(F.slice(fields, i + 2, F.greatest(F.size(fields) - i - 1, F.lit(0))), lambda g: g["key"].eqNullSafe(f["key"])))
    o = last(F.coalesce(own, F.array().cast("array<struct<key:string,label:string>>")))
    d = last(F.coalesce(defaults, F.array().cast("array<struct<key:string,label:string>>")))
    over = F.transform(d, lambda f: F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("struct<key:string,label:string>")), F.filter(o, lambda g: g["key"] == f["key"])), -1), f))
    return F.concat(over, F.filter(o, lambda g: ~F.exists(d, lambda f: f["key"] == g["key"])))


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in labels.items() for x in p]), code), code)


def first_of_json(json: Column, *keys: str) -> Column:
    """The first filled value of some keys of a JSON object; null where the text is no object."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, f"$.{k}")), F.lit("")) for k in keys])


def vector_fault(vector: Column, size: int) -> Column:
    """Why a vector is not taken in: MISSING, WRONG_SIZE or NOT_A_NUMBER; null where it is."""
    return F.when(vector.isNull(), "MISSING").when(F.size(vector) != size, "WRONG_SIZE").when(F.exists(vector, lambda x: F.isnan(x) | x.isNull()), "NOT_A_NUMBER")
