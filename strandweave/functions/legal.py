"""Functions on titles, dates and provisions of legal instruments, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, arabic_digits, squeeze

# Authority of a kind, and the words that tell it, the more specific first.
AUTHORITY = {
    "constitution": 100, "act": 90, "royal_decree": 80, "ministerial_regulation": 70, "notification": 60, "rule": 50,
    "circular": 40, "guideline": 30, "resolution": 30, "contract": 30, "faq": 20, "other": 20,
}
THAI_KINDS = {
    "constitution": ("รัฐธรรมนูญ",),
    "act": ("พระราชบัญญัติ", "พ.ร.บ.", "พรบ.", "พระราชกำหนด", "พ.ร.ก.", "พรก."),
    "royal_decree": ("พระราชกฤษฎีกา", "พ.ร.ฎ."),
    "ministerial_regulation": ("กฎกระทรวง",),
    "notification": ("ประกาศ",),
    "rule": ("ระเบียบ", "ข้อบังคับ"),
    "circular": ("หนังสือเวียน", "หนังสือตอบข้อหารือ"),
    "guideline": ("แนวปฏิบัติ", "คู่มือ", "มาตรฐาน"),
    "resolution": ("มติ",),
}
ENGLISH_KINDS = {
    "constitution": ("constitution",),
    "act": ("act",),
    "royal_decree": ("royal decree",),
    "ministerial_regulation": ("ministerial regulation",),
    "notification": ("notification",),
    "rule": ("regulation", "rule"),
    "circular": ("circular",),
    "guideline": ("guideline", "manual", "standard"),
    "resolution": ("resolution",),
}
MONTHS = ("มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม")
VERSION = r"\(\s*ฉบับที่\s*([0-9๐-๙]+)\s*\)"
BUDDHIST_YEAR = r"(?:พ\.?\s*ศ\.?|พุทธศักราช)\s*([0-9๐-๙]{4})"
COMMON_YEAR = r"(?i)(?:ค\.?\s*ศ\.?|B\.?E\.?|A\.?D\.?)\s*([0-9๐-๙]{4})"
ORDINALS = ("ทวิ", "ตรี", "จัตวา", "เบญจ", "ฉ", "สัตต", "อัฏฐ", "นว", "ทศ")
REFERENCE = (
    r"(?i)(มาตรา|ข้อ|หมวด|ส่วนที่|section|article|clause)\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)\s*(ทวิ|ตรี|จัตวา|เบญจ)?"
    r"(?:\s*(วรรค\s*(?:[0-9๐-๙]+|หนึ่ง|สอง|สาม|สี่|ห้า|หก|เจ็ด|แปด|เก้า|สิบ)))?"
)
STATUS_FACTOR = {"in_force": 1.0, "amended": 0.85, "not_yet_effective": 0.3, "unknown": 0.5, "superseded": 0.1, "repealed": 0.1}
#: Years above this are counted in the Buddhist era, which runs ahead by the second number.
BUDDHIST_FROM, BUDDHIST_AHEAD = 2400, 543


def kind_of(title: Column, hint: Column | None = None) -> Column:
    """The kind a title names: Thai words first, then English ones as whole words, then a valid hint."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in THAI_KINDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(title, F.lit(w))
        out = out.when(hit, kind)
    low = F.lower(title)
    for kind, words in ENGLISH_KINDS.items():
        out = out.when(low.rlike(r"\b(?:" + "|".join(words) + r")\b"), kind)
    if hint is not None:
        known = F.replace(F.lower(F.trim(hint)), F.lit(" "), F.lit("_"))
        out = out.when(known.isin(*AUTHORITY), known)
    return out.otherwise("other")


def authority_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(AUTHORITY["other"]))


def status_factor(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_FACTOR.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(0.5))


def _cut_first(text: Column, found: Column) -> Column:
    """``text`` without the first place where ``found`` stands."""
    at = F.position(found, text)
    return F.when(F.length(found) > 0, F.concat(F.left(text, at - 1), F.substr(text, at + F.length(found)))).otherwise(text)


def version_number(title: Column) -> Column:
    """The number of an amended edition, null for a full one."""
    return F.nullif(arabic_digits(F.regexp_extract(title, VERSION, 1)), F.lit(""))


def enacted_year(title: Column) -> Column:
    """The year of a title in the common era."""
    body = F.regexp_replace(title, VERSION, "")
    buddhist, common = F.regexp_extract(body, BUDDHIST_YEAR, 1), F.regexp_extract(body, COMMON_YEAR, 1)
    number = lambda c: arabic_digits(c).cast("int")
    return F.when(F.length(buddhist) > 0, number(F.nullif(buddhist, F.lit(""))) - BUDDHIST_AHEAD).when(F.length(common) > 0, number(F.nullif(common, F.lit(""))))


def family_key(title: Column) -> Column:
    """The title all editions of one instrument share: without its first edition number and its year."""
    value = F.trim(title)
    value = _cut_first(value, F.regexp_extract(value, VERSION, 0))
    buddhist = F.regexp_extract(value, BUDDHIST_YEAR, 0)
    common = F.regexp_extract(value, COMMON_YEAR, 0)
    value = _cut_first(value, F.when(F.length(buddhist) > 0, buddhist).otherwise(common))
    return F.lower(squeeze(value))


def written_date(text: Column) -> Column:
    """A Thai date in either era, or the ISO date a text begins with; null where there is none."""
    value = F.trim(text)
    thai = r"([0-9๐-๙]{1,2})\s*(" + "|".join(MONTHS) + r")\s*([0-9๐-๙]{4})"
    day, month, year = (F.nullif(F.regexp_extract(value, thai, i), F.lit("")) for i in (1, 2, 3))
    y = arabic_digits(year).cast("int")
    m = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), month).cast("int")
    spelled = F.format_string("%04d-%02d-%02d", F.when(y > BUDDHIST_FROM, y - BUDDHIST_AHEAD).otherwise(y), m, arabic_digits(day).cast("int"))
    iso = F.left(arabic_digits(value), F.lit(10))
    return F.when(day.isNotNull(), F.try_to_date(spelled, "yyyy-MM-dd")).when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd"))


def provision_refs(text: Column) -> Column:
    """Array of (kind, number, paragraph, raw) of the provisions a text refers to, in order."""
    part = lambda i: F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(i))
    english = F.create_map(*[F.lit(x) for x in ("section", "มาตรา", "article", "มาตรา", "clause", "ข้อ")])
    return F.transform(
        F.arrays_zip(part(1).alias("k"), part(2).alias("n"), part(3).alias("s"), part(4).alias("p"), part(0).alias("r")),
        lambda x: F.struct(
            F.coalesce(F.try_element_at(english, F.lower(x["k"])), x["k"]).alias("kind"),
            F.concat(arabic_digits(x["n"]), F.when(F.length(x["s"]) > 0, F.concat(F.lit(" "), x["s"])).otherwise("")).alias("number"),
            F.nullif(x["p"], F.lit("")).alias("paragraph"),
            F.trim(x["r"]).alias("raw"),
        ),
    )


def first_provision(text: Column) -> Column:
    """The first (kind, number, paragraph, raw) a text refers to, or null: the text is read to there only."""
    return F.get(provision_refs(F.regexp_extract(text, REFERENCE, 0)), F.lit(0))


def provision_number(value: Column) -> Column:
    """A provision number as it is compared: no prefix, no blanks, ordinal words as ``/n``."""
    out = F.regexp_replace(F.trim(value), r"(?i)^(มาตรา|ข้อ|section|article|clause)" + SPACE + "*", "")
    out = F.lower(F.regexp_replace(out, SPACE + "+", ""))
    for n, word in enumerate(ORDINALS, 1):
        out = F.regexp_replace(out, f"([0-9๐-๙]+){word}$", f"$1/{n}")
    return out


def same_provision(target: Column, number: Column) -> Column:
    """Whether a reference names a provision or a paragraph of it; false where either is missing."""
    a, b = provision_number(target), provision_number(number)
    return F.coalesce((F.length(target) > 0) & (F.length(number) > 0) & ((a == b) | F.startswith(a, F.concat(b, F.lit("วรรค")))), F.lit(False))


def valid_on(day: Column, status: Column, start: Column, end: Column) -> Column:
    """Whether an instrument holds on a day; one that was ended needs an end after that day."""
    begun, open_ = start.isNull() | (start <= day), end.isNull() | (end > day)
    ended = status.isin("repealed", "superseded")
    return begun & open_ & (~F.coalesce(ended, F.lit(False)) | end.isNotNull())
