"""Headers and change clauses of official texts, and text layers read through a wrong code page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .legal import VERSION, written_date
from .text import SPACE, arabic_digits, thai_share

# Keys of a header, words that tell the class of an edition, and the wording of changes.
KEYS = {"display_title": "ชื่อในผัง", "official_title": "ชื่อกฎหมาย", "source_reference": "รหัสฉบับ", "version_date": "วันที่ในผัง", "source_uri": "แหล่งข้อมูล"}
CLASSES = (
    (("ฉบับหลัก",), "main", "main"),
    (("ฉบับปรับปรุงล่าสุด", "ฉบับรวมล่าสุด"), "consolidated", "latest_consolidated"),
    (("ฉบับปรับปรุง", "ฉบับรวม", "รวม"), "consolidated", "consolidated"),
    (("ฉบับแก้ไข", "แก้ไขเพิ่มเติม"), "amendment", "amendment"),
)
NUMBER = r"[0-9๐-๙]+(?:/[0-9๐-๙]+)?(?:\s*(?:ทวิ|ตรี|จัตวา|เบญจ|ฉ|สัตต|อัฏฐ|นว|ทศ))?"
CLAUSE = rf"(?i)((?:มาตรา|ข้อ)\s*{NUMBER}[^\n]{{0,420}}?(?:ให้ยกเลิกความใน|ให้ยกเลิก|ให้เพิ่ม|เพิ่มความใน|ให้ใช้ความต่อไปนี้แทน)[^\n]{{0,700}})"
TARGET = rf"(?i)(?:ใน|เป็น|แทน|ยกเลิก|ของ)\s*(?:(วรรค\s*(?:[0-9๐-๙]+|หนึ่ง|สอง|สาม|สี่|ห้า|หก|เจ็ด|แปด|เก้า|สิบ))\s*ของ\s*)?(?:มาตรา|ข้อ)\s*({NUMBER})"
CHAINED = rf"(?i)\G\s*(?:(?:และ|หรือ|,)\s*)?(?:มาตรา|ข้อ)\s*({NUMBER})"
HEADER_LINES, MOST_QUOTE = 30, 5000
CODE_PAGES = (("mac_roman", "tis-620"), ("cp1252", "utf-8"))


def tidy(text: Column) -> Column:
    """Single blanks, and a common slip of two letters for one mended."""
    mended = F.replace(F.replace(text, F.lit("เเก้ไข"), F.lit("แก้ไข")), F.lit("เเก้"), F.lit("แก้"))
    return F.trim(F.regexp_replace(mended, SPACE + "+", " "))


def header(text: Column) -> Column:
    """Struct of what the ``key: value`` lines at the top of a text say, with the class and role of the edition and the work it belongs to."""
    lines = F.filter(F.slice(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), 1, HEADER_LINES), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(tidy(F.substring_index(x, ":", 1)).alias("k"), tidy(F.substr(x, F.instr(x, ":") + 1)).alias("v")))

    def last(word: str) -> Column:
        filled = F.transform(F.filter(pairs, lambda p: (p["k"] == word) & (F.length(p["v"]) > 0)), lambda p: p["v"])
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), filled), -1)

    said = {name: last(word) for name, word in KEYS.items()}
    title = F.coalesce(said["official_title"], said["display_title"])
    shown = F.lower(F.coalesce(said["display_title"], title, F.lit("")))
    kind, role = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for words, k, r in CLASSES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(shown, F.lit(w))
        kind, role = kind.when(hit, k), role.when(hit, r)
    work = tidy(F.coalesce(title, F.lit("")))
    for pattern in (r"^พระราชบัญญัติ\s*แก้ไขเพิ่มเติม\s*", r"^พระราชบัญญัติ\s*", VERSION, r"(?:พ\.?\s*ศ\.?|ค\.?\s*ศ\.?)\s*[0-9๐-๙]{4}"):
        work = F.regexp_replace(work, pattern, "")
    number = F.nullif(arabic_digits(F.regexp_extract(F.coalesce(title, F.lit("")), VERSION, 1)), F.lit(""))
    return F.struct(
        said["display_title"].alias("display_title"), title.alias("official_title"), said["source_reference"].alias("source_reference"), written_date(said["version_date"]).alias("version_date"),
        said["source_uri"].alias("source_uri"), kind.otherwise("unknown").alias("document_class"), role.otherwise("unknown").alias("version_role"), F.nullif(tidy(work), F.lit("")).alias("work"), number.alias("official_number"),
    )


def change_targets(quote: Column) -> Column:
    """The provisions a change clause acts on, in order: the one named with a preposition, then those listed right after it."""
    found = F.regexp_extract(quote, TARGET, 0)
    number, paragraph = arabic_digits(F.regexp_extract(quote, TARGET, 2)), tidy(F.regexp_extract(quote, TARGET, 1))
    first = F.when(F.length(paragraph) > 0, F.concat_ws(" ", F.trim(number), paragraph)).otherwise(F.trim(number))
    rest = F.when(F.length(found) > 0, F.substr(quote, F.position(found, quote) + F.length(found))).otherwise(quote)
    chained = F.transform(F.regexp_extract_all(rest, F.lit(CHAINED), F.lit(1)), lambda n: F.trim(arabic_digits(n)))
    return F.array_distinct(F.concat(F.when(F.length(found) > 0, F.array(first)).otherwise(F.array().cast("array<string>")), chained))


def change_events(text: Column) -> Column:
    """Array of (action, provision_kind, provision_number, target, quote) of the change clauses of a text, each once."""

    def of(clause: Column) -> Column:
        quote = F.left(tidy(clause), F.lit(MOST_QUOTE))
        number = F.trim(arabic_digits(F.regexp_extract(quote, rf"(?i)^(?:มาตรา|ข้อ)\s*({NUMBER})", 1)))
        has = lambda w: F.contains(quote, F.lit(w))
        action = F.when(has("ให้เพิ่ม") | has("เพิ่มความใน"), "insert").when(has("ให้ยกเลิก") & ~has("ให้ใช้ความต่อไปนี้แทน"), "repeal").otherwise("replace")
        kind = F.when(has("มาตรา"), "มาตรา").otherwise("ข้อ")
        targets = change_targets(quote)
        targets = F.when(F.size(targets) > 0, targets).otherwise(F.array(number))
        return F.transform(targets, lambda t: F.struct(action.alias("action"), kind.alias("provision_kind"), number.alias("provision_number"), t.alias("target"), quote.alias("quote")))

    events = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLAUSE), F.lit(1)), of))
    key = lambda e: F.struct(e["action"], e["provision_number"], e["target"])
    return F.filter(events, lambda e, i: F.array_position(F.transform(events, key), key(e)) == i + 1)


def _other_page(texts: pd.Series) -> pd.Series:
    def thai(s: str) -> float:
        return sum("฀" <= c <= "๿" for c in s) / len(s)

    def read_again(t):
        if not isinstance(t, str) or not t or thai(t) >= 0.02:
            return None
        for seen, meant in CODE_PAGES:
            try:
                again = t.encode(seen).decode(meant)
            except UnicodeError:
                continue
            if again and thai(again) > 0.15:
                return again
        return None

    return texts.map(read_again)


def recovered_layer(text: Column) -> Column:
    """A text layer read again through the code page it was written in, where that brings Thai back; else null. Layers with any share of Thai never reach Python's codecs."""
    return F.pandas_udf(_other_page, "string")(F.when((thai_share(text) < 0.02) & text.rlike(r"[^\x00-\x7f]"), text))
