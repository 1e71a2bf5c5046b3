"""Texts cut into overlapping chunks at word boundaries, and at section headings first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import arabic_digits, squeeze

# Fixed value: a heading of an official text, at the start of a line.
HEADING = r"(?m)^[ \t]*(มาตรา|ข้อ|หมวด|ส่วนที่|บทเฉพาะกาล|บทนิยาม)\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)?\s*(ทวิ|ตรี|จัตวา|เบญจ)?"
#: Stands before a heading while a text is split; a private-use sign no text holds after it was removed.
MARK = "\ue028"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named: lambdas share nothing by themselves."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column) -> Column:
    """Array of the sums before each number, and the whole sum at the end."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda seen, n: F.array_append(seen, F.element_at(seen, -1) + n))


def _units(size: int, overlap: int) -> str:
    """What each chunk takes beyond the chunk before: to the end if it is near, to the last blank of the chunk's second half, or all there is room for."""
    half, room = max(1, size // 2), size - overlap
    first = rf"\A(?:.{{1,{size}}}\z|.{{{half},{size - 1}}}(?= )|.{{{size}}})"
    return rf"(?s){first}|.{{1,{room}}}\z|.{{{half - overlap},{room - 1}}}(?= )|.{{{room}}}"


def _spans(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) by a fold, one span a step: for overlaps the pattern has no room for."""
    n = F.length(text)
    most = F.ceil(n / F.lit(max(1, size // 2 - overlap))).cast("int") + 1
    begin = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def advance(acc: Column, _: Column) -> Column:
        start = acc["start"]
        full, half = F.least(n, start + size), start + max(1, size // 2)
        back = F.instr(F.reverse(F.substr(text, half + 1, F.greatest(full - half, F.lit(0)))), " ")
        end = F.when((full < n) & (back > 0), full - back).otherwise(full)
        more = F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end")))
        return F.when(acc["done"] | (n == 0), acc).otherwise(F.struct(F.greatest(end - overlap, start + 1).alias("start"), (end >= n).alias("done"), more.alias("spans")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), begin, advance, lambda acc: acc["spans"])


def pieces(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end, content) over a squeezed text.

    A chunk ends at the last blank of its second half, or at ``size``; the next begins
    ``overlap`` signs before that end. One pass of a pattern takes the text unit by unit,
    and a chunk is its unit behind the end of the unit before, so the work is linear.
    """
    if size // 2 < 2 * overlap:
        at = lambda t, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.trim(F.substr(t, s["start"] + 1, s["end"] - s["start"])).alias("content"))
        return let(F.coalesce(text, F.lit("")), lambda t: F.transform(_spans(t, size, overlap), lambda s: at(t, s)))

    def cut(units: Column) -> Column:
        def one(ends: Column) -> Column:
            def piece(unit: Column, i: Column) -> Column:
                before = F.when(i > 0, F.right(F.get(units, i - 1), F.lit(overlap))).otherwise("")
                start = F.get(ends, i) - F.when(i > 0, overlap).otherwise(0)
                return F.struct(start.alias("start"), F.get(ends, i + 1).alias("end"), F.trim(F.concat(before, unit)).alias("content"))

            return F.transform(units, piece)

        return let(running(F.transform(units, lambda u: F.length(u))), one)

    return let(F.regexp_extract_all(text, F.lit(_units(size, overlap)), F.lit(0)), cut)


def chunk(df: DataFrame, text: str, size: int, overlap: int, *keys: str) -> DataFrame:
    """(keys, chunk_index, char_start, char_end, content): offsets count in the text with its white space collapsed. No shuffle.

    Null and blank texts have no chunk. The explode is an outer one: from an inner one the
    optimizer would infer a filter that cuts every text a second time.
    """
    each = df.select(*keys, F.posexplode_outer(pieces(squeeze(F.col(text)), size, overlap)).alias("chunk_index", "_p"))
    return each.filter("_p IS NOT NULL").select(*keys, "chunk_index", F.col("_p.start").alias("char_start"), F.col("_p.end").alias("char_end"), F.col("_p.content").alias("content"))


def _section(part: Column, i: Column) -> Column:
    """(kind, number, label) of a part that begins with its heading; what stands before the first is the preamble."""
    kind, number, suffix = (F.nullif(F.regexp_extract(part, HEADING, k), F.lit("")) for k in (1, 2, 3))
    full = F.when(number.isNotNull(), F.concat(arabic_digits(number), F.coalesce(F.concat(F.lit(" "), suffix), F.lit(""))))
    named = let(F.struct(kind.alias("k"), full.alias("n")), lambda s: F.struct(s["k"].alias("kind"), s["n"].alias("number"), F.concat_ws(" ", s["k"], s["n"]).alias("label")))
    return F.when(i == 0, F.struct(F.lit("preamble").alias("kind"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("label"))).otherwise(named)


def _parts(text: Column) -> Column:
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("")), HEADING, MARK + "$0"), MARK)


def sections(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, section_no, section_kind, section_number, section_label, body): a text split before each heading at the start of a line."""
    each = df.select(*keys, F.posexplode_outer(_parts(F.col(text))).alias("section_no", "body")).filter(F.length("body") > 0)
    named = each.withColumn("_s", _section(F.col("body"), F.col("section_no")))
    return named.select(*keys, "section_no", F.col("_s.kind").alias("section_kind"), F.col("_s.number").alias("section_number"), F.col("_s.label").alias("section_label"), "body")


def section_chunks(df: DataFrame, text: str, size: int, overlap: int, *keys: str) -> DataFrame:
    """(keys, chunk_index, section_kind, section_number, section_label, char_start, char_end, content): chunks within sections, counted over the whole text.

    An offset is the section's start plus the place in the section with its white space
    collapsed, as the platform counts it. A text is cut where it is read; nothing is shuffled.
    """

    def of(parts: Column, starts: Column) -> Column:
        def within(part: Column, i: Column) -> Column:
            cut = lambda s: F.transform(pieces(squeeze(part), size, overlap), lambda p: F.struct(s.alias("s"), (F.get(starts, i) + p["start"]).alias("start"), (F.get(starts, i) + p["end"]).alias("end"), p["content"].alias("content")))
            return let(_section(part, i), cut)

        return F.flatten(F.transform(parts, within))

    all_ = let(_parts(F.col(text)), lambda parts: let(running(F.transform(parts, lambda p: F.length(p))), lambda starts: of(parts, starts)))
    each = df.select(*keys, F.posexplode_outer(all_).alias("chunk_index", "_p")).filter("_p IS NOT NULL")
    return each.select(
        *keys, "chunk_index", F.col("_p.s.kind").alias("section_kind"), F.col("_p.s.number").alias("section_number"), F.col("_p.s.label").alias("section_label"),
        F.col("_p.start").alias("char_start"), F.col("_p.end").alias("char_end"), F.col("_p.content").alias("content"),
    )
