"""Problem 3: cut oversized texts into pieces at natural boundaries, with overlap.

Method: bounded-quantifier regex extraction, all in the JVM. One pattern lists the
boundaries from strong to weak; each alternative consumes up to the limit greedily, the
last falls back to single characters. A piece is what its match consumed with the last
``overlap`` characters before it in front, cut out by offsets.

Defined cases
    null text           -> no pieces
    empty text          -> no pieces
    text within limit   -> one piece, itself
    no boundary at all  -> pieces of exactly the limit, never inside a code point, a
                           combining sequence or CR LF where the limit leaves a choice
    very long text      -> processed whole; offsets are counted in code points
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import let, running


def _alternatives(room: int, least: int) -> str:
    """Boundaries by strength; each must leave the piece at least ``least`` characters."""
    full = f".{{1,{room}}}"
    ends = [
        r"(?:\r?\n){2}",  # paragraph
        r"\r?\n(?=#{1,6} |[-*•|] ?|\d+[.)] )",  # before a heading, an item or a table row
        r"\r?\n",  # line
        r"[.!?…。ฯ][\"'”’»)]{0,2}\s",  # sentence
        r"[;:,)–—]\s",  # clause
        r"\s",  # word
        r"[/|\\_-]",  # inside a compound
    ]
    widths = [4, 2, 2, 4, 2, 1, 1]
    strong = [f".{{{least},{room - w}}}{e}" for e, w in zip(ends, widths, strict=True)]
    whole = f".{{1,{room}}}\\z"
    # A cut between letters must not part a base from its marks, a leading vowel from its consonant, CR from LF or a joined sign.
    careful = f".{{{least},{room}}}" + r"(?![\p{M}ะ-ฺๅ-๎‍️\n])(?<![เ-ไ‍\r])"
    return "|".join([whole, *strong, careful, full])


def piece_pattern(size: int, overlap: int) -> str:
    """The pattern that consumes a text piece by piece: ``size`` the first time, ``size - overlap`` later.

    Where the sizes allow it every match but the last is at least ``overlap`` characters
    long, so the overlap of a piece lies wholly inside what the piece before it consumed.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the size")
    room = size - overlap
    if room < 8:
        return rf"(?s)\A.{{1,{size}}}|.{{1,{room}}}"
    first, later = (min(max(overlap, limit // 3), limit - 4) for limit in (size, room))
    return rf"(?s)\A(?:{_alternatives(size, first)})|(?:{_alternatives(room, later)})"


def split_oversized(df: DataFrame, text: str, size: int, overlap: int, *keys: str) -> DataFrame:
    """One row per piece: (keys, piece_no, n_pieces, char_start, char_end, piece). No shuffle, no Python.

    A piece is its unit behind the end of what came before, so a row carries its piece and
    never the whole text. The explode is an outer one: from an inner one the optimizer
    would infer a filter that matches every text a second time.
    """
    short = size - overlap < 8  # units may then be shorter than the overlap

    def pieces(units: Column) -> Column:
        def of(ends: Column) -> Column:
            def one(unit: Column, i: Column) -> Column:
                before = F.array_join(F.slice(units, F.greatest(F.lit(1), i + 1 - (overlap + 1 if short else 2)), F.least(i, F.lit(overlap + 1 if short else 2))), "")
                back = F.when(i == 0, F.lit("")).otherwise(F.right(before, F.lit(overlap)))
                return F.struct(F.size(units).alias("n"), (F.get(ends, i) - F.length(back)).alias("start"), F.get(ends, i + 1).alias("end"), F.concat(back, unit).alias("piece"))

            return F.transform(units, one)

        return let(running(F.transform(units, lambda u: F.length(u))), of)

    units = F.regexp_extract_all(F.col(text), F.lit(piece_pattern(size, overlap)), F.lit(0))
    each = df.select(*keys, F.posexplode_outer(let(units, pieces)).alias("_no", "_p")).filter("_p IS NOT NULL")
    return each.select(*keys, (F.col("_no") + 1).alias("piece_no"), F.col("_p.n").alias("n_pieces"), F.col("_p.start").alias("char_start"), F.col("_p.end").alias("char_end"), F.col("_p.piece").alias("piece"))


def oversized(df: DataFrame, text: str, size: int, overlap: int, key: str) -> DataFrame:
    """Keys of the texts the splitter parts into more than one piece."""
    return split_oversized(df, text, size, overlap, key).filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 1)).select(key).distinct()
