"""Which texts lie within which others, without comparing all with all.

A text lies within another only if each of its runs of signs is among the other's runs of
that length. Texts are looked for by the rarest run of the longest of a few widths they
have, so every containment is met by an equi-join, whatever its place, and is then checked.
Only digests are moved to find pairs; the texts join the pairs that were found. The runs of
a text are many times its size, which the optimizer does not see, so it is told to merge
and never to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the windows, long ones first: the longer, the fewer texts share one.
WIDTHS = (16, 6, 2, 1)
#: Classes of digests whose windows are counted to tell rare ones: a fixed size, and which window is taken changes no result.
CLASSES = 1 << 16


def _windows(text: str, width: int, within: tuple[str, ...]) -> Column:
    """Digests of all runs of ``width`` signs of a text, each once."""
    own = [F.col(c).cast("string") for c in within]
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.xxhash64(F.lit(width), *own, F.substr(F.col(text), i, F.lit(width)))))


def containing(holders: DataFrame, holder: str, parts: DataFrame, part: str, widths: tuple[int, ...] = WIDTHS, within: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All columns of both sides for every pair in which ``holder`` contains ``part``; empty and null texts contain nothing and lie in nothing.

    Column names of the two sides must differ. ``within``: columns of the holders and of
    the parts that must be equal. Wide windows come first, so common short texts are the
    only ones that meet many others.
    """
    ours, theirs = tuple(w[0] for w in within), tuple(w[1] for w in within)
    digest = lambda text, own: F.xxhash64(*[F.col(c).cast("string") for c in own], F.col(text))
    h = holders.filter(F.length(holder) >= widths[-1]).dropna(subset=list(ours) or [holder]).withColumn("_h", digest(holder, ours))
    p = parts.filter(F.length(part) >= widths[-1]).dropna(subset=list(theirs) or [part]).withColumn("_p", digest(part, theirs))
    # A width that no part needs would cost all windows of all holders; the driver gets one row a width.
    band = F.coalesce(*[F.when(F.length(part) >= w, w) for w in widths])
    used = {r["_w"] for r in p.select(band.alias("_w")).distinct().collect()} or {widths[0]}
    met = None
    for w in sorted(used, reverse=True):
        held = h.filter(F.length(holder) >= w).select("_h", F.explode(_windows(holder, w, ours)).alias("_window"))
        counts = held.groupBy(F.pmod("_window", F.lit(CLASSES)).alias("_class")).agg(F.count("*").alias("_n"))
        asked = p.filter(band == w).select("_p", F.explode(_windows(part, w, theirs)).alias("_window")).withColumn("_class", F.pmod("_window", F.lit(CLASSES)))
        rarest = asked.hint("merge").join(counts, "_class", "left").groupBy("_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_window"))["_window"].alias("_window"))
        pairs = held.hint("merge").join(rarest, "_window").select("_h", "_p")
        met = pairs if met is None else met.unionByName(pairs)
    both = h.hint("merge").join(met.distinct(), "_h").hint("merge").join(p, "_p").drop("_h", "_p")
    inside = F.contains(F.col(holder), F.col(part))
    for a, b in within:
        inside = inside & (F.col(a) == F.col(b))
    return both.filter(inside)
