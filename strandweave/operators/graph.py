"""Bounded walks, impact and components over tables of edges.

An edge table is (src, dst). A walk doubles the edges instead of joining on "either end",
which would be a nested loop; a frontier is an equi-join, and what was visited is an
anti-join. Each hop is cut, so that a plan does not grow with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, forget


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once, without self loops."""
    fwd = edges.select("src", "dst").filter("src <> dst")
    return fwd.unionByName(fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance): nodes within ``depth`` hops of each start, the start itself at 0."""
    links = cut(both_ways(edges), "edges")
    seen = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(hop)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, start: str, depth: int, kind: str = "string") -> DataFrame:
    """(node, distance, path, direct): shortest ways from one node, the least of equally short ones."""
    links = cut(both_ways(edges), "edges")
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("distance"), F.array(F.lit(start).cast(kind)).alias("path"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).withColumn("distance", F.lit(hop)), "hop")
        seen = seen.unionByName(frontier.select("node", "distance", "path"))
    return seen.filter("distance > 0").select("node", "distance", F.array_join("path", " > ").alias("path"), (F.col("distance") == 1).alias("direct"))


def _mark(links: DataFrame) -> tuple:
    """How many links there are and a digest of them all, whatever their order: one pass over a narrow table."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node of each connected component, for every node of an edge to another.

    Large-star and small-star rounds: every node hangs under the least node it sees, so the
    number of rounds grows with the logarithm of the longest chain, and no round gathers a
    component in one task. A round is written once and the one before it deleted; the
    rounds end when the digest of the links stays as it is.
    """
    a, b = F.col(src), F.col(dst)
    links = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "components")
    seen = _mark(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("root"))
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo")).filter("hi <> lo").distinct()
        down = large.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        low = down.groupBy("hi").agg(F.min("lo").alias("root"))
        under = down.join(low, "hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo")).unionByName(low.select("hi", F.col("root").alias("lo")))
        after = cut(under.filter("hi <> lo").distinct(), "components")
        now = _mark(after)
        forget(links)
        links = after
        if now == seen:
            break
        seen = now
    own = links.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(own).groupBy("node").agg(F.min("component").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at either end; a self loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def representatives(edges: DataFrame, weight: str, k: int) -> DataFrame:
    """Up to k edges: the heaviest of each component first, then the rest by weight."""
    parts = components(edges)
    of = edges.join(parts, edges["src"] == parts["node"]).drop("node")
    order = [F.desc(weight), F.col("src"), F.col("dst")]
    first = F.row_number().over(Window.partitionBy("component").orderBy(*order))
    return of.withColumn("_lead", (first > 1).cast("int")).orderBy("_lead", *order).limit(k).select("src", "dst", weight, "component")
