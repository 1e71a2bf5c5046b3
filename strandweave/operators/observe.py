"""Counts and replays over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(df: DataFrame, status: str, **tests: Column) -> DataFrame:
    """One row: the total and one conditional count for each test."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()])


def top_codes(df: DataFrame, code: str, k: int) -> DataFrame:
    """The k most frequent codes that are not null, ties by code."""
    return df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(k)


def request_metrics(df: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """Count, sum and mean of durations by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(seconds), 6).alias("total_seconds"), F.round(F.avg(seconds), 6).alias("mean_seconds"))


def offered_load(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds ``offered``: events of the key in the sliding window that ends at each event."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return df.withColumn("_at", at).withColumn("offered", F.count("*").over(w)).drop("_at")


def _runs(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, _ts): times of a key in order, parted at pauses of at least the window, after which nothing is held."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ordered = Window.partitionBy(key).orderBy("_at")
    pause = F.coalesce(F.col("_at") - F.lag("_at").over(ordered) >= seconds * 1_000_000, F.lit(True))
    runs = df.select(key, at.alias("_at")).withColumn("_new", pause.cast("long")).withColumn("_run", F.sum("_new").over(ordered))
    return runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list("_at")).alias("_ts"))


def admitted(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """(key, offered, admitted): a sliding limit in which only admitted events count.

    An ordered fold over the times of a key that remembers at most ``limit`` admitted
    times. A key is parted only at pauses of at least the window; what lies between two
    such pauses is one group, however long it is.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("held"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, t: Column) -> Column:
        live = F.filter(acc["held"], lambda x: x > t - seconds * 1_000_000)
        return F.when(F.size(live) < limit, F.struct(F.array_append(live, t).alias("held"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(live.alias("held"), acc["n"].alias("n")))

    folded = _runs(df, key, ts, seconds).select(key, F.size("_ts").alias("_o"), F.aggregate("_ts", start, step, lambda acc: acc["n"]).alias("_a"))
    return folded.groupBy(key).agg(F.sum("_o").alias("offered"), F.sum("_a").alias("admitted"))


def admitted_anchored(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """(key, offered, admitted): a limit by windows that open at their first event; rejected events count within them too."""
    start = F.struct(F.lit(None).cast("bigint").alias("anchor"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, t: Column) -> Column:
        inside = F.coalesce(t - acc["anchor"] < seconds * 1_000_000, F.lit(False))
        count = F.when(inside, acc["c"] + 1).otherwise(1)
        return F.struct(F.when(inside, acc["anchor"]).otherwise(t).alias("anchor"), count.cast("long").alias("c"), (acc["n"] + (count <= limit).cast("long")).alias("n"))

    folded = _runs(df, key, ts, seconds).select(key, F.size("_ts").alias("_o"), F.aggregate("_ts", start, step, lambda acc: acc["n"]).alias("_a"))
    return folded.groupBy(key).agg(F.sum("_o").alias("offered"), F.sum("_a").alias("admitted"))


def retained(runs: DataFrame, spans: DataFrame, run: str, ts: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Runs not older than a day, and the spans of those runs."""
    keep = runs.filter(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))
    old = runs.filter(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz")).select(run)
    return keep, spans.join(old, run, "left_anti")


def span_offsets(df: DataFrame, run: str, order: str, offset: str, duration: str) -> DataFrame:
    """Adds ``start_at``: a span's offset, or where it has none the latest end before it in its run."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.coalesce(offset, F.lit(0)) + F.coalesce(duration, F.lit(0))).over(before)
    return df.withColumn("start_at", F.coalesce(offset, ends, F.lit(0)))


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with no pause of the gap or more."""
    out = df.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def prometheus(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One exposition line for each row of counts."""
    parts = F.concat_ws(",", *[F.format_string(f'{x}="%s"', F.col(x)) for x in labels])
    return df.select(F.concat(F.lit(name + "{"), parts, F.lit("} "), F.col(value).cast("string")).alias("line"))
