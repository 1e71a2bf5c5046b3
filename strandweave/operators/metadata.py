"""Filters and counts over documents and their metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name


#: The shape of a number; other digits and signs nobody sees do not fit.
NUMBER = r"\A[+-]?[0-9]+(?:[.][0-9]+)?\z"


def published_between(df: DataFrame, day: str, start: str | None, end: str | None) -> DataFrame:
    """Half-open window; an undated row never passes a window. Both ends reach the scan."""
    if start:
        df = df.filter(F.col(day) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(day) < F.lit(end).cast("date"))
    return df


def having_all(values: DataFrame, key: str, field: str, value: str, wanted: dict[str, str]) -> DataFrame:
    """Keys for which every wanted field has its value: relational division in one aggregate. An empty wish passes every key."""
    if not wanted:
        return values.select(key).distinct()
    pairs = reduce(lambda a, b: a | b, [(F.col(field) == k) & (F.col(value) == v) for k, v in wanted.items()])
    return values.filter(pairs).groupBy(key).agg(F.countDistinct(field).alias("_n")).filter(F.col("_n") == len(wanted)).select(key)


def latest_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the rank limit is pushed into the partial sort."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def inventory(df: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, key, n): counts by each dimension in one pass; nulls are not counted but for the first dimension."""
    sets = df.select(*dimensions).groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    marked = sets.agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dimensions)])
    name = reduce(lambda acc, x: acc.when(F.col(f"_g{x[0]}") == 0, x[1]), enumerate(dimensions), F.when(F.lit(False), ""))
    key = reduce(lambda acc, x: acc.when(F.col(f"_g{x[0]}") == 0, F.col(x[1]).cast("string")), enumerate(dimensions), F.when(F.lit(False), ""))
    out = marked.select(name.alias("dimension"), key.alias("key"), "n")
    return out.filter(F.col("key").isNotNull() | (F.col("dimension") == dimensions[0]))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Offset paging; ``order`` must be total."""
    return df.orderBy(*order).offset(number * size).limit(size)


def after(df: DataFrame, cursor: Column, last: Column, size: int, *order: Column) -> DataFrame:
    """Keyset paging: strictly before the cursor, one row more than asked to tell whether there are more."""
    return df.filter(cursor < last).orderBy(*order).limit(size + 1)


def search_text(pairs: DataFrame, key: str, order: str, value: str, most: int = 10_000) -> DataFrame:
    """(key, search_text): the values of a key joined in field order, cut at ``most`` signs."""
    rows = pairs.filter(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_v"))
    return rows.select(key, F.left(F.array_join(F.transform("_v", lambda x: x[value]), " "), F.lit(most)).alias("search_text"))


def checked(value: Column, kind: Column) -> Column:
    """A metadata value by its kind, or null where it does not fit: text, number (ASCII digits with a sign and decimals at most), date, boolean."""
    number = F.when(value.rlike(NUMBER), value)
    day = F.try_to_date(value, "yyyy-MM-dd").cast("string")
    yes = F.lower(F.trim(value))
    flag = F.when(yes.isin("true", "yes", "1", "on"), "true").when(yes.isin("false", "no", "0", "off"), "false")
    return F.when(kind == "number", number).when(kind == "date", day).when(kind == "boolean", flag).otherwise(value)


def resolve(asked: DataFrame, name: str, entities: DataFrame, key: str, canon: str, shown: str, aliases: str) -> DataFrame:
    """(name, step, key): what each name asked for resolves to: 1 the same canonical name, 2 a shown name that contains it, 3 an alias; the least key within a step.

    Names no step knows have no row. Containment is met by windows, never all with all, and
    only for names the first step does not know. Sides are merged: neither has a bound that
    would let it be broadcast.
    """
    from .containment import containing

    same = asked.hint("merge").join(entities, F.col(name) == F.col(canon)).select(name, F.lit(1).alias("step"), key)
    rest = asked.hint("merge").join(entities.select(F.col(canon).alias("_known")), F.col(name) == F.col("_known"), "left_anti")
    held = containing(entities.select(key, shown), shown, rest, name, widths=(6, 3, 2, 1)).select(name, F.lit(2).alias("step"), key)
    other = entities.select(key, F.explode(aliases).alias("_a")).select(key, canonical_name(F.col("_a")).alias("_a"))
    alias = rest.hint("merge").join(other, F.col(name) == F.col("_a")).select(name, F.lit(3).alias("step"), key)
    best = same.unionByName(held).unionByName(alias).groupBy(name).agg(F.min(F.struct("step", key)).alias("_m"))
    return best.select(name, "_m.step", f"_m.{key}")
