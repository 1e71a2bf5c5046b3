"""Containment at size: nothing that grows with the data is broadcast, and only what may still be needed is looked for."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from strandweave.operators import evidence, metadata
from strandweave.operators.containment import containing


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("HashedRelationBroadcastMode")


def test_small_looking_files_are_not_broadcast(spark, tmp_path):
    """Files of a few KB whose windows are many: by their size on disk the optimizer would broadcast them."""
    spark.range(200).select("id", F.concat(F.lit("company limited of "), F.sha2(F.col("id").cast("string"), 256)).alias("h")).write.parquet(f"{tmp_path}/h")
    spark.range(200).select(F.col("id").alias("j"), F.concat(F.lit("limited of "), F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(20))).alias("p")).write.parquet(f"{tmp_path}/p")
    got = containing(spark.read.parquet(f"{tmp_path}/h"), "h", spark.read.parquet(f"{tmp_path}/p"), "p")
    assert broadcasts(got) == 0
    assert sorted((r.id, r.j) for r in got.collect()) == [(k, k) for k in range(200)]


def test_within_repeats_and_collisions_of_width(spark):
    h = spark.createDataFrame([("k", 1, "aaaa"), ("k", 2, "aaaa"), ("z", 3, "aaaa"), (None, 4, "aaaa"), ("k", 5, "b")], "hk string, i int, h string")
    p = spark.createDataFrame([("k", 1, "aa"), ("k", 2, "aa"), ("k", 3, "a"), (None, 4, "a"), ("z", 5, "b"), ("k", 6, "aaaa")], "pk string, j int, p string")
    got = sorted((r.i, r.j) for r in containing(h, "h", p, "p", within=(("hk", "pk"),)).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 6), (2, 1), (2, 2), (2, 3), (2, 6)]
    assert containing(h, "h", p.limit(0), "p").count() == 0 and containing(h.limit(0), "h", p, "p").count() == 0


@pytest.mark.parametrize("name", ["entity_cascade", "title_matches"])
def test_queries_broadcast_nothing(spark, sf, name):
    assert broadcasts(driver.queries()[name](spark, sf)) == 0


def test_resolver_works_families_out_once(spark, sf):
    """Instruments are written before they are joined, so no later plan carries the expression of a family again."""
    plan = driver.queries()["question_contexts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "regexp" not in plan


def test_cascade_takes_the_first_step_that_knows_a_name(spark):
    e = spark.createDataFrame([("e1", "ann lee", "ann lee", ["boss"]), ("e2", "ann", "ann", None), ("e3", "bob boss", "bob boss", []), ("e4", "bob  boss", "bob  boss", ["aide", None])], "id string, canon string, shown string, aliases array<string>")
    asked = spark.createDataFrame([(x,) for x in ("ann", "ann lee", "boss", "aide", "lee", "nobody")], "asked string")
    got = {r.asked: (r.step, r.id) for r in metadata.resolve(asked, "asked", e, "id", "canon", "shown", "aliases").collect()}
    assert got == {"ann": (1, "e2"), "ann lee": (1, "e1"), "boss": (2, "e3"), "aide": (3, "e4"), "lee": (2, "e1")}


def test_titles_shorter_than_a_window(spark):
    refs = spark.createDataFrame([("k", "Act", None, None), ("k", "The Pier Act", None, None), ("z", "Act", None, None)], "kb string, t string, n string, d date")
    inst = spark.createDataFrame([("k", "Pier", None, None, "1"), ("k", "Lighthouse Act", None, None, "2"), (None, "Act", None, None, "3")], "kb string, t string, n string, d date, id string")
    got = evidence.title_match(refs, inst, "kb", "t", "n", "t", "n", "d", "id")
    assert {(r.kb, r.t): (r.match, r.score) for r in got.collect()} == {("k", "Act"): ("2", 50), ("k", "The Pier Act"): ("1", 50), ("z", "Act"): (None, None)}
