"""Operators on small tables: nulls, ties, repeats and empty inputs included."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandweave.operators import graph, metadata, observe, registry, retrieval
from strandweave.plans import planner
from strandweave.sources import documents as docs
from strandweave.streaming import flows


def day(s):
    return datetime.date.fromisoformat(s)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "channel string, channel_ord int, rank int, doc_id string, chunk_id string, relevance double")


def test_fusion_adds_reciprocal_ranks_and_keeps_chunks_apart(spark):
    r = ranked(spark, [("v", 0, 1, "a", "1", 0.9), ("v", 0, 2, "b", "1", 0.8), ("k", 1, 1, "a", "1", 1.0), ("k", 1, 2, "a", "2", 0.5)])
    got = {(x.doc_id, x.chunk_id): x for x in retrieval.fuse(r).collect()}
    assert got["a", "1"].score == round(2 / 61, 6) and got["a", "1"].channel == "k" and got["b", "1"].score == got["a", "2"].score == round(1 / 62, 6)
    assert [x.doc_id + x.chunk_id for x in retrieval.cite(retrieval.fuse(r), 3).orderBy("position").collect()] == ["a1", "b1", "a2"]


def test_fusion_weights(spark):
    r = ranked(spark, [("v", 0, 1, "old", "1", 0.9), ("k", 1, 1, "new", "1", 0.9)])
    m = spark.createDataFrame([("old", 90, "repealed", day("2000-01-01")), ("new", 90, "in_force", day("2020-01-01"))], "doc_id string, authority_level int, status string, effective_from date")
    plain = {x.doc_id: x.score for x in retrieval.fuse(r, m).collect()}
    assert plain["old"] == plain["new"] == round(1 / 61, 6)
    raised = {x.doc_id: x.score for x in retrieval.fuse(r, m, 0.5, 0.3, 0.2).collect()}
    assert raised["new"] == round((1 / 61) * (1 + 0.45 + 0.3 + 0.2), 6) and raised["old"] == round((1 / 61) * (1 + 0.45 + 0.03), 6)


@pytest.mark.parametrize(("current", "want"), [(["z"], ["d0", "d1", "d2", "d3", "z"]), (["d1"], ["d0", "d1", "d2", "d3", "d4"]), ([f"d{i}" for i in range(10, 18)], [f"d{i}" for i in range(10, 15)]), (["none"], ["d0", "d1", "d2", "d3", "d4"])])
def test_current_versions_have_a_place(spark, current, want):
    rows = [("v", 0, i + 1, f"d{i}", "1", 0.5) for i in range(20)] + [("v", 0, 21, "z", "1", 0.1)]
    got = retrieval.guarantee_current(retrieval.fuse(ranked(spark, rows)), spark.createDataFrame([(c,) for c in current], "doc_id string"), 5)
    assert [r.doc_id for r in got.orderBy("place").collect()] == want


def test_channels(spark):
    c = spark.createDataFrame([(1, 1, "The quick fox", [1.0, 0.0]), (2, 1, "quick quick", [0.0, 1.0]), (3, 1, None, None), (4, 1, "", [0.0, 0.0])], "doc_id int, chunk_id int, content string, v array<float>")
    assert [(r.doc_id, r.relevance) for r in retrieval.vector_channel(c, "v", [1.0, 0.0], 5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    assert [r.doc_id for r in retrieval.keyword_channel(c, "content", "quick fox", 5).collect()] == [1]
    assert [r.doc_id for r in retrieval.keyword_channel(c, "content", "quick zebra", 5).orderBy("rank").collect()] == [2, 1]
    assert retrieval.keyword_channel(c, "content", "a ?", 5).count() == 0
    assert [r.doc_id for r in retrieval.exact_channel(c, "content", "QUICK", 1).collect()] == [1]


def test_division_windows_and_search_text(spark):
    v = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "a", "x"), (3, "b", None)], "d int, k string, v string")
    assert [r.d for r in metadata.having_all(v, "d", "k", "v", {"a": "x", "b": "y"}).collect()] == [1]
    assert metadata.having_all(v, "d", "k", "v", {}).count() == 3
    assert {r.d: r.search_text for r in metadata.search_text(v, "d", "k", "v").collect()} == {1: "x y", 2: "x x"}
    p = spark.createDataFrame([(1, day("2020-01-01")), (2, day("2020-02-01")), (3, None)], "d int, p date")
    assert [r.d for r in metadata.published_between(p, "p", "2020-01-01", "2020-02-01").collect()] == [1]


def inst(*rows):
    return [tuple([i, fam, st, src, day(f) if f else None, day(t) if t else None, y, v]) for i, fam, st, src, f, t, y, v in rows]


SCHEMA = "id string, family string, status string, status_source string, effective_from date, effective_to date, enacted_year int, version string"


def test_status_resolver(spark):
    i = spark.createDataFrame(inst(
        ("future", None, "x", "resolver", "2030-01-01", None, None, None), ("plain", None, "x", "resolver", "2000-01-01", None, None, None), ("undated", None, "x", "resolver", None, None, None, None),
        ("gone", None, "x", "resolver", "2000-01-01", None, None, None), ("hand", None, "kept", "manual", "2000-01-01", None, None, None), ("part", None, "x", "resolver", "2000-01-01", None, None, None),
        ("old", "f", "x", "resolver", "1990-01-01", None, None, None), ("new", "f", "x", "resolver", "2010-01-01", None, None, None), ("later", "f", "x", "resolver", "2031-01-01", None, None, None), ("edit", "f", "x", "resolver", "2005-01-01", None, None, "2"),
        ("am", None, "x", "resolver", "2000-01-01", None, None, None),
    ), SCHEMA)
    r = spark.createDataFrame([("new", "gone", "REPEALS", None, "verified"), ("new", "gone", "AMENDS", None, "verified"), ("new", "hand", "REPEALS", None, "verified"), ("new", "part", "REPEALS", "5", "verified"), ("new", "plain", "REPEALS", None, "suggested"), ("new", "am", "AMENDS", None, "verified")], "src string, dst string, relation string, target_provision string, review_status string")
    got = {x.id: (x.resolved_status, str(x.resolved_to) if x.resolved_to else None) for x in registry.resolve_status(i, r, "2020-01-01").collect()}
    assert got == {
        "future": ("not_yet_effective", None), "plain": ("in_force", None), "undated": ("unknown", None), "gone": ("repealed", "2010-01-01"), "hand": ("kept", "2010-01-01"), "part": ("in_force", None),
        "old": ("superseded", "2010-01-01"), "new": ("in_force", None), "later": ("not_yet_effective", None), "edit": ("in_force", None), "am": ("amended", None),
    }


def test_as_of_join_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    left = [(i, rng.choice("ab"), day("2020-01-01") + datetime.timedelta(rng.randrange(200))) for i in range(60)] + [(60, "a", None), (61, "z", day("2020-03-01")), (62, None, day("2020-03-01"))]
    right = [(rng.choice("abc"), day("2020-01-15") + datetime.timedelta(rng.randrange(150)), i) for i in range(30)] + [("a", None, 99)]
    got = registry.as_of(spark.createDataFrame(left, "id int, k string, d date"), spark.createDataFrame(right, "k string, e date, v int"), "k", "d", "e", "v").collect()
    want = {i: max(((e, v) for k2, e, v in right if k2 == k and e and d and e <= d), default=(None, None)) for i, k, d in left}
    assert {r.id: (r.as_of_day, r.v) for r in got} == want


def test_filters_conflicts_and_sole(spark):
    t = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("h", 3, None), ("h", 4, False)], "g string, i int, ok boolean")
    assert sorted(r.i for r in registry.filter_or_keep(t, F.col("ok"), "g").collect()) == [1, 3, 4]
    assert registry.sole(t).count() == 0 and registry.sole(t.filter("i = 1")).count() == 1 and registry.sole(t.limit(0)).count() == 0


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", "a"), ("b", "a"), ("a", "b")]


def test_walks_impact_components_degrees(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    seen = {(r.start, r.node): r.distance for r in graph.reach(e, spark.createDataFrame([("a",), ("x",)], "node string"), 3).collect()}
    assert seen == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("x", "x"): 0, ("x", "y"): 1}
    assert {r.node: (r.distance, r.path, r.direct) for r in graph.impact(e, "a", 2).collect()} == {"b": (1, "a > b", True), "c": (2, "a > b > c", False)}
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "x": "x", "y": "x"}
    assert graph.components(e.limit(0)).count() == 0 and graph.impact(e, "nobody", 2).count() == 0
    assert {r.node: r.degree for r in graph.degrees(e).collect()}["a"] == 5


def test_admission_remembers_only_what_it_let_in(spark):
    base = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([("u", base + datetime.timedelta(seconds=s)) for s in (0, 10, 20, 59, 61, 62, 130)] + [("v", base)], "u string, ts timestamp")
    assert {r.u: (r.offered, r.admitted) for r in observe.admitted(e, "u", "ts", 60, 2).collect()} == {"u": (7, 4), "v": (1, 1)}


def test_admission_holds_over_midnight(spark):
    late = datetime.datetime(2024, 1, 1, 23, 58)
    e = spark.createDataFrame([("u", late + datetime.timedelta(seconds=s)) for s in (0, 60, 130, 200, 301, 302, 601, 602, 603)] + [("w", None)], "u string, ts timestamp")
    assert {r.u: (r.offered, r.admitted) for r in observe.admitted(e, "u", "ts", 300, 2).collect()} == {"u": (9, 5), "w": (0, 0)}


def test_span_offsets(spark):
    s = spark.createDataFrame([("r", 1, 0, 10), ("r", 2, None, 5), ("r", 3, 30, None), ("r", 4, None, 1), ("q", 1, None, None)], "run string, n int, off int, dur int")
    assert [(r.run, r.n, r.start_at) for r in observe.span_offsets(s, "run", "n", "off", "dur").orderBy("run", "n").collect()] == [("q", 1, 0), ("r", 1, 0), ("r", 2, 10), ("r", 3, 30), ("r", 4, 30)]


@pytest.mark.parametrize(("question", "intent"), [
    ("What does LAW-2566-043 say?", "document_exact"), ("Impact if APP-01 stops", "impact_analysis"), ("ข่าวเดือนมิถุนายน 2026", "news_by_date"), ("ภาพรวมความสัมพันธ์ของหน่วยงาน", "graph_global"), ("สาเหตุของความล่าช้า", "semantic_global"),
    ("How does APP-01 connect to DB-01?", "relationship_local"), ("section 15 of the act", "legal_provision"), ("How to apply for VPN", "how_to"), ("Tell me about APP-01", "entity_lookup"), ("Who is responsible?", "semantic_hybrid"),
])
def test_intents(spark, question, intent):
    row = planner.plan(spark.createDataFrame([(question,)], "q string"), "q", planner.Policy(enable_lightrag=False)).first()
    assert row.intent == intent and row.channels == [c for c in planner.CHANNELS[intent][0] if c != "external"]
    assert row.ambiguous == (intent == "semantic_hybrid") and planner.Policy().allows("external")
    if intent == "news_by_date":
        assert (str(row.published_from), str(row.published_to)) == ("2026-06-01", "2026-07-01")


def test_policies_meet_and_clamp():
    p = planner.meet([planner.Policy(enable_graph=False, maximum_top_k=20, retrieval_mode="recall"), planner.Policy(enable_vector=False, default_top_k=5)])
    assert (p.enable_graph, p.enable_vector, p.maximum_top_k, p.default_top_k, p.retrieval_mode) == (False, False, 20, 5, "recall") and planner.meet([]) == planner.Policy()
    assert planner.Policy.parse({"maximum_top_k": "many"}) == planner.Policy() and planner.Policy.parse({"maximum_top_k": 500, "enable_graph": False}) == planner.Policy() and planner.Policy.parse({"maximum_top_k": 20}).maximum_top_k == 20
    got = planner.clamp({"channels": ["graph", "external"], "max_sources": 99, "graph_depth": 9}, {"intent": "x"}, planner.Policy(enable_lightrag=False), "ที่ดินชายน้ำ")
    assert got["channels"] == ["graph", "vector"] and got["max_sources"] == 12 and got["graph_depth"] == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Fish &amp; <b>chips</b></p><script>x</script><p>second</p>")
    (tmp_path / "b.xls").write_text("<table><tr><th>a</th><td> b </td></tr><tr><td>1</td></tr></table>")
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.exe").write_text("no")
    (tmp_path / "f.md").write_text("  ")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in docs.extracted(docs.files(spark, str(tmp_path))).collect()}
    assert got == {"a.html": ("Fish & chips\nsecond", None), "b.xls": ("a | b\n1", None), "c.txt": ("plain", None), "d.pdf": (None, "CONVERTER_REQUIRED"), "f.md": (None, "EMPTY_TEXT")}
    docs.store_results(spark.createDataFrame([(1,)], "i int"), str(tmp_path / "r"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert docs.stored_results(spark, str(tmp_path / "r"), F.lit("2024-01-01 00:29:00").cast("timestamp")).count() == 1
    assert docs.stored_results(spark, str(tmp_path / "r"), F.lit("2024-01-01 00:31:00").cast("timestamp")).count() == 0


def test_streams_deliver_the_latest_once(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    for n in range(3):
        spark.createDataFrame([("k1", n, now), (f"k{n}", n * 10, now)], "key string, v int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.file_stream(spark, str(tmp_path / "in"))
    flows.deliver(stream, str(tmp_path / "out"), "key", "v").awaitTermination()
    got = {r.key: r.v for r in flows.delivered(spark, str(tmp_path / "out"), "key", "v").collect()}
    assert got == {"k0": 0, "k1": 10, "k2": 20}
