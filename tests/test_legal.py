"""Resolver, provisions, answers, graph writes and containment on small tables."""

import datetime

from pyspark.sql import functions as F

from strandweave.operators import answers, graph, graphviews, provisions, registry, resolver
from strandweave.operators.containment import containing


def day(s):
    return datetime.date.fromisoformat(s) if s else None


def test_containment_equals_all_with_all(spark):
    holders = ["the quick brown fox jumps over", "", None, "ab", "กขคงจฉชซฌญฎฏฐฑฒณดต", "x" * 3000 + "needle in a long text" + "y" * 3000]
    parts = ["quick brown", "b", "", None, "ขคงจฉชซฌญฎฏฐฑฒณด", "needle in a long text", "absent", "ab"]
    h = spark.createDataFrame(list(enumerate(holders)), "i int, h string")
    p = spark.createDataFrame(list(enumerate(parts)), "j int, p string")
    got = sorted((r.i, r.j) for r in containing(h, "h", p, "p").collect())
    assert got == [(i, j) for i, a in enumerate(holders) for j, b in enumerate(parts) if a and b and b in a]


INSTRUMENTS = [
    # id, doc, family, number, version, class, role, status, from, to
    ("act", 1, "พระราชบัญญัติที่ดิน", None, None, "main", "main", "superseded", "1998-01-01", "2019-01-01"),
    ("code", 2, "ประมวลกฎหมายภาษี", "12/2560", None, "consolidated", "latest_consolidated", "in_force", "2019-01-01", None),
    ("old code", 3, "ประมวลกฎหมายภาษี", None, None, "consolidated", "consolidated", "repealed", "2001-01-01", "2010-01-01"),
    ("amends", 4, "พระราชบัญญัติที่ดิน", "2/2562", "2", "amendment", "amendment", "in_force", "2019-01-01", None),
    ("loose", 5, None, None, None, "main", "main", "unknown", None, None),
]


def registry_of(spark):
    rows = [(a, b, c, c, d, e, f, g, h, day(i), day(j)) for a, b, c, d, e, f, g, h, i, j in INSTRUMENTS]
    return spark.createDataFrame(rows, "instrument_id string, doc_id int, family string, base_title string, official_number string, version string, document_class string, version_role string, status string, effective_from date, effective_to date")


def test_resolver(spark):
    asked = [("family", "มาตรา 5 ของภาษี", "2020-01-01"), ("number", "ประกาศ 2/2562 ว่าอย่างไร", "2020-01-01"), ("plain", "an unrelated question", "2020-01-01"), ("past", "an unrelated question", "2005-01-01"), ("bare", "มาตรา 5", "2020-01-01")]
    q = spark.createDataFrame([(a, b, day(c), False) for a, b, c in asked], "q string, question string, as_of date, historical boolean")
    p = spark.createDataFrame([], "doc_id int, number string")
    rel = spark.createDataFrame([("amends", "act", "AMENDS", "verified"), ("loose", "code", "ISSUED_UNDER", "verified"), ("act", "code", "AMENDS", "suggested")], "src string, dst string, relation string, review_status string")
    roles, flags = resolver.resolve(q, registry_of(spark), p, rel)
    got = {}
    for r in roles.collect():
        got.setdefault((r.q, r.role), set()).add(r.doc_id)
    assert got["family", "preferred"] == {2} and got["family", "current"] == {2, 5} and got["family", "excluded"] == {3}
    assert got["number", "matched"] == {4} and ("number", "excluded") not in got
    assert got["plain", "excluded"] == {1, 3} and ("plain", "matched") not in got
    assert got["past", "excluded"] == {2, 4}
    assert got["bare", "preferred"] == {2}
    assert not any(r.ambiguous for r in flags.collect()) and flags.count() == 5


def test_two_current_editions_are_ambiguous(spark):
    twice = registry_of(spark).unionByName(registry_of(spark).filter("instrument_id = 'code'").withColumn("instrument_id", F.lit("code b")).withColumn("doc_id", F.lit(9)))
    q = spark.createDataFrame([("f", "ภาษี มาตรา 1", day("2020-01-01"), False)], "q string, question string, as_of date, historical boolean")
    none = spark.createDataFrame([], "src string, dst string, relation string, review_status string")
    roles, flags = resolver.resolve(q, twice, spark.createDataFrame([], "doc_id int, number string"), none)
    assert flags.first().ambiguous and {r.doc_id for r in roles.filter("role = 'candidate'").collect()} == {2, 9} and roles.filter("role = 'matched'").count() == 0


def evidence_of(spark, rows):
    return spark.createDataFrame(rows, "q int, position int, doc_id int, instrument_id string, family string, section_kind string, section_number string, status string, current boolean")


def test_conflicts_by_each_precedence(spark):
    rel = spark.createDataFrame([("a", "AMENDS", "5", "verified"), ("c", "REPEALS", "7", "verified"), ("e", "AMENDS", "1", "suggested")], "dst string, relation string, target_provision string, review_status string")
    rows = [
        (1, 1, 1, "a", "f", "มาตรา", "5", "in_force", True), (1, 2, 2, "b", "f", "มาตรา", "5", "in_force", False),  # the amended one goes
        (2, 1, 1, "x", "f", "มาตรา", "6", "in_force", False), (2, 2, 2, "y", "f", "มาตรา", "6", "in_force", True),  # the current one stays
        (3, 1, 1, "x", "f", "มาตรา", "8", "unknown", False), (3, 2, 2, "y", "f", "มาตรา", "8", "in_force", False),  # nobody can tell
        (4, 1, 3, "c", "g", "มาตรา", "7", "in_force", True), (4, 2, 3, "c", "g", "มาตรา", "7", "in_force", True),  # one document is no conflict
        (5, 1, 1, "n", None, None, None, None, None),
    ]
    stays, warnings = provisions.version_conflicts(evidence_of(spark, rows), rel, ["q"])
    assert sorted((r.q, r.position) for r in stays.collect()) == [(1, 2), (2, 2), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1)]
    assert sorted((r.q, r.position, r.code) for r in warnings.collect()) == [(1, 1, "SUPERSEDED_VERSION_REMOVED"), (2, 1, "SUPERSEDED_VERSION_REMOVED"), (3, 1, "UNVERIFIED_VALIDITY"), (4, 1, "PROVISION_REPEALED"), (4, 2, "PROVISION_REPEALED")]
    stays, warnings = provisions.version_conflicts(evidence_of(spark, rows), rel, ["q"], resolved=False, historical=True)
    assert stays.count() == len(rows) and warnings.filter("code = 'SUPERSEDED_VERSION_PRESENT'").count() == 3
    assert provisions.version_conflicts(evidence_of(spark, []), rel, ["q"])[0].count() == 0


def test_as_of_falls_back_to_any(spark):
    left = spark.createDataFrame([(1, "k", day("2000-01-01")), (2, "k", day("2010-01-01")), (3, "none", day("2010-01-01"))], "i int, k string, d date")
    right = spark.createDataFrame([("k", day("2005-01-01"), "a"), ("k", day("2008-01-01"), "b"), ("k", None, "c")], "k string, e date, v string")
    assert {r.i: r.v for r in registry.as_of_or_any(left, right, "k", "d", "e", "v").collect()} == {1: "a", 2: "b", 3: None}


def test_gate_rerank_and_filters(spark):
    e = spark.createDataFrame([("a", 1, "S1", 10), ("a", 2, "S2", 11), ("b", 1, "S1", 12), ("c", 1, "S1", 13)], "q string, position int, citation_id string, doc_id int")
    a = spark.createDataFrame([("a", "see [S2]"), ("b", "see [S1] and [S9]"), ("c", "nothing"), ("d", None)], "q string, answer string")
    said, kept = answers.narrowed(a, e)
    assert {r.q: r.action for r in said.collect()} == {"a": "NARROW", "b": "DROP_ANSWER_NARROW", "c": "DROP_ANSWER", "d": "NONE"}
    assert sorted((r.q, r.citation_id) for r in kept.collect()) == [("a", "S2"), ("b", "S1"), ("c", "S1")]
    s = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("a", 7, 1.0)], "q string, index int, relevance double")
    assert [(r.q, r.place, r.doc_id) for r in answers.reranked(e, s, 5).orderBy("q", "place").collect()] == [("a", 1, 11), ("a", 2, 10), ("b", 1, 12), ("c", 1, 13)]
    roles = spark.createDataFrame([("a", 10, "excluded"), ("b", 99, "preferred")], "q string, doc_id int, role string")
    assert sorted((r.q, r.doc_id) for r in answers.permitted(e, roles).collect()) == [("a", 11), ("c", 13)]
    lines = answers.composed(e.withColumn("title", F.lit("T")).withColumn("section_label", F.lit(None).cast("string")).withColumn("uri", F.lit("u"))).filter("q = 'a'").first()
    assert lines.citations == "[S1] [S2]" and lines.details == "[S1] T — u\n[S2] T — u"


def test_shortcuts_and_fields(spark):
    cases = {"มีเอกสารกี่ฉบับ": "inventory", "ฉบับล่าสุดคือฉบับใด": "metadata", "มาตรา 5 ถูกแก้ไขโดยใคร": "provenance", "มาตรา 9": "current_provision", "ฎีกาว่าอย่างไร": "court_gap", "what is a fee": None, None: None, "กฎหมายเริ่มใช้บังคับเมื่อใด": "commencement"}
    q = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.s for r in q.select("i", answers.shortcut(F.col("t")).alias("s")).orderBy("i").collect()] == list(cases.values())
    f = spark.createDataFrame([([("a", "A"), ("b", "B")], [("b", "mine"), ("c", "C"), (None, "x"), ("c", "D")])], "d array<struct<key:string,label:string>>, o array<struct<key:string,label:string>>")
    assert [(x.key, x.label) for x in f.select(answers.merged_fields(F.col("d"), F.col("o")).alias("m")).first().m] == [("a", "A"), ("b", "mine"), ("c", "D")]
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([1.0, float("nan")],)], "v array<float>")
    assert [r.f for r in v.select(answers.vector_fault(F.col("v"), 2).alias("f")).collect()] == [None, "WRONG_SIZE", "MISSING", "NOT_A_NUMBER"]


def test_graph_writes(spark):
    held = spark.createDataFrame([("k", "generic:a", "T", "A", True, 1), ("k", "generic:b", "T", "B", False, 2)], "base string, identity_key string, entity_type string, name string, deleted boolean, source_count int")
    given = spark.createDataFrame([("k", "generic:a", "T", "a2", 1, "x", 1), ("k", "generic:a", "T", "a3", 1, "x", 2), ("k", "generic:c", "T", "C", None, None, 1)], "base string, identity_key string, entity_type string, name string, doc_id int, excerpt string, at int")
    got = {r.identity_key: (r.name, r.deleted, r.source_count, r.outcome) for r in graphviews.upserted(held, given).collect()}
    assert got == {"generic:a": ("a3", False, 2, "revived"), "generic:b": ("B", False, 2, "untouched"), "generic:c": ("C", False, 0, "created")}
    node = "struct<id:string,name:string,entity_type:string,description:string,file_path:string>"
    g = spark.createDataFrame([("k", [("1", "Ann", None, "d", "kb=k/x"), ("2", "ann", "", None, "kb=k/y"), ("3", "Bob", "Person", None, "kb=k/z"), ("4", "Far", None, None, "kb=other")], [("1", "3", None, "kb=k/x"), ("1", "2", None, "kb=k/x"), ("3", "4", None, "kb=k/x")])], f"base string, nodes array<{node}>, edges array<struct<source:string,target:string,description:string,file_path:string>>")
    ents, edges = graphviews.materialised(g, F.concat(F.lit("kb="), F.col("base"), F.lit("/")))
    assert sorted((r.identity_key, r.entity_type) for r in ents.collect()) == [("generic:ann", "Concept"), ("generic:bob", "Person")]
    assert [(r.source, r.target) for r in edges.collect()] == [("generic:ann|Concept", "generic:bob|Person")]
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert sorted((r.src, r.deleted) for r in graphviews.without_ends(e, spark.createDataFrame([("a",), (None,)], "n string"), "n").collect()) == [("a", True), ("b", False)]
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
