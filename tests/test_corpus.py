"""Headers, change clauses, code pages and the joins around them."""

import datetime

from pyspark.sql import functions as F

from strandweave.functions import corpus
from strandweave.operators import evidence


def one(spark, expr, t):
    return spark.createDataFrame([(t,)], "t string").select(expr.alias("r")).first().r


def test_header(spark):
    t = "ชื่อในผัง: พระราชบัญญัติที่ดิน ฉบับเเก้ไข\nไม่เกี่ยว\nชื่อกฎหมาย: พระราชบัญญัติแก้ไขเพิ่มเติม ที่ดิน (ฉบับที่ ๒) พ.ศ. 2550\nรหัสฉบับ :  A-1 \nวันที่ในผัง: 5 มีนาคม ๒๕๕๐\n" + "x\n" * 40 + "แหล่งข้อมูล: late"
    h = one(spark, corpus.header(F.col("t")), t)
    assert (h.document_class, h.version_role, h.source_reference, h.version_date, h.source_uri) == ("amendment", "amendment", "A-1", datetime.date(2007, 3, 5), None)
    assert (h.work, h.official_number) == ("ที่ดิน", "2")
    empty = one(spark, corpus.header(F.col("t")), None)
    assert (empty.document_class, empty.work, empty.official_title) == ("unknown", None, None)


def test_change_clauses(spark):
    t = (
        "มาตรา ๓ ให้ยกเลิกความในมาตรา ๑๕ แห่งพระราชบัญญัติ และให้ใช้ความต่อไปนี้แทน\n"
        "มาตรา 4 ให้ยกเลิกมาตรา ๑๐๕ มาตรา ๑๐๕ ทวิ และมาตรา ๑๐๖ แห่งพระราชบัญญัติ\n"
        "มาตรา 5 ให้เพิ่มความต่อไปนี้เป็นมาตรา ๙๖ ทวิ และมาตรา ๙๖ ตรี ตามมาตรา 1\n"
        "มาตรา 4 ให้ยกเลิกมาตรา ๑๐๕ แห่งพระราชบัญญัติ\n"
    )
    got = [(e.action, e.provision_number, e.target) for e in one(spark, corpus.change_events(F.col("t")), t)]
    assert got == [("replace", "3", "15"), ("repeal", "4", "105"), ("repeal", "4", "105 ทวิ"), ("repeal", "4", "106"), ("insert", "5", "96 ทวิ"), ("insert", "5", "96 ตรี")]
    assert one(spark, corpus.change_events(F.col("t")), None) == []


def test_code_pages(spark):
    thai = "ประกาศคณะกรรมการที่ดิน" * 3
    got = [r.r for r in spark.createDataFrame([(thai.encode("tis-620").decode("mac_roman"),), (thai,), ("plain",), (None,), ("café",), ("",)], "t string").select(corpus.recovered_layer(F.col("t")).alias("r")).collect()]
    assert got == [thai, None, None, None, None, None]


def test_titles_within_titles_at_any_place(spark):
    refs = spark.createDataFrame([("k", t, None, None) for t in ("Copy: Notification on Ferries and Piers", "Rules for the Lighthouse", "Old Kiln Act", "สำเนา ประกาศเรื่องท่าเรือและประภาคาร", " ", None)], "kb string, t string, n string, d date")
    main = ["notification on ferries and piers", "Annex to the Rules for the Lighthouse (full)", "kiln", "ประกาศเรื่องท่าเรือและประภาคาร", "", None]
    inst = spark.createDataFrame([("k", t, None, None, str(k)) for k, t in enumerate(main)] + [("z", "Rules for the Lighthouse", None, None, "elsewhere")], "kb string, t string, n string, d date, id string")
    got = evidence.title_match(refs, inst, "kb", "t", "n", "t", "n", "d", "id").collect()
    assert [(r.match, r.score) for r in sorted(got, key=lambda r: r.t or "")] == [(None, None), (None, None), ("0", 50), ("2", 50), ("1", 50), ("3", 50)]


def test_joins_around_evidence(spark):
    p = spark.createDataFrame([(1, "มาตรา ๙ ทวิ".replace("๙", "9")), (1, "7"), (2, None)], "d int, n string")
    c = spark.createDataFrame([(1, "9/1", 10), (1, "9/1", 11), (2, "7", 12), (1, None, 13)], "d int, n2 string, c int")
    assert {(r.d, r.n): r.chunk_ids for r in evidence.provision_chunks(p, c, "d", "n", "n2", "c").collect()} == {(1, "มาตรา 9 ทวิ"): [10, 11], (1, "7"): None, (2, None): None}
    refs = spark.createDataFrame([("k", "Act on Tides", "5", datetime.date(2000, 1, 1)), ("k", "Nothing", None, None)], "kb string, t string, n string, d date")
    inst = spark.createDataFrame([("k", "Act on Tides and Canals", "9", datetime.date(1990, 1, 1), "by title"), ("k", "Other", "5", datetime.date(2010, 1, 1), "by number"), ("z", "Act on Tides", "5", None, "elsewhere")], "kb string, t string, n string, d date, id string")
    got = evidence.title_match(refs, inst, "kb", "t", "n", "t", "n", "d", "id", F.col("d")).collect()
    assert {r.t: (r.match, r.score) for r in got} == {"Act on Tides": ("by number", 80), "Nothing": (None, None)}
    left = spark.createDataFrame([(1,), (2,)], "k int")
    log = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (1, 5, "c"), (None, 1, "x")], "k int, at int, v string")
    assert {r.k: r.v for r in evidence.with_latest(left, log, "k", [F.desc("at"), F.desc("v")], "v").collect()} == {1: "c", 2: None}
    assert {r.k: r.v for r in evidence.with_oldest(left, log, "k", "at", "v").collect()} == {1: "a", 2: None}
    assert evidence.lexical_rank(spark.createDataFrame([("a fox",)], "t string"), "t", "a ?").count() == 0
