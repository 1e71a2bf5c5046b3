from pyspark.sql import functions as F

from strandweave.llm import namelinks as N


def link(spark, names, person):
    df = spark.createDataFrame([(str(i), n, person) for i, n in enumerate(names)], "id string, name string, person boolean").withColumn("tab", F.lit("x"))
    got = N.classes(df, "id", "name", F.col("person"), "tab").collect()
    return {int(r.id): r.cluster for r in got}


def test_persons(spark):
    same = ["Patricia Ganinali", "Ganinali, Patricia", "Pat Ganinali", "P. Ganinali", "GANINALI Patricia", "Patricai Ganinali", "Ms Patricia C. Ganinali", "Patricia Ganiali"]
    other = ["Gregory Ganinali", "Patricia Lasevoki", None, "", "Kenneth Zibedudu", "Kimberley Zibedudu", "K. Zibedudu"]
    c = link(spark, same + other, True)
    assert len({c[i] for i in range(8)}) == 1
    assert len({c[0], c[8], c[9], c[12], c[13], c[14]}) == 6 and 10 not in c and 11 not in c


def test_thai_persons_and_bodies(spark):
    c = link(spark, ["ขจร ธนโชคญาดี", "นางสาวขจร ธนโชคญาดี", "ธนโชคญาดี, ขจร", "ขจรธนโชคญาดี", "ภาสกร ธนโชคญาดี", "ขจร ทนโชคยาดี"], True)
    assert len({c[i] for i in (0, 1, 2, 3, 5)}) == 1 and c[4] != c[0]
    b = link(spark, ["บริษัท ระสุขไพรดี น้ำตาล จำกัด", "บ. ระสุขไพรดี น้ำตาล จก.", "ระสุขไพรดี น้ำตาล (บริษัท)", "บมจ. ระสุขไพรดี น้ำตาล", "สมาคมน้ำตาล ระสุขไพรดี", "กระทรวงที่ดินชายน้ำ", "กท. ที่ดินชายน้ำ", "กรมที่ดินชายน้ำ"], False)
    assert len({b[i] for i in range(4)}) == 1 and b[4] != b[0] and b[5] == b[6] != b[7]


def test_bodies(spark):
    same = ["Authority of Estuary Dredging", "AUTHORITY OF ESTUARY DREDGING", "Auth Estuary Dredging", "Estuary Dredging, Authority of", "Authority of Estuary Dred.", "A.E.D.", "AED (Dredging)", "Authorty of Estuary Dredging (Head Office)"]
    c = link(spark, [*same, "Authority of Barge Navigation", "Board of Ferry Licensing", "Department of Ferry Licensing"], False)
    assert len({c[i] for i in range(8)}) == 1 and len({c[0], c[8], c[9], c[10]}) == 4


def test_similarity_and_slips():
    assert round(N.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(N.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert N.one_slip("abcd", "abdc") and N.one_slip("abc", "abxc") and N.one_slip("abc", "ab") and not N.one_slip("abcd", "badc")


def test_pairs_and_empty_table(spark):
    df = spark.createDataFrame([("1", "Ken Zibedudu", True), ("2", "Kenneth Zibedudu", True), ("2", "Kenneth Zibedudu", True), ("3", None, True)], "id string, name string, person boolean").withColumn("tab", F.lit("x"))
    assert [(r.key_a, r.key_b) for r in N.linked_records(df, "id", "name", F.col("person"), "tab").collect()] == [("1", "2")]
    assert N.linked_records(df.limit(0), "id", "name", F.col("person"), "tab").count() == 0


def test_slips_and_short_names_that_once_did_not_meet(spark):
    c = link(spark, ["Dominic Nalekesi", "Dominic Nalekei", "Barbara Niramobe", "Ms Brbara Niramobe", "Vincent Vapezami", "Vapezami, Vin", "Ingrid Tigutana", "Tiigutana, Inge"], True)
    assert c[0] == c[1] and c[2] == c[3] and c[4] == c[5] and c[6] == c[7] and len(set(c.values())) == 4
    b = link(spark, ["Falagifo Harbour Cooperative Limited", "Falagifo Hbr. Coop. Ltd", "สมาคมปุ๋ยหมัก ลักษ์กุลโชคดารา", "สมาคมปุ๋ยหมัก ลักษกุลโชคดารา"], False)
    assert b[0] == b[1] and b[2] == b[3] != b[0]


def test_names_that_are_alike_stay_apart(spark):
    c = link(spark, ["Patricia Ganinali", "Patrick Ganinali", "Pat Ganinali", "Samuel Mobugoro", "Samantha Mobugoro", "S. Mobugoro"], True)
    assert len({c[0], c[1], c[2]}) == 3 and len({c[3], c[4], c[5]}) == 3
