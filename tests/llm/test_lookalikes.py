import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandweave.llm import lookalikes as L


@pytest.fixture(scope="module")
def looks(spark):
    return L.Looks.of(spark)


def test_the_table_is_the_published_one(looks):
    assert len(looks.table) > 10_000
    assert looks.table["а"] == "a" and looks.table["Ꭺ"] == "A" and looks.table["m"] == "rn"
    assert looks.skeleton("Іnk") == looks.skeleton("lnk") == looks.skeleton("1nk")


def test_ordinary_form_of_known_disguises(looks):
    cases = {
        "Ｃｌａｕｓｅ １２": "Clause 12", "Вoroрipa": "Boropipa", "ตําบล": "ตำบล", "นํ้า": "น้ำ", "น้ํา": "น้ำ", "เเก้ว": "แก้ว", "café": "café", "ΝΕΤ-2567": "NET-2567",
        "a​b­c": "abc", "a b　c": "a b c", "Oﬃce": "Office", "Part Ⅱ": "Part II", "PRJ‑1": "PRJ-1", "ท่ี": "ที่", "Gewӓsser": "Gewässer", "Ωmega": "Ωmega",
    }
    for odd, plain in cases.items():
        assert looks.ordinary(odd) == plain, odd


def test_what_is_ordinary_stays(looks):
    for text in ("Комитет Лугорья", "Νησί Καλύμνα", "Ωmega Ledger", "Δ-Netz", "๒๕๖๑", "Łąkowa Spółka", "น้ำบาดาล", "", "a b", "ฤๅษี"):
        assert looks.ordinary(text) == text


@given(st.text(alphabet="abcАВеорс ก้ำําเแｆ​́é-Ω", max_size=12))
@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_forms_are_fixed_points_and_equal_looks_meet(looks, text):
    once = looks.ordinary(text)
    assert looks.ordinary(once) == once
    assert looks.skeleton(once) == looks.skeleton(text)


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [("1", "Оffice", 1), ("1", "Оffice", 1), ("2", "Office", 2), ("3", None, 3), ("4", "", 4), ("5", "x" * 50_000, 5)]
    df = spark.createDataFrame(rows, "id string, t string, ordinary int")
    assert [r.id for r in L.not_ordinary(df.drop("ordinary"), "t", "id").distinct().collect()] == ["1"]
    classes = L.classes(df.drop("ordinary"), "t", "id").collect()
    assert [(c.ordinary, c.n_records, c.n_spellings) for c in classes] == [("Office", 2, 2)]
    assert L.not_ordinary(df.drop("ordinary").limit(0), "t", "id").count() == 0
