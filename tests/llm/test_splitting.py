import pytest
from pyspark.sql import functions as F

from strandweave.llm import splitting as S

TEXTS = {
    "short": "abc", "edge": "x" * 40, "run": "x" * 500, "empty": "", "none": None, "words": "lorem ipsum dolor " * 30, "marks": "น้ำที่กี่ปู่ " * 40,
    "astral": "😀" * 200, "crlf": "one line.\r\n\r\n" * 20, "lists": "- item one two\n" * 25, "blank": " " * 300,
}


@pytest.mark.parametrize(("size", "overlap"), [(40, 8), (41, 0), (5, 2), (100, 60)])
def test_pieces_cover_the_text_within_the_limit(spark, size, overlap):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, t string").withColumn("piece", F.lit(1)).drop("piece")
    got = S.split_oversized(df, "t", size, overlap, "id").orderBy("id", "piece_no").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {k for k, t in TEXTS.items() if t}
    for key, pieces in by.items():
        text, end = TEXTS[key], 0
        for n, p in enumerate(pieces):
            assert p.n_pieces == len(pieces) and 0 < len(p.piece) <= size and text[p.char_start : p.char_end] == p.piece
            assert p.char_start == max(0, end - overlap) if n else p.char_start == 0
            end = p.char_end
        assert end == len(text)


def test_boundaries_are_preferred_by_strength(spark):
    text = "First sentence here. Second one follows it.\n\nNew paragraph starts now and goes on and on."
    got = [r.piece for r in S.split_oversized(spark.createDataFrame([(1, text)], "id int, t string"), "t", 60, 0, "id").orderBy("piece_no").collect()]
    assert got[0].endswith("\n\n") and got[1].startswith("New paragraph")


def test_oversized_counts_a_key_once_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "x" * 50), (1, "x" * 50), (2, "x" * 40), (3, None)], "id int, t string")
    assert [r.id for r in S.oversized(df, "t", 40, 5, "id").collect()] == [1]
    assert S.oversized(df.limit(0), "t", 40, 5, "id").count() == 0


def test_bad_sizes_are_refused():
    with pytest.raises(ValueError):
        S.piece_pattern(10, 10)
