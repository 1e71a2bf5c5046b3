import os

import pytest

from strandweave.llm import packing as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.default_vocabulary()), reason="no public vocabulary here")


def test_pieces_hold_the_capacity_and_the_text():
    enc = P.encoder(P.default_vocabulary())
    for text in ("a b c " * 400, "ที่ดินชายน้ำ" * 300, "😀" * 300, "x" * 2000, ""):
        spans = P.token_pieces(text, 50, enc)
        assert "".join(text[a:b] for a, b, _ in spans) == text
        assert all(n <= 50 and n == len(enc.encode_ordinary(text[a:b])) for a, b, n in spans)


def test_every_text_in_one_container_and_none_too_full(spark):
    rows = [(i, "word " * (i % 60)) for i in range(400)] + [(400, None), (401, "word " * 500), (5, "word " * 5)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(5)
    got = P.pack(df, "id", "t", 100, open_windows=8).toPandas()
    assert len(got[got.n_pieces == 1]) == 401 and 400 not in set(got.id)
    assert (got[got.id == 401].n_pieces > 1).all() and (got[(got.id != 401)].n_pieces == 1).all()
    fill = got.groupby("container_id").tokens.sum()
    assert fill.max() <= 100
    assert got.tokens.sum() / 100 / len(fill) > 0.85


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "id int, t string"), "id", "t", 100).count() == 0


def test_leftovers_leave_little_room(spark):
    """Against the least number of containers there can be: the tokens over the capacity."""
    rng = __import__("random").Random(7)
    rows = [(i, "word " * rng.randint(1, 90)) for i in range(3000)]
    got = P.pack(spark.createDataFrame(rows, "id int, t string").repartition(6), "id", "t", 100).toPandas()
    least = -(-int(got.tokens.sum()) // 100)
    assert got.container_id.nunique() <= 1.03 * least


def test_long_texts_are_cut_in_linear_work():
    enc, text = P.encoder(P.default_vocabulary()), "ที่ดิน river 12 " * 60_000
    spans = P.token_pieces(text, 2048, enc)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
