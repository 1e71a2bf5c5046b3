import random

from strandweave.llm import leakage as G


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        for k, p in items:
            if t and p and any(p[i : i + n] in t for i in range(len(p) - n + 1)):
                out.add((d, k))
    return out


def test_search_equals_brute_force():
    rng = random.Random(3)
    items = [(f"i{k}", "".join(rng.choice("abกข") for _ in range(rng.randint(5, 60)))) for k in range(40)]
    docs = []
    for d in range(200):
        t = "".join(rng.choice("abกข") for _ in range(rng.randint(0, 80)))
        if d % 3 == 0:
            p = items[rng.randrange(40)][1]
            a = rng.randint(0, len(p) // 2)
            t = t[:20] + p[a : a + rng.randint(5, 40)] + t[20:]
        docs.append((d, t))
    for n in (8, 12, 20):
        s = G.Searcher(items, n, 5)
        assert {(d, k) for d, t in docs for k in s.find(t)} == brute(docs, items, n)


def test_signs_case_and_gaps_are_skipped(spark):
    passage = "The open, Ginadoso stipend HAS to survey the Menibiso tender unless the order is suspended."
    docs = spark.createDataFrame([(1, "x " + passage.upper().replace(" ", "\n- ")), (2, passage[:50]), (3, None), (4, ""), (5, passage + passage)], "doc_id long, text string")
    items = spark.createDataFrame([("a", passage), ("b", passage), ("c", "short"), ("d", None)], "item_id string, passage string")
    got = {(r.doc_id, r.item_id) for r in G.leaks(docs, "doc_id", "text", items, "item_id", "passage", 60).collect()}
    assert got == {(d, k) for d in (1, 5) for k in "ab"}
    assert G.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage", 60).count() == 0
    assert G.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage", 60).count() == 0


def test_shards_find_what_one_table_finds(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"{chr(97 + n) * 70} filler") for n in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(str(n), chr(97 + n) * 65) for n in range(6)], "item_id string, passage string")
    monkeypatch.setattr(G, "SHARD_SIGNS", 100)
    assert G.leaks(docs, "doc_id", "text", items, "item_id", "passage", 60).count() == 6
