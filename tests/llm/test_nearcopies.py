import random
import time
from collections import Counter

from strandweave.llm import nearcopies as N
from strandweave.operators import graph

WORDS = [a + b + c for a in ("ka", "mo", "ti", "se", "ru", "กำ", "ที่") for b in ("lo", "ne", "pa", "zu") for c in ("r", "n", "st", "")]


def fixture(seed=5):
    rng, rows = random.Random(seed), []
    for g in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(25, 60))]
        rows.append((f"r{len(rows):04}", " ".join(base)))
        for _ in range(rng.randint(0, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[k:] + w[:k]
            rows.append((f"r{len(rows):04}", " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return rows


def exact(rows, least):
    bare = {k: "".join(t.lower().split()) for k, t in rows if t}
    grams = {k: Counter(s[i : i + 4] for i in range(len(s) - 3)) for k, s in bare.items()}
    keys = sorted(grams)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sum((grams[a] & grams[b]).values()) >= least * max(grams[a].total(), grams[b].total())}


def test_all_pairs_of_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows + rows[:5] + [("n1", None)], "id string, t string").selectExpr("'x' AS tab", "id", "t", "1 AS a")
    got = {(r.id_a, r.id_b) for r in N.near_copies(df, "id", "t", "tab", 0.7).collect()}
    want = exact(rows, 0.7)
    assert got <= want and len(want - got) <= 0.02 * len(want)


def test_short_empty_and_equal_texts(spark):
    df = spark.createDataFrame([("x", "1", "ab"), ("x", "2", " A b"), ("x", "3", "abc"), ("x", "4", ""), ("y", "5", "ab"), ("x", "6", None)], "tab string, id string, t string")
    assert {(r.id_a, r.id_b) for r in N.near_copies(df, "id", "t", "tab").collect()} == {("1", "2")}
    assert N.near_copies(df.limit(0), "id", "t", "tab").count() == 0


def test_classes_name_every_record_once(spark):
    rows = fixture(8)
    df = spark.createDataFrame(rows, "id string, t string").selectExpr("'x' AS tab", "id", "t")
    got = N.near_copy_classes(df, "id", "t", "tab").collect()
    assert sorted(r.id for r in got) == sorted(k for k, _ in rows)
    of = {r.id: r.class_id for r in got}
    assert all(of[a] == of[b] for a, b in exact(rows, 0.75))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(40))
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pairs_near_the_limit_and_with_repeated_runs(spark):
    rng, rows = random.Random(11), []
    for g in range(250):
        base = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(203))
        rows += [(f"{g}a", base), (f"{g}b", base[: 142 + g % 9] + "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(61 - g % 9)))]
    stutter = "abcd" * 60
    rows += [("sa", stutter + "".join(rng.sample(WORDS, 15))), ("sb", stutter + "".join(rng.sample(WORDS, 15)))]
    bare = {k: "".join(t.lower().split()) for k, t in rows}
    want = {(f"{g}a", f"{g}b") for g in range(250) if N.share(bare[f"{g}a"], bare[f"{g}b"]) >= 0.695}
    assert len(want) >= 200 and N.share(bare["sa"], bare["sb"]) >= 0.7
    got = {(r.id_a, r.id_b) for r in N.near_copies(spark.createDataFrame(rows, "id string, t string").selectExpr("'x' AS tab", "id", "t"), "id", "t", "tab", 0.695).collect()}
    assert got <= want | {("sa", "sb")} and ("sa", "sb") in got
    assert len(want & got) >= 0.975 * len(want)


def test_shares_of_many_pairs_are_those_of_single_pairs():
    rng, left, right = random.Random(3), [None, "", "abc", "abc", "x" * 20_000], ["abcd", "abcd", "abc", "abcd", "x" * 16_000]
    for signs in ("ab", "กขคงำ่ e", [chr(0x4E00 + i) for i in range(3000)], "é\U0010ffff\U0001f600\0"):
        text = lambda n: "".join(rng.choice(signs) for _ in range(n))  # noqa: B023, E731
        for _ in range(150):
            x = text(rng.choice([3, 4, 5, 40, 300]))
            left.append(x)
            right.append(x[len(x) // 3 :] + text(rng.randint(0, 90)))
    assert N.shares(left, right).tolist() == [N.share(x, y) for x, y in zip(left, right, strict=True)]
    assert len(N.shares([], [])) == 0


def test_shares_take_less_time_than_single_pairs():
    rng = random.Random(4)
    left = [" ".join(rng.choices(WORDS, k=130)) for _ in range(600)]
    right = [t[60:] + t[:60] for t in left]

    def seconds(count):
        N._counts.cache_clear()
        start = time.process_time()
        count()
        return time.process_time() - start

    one = min(seconds(lambda: [N.share(x, y) for x, y in zip(left, right, strict=True)]) for _ in range(3))
    assert min(seconds(lambda: N.shares(left, right)) for _ in range(3)) < one / 2


def test_a_sketch_does_not_depend_on_the_texts_beside_it(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abกขé漢\U0001f600", k=n)) for n in (4, 5, 300, 20_000, 4, 900, 16_384, 7)]
    symbols, runs = N.sketches(texts)
    assert runs.tolist() == [len(t) - 3 for t in texts]
    assert all(symbols[i].tolist() == N.sketches([t])[0][0].tolist() for i, t in enumerate(texts))
    monkeypatch.setattr(N, "SIGNS", 10)
    assert (N.sketches(texts)[0] == symbols).all()
    assert N.shares(texts, texts[::-1]).tolist() == [N.share(x, y) for x, y in zip(texts, texts[::-1], strict=True)]
