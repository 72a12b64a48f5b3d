"""Hard negatives, lexical search and mixing, against SQL, brute force and bounds."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import hardneg, lexsearch, mixing

SF = "/root/testdata/sf0.001"


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        got = df.toArrow() if hasattr(df, "toArrow") else df  # noqa: F841
        con.sql(f"create table {name} as select * from got")
    return sorted(con.sql(sql).fetchall(), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 11

VECTORS = "vec_id long, embedding array<float>, label int, uid string, e int, score int"


def vectors(spark, got):
    return spark.createDataFrame([(i, v, k, "x", 1, 2) for i, v, k in got], VECTORS)


def test_hard_negatives_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    # Few directions, so that ties are many; repeated ids, and vectors of another length.
    base = np.round(rng.normal(size=(12, 6)), 2)
    got = [(int(i), [float(x) for x in base[rng.integers(12)]], int(rng.integers(3))) for i in range(0, 900, 5)]
    got += [(200, [float(x) for x in base[0]], 1), (200, [float(x) for x in base[0]], 1), (300, [1.0, 2.0], 0), (301, [1.0, 1.5], 0), (302, [1.0, 1.9], 1), (700, [0.0] * 6, 2)]
    got += [(400, None, 1), (401, [1.0] * 6, None), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1)]
    df = vectors(spark, got)
    want = in_duckdb(hardneg.ORACLE, embeddings=df.select("vec_id", "embedding", "label"))
    assert len(want) > 100
    assert rows(hardneg.mine(df.repartition(3))) == want
    assert rows(hardneg.mine(df.repartition(3), lot_rows=2)) == want  # several lots of anchors


def test_hard_negatives_without_ids_and_of_large_numbers(spark):
    big = 3.0e12  # products pass 2^53, and some pass a long
    got = [(0, [big, 1.0], 0), (1, [big, 2.0], 1), (3, [big, 1.0], 2), (None, [big, 1.5], 2), (4, [1.0, 1.0], 2), (5, [-1.0, 0.0], 1)]  # the anchor's id is divisible by 7: its label becomes 1
    top = (1 << 63) - 1
    out = rows(hardneg.mine(vectors(spark, got)))
    assert {r[1] for r in out} == {1} and all(r[4] == top for r in out)
    assert [(r[2], r[3]) for r in sorted(out, key=lambda r: r[2])] == [(1, 3), (2, None)]
    exact = hardneg.products(np.array([[2**40, 1]], object), np.array([[2**20, 3]], object))
    assert exact.tolist() == [[2**60 + 3]]


def test_hard_negatives_of_nothing(spark):
    assert rows(hardneg.mine(vectors(spark, []))) == []
    assert rows(hardneg.mine(vectors(spark, [(100, [1.0], 1), (101, [1.0], 2)]))) == []  # no positive


def test_best_merges_blocks_like_a_sort():
    rng = np.random.default_rng(1)
    best = hardneg.Best(4, 5)
    seen = [[] for _ in range(4)]
    for block in range(7):
        ids = np.sort(rng.choice(1000, 30, replace=False)) + 1000 * int(rng.integers(5))
        score, ok = rng.integers(-3, 4, (4, 30)), rng.random((4, 30)) < 0.5
        best.add(np.arange(4), score, ids, ok)
        for r in range(4):
            seen[r] += [(-int(s), int(i)) for s, i, k in zip(score[r], ids, ok[r]) if k]
    for r in range(4):
        assert [(-int(s), int(i)) for s, i in zip(best.score[r], best.id[r])] == sorted(seen[r])[:5]


# --- 12

DOCS = "doc_id long, text string, lang string, source string, n int, q string, terms string"


def docs(spark, got):
    return spark.createDataFrame([(i, t, None, s, 1, "q", "t") for i, t, s in got], DOCS)


def invented(n, seed, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Été", "日本", "x-y", "A.b"]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.choice((0, 1, 5, 30, 200)))) for _ in range(n)]


def test_lexical_search_equals_scoring_all_pairs(spark):
    texts = invented(300, 1)
    got = [(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s"), (7, texts[7], "s"), (500, None, "s"), (501, "", "s"), (None, texts[9], "s"), (502, "w1 " * 30_000 + "w59", "s")]
    items = [(k, t) for k, t in enumerate(invented(25, 2))] + [(3, "w1 w1 W1"), (90, None), (91, ""), (92, "never seen"), (None, "w2 w3")]
    d, b = docs(spark, got), spark.createDataFrame(items, "item_id long, text string")
    want = in_duckdb(lexsearch.ORACLE, documents=d.select("doc_id", "text"), benchmark=b)
    assert len(want) > 150
    assert rows(lexsearch.search(d.repartition(3), b)) == want
    assert rows(lexsearch.search(d.repartition(3), b, shard_rows=40, lot_queries=7)) == want  # shards and lots


def test_lexical_search_of_nothing(spark):
    d, b = docs(spark, [(1, "a b", "s")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(lexsearch.search(d.limit(0), b)) == [] and rows(lexsearch.search(d, b.limit(0))) == []
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexsearch.search(d, b).collect()] == [(1, 1, 1)]


def test_terms_are_those_of_the_pattern():
    text = "Ab,c É日本x_9\x00\x7f~[Q]`{Z} 😀a b"
    want = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    assert [t.decode() for t in lexsearch.terms(text)] == want and lexsearch.terms(None) == []


def test_blocks_have_the_least_cost():
    rng = np.random.default_rng(0)
    lists = [rng.integers(1, 50, int(rng.integers(1, 120))) for _ in range(12)]
    share, first = np.concatenate(lists), np.cumsum([0] + [len(x) for x in lists[:-1]])
    starts = lexsearch.cut_blocks(share, first)
    for at, x in zip(first, lists):
        best = [0.0] + [math.inf] * len(x)
        for j in range(1, len(x) + 1):
            best[j] = min(best[i] + max(x[i:j]) * (j - i) + lexsearch.PRICE * x.mean() for i in range(max(0, j - lexsearch.BLOCK), j))
        mine = [s - at for s in starts if at <= s < at + len(x)]
        ends = [*mine[1:], len(x)]
        assert mine[0] == 0 and sum(x[i:j].max() * (j - i) + lexsearch.PRICE * x.mean() for i, j in zip(mine, ends)) == pytest.approx(best[-1])


def test_blocks_are_skipped_and_nothing_is_lost():
    import pandas as pd

    rng = np.random.default_rng(5)
    n, words = 4_000, 40
    held = [np.sort(rng.choice(words, int(rng.integers(1, 4)), replace=False)).astype(np.int32) for _ in range(n)]
    often = [np.where(rng.random(len(h)) < 0.02, 40, 1).astype(np.int32) for h in held]  # few documents stand out
    pdf = pd.DataFrame({"doc_id": range(n), "n": [int(t.sum()) for t in often], "terms": [h.tobytes() for h in held], "tf": [t.tobytes() for t in often]})
    weights = rng.integers(100, 5_000, words)
    total = int(pdf["n"].sum())
    s = lexsearch.Shard.build(pdf, weights, n, total)
    read = there = 0
    for _ in range(30):
        asked = np.sort(rng.choice(words, 3, replace=False)).astype(np.int32)
        score = [sum(int(lexsearch.shares(weights[h[k : k + 1]], t[k : k + 1], np.array([t.sum()]), n, total)[0]) for k in np.flatnonzero(np.isin(h, asked))) for h, t in zip(held, often)]
        got, points, scored = s.search(asked, 10)
        assert [(-p, d) for d, p in zip(got.tolist(), points.tolist())] == sorted((-x, i) for i, x in enumerate(score) if x > 0)[:10]
        read, there = read + scored, there + sum(bool(np.isin(asked, h).any()) for h in held)
    assert read < 0.7 * there


# --- 13


def test_mix_equals_sql(spark):
    texts = invented(400, 3)
    rng = random.Random(1)
    got = [(i, t, rng.choice(("a", "a", "a", "b", "ü", "Z", "", None, "tiny"))) for i, t in enumerate(texts)]
    got = [(i, "one two" if s == "tiny" else t, s) for i, t, s in got] + [(1, texts[1], "a"), (1, texts[1], "a"), (None, "x y z", "b"), (900, None, "b"), (901, "   \n", "only"), (902, " a\x0bb c \t", "c")]
    d = docs(spark, got)
    want = in_duckdb(mixing.ORACLE, documents=d.select("doc_id", "text", "source"))
    assert rows(mixing.mix(d.repartition(3))) == want
    assert rows(mixing.mix(d.repartition(2), slice_rows=9)) == want  # many slices, and a second run


def test_mix_meets_targets(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(d).withColumn("source", F.lit(None)).collect()
    assert len(got) == d.count() and all(r.copies <= 3 and r.taken == r.copies * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
    largest = max(r["size"] for r in got)
    for (_, target), some in by.items():
        assert target - largest <= sum(r.taken for r in some) <= target + 1e-6
    total = sum(s for s, _ in by)
    assert sum(t for _, t in by) == pytest.approx(total, rel=1e-9)


def test_targets_fill_up(spark, tmp_path):
    from lexiloom.llm.scratch import Scratch

    sizes = [("a", 10), ("b", 1_000), ("c", 20), ("d", 5_000), ("e", 0), ("f", 3_000)]
    src = spark.createDataFrame([(False, s, 1, n) for s, n in sizes], "none boolean, s string, rows long, source_size long").repartition(3)
    got = {r.s: (r.weight, r.target) for r in mixing.targets(src, Scratch(spark, "t")).collect()}
    weights = {s: 1 + i % 3 for i, (s, _) in enumerate(sizes)}
    low, high = 0.0, 1e9  # the share at which all adds up, by bisection
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * n, mid * weights[s]) for s, n in sizes) < sum(n for _, n in sizes) else (low, mid)
    assert {s: w for s, (w, _) in got.items()} == weights
    for s, n in sizes:
        assert got[s][1] == pytest.approx(min(3 * n, low * weights[s]), rel=1e-9)


def test_mix_with_unequal_odds(spark):
    got = [(i, "w " * (1 + i % 5), "a" if i % 3 else "b") for i in range(3_000)]
    d = docs(spark, got).withColumn("odds", F.when(F.col("doc_id") % 7 == 0, None).otherwise((F.col("doc_id") % 4).cast("double")))
    out = mixing.mix(d, odds="odds").collect()
    mean = lambda k: np.mean([r.copies for r in out if r.doc_id % 7 and r.doc_id % 4 == k and r.doc_id % 3])
    assert all(r.copies == 0 for r in out if r.doc_id % 7 == 0 or r.doc_id % 4 == 0) and max(r.copies for r in out) <= 3
    assert mean(2) == pytest.approx(2 * mean(1), rel=0.15) and mean(3) > 1.2 * mean(2)
    for name in ("a", "b"):
        some = [r for r in out if ("a" if r.doc_id % 3 else "b") == name]
        assert sum(r.taken for r in some) == pytest.approx(some[0].target, rel=0.01) or all(r.copies in (0, 3) for r in some)


def test_mix_of_nothing(spark):
    d = docs(spark, [(1, None, None)])
    assert rows(mixing.mix(d.limit(0))) == []
    assert [tuple(r) for r in mixing.mix(d).collect()] == [(1, 0, 0, 0.0, 0, 0)]
