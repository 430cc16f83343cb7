"""Ranking and metric operators against hand calculations and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kgrec.operators import metrics as M
from kgrec.operators import rank as R


def test_topk_ties_smaller_item_first(spark):
    preds = spark.createDataFrame([(1, 7, 0.9), (1, 3, 0.9), (1, 5, 0.1)], "user_id long, item_id long, score double")
    got = [r["item_id"] for r in R.topk_per_user(preds, 2).orderBy("rank").collect()]
    assert got == [3, 7]


def test_metrics_hand_example(spark):
    # list [a, b]; truth a=1, b=0, c=1; k=2
    preds = spark.createDataFrame([("m", 1, 1, 0.9), ("m", 1, 2, 0.8)],
                                  "model string, user_id long, item_id long, score double")
    test = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 0, 0), (1, 3, 1, 0)],
                                 "user_id long, item_id long, rating long, seq long")
    train = spark.createDataFrame([(1, 9, 1, 0), (2, 1, 1, 0)], "user_id long, item_id long, rating long, seq long")
    um = M.user_metrics(preds, train, test, ks=(2,)).collect()[0]
    assert um["precision"] == 0.5 and um["recall"] == 0.5 and um["f1"] == 0.5
    assert math.isclose(um["ndcg"], 1.0 / (1.0 + 1.0 / math.log2(3)))


def _gini_direct(xs):
    xs = sorted(xs)
    n = len(xs)
    return sum((2 * (i + 1) - n - 1) * x for i, x in enumerate(xs)) / (n * sum(xs))


def test_gini_histogram_equals_direct(spark):
    rnd = random.Random(3)
    rows = [("m", u, rnd.randrange(30), rnd.random()) for u in range(60) for _ in range(8)]
    preds = spark.createDataFrame(rows, "model string, user_id long, item_id long, score double") \
        .dropDuplicates(["model", "user_id", "item_id"])
    got = M.gini(preds, ks=(5,)).collect()[0]["gini"]
    lists = M.ranked_lists(preds, (5,)).groupBy("item_id").count().collect()
    assert math.isclose(got, _gini_direct([r["count"] for r in lists]), rel_tol=1e-12)


def test_global_row_number_matches_sort(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.randrange(50), i) for i in range(500)], "a long, b long").repartition(7)
    got = R.global_row_number(df, [F.col("a").desc(), F.col("b").asc()], "idx").orderBy("idx").collect()
    want = sorted([(r["a"], r["b"]) for r in df.collect()], key=lambda t: (-t[0], t[1]))
    assert [(r["a"], r["b"]) for r in got] == want
    assert [r["idx"] for r in got] == list(range(500))


def test_topk_all_items_brute_force(spark):
    rnd = random.Random(5)
    seen = {(u, rnd.randrange(40)) for u in range(20) for _ in range(rnd.randrange(0, 30))}
    scores = [(i, float(rnd.randrange(10))) for i in range(40)]
    users = spark.createDataFrame([(u,) for u in range(20)], "user_id long")
    sdf = spark.createDataFrame(scores, "item_id long, score double")
    seen_df = spark.createDataFrame(sorted(seen), "user_id long, item_id long")
    for mask in (None, -9.0):
        got = R.topk_all_items(users, sdf, seen_df, 5, mask_score=mask).collect()
        got_map = {}
        for r in got:
            got_map.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
        for u in range(20):
            cand = []
            for i, s in scores:
                if (u, i) in seen:
                    if mask is None:
                        continue
                    s = mask
                cand.append((-s, i))
            want = [i for _, i in sorted(cand)[:5]]
            assert [i for _, i in sorted(got_map.get(u, []))] == want


def test_topk_all_items_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "POS_CHUNK", 3)
    test_topk_all_items_brute_force(spark)


def test_running_sum_cuts_a_hot_key(spark):
    import random
    from pyspark.sql import functions as F
    from kgrec.operators.rank import running_sum
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 40), 1 + k % 3, k) for k in range(600)] + [(f"k{k % 50}", rng.randint(0, 9), 1, 1000 + k) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, x int, v int, id int").repartition(5)
    got = running_sum(df, ["k"], [F.col("x").desc(), F.col("id")], "v", "before").collect()
    assert len(got) == len(rows)
    want = {}
    for key in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[3])):
            want[r[3]] = total
            total += r[2]
    assert {r.id: r.before for r in got} == want


def test_signed_ranks_equal_a_plain_test(spark):
    import itertools
    import random
    from kgrec.operators import metrics as M
    rng = random.Random(9)
    rows = [(m, 5, u, rng.randint(0, 5) / 5 + (0.2 if m == "b" else 0.0)) for m in "abc" for u in range(1000) if rng.random() < 0.9]
    rows += [(m, 10, 1, 0.5) for m in "ab"]  # no difference at all
    df = spark.createDataFrame(rows, "model string, k int, user_id int, p double").repartition(6)
    got = {(r.k, r.a, r.b): r for r in M.signed_ranks(df, ["p"]).collect()}
    by = {(m, k, u): v for m, k, u, v in rows}
    for a, b in itertools.combinations("abc", 2):
        d = [round(by[a, 5, u] - by[b, 5, u], 6) for u in range(1000) if (a, 5, u) in by and (b, 5, u) in by]
        other = [x for x in d if x]
        size = sorted(abs(x) for x in other)
        rank = {s: sum(i + 1 for i, x in enumerate(size) if x == s) / size.count(s) for s in set(size)}
        w, n = sum(rank[abs(x)] for x in other if x > 0), len(other)
        var = n * (n + 1) * (2 * n + 1) / 24 - sum(size.count(s) ** 3 - size.count(s) for s in set(size)) / 48
        r = got[5, a, b]
        assert (r.n_users, r.n) == (len(d), n) and abs(r.w_plus - w) < 1e-6 and abs(r.z - (w - n * (n + 1) / 4) / var ** 0.5) < 1e-9
    assert got[5, "a", "b"].z < -5 and (got[10, "a", "b"].n, got[10, "a", "b"].w_plus, got[10, "a", "b"].z) == (0, 0.0, None)


@pytest.mark.parametrize("mask", [None, -9.0])
def test_topk_all_items_broadcasts_no_history(spark, capsys, mask):
    users = spark.range(4).withColumnRenamed("id", "user_id")
    scores = spark.range(9).select(F.col("id").alias("item_id"), F.col("id").cast("double").alias("score"))
    seen = spark.createDataFrame([(1, 8), (2, 0)], "user_id long, item_id long")
    R.topk_all_items(users, scores, seen, 3, mask_score=mask).explain()
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "Join" in line and "item_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), plan  # a small history as well: its size on disk says little


def test_scored_items_copy_no_block(spark, monkeypatch):
    """Blocks meet without a shuffle that copies them; ties, masks, many parts of the catalogue, users without items seen and repeated rows agree with brute force."""
    import numpy as np

    from kgrec.operators import rank as R
    rng = np.random.default_rng(2)
    u, v = rng.integers(-2, 3, (9, 2)).astype(float), rng.integers(-2, 3, (23, 2)).astype(float)
    users = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(u)] + [(0, u[0].tolist())], "user_id long, vec array<double>")
    items = spark.createDataFrame([(3 * k, x.tolist()) for k, x in enumerate(v)], "item_id long, vec array<double>")
    had = {(k, 3 * j) for k in range(8) for j in range(23) if (k + j) % 3 == 0 or k == 2}
    seen = spark.createDataFrame([*sorted(had), (1, None), (1, 7), (5, 9), (5, 9)], "user_id long, item_id long")
    had.add((5, 9))
    monkeypatch.setattr(R, "ITEM_BLOCKS", 2)
    for mask in (None, -1.0):
        top = R.topk_scored_items(users, items, seen, 4, mask, user_block=2, item_block=3)
        assert "CartesianProduct" in top._jdf.queryExecution().sparkPlan().toString()
        got = sorted(map(tuple, top.select("user_id", "rank", "item_id", "score").collect()))
        want = []
        for k in range(9):
            rows = [(-(mask if (k, 3 * j) in had else u[k] @ v[j]), 3 * j) for j in range(23) if mask is not None or (k, 3 * j) not in had]
            want += [(k, n + 1, j, -s) for n, (s, j) in enumerate(sorted(rows * (2 if k == 0 else 1))[:4])]
        assert got == want


def test_lists_of_a_scorer_work_out_few_pairs_exactly(spark, monkeypatch):
    """Rough scores leave out what cannot be in a list, never what can: nearly equal scores, ties, masks, huge and not-a-number vectors."""
    import numpy as np

    from kgrec.operators import scorer as S
    rng = np.random.default_rng(9)
    u, v = rng.standard_normal((40, 8)), rng.standard_normal((3000, 8))
    v[100:200] = v[0] * (1 + 1e-9 * np.arange(100))[:, None]   # equal in single precision
    v[300:330] = v[1]
    item, k = np.arange(3000) * 2, 5
    who, seen = np.repeat(np.arange(40), 30), np.sort(rng.integers(0, 6000, (40, 30)), axis=1).ravel()
    theta = S.init_params(8)
    for score, few in ((R.dot_scores, True), (S.block_scores(theta, 8), True), (S.block_scores(3 * theta, 8), False)):  # the last gives many scores of 1
        worked = []
        monkeypatch.setattr(type(score), "pairs", lambda self, *a, f=type(score).pairs: worked.append(len(a[2])) or f(self, *a))
        for mask in (None, 0.5):
            def run(rough, u=u, v=v):
                held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for at in range(0, 3000, 700):
                    held = R._taken_through(score, u, v[at:at + 700], item[at:at + 700], who, seen, k, mask, held, rough)
                return held
            worked.clear()
            for a, b in zip(run(False), run(True), strict=True):
                assert np.allclose(a, b, rtol=0, atol=2e-9) and (a.dtype == float or (a == b).all())
            assert not few or 0 < sum(worked) < 0.1 * 40 * 3000
            for odd in (1e200, np.nan, np.inf):
                w = v.copy()
                w[17] = odd
                with np.errstate(all="ignore"):
                    assert all(np.array_equal(a, b, equal_nan=a.dtype == float) or np.allclose(a, b, rtol=1e-9, atol=2e-9, equal_nan=True)
                               for a, b in zip(run(False, v=w), run(True, v=w), strict=True))
