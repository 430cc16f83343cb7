"""Vectors, neighbourhood models and file sources."""

import itertools
import os
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from kgrec.operators import neighbors as NB
from kgrec.operators import vectors as VX
from kgrec.sources import files as FS


def test_imputation_partition_invariant(spark):
    vecs = spark.createDataFrame([("a", [0.1, 0.2, 0.3]), ("b", [0.0, -0.1, 0.5])], "entity string, vec array<double>")
    ents = spark.createDataFrame([("a",), ("zz",), ("yy",)], "entity string")
    one = {r["entity"]: r["vec"] for r in VX.impute_vectors(ents.repartition(1), vecs, dim=3).collect()}
    seven = {r["entity"]: r["vec"] for r in VX.impute_vectors(ents.repartition(7), vecs, dim=3).collect()}
    assert one == seven
    assert one["a"] == [0.1, 0.2, 0.3]
    assert one["zz"] != one["yy"]


def _brute_co(rows):
    by_user = {}
    for u, i in rows:
        by_user.setdefault(u, set()).add(i)
    out = {}
    for items in by_user.values():
        for a, b in itertools.permutations(sorted(items), 2):
            out[(a, b)] = out.get((a, b), 0) + 1
    return out


def test_co_counts_heavy_path_exact(spark):
    rnd = random.Random(7)
    rows = {(u, rnd.randrange(60)) for u in range(40) for _ in range(rnd.choice([3, 5, 40, 80]))}
    df = spark.createDataFrame(sorted(rows), "user_id long, item_id long")
    got = {(r["i"], r["j"]): r["c"] for r in NB.co_counts(df, heavy_threshold=10, item_block=16, user_chunk=4).collect()}
    assert got == _brute_co(rows)


def test_knn_scores(spark):
    rows = [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 3)]
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    sims = {(r["i"], r["j"]): r["sim"] for r in NB.knn_similarities(df, 5, 0.0).collect()}
    assert np.isclose(sims[(1, 2)], 2 / (np.sqrt(2) * np.sqrt(2)))
    pairs = spark.createDataFrame([(2, 1), (2, 2)], "user_id long, item_id long")
    sc = {r["item_id"]: r["score"] for r in NB.score_pairs(df, NB.knn_similarities(df, 5, 0.0), pairs).collect()}
    assert np.isclose(sc[1], sims[(3, 1)]) and np.isclose(sc[2], sims[(3, 2)])


def test_typed_header_file(spark):
    base = tempfile.mkdtemp(prefix="kgrec-atomic-", dir="/tmp")
    path = os.path.join(base, "x.inter")
    with open(path, "w") as fh:
        fh.write("user_id:token\titem_id:token\tlabel:float\n")
    df = FS.read_atomic(spark, path)
    assert df.count() == 0
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string", "double"]


def test_relations_crlf(spark):
    base = tempfile.mkdtemp(prefix="kgrec-rel-", dir="/tmp")
    path = os.path.join(base, "rel.tsv")
    with open(path, "wb") as fh:
        fh.write(b"0\tdislike\r\n1\tlike\r\n")
    got = [(r["rel_id"], r["relation"]) for r in FS.read_relations(spark, path).collect()]
    assert got == [(0, "dislike"), (1, "like")]


def test_json_docs_entity_from_name(spark):
    base = tempfile.mkdtemp(prefix="kgrec-json-", dir="/tmp")
    with open(os.path.join(base, "user3_sysprompt1.json"), "w") as fh:
        fh.write('{"plain": "x", "genre": ["a", "b"]}')
    got = {(r["entity"], r["key"]): list(r["values"]) for r in FS.read_json_docs(spark, base).collect()}
    assert got == {("user3", "plain"): ["x"], ("user3", "genre"): ["a", "b"]}


def test_topk_store_exact_k(spark):
    base = tempfile.mkdtemp(prefix="kgrec-topk-", dir="/tmp")
    df = spark.createDataFrame([("s1", 5, 1, 2), ("s1", 50, 1, 3), ("s2", 5, 2, 4)],
                               "setting string, k int, user_id long, item_id long")
    FS.write_topk_lists(df, base + "/lists")
    got = sorted((r["setting"], r["item_id"]) for r in FS.read_topk_lists(spark, base + "/lists", 5).collect())
    assert got == [("s1", 2), ("s2", 4)]


def _exchanges(df) -> list[str]:
    """The shuffles of a plan as it starts, reused ones left out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]


def test_symmetric_norm_edges_of_repeated_and_null_names(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "x"), ("x", "a"), ("b", "x"), ("b", "b"), ("a", None)], "u string, i string")
    want = {("a", "x"): 2 * 2, ("x", "a"): 2 * 2, ("b", "x"): 2 * 2, ("x", "b"): 2 * 2, ("b", "b"): 2 * 2}  # a null name counts as a neighbour
    got = {(r["src"], r["dst"]): r["w"] for r in VX.symmetric_norm_edges(pairs, "u", "i").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k] ** -0.5) < 1e-12 for k in want)
    some = VX.symmetric_norm_edges(pairs, "u", "i", sources=spark.createDataFrame([("b",), ("b",), (None,)], "entity string"))
    assert {(r["src"], r["dst"]): r["w"] for r in some.collect()} == {k: w for k, w in got.items() if k[0] == "b"}


def test_symmetric_norm_edges_shuffle_edges_twice(spark, tmp_path):
    spark.range(50).selectExpr("'u' || id % 7 u", "'i' || id i").write.parquet(f"{tmp_path}/pairs")
    spark.range(40).selectExpr("'i' || id entity", "array(double(id), 1.0D) vec").write.parquet(f"{tmp_path}/vecs")
    adaptive, limit = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        vecs = spark.read.parquet(f"{tmp_path}/vecs")
        out = VX.propagate(VX.symmetric_norm_edges(spark.read.parquet(f"{tmp_path}/pairs"), "u", "i"), vecs, dim=2)
        # edges by dst, edges by src, the vectors, the sums
        assert len(_exchanges(out)) == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_first_free_slots_are_settled_in_one_written_pass(spark):
    from kgrec.operators.graph import redraw_slots
    names = ["n0", "n1", None, "n3", "n4"]
    slots = spark.createDataFrame(list(enumerate(names)), "slot long, neg string")
    n = spark.createDataFrame([(len(names),)], "n long")
    facts = {("a", "n0"), ("a", "n1"), ("b", "n4"), ("b", None), *(("full", x) for x in names if x)}
    known = spark.createDataFrame([*facts, *facts], "k string, neg string")
    asked = [(r, k, base) for r, (k, base) in enumerate(itertools.product(["a", "b", None, "full"], [0, 3, 4, 12, -1]))]
    positives = spark.createDataFrame([*asked, (99, "a", None)], "row long, k string, base long")
    want = {}
    for row, k, base in asked:
        tries = [names[(base + step) % len(names)] for step in range(len(names))]
        want[row] = next(x for x in tries if x is None or (k, x) not in facts)   # a null name equals none that is known
    out = redraw_slots(positives, slots, known, ["k"], n)
    assert {r["row"]: r["neg"] for r in out.collect()} == want
    assert out.count() == len(want)
    free = redraw_slots(positives.filter("k = 'b' and base = 0"), slots, known, ["k"], n)
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "ExistingRDD" not in plan   # read from the one written table, not from row-wise checkpoints
    assert redraw_slots(positives, slots.limit(0), known, ["k"], n.selectExpr("n * 0 n")).count() == 0


def test_co_occurrence_shuffles_no_pairs(spark, monkeypatch):
    """Light users' pairs are counted in their block's task: no shuffle has a row for each of them; hot items, many pieces and heavy users give the same."""
    rnd = random.Random(11)
    rows = {(u, rnd.choice([5, 7 << 40, -3]) + rnd.randrange(80)) for u in range(50) for _ in range(rnd.choice([1, 4, 30]))}
    nulls = [(None, 5), (None, 6), (3, None), (3, 5), (3, 5)]
    df = spark.createDataFrame([*sorted(rows), *nulls], "user_id long, item_id long")
    rows.add((3, 5))
    want = _brute_co(rows)
    degree = {i: sum(1 for _, j in rows if j == i) + (i in (5, 6)) for _, i in rows}
    sims = {}
    for i in degree:
        near = sorted((-c / (np.sqrt(float(degree[i])) * np.sqrt(float(degree[j])) + 0.5), j) for (a, j), c in want.items() if a == i)[:4]
        sims |= {(i, j): -s for s, j in near}
    plan = NB.co_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [i" not in plan and "FlatMapGroupsInArrow" in plan
    for sizes in ({}, {"PAIRS": 50, "BLOCK_IDS": 300}, {"HOT_IDS": 200, "BLOCK_IDS": 300}):
        with monkeypatch.context() as m:
            for name, value in sizes.items():
                m.setattr(NB, name, value)
            for heavy in (1 << 12, 12):
                assert {(r["i"], r["j"]): r["c"] for r in NB.co_counts(df, heavy_threshold=heavy, item_block=16).collect()} == want
                got = NB.knn_similarities(df, 4, 0.5, heavy_threshold=heavy, item_block=16).collect()
                assert {(r["i"], r["j"]): r["sim"] for r in got} == sims and len(got) == len(sims)
    assert NB.co_counts(df.limit(0)).count() == 0


def test_scores_of_users_with_few_and_many_wanted_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    hist = [(rnd.randrange(6), rnd.randrange(12)) for _ in range(40)]
    sims = {(i, j): rnd.random() for i in range(12) for j in range(12) if i != j and rnd.random() < 0.4}
    pairs = [(u, j) for u in range(7) for j in range(12) if u % 2 or j % 5 == 0] + [(1, 1), (None, 2)]
    dfs = (spark.createDataFrame(hist, "user_id long, item_id long"), spark.createDataFrame([(*k, s) for k, s in sims.items()], "i long, j long, sim double"),
           spark.createDataFrame(pairs, "user_id long, item_id long"))
    monkeypatch.setattr(NB, "FEW_WANTED", 4)
    got = sorted((r["user_id"] or -1, r["item_id"], round(r["score"], 9)) for r in NB.score_pairs(*dfs).collect())
    assert got == sorted((u or -1, j, round(sum(sims.get((i, j), 0.0) for v, i in hist if v == u), 9)) for u, j in pairs)


def test_pair_norms_ship_no_vectors(spark):
    """Norms are worked out before the joins, so no exchange carries the vectors of a pair; a null vector has a null norm."""
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("c", "a", 3), ("a", "x", 4)], "user_entity string, item_entity string, n int")
    vecs = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None)], "entity string, vec array<double>")
    got = VX.pair_norms(pairs, vecs)
    assert sorted((r.n, r.u_norm, r.v_norm) for r in got.collect()) == [(1, 5.0, 0.0), (2, 5.0, None), (3, None, 5.0)]
    assert set(got.columns) == {"user_entity", "item_entity", "n", "u_norm", "v_norm"}


def test_registered_pair_features_join_norms(spark, monkeypatch):
    from kgrec.plans import catalog as C
    vecs = spark.createDataFrame([("user1", [3.0, 4.0]), ("uri7", [6.0, 8.0])], "entity string, vec array<double>")
    monkeypatch.setattr(C, "_imputed", lambda *_: vecs)
    monkeypatch.setattr(C.V, "train", lambda *_: spark.createDataFrame([(1, 7, 1)], "user_id long, item_id long, rating long"))
    monkeypatch.setattr(C.V, "item_uris", lambda *_: spark.createDataFrame([(7, "uri7")], "item_id long, uri string"))
    wide = []
    monkeypatch.setattr(C.VX, "pair_vectors", lambda p, u, v, f=C.VX.pair_vectors: wide.append(u.agg(F.max(F.size("vec"))).first()[0]) or f(p, u, v))
    assert list(map(tuple, C.q_pair_features(spark, "").collect())) == [(1, 7, 1, 5.0, 10.0)] and wide == [1]


def test_draws_are_made_in_as_many_tasks_as_cores_allow(spark):
    """Names have few bytes, so that by bytes one task would make all draws."""
    names = spark.createDataFrame([(f"n{k}",) for k in range(400)], "entity string")
    given = spark.createDataFrame([("n1", [1.0, 2.0])], "entity string, vec array<double>")
    out = VX.impute_vectors(names, given, dim=2).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 4 and out.count() == 400
