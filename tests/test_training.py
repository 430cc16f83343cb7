"""Trained vector models: gradients against finite differences and numpy, both ways of reading vectors, batches, resumed runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgrec.operators import models as M
from kgrec.operators import training as TR
from kgrec.sources.files import remove, scratch_path

DIM = 3
TRIPLES = [("a", "r", "b"), ("b", "r", "c"), ("a", "q", "c"), ("c", "q", "d"), ("d", "r", "a"), ("e", "r", "b"), ("b", "q", "b")]
SAMPLES = [("a", "r", "b", "d"), ("b", "q", "c", "a"), ("d", "r", "e", "e"), ("a", "r", "b", "c")]


@pytest.fixture
def read_as(spark):
    """Vectors are broadcast, or joined where nothing may be broadcast."""
    def set_way(way):
        if way == "joined":
            spark.conf.set("spark.kgrec.vectorBroadcastBytes", "0")
    yield set_way
    spark.conf.unset("spark.kgrec.vectorBroadcastBytes")


def given(spark, names, seed=0):
    rng = np.random.default_rng(seed)
    vectors = {n: rng.standard_normal(DIM) for n in names}
    return vectors, spark.createDataFrame([(n, v.tolist()) for n, v in vectors.items()], "entity string, vec array<double>")


def dense_conv_loss(vectors, rels, arrays, layers, comp, kind):
    """The mean loss of SAMPLES, written densely."""
    names = sorted({n for h, _, t in TRIPLES for n in (h, t)} | set(vectors))
    f = TR.COMPOSE[comp]
    x, r = {n: vectors.get(n, np.zeros(DIM)) for n in names}, dict(rels)
    for k in range(layers):
        new = {}
        for n in names:
            a = [f(x[h], r[p]) for h, p, t in TRIPLES if t == n]
            b = [f(x[t], r[p]) for h, p, t in TRIPLES if h == n]
            z = x[n] @ arrays[f"loop{k}"]
            z = z + (np.mean(a, axis=0) @ arrays[f"in{k}"] if a else 0) + (np.mean(b, axis=0) @ arrays[f"out{k}"] if b else 0)
            new[n] = np.tanh(z) if k + 1 < layers else z
        x, r = new, {p: v @ arrays[f"turn{k}"] for p, v in r.items()}
    score = {"inner": lambda h, p, t: (h + p) @ t, "distmult": lambda h, p, t: (h * p) @ t, "transe": lambda h, p, t: -((h + p - t) ** 2).sum()}[kind]
    return np.mean([np.logaddexp(0, score(x[h], r[p], x[n]) - score(x[h], r[p], x[t])) for h, p, t, n in SAMPLES])


@pytest.mark.parametrize(("layers", "comp", "kind", "way"), [(1, "sub", "inner", "broadcast"), (2, "mult", "distmult", "joined"), (3, "add", "transe", "broadcast")])
def test_convolution_gradients_are_finite_differences(spark, read_as, layers, comp, kind, way):
    read_as(way)
    vectors, vecs = given(spark, "abcdez")
    rng = np.random.default_rng(1)
    rels = {p: rng.standard_normal(DIM) for p in "qr"}
    arrays = {f"{w}{k}": rng.standard_normal((DIM, DIM)) for k in range(layers) for w in ("in", "out", "loop", "turn")}
    triples = spark.createDataFrame(TRIPLES, "head string, relation string, tail string").repartition(3)
    samples = spark.createDataFrame(SAMPLES, "head string, relation string, tail string, neg_tail string")
    new, moved = M.compgcn_step(triples, vecs, rels, arrays, samples, layers, 1.0, comp, kind, dim=DIM)
    got = {r.entity: np.array(r.vec) for r in new.collect()}

    def slope(change):
        e = 1e-5
        return (change(e) - change(-e)) / (2 * e)

    for name in "abcdez":
        for d in range(DIM):
            def at(e, name=name, d=d):
                v = {**vectors, name: vectors[name] + e * np.eye(DIM)[d]}
                return dense_conv_loss(v, rels, arrays, layers, comp, kind)
            assert vectors[name][d] - got[name][d] == pytest.approx(slope(at), abs=1e-8)
    for p, old in rels.items():
        for d in range(DIM):
            def at(e, p=p, d=d):
                return dense_conv_loss(vectors, {**rels, p: rels[p] + e * np.eye(DIM)[d]}, arrays, layers, comp, kind)
            assert old[d] - moved["rel"]["qr".index(p)][d] == pytest.approx(slope(at), abs=1e-8)
    for name, w in arrays.items():
        for i, o in ((0, 0), (1, 2), (2, 1)):
            def at(e, name=name, i=i, o=o):
                step = np.zeros((DIM, DIM))
                step[i, o] = e
                return dense_conv_loss(vectors, rels, {**arrays, name: arrays[name] + step}, layers, comp, kind)
            assert w[i, o] - moved[name][i, o] == pytest.approx(slope(at), abs=1e-8)


@pytest.mark.parametrize(("layers", "way"), [(0, "broadcast"), (0, "joined"), (1, "broadcast"), (2, "joined"), (3, "broadcast")])
def test_lightgcn_step_equals_numpy(spark, read_as, layers, way):
    read_as(way)
    pairs = [("u1", "i1"), ("u1", "i2"), ("u2", "i2"), ("u3", "i3"), ("u2", "i1"), ("u1", "i1")]
    samples = [("u1", "i1", "i3"), ("u2", "i2", "i3"), ("u1", "i2", "i4"), ("u1", "i1", "i4")]
    names = ["i1", "i2", "i3", "i4", "u1", "u2", "u3"]
    vectors, vecs = given(spark, names, 3)
    x = np.array([vectors[n] for n in names])
    a = np.zeros((7, 7))
    for u, i in set(pairs):
        a[names.index(u), names.index(i)] = a[names.index(i), names.index(u)] = 1
    deg = np.maximum(a.sum(axis=1), 1)
    a /= np.sqrt(deg[:, None] * deg)
    mean = sum(np.linalg.matrix_power(a, k) for k in range(layers + 1)) / (layers + 1)

    def loss(x):
        y, at = mean @ x, names.index
        fit = sum(np.logaddexp(0, -(y[at(u)] @ (y[at(p)] - y[at(n)]))) for u, p, n in samples)
        return (fit + 0.05 * sum((x[at(c)] ** 2).sum() for s in samples for c in s)) / len(samples)

    new = M.lightgcn_step(spark.createDataFrame(pairs, "a string, b string"), vecs, spark.createDataFrame(samples, "u string, p string, n string"), layers, 1.0, 0.1, DIM)
    got = {r.entity: np.array(r.vec) for r in new.collect()}
    for k, n in enumerate(names):
        for d in range(DIM):
            e = np.zeros_like(x)
            e[k, d] = 1e-5
            assert vectors[n][d] - got[n][d] == pytest.approx((loss(x + e) - loss(x - e)) / 2e-5, abs=1e-8)


def test_next_free_slots(spark):
    known = [(0, s) for s in (0, 1, 2, 5, 8, 9)] + [(1, s) for s in range(10)] + [(2, 9), (3, 4)]
    rows = spark.createDataFrame([*known, known[0]], "k long, slot long").repartition(4)
    got = {(r.k, r.slot): r.free for r in TR.next_free(rows, ["k"], 10).collect()}
    want = {}
    for k, s in known:
        mine = {x for q, x in known if q == k}
        want[k, s] = next((x % 10 for x in range(s, s + 10) if x % 10 not in mine), None)
    assert got == want
    asked = spark.createDataFrame([(k, 7 * j) for k in range(5) for j in range(4)], "k long, b long")
    out = TR.corrupted(asked, TR.next_free(rows, ["k"], 10), ["k"], "b", 10, 3, "neg").collect()
    assert {r.k for r in out} == {0, 2, 3, 4} and len(out) == 16  # a key that knows everything has none
    assert not {(r.k, r.neg) for r in out} & set(known)


def graph(spark):
    rng = np.random.default_rng(7)
    rows = {(f"e{int(h)}", f"r{int(h + t) % 3}", f"e{int(t)}") for h, t in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60) // 2, strict=True)}
    return spark.createDataFrame(sorted(rows), "head string, relation string, tail string")


def vectors_of(result):
    return {r.entity: np.array(r.vec) for r in result.vectors.collect()}


def close(a, b, tol=1e-9):
    return a.keys() == b.keys() and all(np.abs(a[k] - b[k]).max() < tol for k in a)


def test_convolution_training_learns(spark):
    result = M.compgcn_model(graph(spark), layers=1, epochs=3, dim=4)
    assert result.losses[-1] < result.losses[0] and result.vectors.count() == 12 and result.relations.count() == 3


@pytest.mark.parametrize("model", ["triples", "lightgcn"])
def test_training_learns_resumes_and_ignores_partitions(spark, model):
    def train(parts, epochs, path=None, **more):
        if model == "lightgcn":
            rng = np.random.default_rng(2)
            rows = sorted({(int(u), int(i), int(i % 4 != 3)) for u, i in zip(rng.integers(0, 15, 70), rng.integers(0, 9, 70), strict=True)})
            df = spark.createDataFrame(rows, "user_id long, item_id long, rating int").repartition(parts)
            items = spark.createDataFrame([(i,) for i in range(11)], "item_id long")
            return M.lightgcn_model(df, items, 2, epochs, dim=4, batch_rows=40, log_path=path)
        return M.triple_model(graph(spark).repartition(parts), epochs=epochs, dim=4, batch_rows=30, log_path=path, **more)

    whole = train(1, 3)
    assert whole.losses[-1] < whole.losses[0] and len(whole.losses) == 3
    path = scratch_path(spark, "epochs")
    log = TR.EpochLog(spark, path, {})
    train(5, 2, path)
    assert log.committed() == [1, 2]
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/epoch-3/rows")  # killed before the commit
    resumed = train(2, 3, path)
    assert log.committed() == [2, 3]
    assert close(vectors_of(whole), vectors_of(resumed)) and resumed.losses == pytest.approx(whole.losses)
    assert train(1, 3, path).losses == resumed.losses  # nothing left to run
    if model == "triples":
        with pytest.raises(ValueError, match="other settings"):
            train(1, 3, path, lr=0.5)
    remove(spark, path)


def test_batches_deal_every_row_once(spark):
    rows = spark.range(1000).withColumn("x", F.col("id") % 7)
    parts = TR.dealt(rows, ["id", "x"], 3, 4)
    assert sum(p.count() for p in parts) == 1000 and parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct().count() == 1000
    assert min(p.count() for p in parts) > 180


def scorer_samples(n, dim=4):
    rng = np.random.default_rng(8)
    return [(rng.standard_normal(dim).tolist(), rng.standard_normal(dim).tolist(), float(k % 2)) for k in range(n)]


def test_one_copy_of_the_scorer_is_plain_mini_batch_adam(spark):
    from kgrec.operators import scorer as S
    rows = scorer_samples(50)
    df = spark.createDataFrame(rows, "u array<double>, v array<double>, y double")
    res = S.mlp_train(df, epochs=2, lr=0.01, seed=5, dim=4, batch=16)
    keyed = sorted(df.select("u", "v", "y", F.xxhash64("u", "v", "y").alias("k")).collect(), key=lambda r: r.k)
    u, v, y = (np.array([r[c] for r in keyed]) for c in ("u", "v", "y"))
    th, t, losses = S.init_params(4, 5), 0, []
    m, s = np.zeros_like(th), np.zeros_like(th)
    for epoch in range(2):
        order, total = np.random.default_rng([5, epoch, 0]).permutation(50), 0.0
        for at in range(0, 50, 16):
            rows_ = order[at:at + 16]
            g, loss = S.backward(th, u[rows_], v[rows_], y[rows_], 4)
            g, t, total = g / len(rows_), t + 1, total + loss
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            th = th - 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
        losses.append(total / 50)
    assert np.allclose(res.theta, th, atol=1e-12) and res.losses == pytest.approx(losses)


def test_copies_of_the_scorer_average_in_a_tree(spark, monkeypatch):
    from kgrec.operators import scorer as S
    rows = scorer_samples(60) + [scorer_samples(1)[0]] * 40  # a sample that many rows repeat is dealt over the copies as well
    df = spark.createDataFrame(rows, "u array<double>, v array<double>, y double")
    data, copies = S.packed_copies(df, 4, copy_rows=10)
    sizes = [r.n for r in data.collect()]
    assert copies == 10 and sum(sizes) == 100 and max(sizes) < 25
    flat = S.mlp_train(df.repartition(1), epochs=2, dim=4, batch=4, copy_rows=10)
    monkeypatch.setattr(S, "FAN_IN", 3)  # ten copies, then four, then two
    tree = S.mlp_train(df.repartition(7), epochs=2, dim=4, batch=4, copy_rows=10)
    assert np.allclose(flat.theta, tree.theta, atol=1e-12) and flat.losses == pytest.approx(tree.losses)


def test_network_scores_blocks_for_whole_catalogue_lists(spark, monkeypatch):
    from kgrec.operators import rank as R
    from kgrec.operators import scorer as S
    rng = np.random.default_rng(3)
    u, v = rng.standard_normal((7, 4)), rng.standard_normal((11, 4))
    weights = [rng.standard_normal(shape) for shape in S.layer_shapes(4)]
    theta = S.import_weights(weights, 4)
    assert all((w == x).all() and not b.any() for w, (x, b) in zip(weights, S.unpack(theta, 4), strict=True))
    with pytest.raises(ValueError, match="shapes"):
        S.import_weights(weights[1:], 4)
    theta = rng.standard_normal(S.n_params(4))
    monkeypatch.setattr(S, "CELLS", 25)
    every = np.array([S.forward(theta, np.repeat(u[k:k + 1], 11, axis=0), v, 4) for k in range(7)])
    assert np.allclose(S.block_scores(theta, 4)(u, v), every)
    users = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(u)], "user_id long, vec array<double>")
    items = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "item_id long, vec array<double>")
    seen = spark.createDataFrame([(k, j) for k in range(7) for j in range(k)], "user_id long, item_id long")
    got = R.topk_scored_items(users, items, seen, 3, score=S.block_scores(theta, 4), user_block=3, item_block=4).collect()
    for k in range(7):
        want = sorted((-every[k, j], j) for j in range(k, 11))[:3]
        mine = sorted((r.rank, r.item_id, r.score) for r in got if r.user_id == k)
        assert [m[1] for m in mine] == [w[1] for w in want] and np.allclose([m[2] for m in mine], [-w[0] for w in want])


def test_dictionary_table(spark, tmp_path):
    from kgrec.sources import files as FS
    FS.write_dictionary(spark.createDataFrame([("b", 2), ("a", 1)], "name string, id int"), str(tmp_path / "d"))
    assert sorted(map(tuple, FS.read_dictionary(spark, str(tmp_path / "d")).collect())) == [("a", 1), ("b", 2)]
