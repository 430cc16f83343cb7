"""Two layers of the relation-aware convolution against numpy."""

import numpy as np

from kgrec.operators import gcn as GC


def test_two_layers_match_numpy(spark):
    rng = np.random.default_rng(8)
    names, rel_names, dim = [f"e{k}" for k in range(7)], ["r", "s"], 4
    triples = sorted({(names[a], rel_names[r], names[b]) for a, r, b in zip(rng.integers(0, 7, 14), rng.integers(0, 2, 14), rng.integers(0, 7, 14), strict=True)})
    h = {n: rng.normal(size=dim) for n in names[:6]}
    rel = {r: rng.normal(size=dim) for r in rel_names}
    weights = [tuple(rng.normal(size=(dim, dim)) for _ in range(3)) for _ in range(2)]
    turn = [rng.normal(size=(dim, dim))]

    def layer(h, rel, w):
        out = {}
        for e in names:
            come = [h[s] - rel[r] for s, r, t in triples if t == e and s in h]
            go = [h[t] - rel[r] for s, r, t in triples if s == e and t in h]
            if e in h or come or go:
                mean = lambda m: np.mean(m, axis=0) if m else np.zeros(dim)
                out[e] = np.tanh(mean(come) @ w[0] + mean(go) @ w[1] + h.get(e, np.zeros(dim)) @ w[2])
        return out

    want = layer(layer(h, rel, weights[0]), {r: v @ turn[0] for r, v in rel.items()}, weights[1])
    frame = lambda d: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], "entity string, vec array<double>")
    got = GC.compgcn(spark.createDataFrame(triples, "head string, relation string, tail string"), frame(h), frame(rel), weights, turn)
    rows = {r.entity: r.vec for r in got.collect()}
    assert set(rows) == set(want)
    for e, v in want.items():
        np.testing.assert_allclose(rows[e], v, atol=1e-12)
