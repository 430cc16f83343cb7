"""Operator 11 against numpy's eigenvectors."""

import numpy as np
import pytest

from kgrec.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def expected(vectors, components):
    """Fit size, exact deviations, absolute whitened rows and explained shares, by numpy."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = (fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    white = (x - sums / n) @ w / np.sqrt(e)
    return n, [int(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums))) for row in x], np.abs(white), e / np.trace(v)


@pytest.mark.parametrize("kind", ["random", "equal", "low rank", "clusters", "diagonal", "one"])
def test_split_gives_eigenvectors(kind):
    rng = np.random.default_rng(4)
    n = 1 if kind == "one" else 24
    a = {"random": lambda: rng.standard_normal((n, n)), "one": lambda: np.array([[2.0]]), "equal": lambda: np.eye(n),
         "low rank": lambda: rng.standard_normal((n, 5)), "diagonal": lambda: np.diag(np.arange(n) % 4 + 0.5),
         "clusters": lambda: np.linalg.qr(rng.standard_normal((n, n)))[0] * np.sqrt(np.repeat([9, 9 - 1e-9, 1, 1e-12], 6))}[kind]()
    a = a @ a.T
    e, v = whitening.split(a)
    scale = np.linalg.norm(a)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ v - v * e) <= 1e-13 * scale and np.abs(v.T @ v - np.eye(len(a))).max() < 1e-13


def test_polar_factor_is_orthogonal():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    u = whitening.polar(a)
    e, v = np.linalg.eigh(a)
    assert np.allclose(u, v @ np.diag(np.sign(e)) @ v.T, atol=1e-12)


def test_query_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, white, explained = expected(table.embedding.tolist(), 4)
    got = queries.op11_qdwh_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 4 * len(table) and got.component.tolist() == [1, 2, 3, 4] * len(table)
    assert set(got.n) == {n}
    assert got.deviation.tolist() == np.repeat(deviation, 4).tolist()
    assert np.abs(np.abs(got.whitened.to_numpy().reshape(-1, 4)) - white).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] < 1e-9


SCHEMA = "vec_id bigint, embedding array<float>, x string, component int, n string"


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(k, [float(c) for c in np.float32(rng.standard_normal(3) * 3)]) for k in range(40)]
    good += [(None, good[0][1]), (7, good[1][1]), (7, good[1][1])]  # null id, repeated ids and rows
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]), (94, [])]
    rows = spark.createDataFrame([(k, v, "x", 1, "n") for k, v in [*good, *bad]], SCHEMA).repartition(5)
    got = whitening.whiten(rows, whitening.fit(whitening.fit_list(rows), 4)).toPandas()
    assert len(got) == 3 * len(good)  # three dimensions: three components
    n, deviation, white, explained = expected([v for _, v in good], 3)
    assert set(got.n) == {n} == {40}
    assert sorted(got.deviation) == sorted(np.repeat(deviation, 3).tolist())
    first = got[got.component == 1]
    assert np.allclose(np.sort(np.abs(first.whitened)), np.sort(white[:, 0]), atol=1e-9)
    assert got[got.vec_id.isna()].shape[0] == 3
    assert set(got.deviation_digits) == set(map(str, deviation))


def test_no_variance_large_entries_and_empty_tables(spark):
    same = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id int, embedding array<double>")
    got = whitening.whiten(same, whitening.fit(whitening.fit_list(same))).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    line = spark.createDataFrame([(1, [2.0, 3.0]), (2, [4.0, 3.0])], "vec_id int, embedding array<double>")
    got = whitening.whiten(line, whitening.fit(whitening.fit_list(line))).collect()
    assert [abs(r.whitened) for r in got if r.component == 1] == pytest.approx([1, 1])
    assert {(r.whitened, r.explained) for r in got if r.component == 2} == {(None, 0.0)}
    large = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e9, 2.0])], "vec_id int, embedding array<double>")
    got = whitening.whiten(large, whitening.fit(whitening.fit_list(large))).collect()
    top = [(1 << 63) - 1, -(1 << 63), 256 * 5 * 10 ** 9]
    for r in got:
        want = (3 * top[r.vec_id - 1] - sum(top)) ** 2 + (3 * [0, 256, 512][r.vec_id - 1] - 768) ** 2
        assert int(r.deviation_digits) == want and r.deviation is None
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.fit(whitening.fit_list(none)) is None
    assert whitening.whiten(none, None).count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        whitening.fit(whitening.fit_list(mixed))
