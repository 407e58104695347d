"""Whitening against the eigenvectors of the covariance formed in full."""

import math

import numpy as np
import pytest

from fieldsense.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, components=4):
    """``{vec_id: [(component, n, deviation, whitened up to sign, explained)]}`` with numpy on everything."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    ints = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v)) for _, v in kept]
    fit = sorted({tuple(x) for x in ints})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    xc = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    v = xc.T @ xc / n
    values, vectors = np.linalg.eigh(v)
    out = []
    for (i, _), x in zip(kept, ints):
        for c in range(1, min(components, dims) + 1):
            e, q = values[-c], vectors[:, -c]
            if e > 1e-9 * values[-1]:
                z = (np.array(x, dtype=float) - np.array(sums) / n) @ q / math.sqrt(e)
                out.append((i, c, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(z), e / np.trace(v)))
    return out


def got_of(df):
    return [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"])
            for r in df.collect()]


def close(got, want):
    got, want = sorted(got), sorted(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((160, 9)) * np.linspace(0.4, 2, 9)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_equals_brute_force(spark, cloud, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_BYTES", 9 * 8 * 7)       # several matrices a task
    close(got_of(W.whiten(spark.createDataFrame(cloud, SCHEMA).repartition(3))), brute(cloud))


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    out = W.whiten(table)
    assert out.agg({"identity_error": "max"}).first()[0] < 1e-12
    close(got_of(out), brute(rows))


def test_unusual_rows(spark, cloud):
    inf, nan = float("inf"), float("nan")
    odd = [(None, cloud[0][1]), (900, None), (901, [1.0, None]), (902, [inf]), (903, [0.5, nan]), (904, []),
           (905, [3.0, -2.0]), *[cloud[1]] * 50, (1, cloud[2][1])]
    rows = cloud + odd
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "'c' AS n", "2 AS component")
    got, want = got_of(W.whiten(df)), brute(rows)
    close([(-1 if g[0] is None else g[0], *g[1:]) for g in got], [(-1 if w[0] is None else w[0], *w[1:]) for w in want])
    assert not {900, 901, 902, 903} & {g[0] for g in got} and {904, 905} <= {g[0] for g in got}


def test_no_variance_and_empty_table(spark, cloud):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert W.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)]            # one direction only
    assert {g[1] for g in got_of(W.whiten(spark.createDataFrame(line, SCHEMA)))} == {1}


def test_huge_entries_do_not_overflow(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e9, 2.0]), (4, [5.0, 3.0])]
    got = got_of(W.whiten(spark.createDataFrame(rows, SCHEMA)))
    assert {g[0] for g in got} == {1, 2, 3, 4} and all(g[3] is None for g in got if g[0] < 3)


@pytest.mark.parametrize("values", [np.linspace(5, 1, 40), np.r_[np.full(6, 3.0), np.linspace(2, 0, 30)],
                                    np.r_[1e6, 1.0 + 1e-3 * np.arange(60)]])
def test_residuals_reach_double_precision(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values),) * 2))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, u = W.leading_pairs(lambda x: v @ x, len(v), 4)
    np.testing.assert_allclose(e, np.sort(values)[::-1][:4], rtol=1e-12, atol=1e-15 * values.max())
    assert np.abs(v @ u - u * e).max() < 1e-12 * values.max() and np.abs(u.T @ u - np.eye(4)).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 2))
    xs = W.in_step([W.minres(b[:, 0], 40, 1e-13), W.minres(b[:, 1], 40, 1e-13)], lambda v, which: a @ v)
    np.testing.assert_allclose(a @ np.column_stack(xs), b, atol=1e-9)
