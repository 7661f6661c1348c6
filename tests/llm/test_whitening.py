"""Whitening against numpy's own eigensolver and exact integer arithmetic."""
import math

import numpy as np
import pytest

from pagelake.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, deviation string, whitened int"


def clean(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, d):
    left = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in clean(rows) if len(v) == d]
    fit = sorted({x for _, x in left})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    return left, n, sums, y, y.T @ y / n


def vectors(kind):
    rng = np.random.default_rng(7)
    base = {"plain": lambda: rng.standard_normal((300, 24)) * np.linspace(3, 0.2, 24),
            "equal": lambda: np.vstack([np.eye(6) * 4, -np.eye(6) * 4]),  # all eigenvalues equal
            "flat": lambda: rng.standard_normal((200, 3)) @ rng.standard_normal((3, 10)).round() + 5,  # few have variance
            "big": lambda: rng.standard_normal((50, 5)) * 1e11}[kind]()
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [rows[3]] * 40 + [(None, rows[5][1]), (3, rows[6][1])]
    return rows + [(900, None), (901, [None] * len(rows[0][1])), (902, [float("nan")] * len(rows[0][1])), (903, rows[0][1][:-1] + [float("inf")]), (904, []), (905, [1.0])]


@pytest.mark.parametrize("kind", ["plain", "equal", "flat", "big"])
def test_whitening(spark, tmp_path, kind):
    rows = vectors(kind)
    d = len(rows[0][1])
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_embedding_whitening"](spark, str(tmp_path)).collect()
    left, n, sums, y, v = brute(rows, d)
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(16, int((values > d * 2.3e-16 * values.sum()).sum()))
    if kind == "flat":
        k = min(16, len({r.component for r in got}))
        assert k >= 3
    assert {r.component for r in got} == set(range(1, k + 1)) and len(got) == k * len(left)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) <= 1e-4
    for r in got:
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-4 * r.explained
    exact = sorted((-1 if i is None else i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in left)
    assert sorted((-1 if r.vec_id is None else r.vec_id, int(r.deviation_exact)) for r in got if r.component == 1) == exact
    assert all(r.deviation == (int(r.deviation_exact) if r.deviation_exact < 2**63 else None) for r in got)
    model = whitening.fit(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    c = model.components
    assert np.abs(c @ c.T - np.eye(k)).max() < 1e-12 and np.abs(v @ c.T - c.T * model.values).max() < 1e-10 * values[0]
    if kind == "plain":
        for at in range(k):
            sign = np.sign(vecs[:, at] @ c[at])
            want = sorted((-1 if i is None else i, float(sign * ((np.array(x) * n - np.array(sums)) / n) @ vecs[:, at] / math.sqrt(values[at]))) for i, x in left)
            have = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in got if r.component == at + 1)
            assert np.allclose([w for _, w in want], [w for _, w in have], rtol=1e-9, atol=1e-9)


def test_nothing_to_whiten(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0])] * 3 + [(2, None)], "vec_id int, embedding array<double>")
    for name, part in (("none", df.limit(0)), ("one", df), ("hollow", df.where("vec_id = 2"))):
        part.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = queries.QUERIES["op11_embedding_whitening"](spark, f"{tmp_path}/{name}")
        assert got.count() == 0 and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_eigenpairs(n):
    rng = np.random.default_rng(n)
    for a in (rng.standard_normal((n, n)), np.diag(np.repeat([3.0, 1.0], [n // 2, n - n // 2])), np.ones((n, n)), np.diag(10.0 ** -np.arange(n, dtype=float))):
        a = a @ a.T
        values, c = whitening.leading_eigenpairs(a, min(n, 16))
        want = np.linalg.eigvalsh(a)[::-1][: len(values)]
        assert np.abs(values - want).max() <= 1e-12 * want[0] and np.abs(c @ c.T - np.eye(len(c))).max() < 1e-12
        assert np.abs(a @ c.T - c.T * values).max() <= 1e-11 * want[0]
