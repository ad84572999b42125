"""op13 against numpy in double precision; the refinement on clustered and tiny eigenvalues."""

import numpy as np
import pytest

from scour.llm.common import ship
from scour.llm.op13_whitening import WIDE, deviations, eigen, fit, refine, usable, whiten

SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("values", [
    np.r_[np.full(5, 3.0), 2 + 1e-9 * np.arange(5), 1 + 1e-13 * np.arange(5), np.linspace(0.1, 0.9, 20)],
    10.0 ** -np.arange(40.0), np.ones(12), np.r_[5.0, np.zeros(6)]])
def test_eigen_to_double_precision(values):
    r = np.random.default_rng(0)
    n = len(values)
    q = np.linalg.qr(r.standard_normal((n, n)))[0].astype(WIDE)
    a = ((q * values.astype(WIDE)) @ q.T).astype(float)
    a = (a + a.T) / 2
    got, x = eigen(a)
    size = np.abs(a).max()
    assert np.abs(got - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * n * size
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-14
    assert np.abs(a @ x - x * got).max() < 1e-13 * size


def test_sub_solve_separates_a_cluster():
    # two eigenvalues 1e-8 apart: float32 vectors are an arbitrary mixture of theirs
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((20, 20)))[0].astype(WIDE)
    values = np.r_[1, 1 + 1e-8, np.linspace(2, 3, 18)].astype(WIDE)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = refine(a, np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE))
    for i, want in ((18, q[:, 1]), (19, q[:, 0])):
        want = want / np.sqrt((want * want).sum())
        assert 1 - abs(float(x[:, i] @ want)) < 1e-12


def _vectors(n=300, d=12, seed=0):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, d)) * np.linspace(0.2, 3, d)).astype(np.float32)


def test_equals_numpy(spark):
    ship(spark)
    v = _vectors()
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(v)]
    bad = [(1000, None), (1001, [float("nan")] * 12), (1002, [float("inf")] + [0.0] * 11), (1003, [None] + [0.0] * 11), (1004, []), (1005, [1.0, 2.0])]
    copies = [(2000 + i, rows[5][1]) for i in range(100)] + [(7, rows[7][1])]
    keep = rows + copies
    got = whiten(spark.createDataFrame(keep + bad, SCHEMA).repartition(5), components=8).toPandas()
    x = np.floor(np.array([r[1] for r in keep], dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = x - s / n
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == n * 8 and set(got.n) == {n}
    assert got.identity_error.max() < 1e-12
    far = ((n * x.astype(object) - s) ** 2).sum(1)
    want_w = z @ q[:, :8] / np.sqrt(e[:8])
    for k in range(8):
        one = got[got.component == k + 1].sort_values(["vec_id", "whitened"])
        assert np.allclose(one.explained, e[k] / e.sum(), rtol=1e-10)
        ids = np.array([r[0] for r in keep])
        order = np.lexsort((want_w[:, k], ids))
        a, b = one.whitened.to_numpy(), want_w[order, k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert [int(d) for d in one.deviation] == [int(far[i]) for i in order]


def test_empty_single_constant_and_clashing(spark):
    ship(spark)
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.whitened, r.explained, int(r.deviation), r.identity_error) for r in one] == [(0.0, 0.0, 0, 0.0)] * 2
    df = spark.createDataFrame([(i, [float(i), 1.0], 5, "c") for i in range(10)], SCHEMA + ", n int, c string")
    got = whiten(df).toPandas()
    assert set(got[got.component == 2].whitened) == {0.0} and got.identity_error.max() < 1e-12
    assert abs(got[got.component == 1].whitened.to_numpy().std() - 1) < 1e-12


def test_extreme_entries_stay_exact(spark):
    ship(spark)
    rows = [(i, [3e38 if i == 0 else -1e20 if i == 1 else float(i), 0.5 * i]) for i in range(20)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 40 and np.isfinite(got.whitened).all()
    x = np.clip(np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 64), -(1 << 52), 1 << 52).astype(np.int64).astype(object) + 1_000_000
    s = x.sum(0)
    want = {i: int(((20 * x[i] - s) ** 2).sum()) for i in range(20)}
    assert {r.vec_id: int(r.deviation) for r in got.itertuples()} == want
    assert deviations(x.astype(np.int64), 20, s) == [want[i] for i in range(20)]


def test_layout_does_not_matter(spark):
    ship(spark)
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(_vectors(200, 6))], SCHEMA)
    a, b = (fit(usable(df.repartition(p)), 6) for p in (1, 9))
    assert np.abs(a.directions - b.directions).max() < 1e-12
