"""Queries take all rows: against brute force on the tables and on small fixtures."""

import duckdb
import numpy as np
import pytest

from loomlake.operators import information, metrics
from loomlake.plans import catalog

DATA = "/root/testdata"


def silhouette_of(v, label):
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    out = []
    for i in range(len(v)):
        means = {c: gap[i, label == c].sum() / max(1, (label == c).sum() - (c == label[i])) for c in set(label)}
        own, other = means.pop(label[i]), min(means.values())
        out.append((other - own) / max(own, other) if (label == label[i]).sum() > 1 and max(own, other) > 0 else 0.0)
    return np.mean(out)


def tau_of(x, y):
    a, b = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


def test_silhouette_of_all_embeddings(spark):
    e = duckdb.sql(f"SELECT label, embedding FROM '{DATA}/sf0.001/embeddings.parquet'").df()
    want = silhouette_of(np.stack(e["embedding"].to_numpy()).astype(float), e["label"].to_numpy())
    assert catalog.queries()["A22_silhouette"](spark, f"{DATA}/sf0.001").first()[0] == pytest.approx(want, abs=2e-6)


def test_silhouette_in_blocks(spark):
    rng = np.random.default_rng(1)
    label = np.array([0] * 30 + [1] * 30 + [2])
    v = rng.normal(0, 1, (61, 3)) + label[:, None]
    v[5:9] = v[5]
    df = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(label, v, strict=True))] + [(99, 0, None)], "k long, l long, v array<double>")
    for rows in (7, 2048):
        assert metrics.silhouette(df, "l", "v", "k", rows).first()[0] == pytest.approx(silhouette_of(v, label), abs=1e-9)


def test_kendall_of_all_suppliers(spark):
    s = duckdb.sql(f"SELECT s_acctbal, s_nationkey FROM '{DATA}/sf0.1/supplier.parquet'").df().to_numpy().astype(float)
    assert catalog.queries()["A31_kendall_tau"](spark, f"{DATA}/sf0.1").first()[0] == pytest.approx(tau_of(*s.T), abs=1e-6)


@pytest.mark.parametrize("rows", [40, 50_000])
def test_kendall_in_blocks(spark, rows):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 90, 400).astype(float), rng.normal(0, 1, 400).round(1)
    x[:80] = 7
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    assert metrics.kendall_tau(df, "x", "y", rows).first()[0] == pytest.approx(tau_of(x, y), abs=1e-12)


def test_knn_co_information_of_all_rows(spark):
    rng = np.random.default_rng(3)
    y = np.array([0] * 3000 + [1] * 3000 + [2] * 3 + [3])
    x = rng.normal(0, 1, (len(y), 3)) + np.stack([y == 1, y * 0, y * 0], 1)
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y, strict=True)], "a double, b double, c double, y int")
    z = (x - x[y < 3].mean(0)) / x[y < 3].std(0)
    mi = {(i, j): information.knn_information(z[:, sorted({i, j})], y) for i in range(3) for j in range(i, 3)}
    for r in information.knn_co_information(df, ["a", "b", "c"], "y", leaf_rows=300).collect():
        assert r.coi == pytest.approx(mi[r.i, r.i] + mi[r.j, r.j] - mi[r.i, r.j], abs=1e-6)


def test_neighbours_in_buckets(monkeypatch):
    """Against all distances, on places that many points share but for noise; each point sees few others."""
    rng = np.random.default_rng(4)
    x, y = (rng.integers(0, m, 4000) + rng.normal(0, 1e-10, 4000) for m in (3, 40))
    x[:500], y[:500] = rng.normal(0, 9, 500), 2.0  # on a line
    gap = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(gap, np.inf)
    seen, gaps = [], information.Buckets.gaps
    monkeypatch.setattr(information.Buckets, "gaps", lambda *a: seen.append((out := gaps(*a)).size) or out)
    z = information.Buckets(x, y)
    near = z.back(information._near_others(z, 3, 3))
    assert (near == np.sort(gap, 1)[:, :3]).all()
    r = near[:, 2]
    within = z.back(information._within(z, z, z.placed(r, 0.0)))
    assert (within - (r > 0) == (gap < r[:, None]).sum(1)).all()
    assert sum(seen) < 200 * len(x)  # leaves of 512 rows saw thousands
    some = np.sort(np.r_[x, x[:9]])
    line = np.abs(some[:, None] - some)
    np.fill_diagonal(line, np.inf)
    r = information._line_near(some, 3)[:, 2]
    assert (r == np.sort(line, 1)[:, 2]).all()
    assert (information._line_within(some, some, r) - (r > 0) == (line < r[:, None]).sum(1)).all()


def test_knn_co_information_of_equal_rows_by_strips(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(c), int((a + b + d) % 3)) for a, b, c, d in rng.integers(0, [4, 9, 2, 2], (2500, 4))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    one, many = ({(r.i, r.j): r.coi for r in information.knn_co_information(df, ["a", "b", "c"], "y", leaf_rows=n).collect()} for n in (1 << 19, 150))
    assert one == pytest.approx(many, abs=1e-12) and one[0, 1] < -0.1
    assert len(set(one.values())) == 3
