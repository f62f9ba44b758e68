"""The regression's optimiser as a table of blocks: the same sums in parts and blocks, nothing of the model's size in the driver."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from shelfwise.operators import logistic as LG


def rows_of(x, y):
    return [(float(t), [int(j) for j in np.nonzero(r)[0]], [float(v) for v in r[np.nonzero(r)[0]]]) for r, t in zip(x, y)]


def test_parts_and_blocks_add_up(spark, monkeypatch):
    """Copies, an empty row and several parts, against a sum over all rows."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.standard_normal((20, 9)) * (rng.random((20, 9)) < 0.4), np.zeros((1, 9))])
    x, y, beta = np.vstack([x, x, x]), np.arange(63) % 2.0, np.linspace(-1, 1, 9)
    monkeypatch.setattr(LG, "BLOCK", 4)
    monkeypatch.setattr(LG, "PART_MOST", 40)
    data = spark.createDataFrame(rows_of(x, y), "label double, indices array<int>, values array<double>")
    dealt = LG.deal(data, 9)
    sizes = [r["count"] for r in dealt.rows.groupBy("part").count().collect()]
    dealt.forget()
    assert dealt.parts > 3 and sum(sizes) == 63 and max(sizes) < 63
    loss, g, by_intercept, n = LG.loss_and_gradient(data, 9, beta, -0.2)
    z = x @ beta - 0.2
    missed = 1 / (1 + np.exp(-z)) - y
    assert (loss, by_intercept, n) == pytest.approx((np.log1p(np.exp(z)).sum() - y @ z, missed.sum(), 63)) and g == pytest.approx(x.T @ missed)


def test_no_vector_of_the_models_size_reaches_the_driver(spark, monkeypatch):
    """what the driver collects stays far below a number for every coordinate."""
    size, seen, collect = 200_000, [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        seen.append(sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in rows for v in r))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    rows = [(float(k % 2), list(range(k, size, 10)), [1e-3 * (k + 1)] * (size // 10)) for k in range(10)]
    found = LG.fit_logistic(spark.createDataFrame(rows, "label double, indices array<int>, values array<double>"), size, 0.1, 1e-9, 2)
    assert len(found.history) == 3 and found.history[-1][1] < found.history[0][1]
    assert seen and max(seen) < size
    assert found.weights.count() == size


def test_a_step_writes_its_own_vectors_only(spark, monkeypatch):
    """a state has four vectors, not those of the last ten steps, and files of steps out of use are gone."""
    written, gone, write, drop = [], [], LG.stored, LG.forget

    def stored(df, name, *more):
        out = write(df, name, *more)
        if name == "optimiser":
            rows = out.drop("dots").where("block >= 0").collect()
            written.append((out, max(sum(len(x) for v in r for x in (v if isinstance(v, list) else [v]) if isinstance(x, (bytes, bytearray))) for r in rows)))
        return out

    def forget(df):
        gone.append(df._stored_at)
        drop(df)

    monkeypatch.setattr(LG, "stored", stored)
    monkeypatch.setattr(LG, "forget", forget)
    monkeypatch.setattr(LG, "MEMORY", 3)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 9)) * np.linspace(0.1, 3, 9)
    data = spark.createDataFrame(rows_of(x, (x[:, 0] * 9 + x[:, 8] > 0.1).astype(float)), "label double, indices array<int>, values array<double>")
    found = LG.fit_logistic(data, 9, 1e-3, 1e-6, 8)
    assert len(found.history) > 6 and [o for _, o, _, _ in found.history] == sorted((o for _, o, _, _ in found.history), reverse=True)
    assert max(most for _, most in written) <= 4 * 8 * 10
    assert all(state._stored_at in gone for state, _ in written)
