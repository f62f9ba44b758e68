import math

import numpy as np
import pytest
from llm_helpers import CLASHING

from shelfwise.llm import whitening as W


def vectors(n=300, d=12, seed=5, spread=None):
    rng = np.random.default_rng(seed)
    turned = np.linalg.qr(rng.standard_normal((d, d)))[0]
    scales = np.array(spread if spread is not None else [2.0 ** -k for k in range(d)])
    return ((rng.standard_normal((n, d)) * scales) @ turned).astype(np.float32)


def table(spark, rows):
    extra = [f"`{c}` string" for c in CLASHING]
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *("clash" for _ in extra)) for i, v in rows],
                                 ", ".join(["vec_id long", "embedding array<float>", *extra]))


def by_hand(rows, k=4):
    """x, n, S, covariance and its eigenvectors by numpy, and exact deviations."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = {pos: tuple(math.floor(256 * float(np.float32(c))) for c in v) for pos, (i, v) in enumerate(kept)}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], dtype=float) / n
    cov = centred.T @ centred / n
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    deviation = {p: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for p, v in x.items()}
    z = {p: (np.array([n * c - s for c, s in zip(v, sums)], dtype=float) / n) @ directions[:, order] / np.sqrt(values[order]) for p, v in x.items()}
    return kept, n, deviation, z, values[order] / np.trace(cov)


def check(got, rows, k=4):
    kept, n, deviation, z, explained = by_hand(rows, k)
    assert len(got) == len(kept) * k and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = sorted((i is None, i or 0, c + 1, deviation[p]) for p, (i, _) in enumerate(kept) for c in range(k))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.deviation) for r in got) == want
    for c in range(k):
        mine = sorted((r.vec_id, r.whitened) for r in got if r.component == c + 1 and r.vec_id is not None)
        hand = sorted((i, z[p][c]) for p, (i, _) in enumerate(kept) if i is not None)
        a, b = np.array([x for _, x in mine]), np.array([x for _, x in hand])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        found = {r.explained for r in got if r.component == c + 1}
        assert len(found) == 1 and abs(found.pop() / explained[c] - 1) < 1e-9


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_matches_numpy(spark, parts):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors())]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, None), (502, [None] * 12), (503, [math.nan] * 12), (504, [math.inf] + [0.0] * 11),
             (None, rows[3][1]), (505, [-0.0] * 12), (506, [1e-9] * 12), (507, [0.0] * 12)]
    check(W.whiten(table(spark, rows).repartition(parts)).collect(), rows)


def test_few_rows_and_no_variance(spark):
    out = W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained) for r in out} == {(1, 1, 0, None, None), (2, 1, 0, None, None)}
    out = W.whiten(table(spark, [(1, [1.0, 2.0, 0.5]), (2, [3.0, 2.0, 0.5])])).collect()
    assert [(r.component, abs(r.whitened) if r.whitened is not None else None, r.explained) for r in out if r.vec_id == 1] == [
        (1, pytest.approx(1.0), pytest.approx(1.0)), (2, None, 0.0), (3, None, 0.0)]
    assert W.whiten(table(spark, [])).collect() == [] and W.whiten(table(spark, [(1, None), (2, [])])).collect() == []


def test_other_lengths_and_huge_values(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(40, 5))] + [(90, [1.0]), (91, [1.0, 2.0])]
    assert {r.vec_id for r in W.whiten(table(spark, rows)).collect()} == set(range(40))
    huge = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [5.0, 5.0])]
    out = W.whiten(table(spark, huge)).collect()
    assert len(out) == 6 and {r.vec_id for r in out if r.deviation is None} >= {1, 2}
    wide = [(k, [float(x) * 4e4 for x in v]) for k, v in enumerate(vectors(30, 3))]
    check(W.whiten(table(spark, wide), components=3).collect(), wide, 3)


@pytest.mark.parametrize("spread", [[1, 1, 1, 1, 1, 1], [4, 4, 2, 2, 1, 1], [1, 1e-4, 1e-8, 1e-12, 0, 0], [1, 1, 1 + 1e-9, 1 - 1e-12, 0.5, 0.5], [5]])
def test_directions_of_clustered_values(spread):
    """Values to high accuracy and orthonormal directions, for equal, nearly equal, graded and missing values."""
    d = len(spread)
    rng = np.random.default_rng(d)
    u, v = np.linalg.qr(rng.standard_normal((40, d)))[0], np.linalg.qr(rng.standard_normal((d, d)))[0]
    m = (u * np.array(spread, dtype=float)) @ v.T
    values, directions = W.leading_directions(np.linalg.qr(m, mode="r"), d)
    want = np.sort(np.array(spread, dtype=float))[::-1] ** 2
    assert np.allclose(values, want, atol=1e-14 * want[0], rtol=1e-10)
    live = values > 1e-20 * values[0]
    gram = directions[:, live].T @ directions[:, live]
    assert np.abs(gram - np.eye(live.sum())).max() < 1e-12
    assert np.abs((m.T @ m) @ directions - directions * values).max() < 1e-12 * want[0]


def test_dqds_on_graded_and_random_bidiagonals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        for kind in range(3):
            a, b = rng.uniform(0.5, 2, n), rng.uniform(0, 2, n - 1)
            if kind == 1:
                a, b = a * 10.0 ** -np.arange(n) if n < 20 else a, b * 10.0 ** -np.arange(n - 1) if n < 20 else b
            if kind == 2:
                b = b * 0
            got = np.sort(W.dqds((a * a).tolist(), (b * b).tolist()))
            want = np.sort(np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)) ** 2
            assert np.allclose(got, want, rtol=1e-9, atol=1e-15 * want[-1])


def test_high_relative_accuracy():
    """A value of 10^-30 beside 1: found to twelve digits, where a covariance would know none."""
    a, b = [1.0, 1e-8, 1e-15], [1.0, 1e-8]
    got = sorted(W.dqds([x * x for x in a], [x * x for x in b]))
    from fractions import Fraction
    det = Fraction(a[0]) ** 2 * Fraction(a[1]) ** 2 * Fraction(a[2]) ** 2
    assert float(Fraction(got[0]) * Fraction(got[1]) * Fraction(got[2]) / det) == pytest.approx(1, rel=1e-12)
