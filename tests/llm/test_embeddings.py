"""Recall of the cap filters at any size, and odd tables of vectors."""

import math

import numpy as np
import pytest

from quillon.llm import capfilter, common


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def corpus(rng, shared, n, dims=64):
    """Unit vectors of which any two have a mean cosine of `shared`."""
    centre = unit(np.random.default_rng(0).standard_normal((1, dims)))
    return unit(math.sqrt(shared) * centre + math.sqrt(1 - shared) * unit(rng.standard_normal((n, dims))))


@pytest.mark.parametrize("n,shared", [(10**5, 0), (10**6, 0), (10**7, 0), (10**9, 0), (10**5, 0.75), (10**7, 0.75), (10**5, 0.97)])
def test_recall_at_any_size(n, shared, monkeypatch):
    """Pairs at the least cosine, other than those that the codes were chosen by, nearly all meet."""
    monkeypatch.setattr(capfilter, "TRIED", 512 if n < 10**9 else 256)
    rng = np.random.default_rng(3)
    filters = capfilter.Filters(n, corpus(rng, shared, 1024), 0.95)
    x = corpus(rng, shared, 600 if n < 10**9 else 300)
    away = rng.standard_normal(x.shape)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * unit(away - (away * x).sum(1, keepdims=True) * x)
    (r1, f1), (r2, f2) = filters.decode(x), filters.decode(y)
    per = np.bincount(r1, minlength=len(x))
    assert per.min() >= capfilter.FEWEST * len(filters.codes) and per.mean() < 2 * capfilter.PASSED * len(filters.codes)
    total = sum(c.filters for c in filters.codes)
    met = np.intersect1d(r1 * total + f1, r2 * total + f2) // total
    assert len(np.unique(met)) >= 0.99 * len(x)


def test_lists_of_filters():
    """Each filter of a code that reaches the threshold is listed, and no other."""
    rng = np.random.default_rng(1)
    for dims in (1, 2, 7, 64):
        x = unit(rng.standard_normal((300, dims)))
        code = capfilter.Code(5000, x, 2)
        row, found = code.decode(x)
        a, b = code._scores(x)
        sums = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        for k in range(len(x)):
            want = np.flatnonzero(sums[k] >= code.least)
            got = found[row == k]
            assert (got == want).all() if len(want) >= capfilter.FEWEST else set(want) <= set(got) and len(got) == min(capfilter.FEWEST, code.filters)


def brute(x, least=0.95):
    u = unit(np.array(x, np.float32).astype(float))
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near, common.lowest(np.arange(len(u)), *np.nonzero(near))


def test_shared_direction_and_groups(spark):
    rng = np.random.default_rng(4)
    x = list(corpus(rng, 0.75, 1200))
    for k in range(40):
        x += list(unit(x[k] + 0.03 * rng.standard_normal((3, 64))))
    near, parent = brute(x)
    got = {r.vec_id: r for r in capfilter.near_duplicates(spark, spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    assert near.sum() > 200 and sum(r.n_links for r in got.values()) >= 0.99 * near.sum()
    assert np.mean([got[k].component_id == parent[k] for k in range(len(x))]) > 0.99


def test_vectors_that_are_all_close(spark):
    """Where nearly all pairs are links, codes that cannot tell vectors apart give way to larger filters."""
    rng = np.random.default_rng(5)
    x = corpus(rng, 0.96, 400)
    near, parent = brute(x)
    got = {r.vec_id: r for r in capfilter.near_duplicates(spark, spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert near.mean() > 0.5 and sum(r.n_links for r in got.values()) >= 0.99 * near.sum() and all(got[k].component_id == parent[k] for k in range(len(x)))


def test_odd_vectors(spark):
    """Missing ids, several vectors of one id, repeated rows and columns with clashing names."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.02]), (None, [-1.0, 0.0]), (None, None), (9, [-1.0])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, rep string, dims string, filter string")
    got = sorted(capfilter.near_duplicates(spark, df).collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.component_id is None))
    assert len(got) == len(rows)
    assert [(r.vec_id, r.component_id) for r in got] == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (9, 9), (None, 1), (None, None), (None, None)]
    assert [r.n_links for r in got if r.vec_id == 3] == [2, 2]
