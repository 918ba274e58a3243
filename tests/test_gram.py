"""Statistics of all pairs without a row a pair."""

import numpy as np
import pytest

from gleaner.operators import vectors


@pytest.mark.parametrize(("n", "block"), [(2, 4), (3, 100), (40, 100), (40, 7), (41, 6)])
def test_off_diagonal_is_exact(spark, n, block):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 5))
    x[1] = x[0]  # a tie, and cosines of 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"k{k}", v.tolist()) for k, v in enumerate(x)], "label string, proto array<double>")
    r = vectors.off_diagonal(df, block=block).first()
    c = (x @ x.T)[~np.eye(n, dtype=bool)]
    want = (c.mean(), np.median(c), np.percentile(c, 95), c.max(), c.min())
    assert np.allclose([r["mean"], r["median"], r["p95"], r["max"], r["min"]], want, atol=1e-12)


def test_fewer_than_two(spark):
    none = spark.createDataFrame([], "label string, proto array<double>")
    one = spark.createDataFrame([("a", [1.0])], "label string, proto array<double>")
    assert list(vectors.off_diagonal(none).first()) == list(vectors.off_diagonal(one).first()) == [None] * 5


def test_keys_keep_the_order_of_doubles():
    x = np.sort(np.concatenate([np.random.default_rng(1).normal(size=100), [0.0, -1.0, 1.0, 1e-300, -1e-300]]))
    keys = vectors._ordered_keys(x)
    assert (np.diff(keys.astype(object)) >= 0).all()
    assert [vectors._double_of(int(k)) for k in keys] == x.tolist()
