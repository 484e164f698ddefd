"""The gradient of a task is taken over blocks of its windows and does not depend on their size."""

import numpy as np

from wardlight.operators import window_network


def test_gradient_by_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    x, mean, d = rnd.standard_normal((53, 6)), rnd.standard_normal(6), 6
    shapes = {"W1": (d, 4), "b1": (4,), "V": (d, 2), "W2": (4, 2), "W3": (2, 4), "b3": (4,), "U": (2, d), "W4": (4, d)}
    p = {n: rnd.standard_normal(s) for n, s in shapes.items()}
    table = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").coalesce(1)
    loss, gradient = window_network.loss_gradient(p, x - mean)
    whole = window_network.loss_gradient

    def small(p, c):
        assert len(c) <= 10
        return whole(p, c)

    monkeypatch.setattr(window_network, "BLOCK", 10)
    monkeypatch.setattr(window_network, "loss_gradient", small)
    rows, error, got = window_network.summed_gradient(table, mean, p)
    assert rows == 53 and np.isclose(error, loss)
    assert np.allclose(got, np.concatenate([gradient[n].ravel() for n in window_network.NAMES]))
