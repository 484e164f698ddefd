"""The non-linear window model: gradients, sums over tasks, curved data, odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.operators import window_network as net
from wardlight.operators import windows
from wardlight.sources.stage import stage


def small_network(size=5, latent=2, width=3, seed=1):
    draw = np.random.default_rng(seed)
    shapes = {"W1": (size, width), "b1": (width,), "V": (size, latent), "W2": (width, latent),
              "W3": (latent, width), "b3": (width,), "U": (latent, size), "W4": (width, size)}
    return {n: draw.standard_normal(s) * 0.5 for n, s in shapes.items()}


def test_gradient_by_differences():
    p, x = small_network(), np.random.default_rng(2).standard_normal((7, 5))
    loss, gradient = net.loss_gradient(p, x)
    assert loss == pytest.approx(net.errors(p, x).sum())
    for name, values in p.items():
        for at in np.ndindex(values.shape):
            was = values[at]
            values[at] = was + 1e-6
            above = net.errors(p, x).sum()
            values[at] = was - 1e-6
            below = net.errors(p, x).sum()
            values[at] = was
            assert gradient[name][at] == pytest.approx((above - below) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("tasks", [1, 3, 80])
def test_sums_over_tasks(spark, tasks):
    x = np.random.default_rng(3).random((100, 5))
    p, mean = small_network(), x.mean(axis=0)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(tasks)
    rows, loss, gradient = net.summed_gradient(df, mean, p)
    want, parts = net.loss_gradient(p, x - mean)
    assert rows == 100 and loss == pytest.approx(want)
    assert np.allclose(gradient, net._flat(parts))
    assert net.summed_gradient(df.where(F.lit(False)), mean, p)[0] == 0


def curved(spark, users=40, days=15):
    """User-days on a circle: one number, the angle, tells a whole window."""
    draw = np.random.default_rng(5)
    rows = []
    for u in range(users):
        start = draw.random() * math.pi
        for d in range(days):
            turn = start + 0.15 * d
            rows.append((f"u{u:02d}", d, "train" if d < 12 else "test", math.cos(turn), math.sin(turn)))
    df = spark.createDataFrame(rows, "user string, d int, dataset_split string, a double, b double")
    return stage(df.withColumn("email_day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).drop("d"), "curved")


def test_curved_data_beats_the_linear_model(spark):
    days = curved(spark)
    scored = windows.scaled_windows(days, ["a", "b"])
    fit_on = stage(scored.where("dataset_split = 'train' and window is not null"), "fit")
    mean, start = net.linear_start(windows.fit_reconstruction(fit_on, 14, 1), width=16)
    flat = stage(fit_on.select(F.flatten("window").alias("x")), "flat")
    linear = windows.reconstruction_error(fit_on, windows.fit_reconstruction(fit_on, 14, 1), 14).agg(F.avg("lstm_raw_error")).first()[0]
    best, history = net.train(flat, mean, start, epochs=40)
    assert history[0] == pytest.approx(linear)
    assert history == sorted(history, reverse=True)
    assert history[-1] < 0.7 * linear
    got = net.network_error(fit_on, mean, best).agg(F.avg("lstm_raw_error")).first()[0]
    assert got == pytest.approx(history[-1])


def test_scored_days(spark):
    got = net.score_windows(curved(spark, users=8), ["a", "b"], latent=2, width=4, epochs=3).toPandas()
    assert len(got) == 8 * 15
    short = got.lstm_raw_error.isna()
    assert short.sum() == 8 * 6 and (got.lstm_risk_severity[short] == "undetermined").all()
    assert set(got.columns) >= {"lstm_score", "lstm_flag", "lstm_risk_severity"}
