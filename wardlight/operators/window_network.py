"""A non-linear encoder-decoder for windows of user-days, trained by gradients summed over tasks.

With c = x - mean, and a bottleneck z of `latent` values:

    h = tanh(c W1 + b1)    z = c V + h W2
    g = tanh(z W3 + b3)    y = z U + g W4

The error of a window is the mean square of y - c. Training starts at W2 = W4 = 0 with V and U
the leading principal components, so the network begins as the linear model and its error on the
train windows never ends above the linear one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from wardlight import fixed
from wardlight.operators.windows import fit_reconstruction, scaled_windows, score_errors
from wardlight.sources.stage import drop_stage, stage

Params = dict[str, np.ndarray]

EPOCHS = 60
MEMORY = 10      # steps remembered for the quasi-Newton direction
FIRST_STEP = 0.1  # length of the first step
WIDTH = 64       # units of each hidden layer
BLOCK = 512      # windows whose gradient is taken at once; their layers stay in the processor's cache
BRANCHES = 64    # partial sums of the gradient below the last one
NAMES = ("W1", "b1", "V", "W2", "W3", "b3", "U", "W4")


def linear_start(model, width: int = WIDTH, seed: int = 7) -> tuple[np.ndarray, Params]:
    """(mean, parameters) of a network that equals the fitted linear model.

    The hidden layers get random weights, scaled so that their inputs vary by about one.
    """
    scaler, pca = model.stages
    mean, spread = np.asarray(scaler.mean), np.asarray(scaler.std) ** 2
    basis = pca.pc.toArray()
    size, latent = basis.shape
    along = np.maximum(np.asarray(pca.explainedVariance) * spread.sum(), 1e-6)
    draw = np.random.default_rng(seed)
    return mean, {
        "W1": draw.standard_normal((size, width)) / np.sqrt(max(spread.sum(), 1e-6)), "b1": np.zeros(width),
        "V": basis.copy(), "W2": np.zeros((width, latent)),
        "W3": draw.standard_normal((latent, width)) / np.sqrt(along * latent)[:, None], "b3": np.zeros(width),
        "U": basis.T.copy(), "W4": np.zeros((width, size)),
    }


def _forward(p: Params, c: np.ndarray):
    h = np.tanh(c @ p["W1"] + p["b1"])
    z = c @ p["V"] + h @ p["W2"]
    g = np.tanh(z @ p["W3"] + p["b3"])
    return h, z, g, z @ p["U"] + g @ p["W4"] - c


def errors(p: Params, c: np.ndarray) -> np.ndarray:
    """Mean squared error of every centred window."""
    return (_forward(p, c)[3] ** 2).mean(axis=1)


def loss_gradient(p: Params, c: np.ndarray) -> tuple[float, Params]:
    """Sum of the windows' errors and its gradient."""
    h, z, g, off = _forward(p, c)
    dy = 2.0 / c.shape[1] * off
    dg = (dy @ p["W4"].T) * (1 - g * g)
    dz = dy @ p["U"].T + dg @ p["W3"].T
    dh = (dz @ p["W2"].T) * (1 - h * h)
    return float((off ** 2).mean(axis=1).sum()), {
        "W1": c.T @ dh, "b1": dh.sum(axis=0), "V": c.T @ dz, "W2": h.T @ dz,
        "W3": z.T @ dg, "b3": dg.sum(axis=0), "U": z.T @ dy, "W4": g.T @ dy}


def _flat(p: Params) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in NAMES])


def _shaped(flat: np.ndarray, like: Params) -> Params:
    cuts = np.cumsum([like[n].size for n in NAMES])[:-1]
    return {n: part.reshape(like[n].shape) for n, part in zip(NAMES, np.split(flat, cuts))}


def summed_gradient(windows: DataFrame, mean: np.ndarray, p: Params) -> tuple[int, float, np.ndarray]:
    """(windows, summed error, summed gradient) over column `x` of a stored table.

    A task reads its windows in Arrow batches and returns one vector of the parameters' size; the
    vectors meet in BRANCHES partial sums and one last sum, so no task holds more than one sum.
    """
    size = sum(v.size for v in p.values())

    def task(batches):
        total = np.zeros(size + 2)
        for batch in batches:
            # The flat values of the batch; an object per window would cost as much as its gradient.
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean))
            for part in np.split(x, range(BLOCK, len(x), BLOCK)):
                if len(part):
                    loss, gradient = loss_gradient(p, part - mean)
                    total += np.concatenate([[len(part), loss], _flat(gradient)])
        yield pa.RecordBatch.from_pydict({"sums": [total.tolist()]})

    partial = windows.select("x").mapInArrow(task, "sums array<double>")
    branches = partial.groupBy((F.spark_partition_id() % BRANCHES).alias("branch")).agg(
        Summarizer.sum(array_to_vector("sums")).alias("v"))
    # Grouped by a constant: a table without windows gives no row.
    total = branches.groupBy(F.lit("all").alias("all")).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v")).first()
    if total is None:
        return 0, 0.0, np.zeros(size)
    return round(total["v"][0]), total["v"][1], np.asarray(total["v"][2:])


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton direction of descent from the last (step, change of gradient) pairs."""
    q, shares = gradient.copy(), []
    for moved, turned in reversed(pairs):
        shares.append(moved @ q / (moved @ turned))
        q -= shares[-1] * turned
    if pairs:
        moved, turned = pairs[-1]
        q *= moved @ turned / (turned @ turned)
    for (moved, turned), share in zip(pairs, reversed(shares)):
        q += moved * (share - turned @ q / (moved @ turned))
    return -q


def train(windows: DataFrame, mean: np.ndarray, start: Params, epochs: int = EPOCHS) -> tuple[Params, list[float]]:
    """The trained parameters, and the mean error of the first and of every accepted epoch (falling).

    One job an epoch sums the gradient over all windows; the step is taken on the driver on vectors
    of the parameters' size: limited-memory quasi-Newton with the last MEMORY steps, halved until
    the error falls (each trial is an epoch). The result does not depend on how windows are dealt
    to tasks, but for rounding. Without windows the start is returned.
    """
    at = _flat(start)

    def measure(flat: np.ndarray) -> tuple[float, np.ndarray]:
        rows, loss, gradient = summed_gradient(windows, mean, _shaped(flat, start))
        return (loss / rows, gradient / rows) if rows else (0.0, gradient)

    error, gradient = measure(at)
    history, pairs, scale = [error], [], 1.0
    for _ in range(epochs):
        if not gradient.any():
            break
        direction = _direction(gradient, pairs)
        if not pairs:
            direction *= min(1.0, FIRST_STEP / np.linalg.norm(direction))
        slope = direction @ gradient
        tried = at + scale * direction
        found, there = measure(tried)
        if not found <= error + 1e-4 * scale * slope:
            scale /= 4
            if scale < 1e-9:
                break
            continue
        moved, turned = tried - at, there - gradient
        if moved @ turned > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(turned):
            pairs = [*pairs, (moved, turned)][-MEMORY:]
        at, error, gradient, scale = tried, found, there, 1.0
        history.append(error)
    return _shaped(at, start), history


def network_error(windows: DataFrame, mean: np.ndarray, p: Params, output: str = "lstm_raw_error") -> DataFrame:
    """Add the error of column `window` (null without a full window), in Arrow batches with no shuffle."""

    @F.pandas_udf("double")
    def error(x: pd.Series) -> pd.Series:
        there = x.notna().to_numpy()
        out = np.full(len(x), np.nan)
        if there.any():
            out[there] = errors(p, np.stack(x[there].to_numpy()) - mean)
        return pd.Series(out)

    return windows.withColumn(output, F.when(F.col("window").isNotNull(), error(F.flatten("window")))).drop("window")


def score_windows(user_days: DataFrame, features=fixed.BEHAVIOR_FEATURES, latent: int = 32, rows: int = fixed.WINDOW_ROWS,
                  width: int = WIDTH, epochs: int = EPOCHS) -> DataFrame:
    """Fit on train windows and score every user-day. `user_days` is a stored table.

    Columns, thresholds and severities are those of `windows.score_windows`; the errors come from the
    trained network in place of the linear model.
    """
    features = list(features)
    dimension = rows * len(features)
    windows = stage(scaled_windows(user_days, features, rows=rows), "scaled-windows")
    chosen = windows.where((F.col("dataset_split") == "train") & F.col("window").isNotNull())
    mean, start = linear_start(fit_reconstruction(chosen, dimension, latent), width)
    fit_on = stage(chosen.select(F.flatten("window").alias("x")), "train-windows")
    network, _ = train(fit_on, mean, start, epochs)
    scored = stage(network_error(windows, mean, network), "network-errors")
    drop_stage(windows, fit_on)
    return score_errors(scored)
