"""Linear-chain conditional random field in numpy: training, forward-backward and Viterbi in batches.

A token's features are ids below `width`; a model is a weight table (width, labels), start
weights and transitions. Chains of a batch are worked together, longest first, so each
step is one array operation over the chains that are still running.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray      # (width, labels)
    start: np.ndarray        # (labels,)
    steps: np.ndarray        # (labels, labels): from, to


def lay_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, running): chains by falling length, their first token, and how many
    chains have a token at each step."""
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(lengths) else np.zeros(0, np.int64)
    most = int(lengths.max()) if len(lengths) else 0
    running = np.searchsorted(-lengths[order], -np.arange(most), side="left")
    return order, first.astype(np.int64), running


def forward_backward(scores: np.ndarray, lengths: np.ndarray, model: Model):
    """(forward, emission times backward) per token, each row up to a factor, and the sum of the
    log partition functions. `scores` holds one row per token, chains one after the other.

    Works step by step on blocks that hold one token of every running chain.
    """
    _, first, running = lay_out(lengths)
    if not len(scores):
        return scores, scores, scores, 0.0
    top = scores.max(axis=1, keepdims=True)
    e, logs = np.exp(scores - top), float(top.sum())
    spots = np.concatenate([first[:n] + t for t, n in enumerate(running)])  # by step, then chain
    edges = np.concatenate([[0], np.cumsum(running)])
    rows = e[spots]
    move, begin = np.exp(model.steps), np.exp(model.start)
    ahead, back = np.empty_like(rows), rows.copy()
    for t, n in enumerate(running):
        lo, hi = edges[t], edges[t + 1]
        a = begin * rows[lo:hi] if t == 0 else (ahead[edges[t - 1]:edges[t - 1] + n] @ move) * rows[lo:hi]
        total = a.sum(axis=1, keepdims=True)
        logs += float(np.log(total).sum())
        np.divide(a, total, out=ahead[lo:hi])
    for t in range(len(running) - 2, -1, -1):
        n, lo = running[t + 1], edges[t]
        b = back[edges[t + 1]:edges[t + 2]] @ move.T
        back[lo:lo + n] *= b / b.sum(axis=1, keepdims=True)
    out = np.empty((2, *rows.shape))
    out[0, spots], out[1, spots] = ahead, back
    return out[0], out[1], e, logs


def marginals(scores: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """(token, label) probabilities by forward-backward."""
    ahead, back, e, _ = forward_backward(scores, lengths, model)
    p = ahead * (back / np.maximum(e, 1e-300))
    return p / p.sum(axis=1, keepdims=True)


def certain(scores: np.ndarray, lengths: np.ndarray, model: Model, label: int = 0) -> np.ndarray:
    """Chains whose best path surely has `label` throughout.

    A run of m other labels gains at most m + 1 transitions (one may be the start), each at most the range of the
    transition weights; if `label` leads by more than twice that at every word, no run pays.
    """
    gap = max(np.ptp(model.steps), np.ptp(model.start))
    lead = scores[:, label] - np.delete(scores, label, axis=1).max(axis=1)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return np.minimum.reduceat(lead, heads) > 2 * gap


def viterbi(scores: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """The best label of every token (ties: the smaller label)."""
    order, first, running = lay_out(lengths)
    came = np.zeros((len(scores), len(model.labels)), np.int8)
    best = np.zeros((len(lengths), len(model.labels)))
    for t, n in enumerate(running):
        at = first[:n] + t
        if t == 0:
            best[:n] = model.start + scores[at]
            continue
        ways = best[:n, :, None] + model.steps
        pick = ways.argmax(axis=1)
        came[at] = pick
        best[:n] = np.take_along_axis(ways, pick[:, None, :], 1)[:, 0] + scores[at]
    out = np.zeros(len(scores), np.int8)
    label = best.argmax(axis=1)
    tail = lengths[order] - 1
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = first[:n] + t
        out[at] = label[:n]
        go = tail[:n] >= t
        label[:n] = np.where(go, came[at, label[:n]], label[:n])
    return out


def token_scores(ids: list[np.ndarray], model: Model) -> np.ndarray:
    """Scores of tokens from the feature ids of each (sum of weight rows)."""
    sizes = np.array([len(x) for x in ids])
    if not len(ids):
        return np.zeros((0, len(model.labels)))
    flat = model.weights[np.concatenate(ids)]
    return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)


def train(ids: list[np.ndarray], labels: np.ndarray, lengths: np.ndarray, names: list[str], width: int,
          rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum conditional likelihood by full-batch adaptive gradient steps.

    `ids` has the feature ids of every token (at least one each), chains one after the
    other. All data is small by contract (a labelled table or a bounded sample).
    """
    k = len(names)
    model = Model(names, np.zeros((width, k)), np.zeros(k), np.zeros((k, k)))
    if not len(ids):
        return model
    sizes = np.array([len(x) for x in ids])
    flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes)
    used, spot = np.unique(flat, return_inverse=True)
    gold = np.eye(k)[labels]
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    inner = np.setdiff1d(np.arange(len(ids)), heads)
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1.0)
    squares = [np.full((len(used), k), 1e-8), np.full(k, 1e-8), np.full((k, k), 1e-8)]
    n = len(lengths)
    for _ in range(rounds):
        scores = token_scores(ids, model)
        ahead, back, e, _ = forward_backward(scores, lengths, model)
        p = ahead * (back / np.maximum(e, 1e-300))
        p /= p.sum(axis=1, keepdims=True)
        joint = ahead[inner - 1][:, :, None] * np.exp(model.steps) * back[inner][:, None, :]
        pair = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        miss = gold - p
        rows = np.empty((len(used), k))
        for j in range(k):
            rows[:, j] = np.bincount(spot, miss[owner, j], len(used))
        grads = [rows / n - decay * model.weights[used], miss[heads].sum(axis=0) / n, (seen - pair) / n - decay * model.steps]
        for sq, g in zip(squares, grads):
            sq += g * g
        model.weights[used] += rate * grads[0] / np.sqrt(squares[0])
        model.start += rate * grads[1] / np.sqrt(squares[1])
        model.steps += rate * grads[2] / np.sqrt(squares[2])
    return model
