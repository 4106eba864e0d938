"""Multinomial logistic regression by follow-the-regularised-leader (FTRL-Proximal).

Per-coordinate learning rates, elastic-net penalty: the L1 part keeps weights at exactly zero,
the L2 part shrinks the others (McMahan et al., "Ad click prediction: a view from the trenches").
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FtrlConfig:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    epochs: int = 4
    seed: int = 7


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, features: int, classes: int, cfg: FtrlConfig) -> tuple[np.ndarray, np.ndarray]:
    """rows: (indices, values) of each example.  Returns weights (features x classes) and biases."""
    z = np.zeros((features + 1, classes))
    n = np.zeros((features + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        return -(np.sign(zi) * np.maximum(np.abs(zi) - cfg.l1, 0)) / ((cfg.beta + np.sqrt(ni)) / cfg.alpha + cfg.l2)

    def bias() -> np.ndarray:
        return -z[features] / ((cfg.beta + np.sqrt(n[features])) / cfg.alpha)

    rng = np.random.default_rng(cfg.seed)
    for _ in range(cfg.epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w, b = weights(at), bias()
            g = softmax(x @ w + b)
            g[y[i]] -= 1
            grad = x[:, None] * g
            add = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / cfg.alpha
            z[at] += grad - add * w
            n[at] += grad**2
            add = (np.sqrt(n[features] + g**2) - np.sqrt(n[features])) / cfg.alpha
            z[features] += g - add * b
            n[features] += g**2
    out = np.empty((features, classes))
    step = max(1, (1 << 20) // max(1, classes))  # rows at a time, as each takes some copies
    for at in range(0, features, step):
        out[at : at + step] = weights(np.arange(at, min(features, at + step)))
    return out, bias()


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature that minimises the negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi, b = b, a
            a = hi - g * (hi - lo)
        else:
            lo, a = a, b
            b = lo + g * (hi - lo)
    return float(np.exp((lo + hi) / 2))
