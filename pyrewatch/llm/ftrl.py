"""Follow the regularised leader: sparse linear models with per-coordinate rates and an elastic net."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rows:
    """Sparse rows: ``bounds[i]:bounds[i + 1]`` are the entries of row ``i``."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Rows:
        lengths = np.diff(self.bounds)[rows]
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[rows] - bounds[:-1], lengths)
        return Rows(bounds, self.index[at], self.value[at])

    def scores(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Row sums of value times weight, for each of the weight columns."""
        owner = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        return np.stack([np.bincount(owner, weights=self.value * column[self.index], minlength=len(self))
                         for column in weights.T], axis=1) + bias


@dataclass(frozen=True)
class Settings:
    rate: float = 0.5
    smooth: float = 1.0
    l1: float = 0.01
    l2: float = 0.001
    epochs: int = 6
    batch: int = 64
    seed: int = 7


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def fit(rows: Rows, targets: np.ndarray, width: int, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width x classes) and biases of a logistic model.

    ``targets`` holds one column of 0 and 1 per class; a single column makes a binary model, more a multinomial one.
    """
    classes = targets.shape[1]
    binary = classes == 1
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
    rng = np.random.default_rng(settings.seed)

    def leader() -> np.ndarray:
        out = -(z - np.sign(z) * settings.l1) / ((settings.smooth + np.sqrt(n)) / settings.rate + settings.l2)
        out[np.abs(z) <= settings.l1] = 0
        out[-1] = -z[-1] * settings.rate / (settings.smooth + np.sqrt(n[-1]))
        return out

    weights = leader()
    for _ in range(settings.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            some = order[at: at + settings.batch]
            part = rows.take(some)
            scores = part.scores(weights[:-1], weights[-1])
            chance = 0.5 * (1 + np.tanh(0.5 * scores)) if binary else softmax(scores)
            error = (chance - targets[some]) / len(some)
            owner = np.repeat(np.arange(len(part)), np.diff(part.bounds))
            slope = np.empty_like(weights)
            for c in range(classes):
                slope[:-1, c] = np.bincount(part.index, weights=part.value * error[owner, c], minlength=width)
            slope[-1] = error.sum(axis=0)
            change = (np.sqrt(n + slope ** 2) - np.sqrt(n)) / settings.rate
            z += slope - change * weights
            n += slope ** 2
            weights = leader()
    return weights[:-1], weights[-1]
