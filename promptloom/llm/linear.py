"""Small linear models over bounded samples of sparse rows, in numpy."""
from __future__ import annotations

import numpy as np

BLOCK_ROWS = 250


def fit_logistic(index: np.ndarray, value: np.ndarray, lengths: np.ndarray, y: np.ndarray, learn: np.ndarray, size: int,
                 steps: int = 200, rate: float = 0.02, decay: float = 1e-3, least: int = 3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and bias by Adam over the rows ``learn``, classes weighted evenly, and the raw scores of all rows.

    ``index`` and ``value`` hold the features of all rows one after the other, ``lengths`` of them a row. They are gone through in
    blocks, so besides them only a few blocks and vectors of ``size`` are in memory.
    """
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    # Common features would drown the others: scale each by its root mean square where present, and drop those of under ``least`` rows.
    seen, square = np.zeros(size), np.zeros(size)
    blocks = []
    for low in range(0, len(lengths), BLOCK_ROWS):
        high = min(low + BLOCK_ROWS, len(lengths))
        part = slice(bounds[low], bounds[high])
        blocks.append((low, high, part))
        seen += np.bincount(index[part], minlength=size)
        square += np.bincount(index[part], value[part].astype(np.float64) ** 2, size)
    # Rows of many features would outweigh others; all are taken as of the same length on average.
    scale = np.where(seen >= least, 1 / np.sqrt(square / np.maximum(seen, 1) + 1e-12), 0) / np.sqrt(max(lengths.mean(), 1))
    weight = np.zeros(len(lengths))
    weight[learn] = np.where(y[learn] == 1, 0.5 / max(1, y[learn].sum()), 0.5 / max(1, (1 - y[learn]).sum()))
    w, bias = np.zeros(size), 0.0
    first, second, fb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0

    def scores() -> np.ndarray:
        scaled, raw = (w * scale).astype(np.float32), np.empty(len(lengths))
        for low, high, part in blocks:
            terms = np.concatenate([[0.0], np.cumsum(value[part] * scaled[index[part]], dtype=np.float64)])
            edge = bounds[low:high + 1] - bounds[low]
            raw[low:high] = terms[edge[1:]] - terms[edge[:-1]]
        return raw + bias

    for step in range(1, steps + 1):
        slope = weight * (1 / (1 + np.exp(-np.clip(scores(), -30, 30))) - y)
        gradient, gb = np.zeros(size), slope.sum()
        for low, high, part in blocks:
            gradient += np.bincount(index[part], value[part] * np.repeat(slope[low:high], lengths[low:high]), size)
        gradient = gradient * scale + decay * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb ** 2
        a, b = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= rate * (first / a) / (np.sqrt(second / b) + 1e-8)
        bias -= rate * (fb / a) / (np.sqrt(sb / b) + 1e-8)
    return w * scale, float(bias), scores()


def fit_platt(raw: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities, with smoothed targets, by Newton's method."""
    positive, negative = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    spread = max(float(raw.std()), 1e-9)
    x = np.column_stack([raw / spread, np.ones(len(raw))])
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 1e-4 * (w - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 1e-3) / spread), float(w[1])
