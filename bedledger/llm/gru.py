"""A gated recurrent layer in numpy: forward steps and backpropagation through time.

Arrays have features first and sequences last, so that each gate is one contiguous block. The input is an
index; its projection is a column of the `table` (three gates, bias included).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def start(rng: np.random.Generator, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    table = rng.normal(0, 0.3, (3 * hidden, inputs)).astype(np.float32)
    table[:hidden] += 1.0  # keep the state at first
    return {"table": table, "state": rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)}


def step(a: np.ndarray, weights: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The next state; `a` holds the projected input and is overwritten."""
    k = len(h)
    b = weights @ h
    a[: 2 * k] += b[: 2 * k]
    gates = sigmoid(a[: 2 * k])
    n, b = a[2 * k :], b[2 * k :]
    b *= gates[k:]
    n += b
    np.tanh(n, out=n)
    out = h - n
    out *= gates[:k]
    out += n
    return out


def forward(p: dict, x: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None):
    """States after each row of x (steps x sequences), and what `backward` needs. keep: 0 resets a state first."""
    k, states, memory = len(h), [], []
    for t in range(len(x)):
        if keep is not None:
            h = h * keep[t]
        a, b = p["table"][:, x[t]], p["state"] @ h
        gates = sigmoid(a[: 2 * k] + b[: 2 * k])
        z, r = gates[:k], gates[k:]
        n = np.tanh(a[2 * k :] + r * b[2 * k :])
        memory.append((h, z, r, n, b[2 * k :]))
        h = n + z * (h - n)
        states.append(h)
    return states, memory


def column_sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the columns of `values` by index."""
    order = np.argsort(index, kind="stable")
    found, first = np.unique(index[order], return_index=True)
    out = np.zeros((len(values), size), np.float32)
    if len(found):
        out[:, found] = np.add.reduceat(values[:, order], first, axis=1)
    return out


def column_sums_of_many(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The same for long windows: row by row, without sorting the columns."""
    return np.stack([np.bincount(index, v, size) for v in values]).astype(np.float32)


def backward(
    p: dict, x: np.ndarray, memory: list, dstates: list[np.ndarray], keep: np.ndarray | None = None, sums=column_sums
) -> dict:
    """Gradients of table and state weights, from those of the states of one window."""
    dweights, dprojected, dh = np.zeros_like(p["state"]), [None] * len(x), 0.0
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, b = memory[t]
        d = dstates[t] + dh
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * b * r * (1 - r)
        dprojected[t] = np.concatenate((dz, dr, dn))
        inner = np.concatenate((dz, dr, dn * r))
        dweights += inner @ h.T
        dh = d * z + p["state"].T @ inner
        if keep is not None:
            dh = dh * keep[t]
    dtable = sums(x.ravel(), np.concatenate(dprojected, axis=1), p["table"].shape[1])
    return {"table": dtable, "state": dweights}


class Adam:
    """Adam with clipped gradients over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.n += 1
        size = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())))
        clip = min(1.0, 5.0 / max(size, 1e-12))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            step = self.m[k] / (1 - 0.9**self.n) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + 1e-6)
            self.params[k] -= self.rate * scale * step
