"""A gated recurrent layer in NumPy: reading, and backpropagation through time.

With s(a) = a / (1 + |a|), three cheap array operations where tanh would take most of a step, update gate z and reset gate r are
(1 + s(a)) / 2 and the candidate c is s(a). The next state is h + z (c - h). A layer is a dictionary: x, what a symbol adds to the
three (a row for each symbol); hg, hc, the recurrent weights of the gates and of the candidate.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * np.sqrt(2.0 / sum(shape[-2:]))).astype(np.float32)


def new_layer(rng: np.random.Generator, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    return {"x": (rng.standard_normal((inputs, 3 * hidden)) * 0.2).astype(np.float32), "hg": glorot(rng, hidden, 2 * hidden), "hc": glorot(rng, hidden, hidden)}


def squash(a: np.ndarray, room: np.ndarray) -> None:
    """s(a), in place; room is of a's shape."""
    np.abs(a, out=room)
    room += 1
    a /= room


class Reader:
    """Steps of a layer without a way back, in buffers that stay in cache: nothing is allocated while reading."""

    def __init__(self, p: dict[str, np.ndarray], lanes: int):
        n = p["hc"].shape[0]
        self.x = [np.ascontiguousarray(p["x"][:, k * n : (k + 1) * n]) for k in range(3)]
        self.gates, self.hc = np.stack([p["hg"][:, :n], p["hg"][:, n:]]), p["hc"] * p["hc"].dtype.type(0.5)
        self.room = np.empty((2, lanes, n), self.hc.dtype), np.empty((2, lanes, n), self.hc.dtype)

    def step(self, symbols: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
        """The states after symbols, from the states h; out may be h itself."""
        g, x = (b[:, : len(symbols)] for b in self.room)
        for k in (0, 1):
            np.take(self.x[k], symbols, 0, out=x[k], mode="clip")
        np.matmul(h, self.gates, out=g)
        g += x
        squash(g, x)
        g += 1  # twice the gates; the weights of the candidate and the last step are halved instead
        z, r, c, room = g[0], g[1], x[0], x[1]
        r *= h
        np.matmul(r, self.hc, out=c)
        np.take(self.x[2], symbols, 0, out=room, mode="clip")
        c += room
        squash(c, room)
        c -= h
        z *= c
        z *= 0.5
        np.add(h, z, out=out)


def forward(p: dict[str, np.ndarray], symbols: np.ndarray, h: np.ndarray, starts: np.ndarray | None = None):
    """States (steps, lanes, hidden) over symbols (steps, lanes), and what the way back needs. starts is 0 where a state is forgotten first."""
    n, kind = p["hc"].shape[0], p["hc"].dtype
    steps, lanes = symbols.shape
    gates, before, reset, cand, states = np.empty((steps, 2, lanes, n), kind), *(np.empty((steps, lanes, n), kind) for _ in range(4))
    w = np.stack([p["hg"][:, :n], p["hg"][:, n:]])
    xz, xr, xc = (np.take(np.ascontiguousarray(p["x"][:, k * n : (k + 1) * n]), symbols, 0) for k in range(3))
    room = np.empty((2, lanes, n), kind)
    for t in range(steps):
        before[t] = h if starts is None else h * starts[t][:, None]
        h = before[t]
        g = np.matmul(h, w, out=gates[t])
        g[0] += xz[t]
        g[1] += xr[t]
        squash(g, room)
        rh = np.multiply(g[1], h, out=reset[t])
        rh += h
        rh *= 0.5
        c = np.matmul(rh, p["hc"], out=cand[t])
        c += xc[t]
        squash(c, room[0])
        move = np.subtract(c, h, out=room[0])
        np.add(g[0], 1, out=room[1])
        move *= room[1]
        move *= 0.5
        h = np.add(h, move, out=states[t])
    return states, (symbols, before, gates, reset, cand, starts)


def backward(p: dict[str, np.ndarray], kept, dstates: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the layer, given those of the states at every step."""
    symbols, before, gates, reset, cand, starts = kept
    n, kind = p["hc"].shape[0], before.dtype
    steps, lanes = symbols.shape
    # The slopes of s, by what they meet on the way: of the update gate with c - h, of the reset gate with h.
    slope_g = 1 - np.abs(gates)
    slope_g *= slope_g
    slope_g *= 0.5
    slope_g[:, 0] *= cand - before
    slope_g[:, 1] *= before
    slope_c = 1 - np.abs(cand)
    slope_c *= slope_c
    gates = (gates + 1) * kind.type(0.5)
    slope_c *= gates[:, 0]
    keep = 1 - gates[:, 0]
    dg, dc, dh = np.empty((steps, 2, lanes, n), kind), np.empty((steps, lanes, n), kind), np.zeros((lanes, n), kind)
    w, hc = np.stack([p["hg"][:, :n].T, p["hg"][:, n:].T]), np.ascontiguousarray(p["hc"].T)
    drh, room = np.empty((lanes, n), kind), np.empty((2, lanes, n), kind)
    for t in reversed(range(steps)):
        dh += dstates[t]
        np.multiply(dh, slope_c[t], out=dc[t])
        np.matmul(dc[t], hc, out=drh)
        np.multiply(dh, slope_g[t, 0], out=dg[t, 0])
        np.multiply(drh, slope_g[t, 1], out=dg[t, 1])
        dh *= keep[t]
        drh *= gates[t, 1]
        dh += drh
        np.matmul(dg[t], w, out=room)
        dh += room[0]
        dh += room[1]
        if starts is not None:
            dh *= starts[t][:, None]
    rows = np.concatenate([dg[:, 0], dg[:, 1], dc], 2).reshape(-1, 3 * n)
    cells = (symbols.reshape(-1, 1) * (3 * n) + np.arange(3 * n)).ravel()
    x = np.bincount(cells, rows.ravel(), p["x"].size).reshape(p["x"].shape).astype(kind)
    return {"x": x, "hg": before.reshape(-1, n).T @ rows[:, : 2 * n], "hc": reset.reshape(-1, n).T @ rows[:, 2 * n :]}


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 1.0):
        self.params, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, self.clip / max(norm, 1e-9))
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * np.float32(shrink)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= np.float32(self.rate * scale * fix) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))
