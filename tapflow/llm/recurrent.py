"""A bidirectional gated recurrent network with attention pooling, in numpy.

Input is a batch of windows of T vectors; the output is one logit for each
window. Both directions have the gates z (update), r (reset) and the candidate
n; attention weighs the joined states of all positions, and the weighted mean
goes through one linear unit. ``backward`` returns exact gradients.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def init(inputs: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["W" + d] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 3 * hidden))
        p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p["c" + d] = np.zeros(3 * hidden)
    p["a"] = rng.normal(0, 1 / np.sqrt(hidden), 2 * hidden)
    p["w"] = rng.normal(0, 1 / np.sqrt(hidden), 2 * hidden)
    p["b"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def direction(gates: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool):
    """States of one direction. ``gates`` (T, B, 3H) are the input parts in
    the order of reading; masked positions leave the state zero. With
    ``keep``, what the gradient needs comes along."""
    steps, batch, h3 = gates.shape
    size = h3 // 3
    h = np.zeros((batch, size), gates.dtype)
    states, tape = np.empty((steps, batch, size), gates.dtype), []
    for t in range(steps):
        hu = h @ u
        zr = sigmoid(gates[t, :, :2 * size] + hu[:, :2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(gates[t, :, 2 * size:] + r * hu[:, 2 * size:])
        new = h + z * (n - h)
        if mask is not None:
            new = new * mask[t, :, None]
        if keep:
            tape.append((h, z, r, n, hu[:, 2 * size:]))
        h = states[t] = new
    return states, tape


def direction_back(d_states: np.ndarray, tape, u: np.ndarray, mask: np.ndarray | None):
    """(gradient of the gates, gradient of u)."""
    steps, batch, size = d_states.shape
    d_gates, du, dh = np.empty((steps, batch, 3 * size), d_states.dtype), np.zeros_like(u), 0
    for t in range(steps - 1, -1, -1):
        h, z, r, n, hun = tape[t]
        dh = dh + d_states[t]
        if mask is not None:
            dh = dh * mask[t, :, None]
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h) * z * (1 - z)
        dr = dn * hun * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dn], axis=1)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dhu
        dh = dh * (1 - z) + dhu @ u.T
    return d_gates, du


def pool(p, fwd: np.ndarray, bwd: np.ndarray, mask: np.ndarray | None):
    """Attention over positions: (logit, states, weights, pooled)."""
    states = np.concatenate([fwd, bwd[::-1]], axis=2)  # T, B, 2H
    score = states @ p["a"]
    if mask is not None:
        score = np.where(mask > 0, score, np.float32(-1e9))
    weight = np.exp(score - score.max(axis=0))
    if mask is not None:
        weight = weight * mask
    weight = weight / np.maximum(weight.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ p["w"] + p["b"][0], states, weight, pooled


def logits_of_gates(p, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Logits from the input parts of both directions, both (T, B, 3H) in
    reading order of the text."""
    fwd, _ = direction(gates_f, p["Uf"], mask, False)
    bwd, _ = direction(gates_b[::-1], p["Ub"], None if mask is None else mask[::-1], False)
    return pool(p, fwd, bwd, mask)[0]


def train_step(p, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray):
    """(loss, gradients, gradient of x) of weighted log loss; x is (T, B, D)."""
    gf, gb = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
    fwd, tape_f = direction(gf, p["Uf"], mask, True)
    bwd, tape_b = direction(gb[::-1], p["Ub"], mask[::-1], True)
    logit, states, att, pooled = pool(p, fwd, bwd, mask)
    prob = sigmoid(logit)
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
    d = (weight * (prob - y) / len(y)).astype(x.dtype)
    g = {"w": pooled.T @ d, "b": np.array([d.sum()], x.dtype)}
    d_pooled = d[:, None] * p["w"]
    d_att = np.einsum("bh,tbh->tb", d_pooled, states)
    d_score = att * (d_att - (att * d_att).sum(axis=0))
    d_states = att[:, :, None] * d_pooled + d_score[:, :, None] * p["a"]
    g["a"] = np.einsum("tb,tbh->h", d_score, states)
    size = fwd.shape[2]
    df, g["Uf"] = direction_back(np.ascontiguousarray(d_states[:, :, :size]), tape_f, p["Uf"], mask)
    db, g["Ub"] = direction_back(np.ascontiguousarray(d_states[::-1, :, size:]), tape_b, p["Ub"], mask[::-1])
    db = db[::-1]
    flat = x.reshape(-1, x.shape[2])
    for k, dg in (("f", df), ("b", db)):
        g["W" + k] = flat.T @ dg.reshape(-1, dg.shape[2])
        g["c" + k] = dg.sum(axis=(0, 1))
    return loss, g, df @ p["Wf"].T + db @ p["Wb"].T


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, g: dict, decay: float = 0.0) -> None:
        self.t += 1
        for k, x in g.items():
            x = x + decay * p[k]
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            p[k] -= (self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)).astype(p[k].dtype)
