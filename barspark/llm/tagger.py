"""A character tagger in numpy: a bidirectional LSTM whose outputs go through a linear-chain CRF.

All windows have the same length, padded with symbol 0 and tag 0, so a batch is one array and every step a matrix product.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
FORBIDDEN = -1e4


def init(symbols: int, tags: int, embed: int = 10, hidden: int = 16, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {"E": rng.normal(0, 0.3, (symbols, embed)), "U": rng.normal(0, 0.3, (2 * hidden, tags)), "u": np.zeros(tags), "T": np.zeros((tags, tags))}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, (1 / embed) ** 0.5, (embed, 4 * hidden))
        p[f"R{d}"] = rng.normal(0, (1 / hidden) ** 0.5, (hidden, 4 * hidden))
        p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _steps(length: int, d: str) -> range:
    return range(length) if d == "f" else range(length - 1, -1, -1)


def _lstm(p: Params, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
    """States (windows, length, hidden) of one direction and, if kept, what the way back needs."""
    n, length, _ = x.shape
    hidden = p[f"R{d}"].shape[0]
    drive = x @ p[f"W{d}"] + p[f"c{d}"]
    out = np.empty((n, length, hidden), np.float32)
    h, c, seen = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32), []
    for t in _steps(length, d):
        z = drive[:, t] + h @ p[f"R{d}"]
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
        g = np.tanh(z[:, 3 * hidden:])
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep:
            seen.append((t, h, before, i, f, o, g, tc))
        h = o * tc
        out[:, t] = h
    return out, seen


def emissions(p: Params, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    e = p["E"][x]
    (hf, sf), (hb, sb) = _lstm(p, e, "f", keep), _lstm(p, e, "b", keep)
    h = np.concatenate([hf, hb], axis=2)
    return h @ p["U"] + p["u"], (x, e, h, sf, sb)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis)


def crf(s: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean negative log-likelihood, its gradient by the emissions, and by the transitions)."""
    n, length, k = s.shape
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[:, 0] = s[:, 0]
    for t in range(1, length):
        alpha[:, t] = _lse(alpha[:, t - 1, :, None] + trans, 1) + s[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = _lse(trans + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    marginal = np.exp(alpha + beta - z[:, None, None])
    rows, at = np.arange(n)[:, None], np.arange(length)
    gold = s[rows, at, y].sum() + trans[y[:, :-1], y[:, 1:]].sum()
    by_s = marginal
    by_s[rows, at, y] -= 1
    by_t = np.zeros_like(trans)
    for t in range(1, length):
        by_t += np.exp(alpha[:, t - 1, :, None] + trans + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
    np.add.at(by_t, (y[:, :-1], y[:, 1:]), -1)
    return float((z.sum() - gold) / n), by_s / n, by_t / n


def gradients(p: Params, allowed: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    s, (x, e, h, sf, sb) = emissions(p, x, keep=True)
    loss, ds, dt = crf(s, p["T"] + allowed, y)
    g: Params = {k: np.zeros_like(v) for k, v in p.items()}
    g["T"] = dt * (allowed == 0)
    flat = ds.reshape(-1, ds.shape[2])
    g["U"], g["u"] = h.reshape(-1, h.shape[2]).T @ flat, flat.sum(axis=0)
    dh_all, de = ds @ p["U"].T, np.zeros_like(e)
    hidden = h.shape[2] // 2
    for d, seen, part in (("f", sf, slice(0, hidden)), ("b", sb, slice(hidden, None))):
        dh, dc = np.zeros((len(x), hidden), np.float32), np.zeros((len(x), hidden), np.float32)
        dz_all = np.empty((len(x), x.shape[1], 4 * hidden), np.float32)
        for t, before_h, before_c, i, f, o, a, tc in reversed(seen):
            dh = dh + dh_all[:, t, part]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * a * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            dz_all[:, t] = dz
            g[f"R{d}"] += before_h.T @ dz
            dh, dc = dz @ p[f"R{d}"].T, dc * f
        flat = dz_all.reshape(-1, 4 * hidden)
        g[f"W{d}"], g[f"c{d}"] = e.reshape(-1, e.shape[2]).T @ flat, flat.sum(axis=0)
        de += dz_all @ p[f"W{d}"].T
    np.add.at(g["E"], x.ravel(), de.reshape(-1, e.shape[2]))
    return loss, g


def train(p: Params, allowed: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Params:
    """Adam over shuffled batches, with the step falling to nothing; gradients are cut at norm 5."""
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    total, step = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            _, g = gradients(p, allowed, x[order[i:i + batch]], y[order[i:i + batch]])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for k, a in g.items():
                a = a * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                p[k] = (p[k] - rate * (1 - (step - 1) / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def viterbi(s: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags of each window."""
    n, length, k = s.shape
    best, back = s[:, 0], np.zeros((n, length, k), np.int8)
    for t in range(1, length):
        to = best[:, :, None] + trans
        back[:, t] = to.argmax(axis=1)
        best = to.max(axis=1) + s[:, t]
    out = np.empty((n, length), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


def decode(p: Params, allowed: np.ndarray, x: np.ndarray, batch: int = 512) -> np.ndarray:
    parts = [viterbi(emissions(p, x[i:i + batch])[0], p["T"] + allowed) for i in range(0, len(x), batch)]
    return np.concatenate(parts) if parts else np.zeros((0, x.shape[1]), np.int8)
