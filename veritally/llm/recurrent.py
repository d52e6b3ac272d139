"""A small recurrent classifier in NumPy: bidirectional GRUs with attention pooling.

Words enter as a learned vector and as the pooled output of a GRU over their characters; a GRU
over the words of a window and a second attention pooling give one logit. Arrays are time-major:
(steps, batch, values). Gradients are written out; Adam trains.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def encoder_params(name: str, n_in: int, hidden: int, attention: int, rng: np.random.Generator) -> Params:
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {}
    for side in "fb":
        out |= {
            f"{name}_W{side}": draw(n_in, 3 * hidden), f"{name}_b{side}": np.zeros(3 * hidden, np.float32),
            f"{name}_U{side}": draw(hidden, 3 * hidden), f"{name}_n{side}": np.zeros(hidden, np.float32),
        }
    return out | {f"{name}_A": draw(2 * hidden, attention), f"{name}_a": np.zeros(attention, np.float32), f"{name}_v": draw(attention)}


def gru(projected: np.ndarray, U: np.ndarray, bias: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of a GRU over projected inputs; masked steps leave the state as it is."""
    steps, batch, width = projected.shape
    size = width // 3
    h = np.zeros((batch, size), np.float32)
    out = np.empty((steps, batch, size), np.float32)
    for t in range(steps):
        from_h = h @ U
        gates = sigmoid(projected[t, :, : 2 * size] + from_h[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        c = from_h[:, 2 * size :] + bias
        n = np.tanh(projected[t, :, 2 * size :] + r * c)
        m = mask[t][:, None]
        new = h + m * (1.0 - z) * (n - h)
        if keep is not None:
            keep.append((h, z, r, c, n, m))
        h = out[t] = new
    return out


def gru_back(d_out: np.ndarray, kept: list, U: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the projected inputs, U and the bias."""
    steps, batch, size = d_out.shape
    d_in = np.empty((steps, batch, 3 * size), np.float32)
    d_U, d_bias, dh = np.zeros_like(U), np.zeros(size, np.float32), np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, n, m = kept[t]
        dh = dh + d_out[t]
        d_new = dh * m
        d_n = d_new * (1.0 - z) * (1.0 - n * n)
        d_z = d_new * (h - n) * z * (1.0 - z)
        d_r = d_n * c * r * (1.0 - r)
        d_c = d_n * r
        d_from = np.concatenate([d_z, d_r, d_c], 1)
        d_in[t] = np.concatenate([d_z, d_r, d_n], 1)
        d_U += h.T @ d_from
        d_bias += d_c.sum(0)
        dh = dh * (1.0 - m) + d_new * z + d_from @ U.T
    return d_in, d_U, d_bias


def encode(p: Params, name: str, projected: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Attention-pooled states of both directions; rows without a step give zeros."""
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    forward = gru(projected["f"], p[f"{name}_Uf"], p[f"{name}_nf"], mask, kept["f"])
    backward = gru(projected["b"][::-1], p[f"{name}_Ub"], p[f"{name}_nb"], mask[::-1], kept["b"])[::-1]
    states = np.concatenate([forward, backward], 2)
    u = np.tanh(states @ p[f"{name}_A"] + p[f"{name}_a"])
    s = np.where(mask > 0, u @ p[f"{name}_v"], np.float32(-1e9))
    weight = np.exp(s - s.max(0)) * mask
    weight = weight / np.maximum(weight.sum(0), 1e-9)
    if keep is not None:
        keep.update(kept=kept, states=states, u=u, weight=weight)
    return (weight[:, :, None] * states).sum(0)


def encode_back(p: Params, name: str, d_pool: np.ndarray, keep: dict, grads: Params) -> dict[str, np.ndarray]:
    """Gradients of both projections; adds those of the parameters to `grads`."""
    states, u, weight = keep["states"], keep["u"], keep["weight"]
    d_weight = (states * d_pool[None]).sum(2)
    d_states = weight[:, :, None] * d_pool[None]
    d_s = weight * (d_weight - (weight * d_weight).sum(0))
    d_u = d_s[:, :, None] * p[f"{name}_v"] * (1.0 - u * u)
    grads[f"{name}_v"] += (u * d_s[:, :, None]).sum((0, 1))
    grads[f"{name}_a"] += d_u.sum((0, 1))
    flat = lambda x: x.reshape(-1, x.shape[2])
    grads[f"{name}_A"] += flat(states).T @ flat(d_u)
    d_states = d_states + d_u @ p[f"{name}_A"].T
    size = d_states.shape[2] // 2
    out = {}
    for side, part, turn in (("f", d_states[:, :, :size], 1), ("b", d_states[::-1, :, size:], -1)):
        d_in, d_U, d_bias = gru_back(part, keep["kept"][side], p[f"{name}_U{side}"])
        grads[f"{name}_U{side}"] += d_U
        grads[f"{name}_n{side}"] += d_bias
        out[side] = d_in[::turn]
    return out


class Classifier:
    """`words` are numbers of known words (0: unknown), `chars` (words, WIDTH) character numbers (0: none)."""

    def __init__(self, n_words: int, n_chars: int, seed: int = 7, word_size: int = 8, char_size: int = 6, char_hidden: int = 4, hidden: int = 8):
        rng = np.random.default_rng(seed)
        self.p: Params = {
            "words": (rng.standard_normal((n_words, word_size)) * 0.1).astype(np.float32),
            "chars": (rng.standard_normal((n_chars, char_size)) * 0.5).astype(np.float32),
            **encoder_params("c", char_size, char_hidden, 6, rng),
            **encoder_params("w", word_size + 2 * char_hidden, hidden, 8, rng),
            "out": np.zeros(2 * hidden, np.float32), "bias": np.zeros(1, np.float32),
        }
        self.p["words"][0] = 0

    def _char_vectors(self, chars: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, x = self.p, self.p["chars"][chars.T]
        mask = (chars.T > 0).astype(np.float32)
        if keep is not None:
            keep["x"] = x
        return encode(p, "c", {s: x @ p[f"c_W{s}"] + p[f"c_b{s}"] for s in "fb"}, mask, keep)

    def vectors(self, words: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words; words of like length are run together."""
        out = np.zeros((len(words), len(self.p["c_Uf"]) * 2), np.float32)
        sizes = (chars > 0).sum(1)
        low = 0
        for high in (4, 6, 8, 11, chars.shape[1]):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(at), 8192):
                part = at[a : a + 8192]
                out[part] = self._char_vectors(chars[part, :high])
            low = high
        return np.concatenate([self.p["words"][words], out], 1)

    def logits(self, vectors: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Logit of each window; `windows` (number, steps) are rows of `vectors`, -1: none."""
        p = self.p
        table = {s: np.concatenate([vectors @ p[f"w_W{s}"] + p[f"w_b{s}"], np.zeros((1, p[f"w_b{s}"].size), np.float32)]) for s in "fb"}
        out = np.empty(len(windows), np.float32)
        for a in range(0, len(windows), 2048):
            w = windows[a : a + 2048].T
            mask = (w >= 0).astype(np.float32)
            pooled = encode(p, "w", {s: table[s][w] for s in "fb"}, mask)
            out[a : a + 2048] = pooled @ p["out"] + p["bias"][0]
        return out

    def gradients(self, words: np.ndarray, chars: np.ndarray, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, Params]:
        """Weighted mean cross-entropy of windows over distinct words, and its gradients."""
        p = self.p
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        keep_c, keep_w = {}, {}
        x = np.concatenate([p["words"][words], self._char_vectors(chars, keep_c)], 1)
        w = windows.T
        mask = (w >= 0).astype(np.float32)
        x_in = x[w] * mask[:, :, None]
        pooled = encode(p, "w", {s: x_in @ p[f"w_W{s}"] + p[f"w_b{s}"] for s in "fb"}, mask, keep_w)
        logit = pooled @ p["out"] + p["bias"][0]
        share = weights / weights.sum()
        loss = float((share * (np.maximum(logit, 0) - logit * labels + np.log1p(np.exp(-np.abs(logit))))).sum())
        d_logit = (share * (sigmoid(logit) - labels)).astype(np.float32)
        grads["out"] += pooled.T @ d_logit
        grads["bias"] += d_logit.sum()
        d_in = encode_back(p, "w", d_logit[:, None] * p["out"][None], keep_w, grads)
        d_x_in = np.zeros_like(x_in)
        flat = lambda v: v.reshape(-1, v.shape[2])
        for s in "fb":
            grads[f"w_W{s}"] += flat(x_in).T @ flat(d_in[s])
            grads[f"w_b{s}"] += d_in[s].sum((0, 1))
            d_x_in += d_in[s] @ p[f"w_W{s}"].T
        d_x = np.zeros_like(x)
        np.add.at(d_x, w[mask > 0], d_x_in[mask > 0])
        size = p["words"].shape[1]
        np.add.at(grads["words"], words, d_x[:, :size])
        grads["words"][0] = 0
        d_c = encode_back(p, "c", d_x[:, size:], keep_c, grads)
        xc = keep_c["x"]
        d_xc = np.zeros_like(xc)
        for s in "fb":
            grads[f"c_W{s}"] += flat(xc).T @ flat(d_c[s])
            grads[f"c_b{s}"] += d_c[s].sum((0, 1))
            d_xc += d_c[s] @ p[f"c_W{s}"].T
        np.add.at(grads["chars"], chars.T, d_xc)
        return loss, grads


class Adam:
    def __init__(self, params: Params, rate: float, decay: float = 1e-4):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            step = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)
            self.p[k] -= self.rate * (step + self.decay * self.p[k])
