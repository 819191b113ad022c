"""Bidirectional gated recurrent network with attention pooling, in numpy.

Input of a step is a word: its own hashed embedding beside the mean of its hashed character n-grams.
What the gates get from a word depends on nothing else, so it is computed once for each distinct word.
"""

from __future__ import annotations

import zlib

import numpy as np

WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 1 << 14, 1 << 14, 12, 16, 12, 12
#: Longer words are cut into steps of so many characters.
GRAM_SIZES, WORD_CHARS = (3, 4, 5), 24
STEPS, STRIDE = 64, 48


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row ids, weights) of each word's character n-grams, ^ and $ at its ends; weight 0 pads."""
    width = max(3, *(min(len(w), WORD_CHARS) for w in words), 0) + 2
    data = "".join([f"^{w[:WORD_CHARS]}$".ljust(width, "\0") for w in words]).encode("utf-32-le", "replace")
    code = np.frombuffer(data, dtype=np.uint32).reshape(len(words), width).astype(np.uint64)
    ids, masks = [], []
    for size in GRAM_SIZES:
        h = np.full((len(words), width - size + 1), size, dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[:, k : width - size + 1 + k]
            h ^= h >> np.uint64(29)
        ids.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % GRAM_ROWS)
        masks.append(code[:, size - 1 :] != 0)
    ids_, mask = np.concatenate(ids, 1), np.concatenate(masks, 1).astype(np.float32)
    mask /= np.maximum(mask.sum(1, keepdims=True), 1)
    return ids_, mask


def word_rows(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.int64) % WORD_ROWS


class Network:
    """Weights: word, gram (embeddings), wx, bx, u, bn (gates of both directions), wa, ba, va (attention), wo, bo."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim, h = WORD_DIM + GRAM_DIM, HIDDEN
        init = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {
            "word": init(WORD_ROWS, WORD_DIM, scale=0.1),
            "gram": init(GRAM_ROWS, GRAM_DIM, scale=0.3),
            "wx": init(dim, 6 * h, scale=dim**-0.5 * 2),
            "bx": np.tile(np.concatenate([np.zeros(h), -np.ones(h), np.zeros(h)]), 2).astype(np.float32),
            "u": init(2, h, 3 * h, scale=h**-0.5),
            "bn": np.zeros((2, 1, h), np.float32),
            "wa": init(2 * h, ATTEND, scale=(2 * h) ** -0.5),
            "ba": np.zeros(ATTEND, np.float32),
            "va": init(ATTEND, scale=0.5),
            "wo": init(2 * h, scale=(2 * h) ** -0.5),
            "bo": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[str]) -> np.ndarray:
        """What the gates of both directions get from each word."""
        ids, mask = gram_rows(words)
        x = np.empty((len(words), WORD_DIM + GRAM_DIM), np.float32)
        x[:, :WORD_DIM] = self.w["word"][word_rows(words)]
        x[:, WORD_DIM:] = np.einsum("ngd,ng->nd", self.w["gram"][ids], mask, optimize=False)
        return x @ self.w["wx"] + self.w["bx"]

    def forward(self, gates: np.ndarray, rows: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows. gates: inputs of distinct words and a row for padding, whole or by direction; rows: (windows, STEPS)."""
        w, h = self.w, HIDDEN
        n, steps = rows.shape
        steps = int(length.max(initial=1))
        # The backward direction reads each window from its own end.
        t = np.arange(steps)
        back = np.where(t < length[:, None], length[:, None] - 1 - t, t)
        both = np.stack([rows[:, :steps], np.take_along_axis(rows, back, 1)])
        turn = np.ascontiguousarray(both.transpose(2, 0, 1))
        half = (np.ascontiguousarray(gates[:, : 3 * h]), np.ascontiguousarray(gates[:, 3 * h :])) if isinstance(gates, np.ndarray) else gates
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((steps, 2, n, h), np.float32)
        saved = []
        x, one_half = np.empty((2, n, 3 * h), np.float32), np.float32(0.5)
        full = int(length.min(initial=steps)) >= steps
        for i in range(steps):
            np.take(half[0], turn[i, 0], axis=0, out=x[0], mode="clip")
            np.take(half[1], turn[i, 1], axis=0, out=x[1], mode="clip")
            a = np.matmul(state, w["u"])
            hn = a[..., 2 * h :] + w["bn"]
            rz = a[..., : 2 * h] + x[..., : 2 * h]
            rz *= one_half
            np.tanh(rz, out=rz)
            rz *= one_half
            rz += one_half
            cand = rz[..., :h] * hn
            cand += x[..., 2 * h :]
            np.tanh(cand, out=cand)
            new = np.subtract(state, cand, out=out[i])
            new *= rz[..., h:]
            new += cand
            if not full:
                np.copyto(new, state, where=(i >= length)[None, :, None])
            if keep:
                saved.append((state, rz, hn, cand))
            state = new
        # Words in order: the backward states are turned round.
        hidden = np.empty((n, steps, 2 * h), np.float32)
        hidden[..., :h] = out[:, 0].transpose(1, 0, 2)
        hidden[..., h:] = np.take_along_axis(out[:, 1].transpose(1, 0, 2), back[..., None], 1)
        tanh = np.tanh(hidden @ w["wa"] + w["ba"])
        score = np.where(t < length[:, None], tanh @ w["va"], -1e9)
        score -= score.max(1, keepdims=True)
        alpha = np.exp(score)
        alpha /= alpha.sum(1, keepdims=True)
        alpha = np.where(length[:, None] > 0, alpha, 0).astype(np.float32)
        pooled = np.einsum("nt,nth->nh", alpha, hidden)
        logit = pooled @ w["wo"] + w["bo"]
        return (logit, (both, back, saved, hidden, tanh, alpha, pooled)) if keep else logit

    def gradients(self, gates: np.ndarray, rows: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """(loss, gradient of gates, gradients of the other weights)."""
        w, h = self.w, HIDDEN
        logit, (both, back, saved, hidden, tanh, alpha, pooled) = self.forward(gates, rows, length, keep=True)
        p = 1 / (1 + np.exp(-logit))
        loss = -(weight * (label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))).sum()
        d = (weight * (p - label)).astype(np.float32)
        g = {"wo": pooled.T @ d, "bo": d.sum(keepdims=True)}
        dp = d[:, None] * w["wo"]
        dalpha = np.einsum("nh,nth->nt", dp, hidden)
        dhid = alpha[..., None] * dp[:, None]
        dscore = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", dscore, tanh)
        dt = dscore[..., None] * w["va"] * (1 - tanh**2)
        g["wa"] = np.einsum("nth,nta->ha", hidden, dt, optimize=True)
        g["ba"] = dt.sum((0, 1))
        dhid = dhid + dt @ w["wa"].T
        dout = np.stack([dhid[..., :h], np.take_along_axis(dhid[..., h:], back[..., None], 1)])  # turning round is its own inverse
        dx = np.zeros((2, *dout.shape[1:3], 3 * h), np.float32)
        g["u"], g["bn"] = np.zeros_like(w["u"]), np.zeros_like(w["bn"])
        ds = np.zeros((2, len(rows), h), np.float32)
        ut = w["u"].transpose(0, 2, 1)
        for i in range(dout.shape[2] - 1, -1, -1):
            state, rz, hn, cand = saved[i]
            ds = ds + dout[:, :, i]
            live = (i < length)[None, :, None]
            do = np.where(live, ds, 0)
            r, z = rz[..., :h], rz[..., h:]
            da = do * (1 - z) * (1 - cand**2)
            dr, dz = da * hn * r * (1 - r), do * (state - cand) * z * (1 - z)
            dgate = np.concatenate([dr, dz, da * r], -1)
            g["u"] += state.transpose(0, 2, 1) @ dgate
            g["bn"] += (da * r).sum(1, keepdims=True)
            dx[:, :, i] = np.concatenate([dr, dz, da], -1)
            ds = np.where(live, do * z + dgate @ ut, ds)
        dgates = np.zeros((len(gates), 6 * h), np.float32)
        for k in (0, 1):
            at = both[k].ravel()
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            dgates[at[order][starts], 3 * h * k : 3 * h * (k + 1)] = np.add.reduceat(dx[k].reshape(-1, 3 * h)[order], starts)
        return loss, dgates, g


class Trainer:
    """Adam for the small weights, Adagrad for the rows of the embeddings that a batch touches."""

    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.rate, self.step_no = net, rate, 0
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items() if k not in ("word", "gram")}
        self.seen = {k: np.full(len(net.w[k]), 1e-6, np.float32) for k in ("word", "gram")}

    def step(self, words: list[str], rows: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
        """words: the distinct words of the batch; rows index them, their number stands for padding."""
        net = self.net
        ids, mask = gram_rows(words)
        own = word_rows(words)
        x = np.concatenate([net.w["word"][own], np.einsum("ngd,ng->nd", net.w["gram"][ids], mask)], 1)
        gates = np.concatenate([x @ net.w["wx"] + net.w["bx"], np.zeros((1, 6 * HIDDEN), np.float32)])
        loss, dgates, g = net.gradients(gates, rows, length, label, weight)
        dgates = dgates[:-1]
        g["wx"], g["bx"] = x.T @ dgates, dgates.sum(0)
        dx = dgates @ net.w["wx"].T
        self._rows("word", own, dx[:, :WORD_DIM])
        live = mask > 0
        word_of = np.nonzero(live)[0]
        self._rows("gram", ids[live], dx[word_of, WORD_DIM:] * mask[live][:, None])
        self.step_no += 1
        for k, (m, v) in self.m.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            net.w[k] -= self.rate * (m / (1 - 0.9**self.step_no)) / (np.sqrt(v / (1 - 0.99**self.step_no)) + 1e-8)
        return float(loss)

    def _rows(self, name: str, at: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        rows = at[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        total, rows = np.add.reduceat(grad[order], starts), rows[starts]
        self.seen[name][rows] += (total**2).mean(1)
        self.net.w[name][rows] -= 0.05 * total / np.sqrt(self.seen[name][rows])[:, None]
