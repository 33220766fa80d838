"""Bidirectional LSTM over the blocks of a page, in numpy: which blocks are the main text."""

from __future__ import annotations

import numpy as np

HIDDEN = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Weights of both directions and of the output; ``scores`` reads whole pages, ``fit`` learns from labelled ones."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        shape = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[f"W{side}"], self.w[f"U{side}"] = shape(inputs, 4 * hidden), shape(hidden, 4 * hidden)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.w[f"b{side}"] = bias
        self.w["Wo"], self.w["bo"] = shape(2 * hidden, 1), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """x (T, B, inputs) → states (T, B, hidden) and what the gradient needs."""
        steps, n, _ = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        pre = x @ self.w[f"W{side}"] + self.w[f"b{side}"]
        out, kept = np.zeros((steps, n, self.h), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ self.w[f"U{side}"]
            i, f, o = (_sigmoid(z[:, k * self.h : (k + 1) * self.h]) for k in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            kept.append((i, f, o, g, before, tc, last))
        return out, kept

    def _back(self, x: np.ndarray, side: str, kept: list, d_out: np.ndarray, grad: dict) -> None:
        u = self.w[f"U{side}"]
        dz = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
        dh = dc = np.zeros((x.shape[1], self.h), np.float32)
        du = np.zeros_like(u)
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, tc, last = kept[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            du += last.T @ dz[t]
            dh = dz[t] @ u.T
            dc = dc * f
        grad[f"U{side}"] = du
        grad[f"W{side}"] = np.tensordot(x, dz, ((0, 1), (0, 1)))
        grad[f"b{side}"] = dz.sum((0, 1))

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(T, B, inputs), for each place its place in the reversed page, and which places are blocks."""
        n = np.array([len(p) for p in pages])
        x = np.zeros((n.max(), len(pages), pages[0].shape[1]), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        t = np.arange(n.max())[:, None]
        real = t < n[None, :]
        return x, np.where(real, n[None, :] - 1 - t, t), real

    def _forward(self, x: np.ndarray, turn: np.ndarray):
        cols = np.arange(x.shape[1])[None, :]
        back = x[turn, cols]
        hf, kf = self._run(x, "f")
        hb, kb = self._run(back, "b")
        both = np.concatenate([hf, hb[turn, cols]], axis=2)
        return both, (both @ self.w["Wo"])[..., 0] + self.w["bo"][0], back, kf, kb, cols

    def scores(self, pages: list[np.ndarray], at_once: int = 64) -> list[np.ndarray]:
        """Probability of being main text for each block of each page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = order[at : at + at_once]
            while len(group) > 1 and len(pages[group[-1]]) * len(group) > 20_000:  # long pages in smaller groups
                group = group[: len(group) // 2]
            x, turn, _ = self._padded([pages[k] for k in group])
            p = _sigmoid(self._forward(x, turn)[1])
            for j, k in enumerate(group):
                out[k] = p[: len(pages[k]), j]
            at += len(group)
        return out

    def gradient(self, x: np.ndarray, turn: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the blocks, by weight."""
        both, z, back, kf, kb, cols = self._forward(x, turn)
        d = (_sigmoid(z) - y) * real / real.sum()
        grad = {"Wo": np.tensordot(both, d[..., None], ((0, 1), (0, 1))), "bo": d.sum(keepdims=True).reshape(1)}
        d_both = d[..., None] * self.w["Wo"][:, 0]
        self._back(x, "f", kf, d_both[..., : self.h], grad)
        self._back(back, "b", kb, d_both[..., self.h :][turn, cols], grad)
        return grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, at_once: int = 32, rate: float = 0.01, seed: int = 9) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        use = np.array([k for k in range(len(pages)) if len(pages[k])], int)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(epochs):
            rng.shuffle(use)
            for a in range(0, len(use), at_once):
                group = use[a : a + at_once]
                x, turn, real = self._padded([pages[k] for k in group])
                y = np.zeros(real.shape, np.float32)
                for j, k in enumerate(group):
                    y[: len(labels[k]), j] = labels[k]
                grad = self.gradient(x, turn, real, y)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                lr = rate * (1 if epoch < epochs * 2 // 3 else 0.2)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self
