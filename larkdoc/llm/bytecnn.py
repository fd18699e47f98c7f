"""A small convolutional network over bytes, in numpy: an embedding of bytes,
filters of several widths, a maximum over the positions of a window, and a softmax.
Trained with Adam on labelled windows, applied to batches of fixed-length windows
that overlap by the widest filter and together cover the whole text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class ByteCNN:
    classes: list
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 8  # of each width
    dim: int = 8
    seed: int = 7
    p: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        wide, n = max(self.widths), self.filters * len(self.widths)
        mask = np.zeros((wide, self.dim, n), np.float32)
        for k, w in enumerate(self.widths):
            mask[:w, :, k * self.filters : (k + 1) * self.filters] = 1 / np.sqrt(w * self.dim)
        self.mask = (mask > 0).reshape(wide * self.dim, n).astype(np.float32)
        if not self.p:
            self.p = {
                "e": rng.normal(0, 1, (256, self.dim)).astype(np.float32),
                "k": (rng.normal(0, 1, (wide, self.dim, n)) * mask).reshape(wide * self.dim, n).astype(np.float32),
                "b": np.zeros(n, np.float32),
                "w": rng.normal(0, 0.3, (n, len(self.classes))).astype(np.float32),
                "c": np.zeros(len(self.classes), np.float32),
            }
            self.p["e"][0] = 0  # byte 0 pads

    @property
    def stride(self) -> int:
        return self.window - max(self.widths) + 1

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of all texts: (windows, index of the text, bytes in the window). No text gets none."""
        n = np.array([len(t) for t in texts], np.int64)
        count = np.maximum(1, -(-(n - self.window) // self.stride) + 1)
        owner = np.repeat(np.arange(len(texts)), count)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = first * self.stride
        size = np.clip(n[owner] - begin, 0, self.window)
        buf = np.frombuffer(b"".join(texts) + bytes(self.window), np.uint8)
        at = (np.cumsum(n) - n)[owner] + begin
        x = buf[at[:, None] + np.arange(self.window)]
        x[np.arange(self.window) >= size[:, None]] = 0
        return x, owner, size

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e, wide = self.p["e"][x], max(self.widths)
        view = np.lib.stride_tricks.as_strided(e, (len(x), self.stride, wide * self.dim), e.strides)
        return np.ascontiguousarray(view)

    def logits(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), block):
            z = (self._columns(x[i : i + block]) @ self.p["k"]).max(1) + self.p["b"]
            out[i : i + block] = np.maximum(z, 0) @ self.p["w"] + self.p["c"]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 3e-3) -> ByteCNN:
        rng, m = np.random.default_rng(self.seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        wide, step, total = max(self.widths), 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                col, row = self._columns(xb), np.arange(len(xb))
                z = col @ self.p["k"]
                at = z.argmax(1)
                h = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["b"]
                a = np.maximum(h, 0)
                s = a @ self.p["w"] + self.p["c"]
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                s[row, yb] -= 1
                s /= len(xb)
                dh = (s @ self.p["w"].T) * (h > 0)
                best = col[row[:, None], at]
                de = np.zeros_like(self.p["e"])
                parts = (dh[:, :, None] * self.p["k"].T).reshape(-1, self.dim)
                np.add.at(de, xb[row[:, None, None], at[:, :, None] + np.arange(wide)].ravel(), parts)
                de[0] = 0
                g = {"e": de, "k": np.einsum("nf,nfk->kf", dh, best) * self.mask, "b": dh.sum(0), "w": a.T @ s, "c": s.sum(0)}
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, v in g.items():
                    m[k][0] += 0.1 * (v - m[k][0])
                    m[k][1] += 0.01 * (v * v - m[k][1])
                    self.p[k] -= now * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-7)
        return self

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """A probability of each class for each text: the windows' log-odds, averaged by length."""
        if not texts:
            return np.empty((0, len(self.classes)), np.float64)
        out = np.zeros((len(texts), len(self.classes)))
        weight = np.zeros(len(texts))
        group: list[int] = []
        held = 0
        for i, t in enumerate([*texts, None]):  # groups of texts with bounded windows
            if group and (t is None or held + len(t) > 1_000_000):
                x, owner, size = self.cut([texts[j] for j in group])
                s = self.logits(x).astype(np.float64)
                s -= np.log(np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)) + s.max(1, keepdims=True)
                w = np.maximum(size, 1).astype(np.float64)
                at = np.array(group)[owner]
                np.add.at(out, at, s * w[:, None])
                np.add.at(weight, at, w)
                group, held = [], 0
            if t is not None:
                group.append(i)
                held += len(t)
        out /= weight[:, None]
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)
