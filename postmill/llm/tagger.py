"""A character tagger in numpy: a bidirectional LSTM gives each character a score for each label, a CRF the labels of a window.

Training and decoding work on whole batches of windows of one length. Labels are outside, and begin and inside of each kind.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Characters that the tagger tells apart: ASCII, and one for all others. 0 fills up windows.
CHARACTERS = 129
EMBED, HIDDEN = 12, 24
NEVER = -1e4


def codes(text: str) -> np.ndarray:
    """The characters of a text as the tagger knows them."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), CHARACTERS - 1).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Weights by name; label 0 is outside, 2k + 1 begins kind k and 2k + 2 continues it."""

    kinds: int
    seed: int = 1
    hidden: int = HIDDEN
    dtype: type = np.float32
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng, h, labels = np.random.default_rng(self.seed), self.hidden, 2 * self.kinds + 1
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(self.dtype)
        self.w = {"embed": draw(CHARACTERS, EMBED) * 4, "out": draw(2 * h, labels), "out_b": np.zeros(labels, self.dtype), "step": np.zeros((labels, labels), self.dtype), "first": np.zeros(labels, self.dtype)}
        for side in "fb":
            bias = np.zeros(4 * h, self.dtype)
            bias[h : 2 * h] = 1  # remember at first
            self.w |= {f"{side}_in": draw(EMBED, 4 * h), f"{side}_own": draw(h, 4 * h), f"{side}_b": bias}
        inside = np.arange(2, labels, 2)
        self.barred = np.zeros((labels, labels), bool)
        self.barred[:, inside] = True
        self.barred[inside, inside] = self.barred[inside - 1, inside] = False
        self.bar()

    def bar(self) -> None:
        """An inside label follows only its own begin or inside."""
        self.w["step"][self.barred] = NEVER
        self.w["first"][2::2] = NEVER

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, tuple]:
        """Outputs by time for inputs (time, rows, 4 x hidden), and what going back needs. Gates: in, keep, out, new."""
        h, own = self.hidden, self.w[f"{side}_own"]
        out, cell, gates = (np.empty((len(x), x.shape[1], n), self.dtype) for n in (h, h, 4 * h))
        last = memory = np.zeros((x.shape[1], h), self.dtype)
        for t in range(len(x)):
            z = x[t] + last @ own
            g = gates[t]
            g[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            memory = g[:, h : 2 * h] * memory + g[:, :h] * g[:, 3 * h :]
            cell[t] = memory
            last = out[t] = g[:, 2 * h : 3 * h] * np.tanh(memory)
        return out, (out, cell, gates)

    def _lstm_back(self, d_out: np.ndarray, kept: tuple, side: str, grad: dict) -> np.ndarray:
        """Gradients of the inputs, from those of the outputs; adds those of the weights."""
        h, own, (out, cell, gates) = self.hidden, self.w[f"{side}_own"], kept
        d_x = np.empty_like(gates)
        d_last = d_memory = np.zeros_like(out[0])
        for t in range(len(out) - 1, -1, -1):
            i, keep, o, new = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
            shown = np.tanh(cell[t])
            d_h = d_out[t] + d_last
            d_c = d_memory + d_h * o * (1 - shown**2)
            before = cell[t - 1] if t else np.zeros_like(shown)
            d_x[t] = np.concatenate([d_c * new * i * (1 - i), d_c * before * keep * (1 - keep), d_h * shown * o * (1 - o), d_c * i * (1 - new**2)], axis=1)
            d_memory = d_c * keep
            d_last = d_x[t] @ own.T
        grad[f"{side}_own"] = np.einsum("tnh,tng->hg", out[:-1], d_x[1:], optimize=True)
        grad[f"{side}_b"] = d_x.sum((0, 1))
        return d_x

    def emissions(self, chars: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (time, rows, labels) of windows (rows, time), and what going back needs."""
        w, ids = self.w, chars.T
        # a character's part in the gates is a row of a small table
        ahead, kept_f = self._lstm((w["embed"] @ w["f_in"] + w["f_b"])[ids], "f")
        back, kept_b = self._lstm((w["embed"] @ w["b_in"] + w["b_b"])[ids[::-1]], "b")
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ w["out"] + w["out_b"], (both, kept_f, kept_b)

    def loss(self, chars: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold labels (rows, time), and its gradient by weight."""
        w, (rows, length), h = self.w, chars.shape, self.hidden
        emit, (both, kept_f, kept_b) = self.emissions(chars)
        step, gold = w["step"], gold.T.astype(np.int64)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + w["first"]
        for t in range(1, length):
            alpha[t] = emit[t] + _log_sum(alpha[t - 1][:, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _log_sum((emit[t + 1] + beta[t + 1])[:, None, :] + step, 2)
        total = _log_sum(alpha[-1], 1)
        own, n = np.arange(rows), np.arange(length)[:, None]
        value = total - emit[n, own, gold].sum(0) - step[gold[:-1], gold[1:]].sum(0) - w["first"][gold[0]]
        d_emit = np.exp(alpha + beta - total[:, None])
        grad = {"first": d_emit[0].sum(0)}
        grad["step"] = sum(np.exp(alpha[t - 1][:, :, None] + step + (emit[t] + beta[t] - total[:, None])[:, None, :]).sum(0) for t in range(1, length))
        np.subtract.at(grad["first"], gold[0], 1)
        np.subtract.at(grad["step"], (gold[:-1].ravel(), gold[1:].ravel()), 1)
        d_emit[n, own, gold] -= 1
        grad["out"] = np.einsum("tnh,tnl->hl", both, d_emit, optimize=True)
        grad["out_b"] = d_emit.sum((0, 1))
        d_both = d_emit @ w["out"].T
        d_f = self._lstm_back(d_both[:, :, :h], kept_f, "f", grad)
        d_b = self._lstm_back(d_both[::-1, :, h:], kept_b, "b", grad)[::-1]
        d_table = {s: np.zeros((CHARACTERS, 4 * h), self.dtype) for s in "fb"}
        for s, d in (("f", d_f), ("b", d_b)):
            np.add.at(d_table[s], chars.T.ravel(), d.reshape(-1, 4 * h))
            grad[f"{s}_in"] = w["embed"].T @ d_table[s]
        grad["embed"] = d_table["f"] @ w["f_in"].T + d_table["b"] @ w["b_in"].T
        grad["step"][self.barred] = 0
        grad["first"][2::2] = 0
        return float(value.mean()), {k: (g / rows).astype(self.dtype) for k, g in grad.items()}

    def train(self, chars: np.ndarray, gold: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.015) -> list[float]:
        """Adam over shuffled batches with a falling rate; the loss of each batch. The same rows give the same weights."""
        rng, losses = np.random.default_rng(self.seed), []
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        steps = epochs * -(-len(chars) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for i in range(0, len(order), batch):
                value, grad = self.loss(chars[order[i : i + batch]], gold[order[i : i + batch]])
                losses.append(value)
                n = len(losses)
                norm = float(np.sqrt(sum(float((g**2).sum()) for g in grad.values())))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.w[k] -= (rate * (1 - 0.9 * n / steps)) * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-8)
                self.bar()
        return losses

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best labels (rows, time) of windows, and each one's lead over outside."""
        emit, _ = self.emissions(chars)
        length, rows, labels = emit.shape
        step, best = self.w["step"], emit[0] + self.w["first"]
        came = np.empty((length, rows, labels), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + step
            came[t] = ways.argmax(1)
            best = np.take_along_axis(ways, came[t][:, None, :].astype(np.int64), 1)[:, 0] + emit[t]
        at, own = best.argmax(1), np.arange(rows)
        path = np.empty((length, rows), np.int64)
        path[-1] = at
        for t in range(length - 1, 0, -1):
            at = path[t - 1] = came[t][own, at]
        return path.T, (np.take_along_axis(emit, path[:, :, None], 2)[:, :, 0] - emit[:, :, 0]).T
