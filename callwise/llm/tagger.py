"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Character classes: 0 is outside the text.
_PUNCTUATION = " \n\t@.-_+()%:;,/=\"'#&*!?[]{}|<>$~^`\\"
CLASSES = 6 + len(_PUNCTUATION)
_TABLE = np.full(128, 5, np.uint8)
_TABLE[ord("a"):ord("z") + 1] = 1
_TABLE[ord("A"):ord("Z") + 1] = 2
_TABLE[ord("0"):ord("9") + 1] = 3
for _i, _c in enumerate(_PUNCTUATION):
    _TABLE[ord(_c)] = 6 + _i


def char_classes(text: str) -> np.ndarray:
    """A class per code point; letters and other signs outside ASCII are class 4."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], 4).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    """Weights as a dict of arrays: wx (2, classes, 4H), wh (2, H, 4H), wo (2H, K), bo, trans (K, K), start."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def new(cls, tags: int, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        wx = rng.normal(0, 0.3, (2, CLASSES, 4 * hidden)).astype(np.float32)
        wx[:, :, hidden:2 * hidden] += 1  # forget gates start open
        return cls({"wx": wx, "wh": rng.normal(0, hidden ** -0.5, (2, hidden, 4 * hidden)).astype(np.float32),
                    "wo": rng.normal(0, 0.2, (2 * hidden, tags)).astype(np.float32), "bo": np.zeros(tags, np.float32),
                    "trans": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)})

    def run(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores (B, T, K) of windows of classes (B, T)."""
        w, (n, t) = self.w, x.shape
        size = w["wh"].shape[1]
        both = np.stack([x, x[:, ::-1]])
        zx = np.stack([w["wx"][d][both[d]] for d in (0, 1)])
        h, c = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        gates = np.empty((t, 2, n, 4 * size), np.float32)
        cells, hidden = np.empty((t + 1, 2, n, size), np.float32), np.empty((t + 1, 2, n, size), np.float32)
        cells[0], hidden[0] = c, h
        for k in range(t):
            z = zx[:, :, k] + h @ w["wh"]
            s = _sigmoid(z[..., :3 * size])
            g = np.tanh(z[..., 3 * size:])
            c = s[..., size:2 * size] * c + s[..., :size] * g
            h = s[..., 2 * size:] * np.tanh(c)
            gates[k, ..., :3 * size], gates[k, ..., 3 * size:] = s, g
            cells[k + 1], hidden[k + 1] = c, h
        states = np.concatenate([hidden[1:, 0], hidden[:0:-1, 1]], axis=-1).transpose(1, 0, 2)
        return states @ w["wo"] + w["bo"], {"both": both, "gates": gates, "cells": cells, "hidden": hidden, "states": states}

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of every window, by Viterbi over scores and transitions."""
        scores, _ = self.run(x)
        n, t, k = scores.shape
        best = scores[:, 0] + self.w["start"]
        back = np.zeros((t, n, k), np.int8)
        for i in range(1, t):
            step = best[:, :, None] + self.w["trans"][None]
            back[i] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[:, i]
        out = np.empty((n, t), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i][np.arange(n), out[:, i]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per character, and its gradients."""
        w = self.w
        scores, seen = self.run(x)
        n, t, k = scores.shape
        size = w["wh"].shape[1]
        alpha, beta = np.empty((t, n, k)), np.zeros((t, n, k))
        alpha[0] = scores[:, 0] + w["start"]
        for i in range(1, t):
            alpha[i] = _logsumexp(alpha[i - 1][:, :, None] + w["trans"], 1) + scores[:, i]
        for i in range(t - 2, -1, -1):
            beta[i] = _logsumexp(w["trans"][None] + (scores[:, i + 1] + beta[i + 1])[:, None, :], 2)
        norm = _logsumexp(alpha[-1], 1)
        rows = np.arange(n)
        gold = scores[rows[:, None], np.arange(t), y].sum(axis=1) + w["start"][y[:, 0]] + w["trans"][y[:, :-1], y[:, 1:]].sum(axis=1)
        share = 1 / (n * t)
        d_scores = np.exp(alpha + beta - norm[None, :, None]).transpose(1, 0, 2)
        d_start = d_scores[:, 0].sum(axis=0)
        d_trans = np.zeros((k, k))
        for i in range(1, t):
            d_trans += np.exp(alpha[i - 1][:, :, None] + w["trans"] + (scores[:, i] + beta[i])[:, None, :] - norm[:, None, None]).sum(axis=0)
        np.add.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        np.add.at(d_start, y[:, 0], -1)
        d_scores[rows[:, None], np.arange(t), y] -= 1
        d_scores = (d_scores * share).astype(np.float32)
        flat = d_scores.reshape(-1, k)
        grads = {"wo": seen["states"].reshape(-1, 2 * size).T @ flat, "bo": flat.sum(axis=0), "trans": d_trans * share, "start": d_start * share}
        d_states = (d_scores @ w["wo"].T).transpose(1, 0, 2)
        d_out = np.stack([d_states[:, :, :size], d_states[::-1, :, size:]], axis=1)
        dh, dc = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        dz_all = np.empty_like(seen["gates"])
        turned = w["wh"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            g, c0, c1 = seen["gates"][i], seen["cells"][i], seen["cells"][i + 1]
            a, f, o, u = g[..., :size], g[..., size:2 * size], g[..., 2 * size:3 * size], g[..., 3 * size:]
            dh = dh + d_out[i]
            tc = np.tanh(c1)
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[i]
            dz[..., :size] = dc * u * a * (1 - a)
            dz[..., size:2 * size] = dc * c0 * f * (1 - f)
            dz[..., 2 * size:3 * size] = dh * tc * o * (1 - o)
            dz[..., 3 * size:] = dc * a * (1 - u * u)
            dc = dc * f
            dh = dz @ turned
        before = seen["hidden"][:-1].transpose(1, 0, 2, 3).reshape(2, -1, size)
        flat_z = dz_all.transpose(1, 0, 2, 3).reshape(2, -1, 4 * size)
        grads["wh"] = before.transpose(0, 2, 1) @ flat_z
        grads["wx"] = np.zeros_like(w["wx"])
        for d in (0, 1):
            hot = np.zeros((t * n, CLASSES), np.float32)
            hot[np.arange(t * n), seen["both"][d].T.ravel()] = 1
            grads["wx"][d] = hot.T @ flat_z[d]
        return float(((norm - gold) * share).sum()), grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over random batches; returns the losses."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v, np.float64) for k, v in self.w.items()}
        second = {k: np.zeros_like(v, np.float64) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            loss, grads = self.gradients(x[at], y[at])
            losses.append(loss)
            pace = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                self.w[k] = (self.w[k] - move).astype(np.float32)
        return losses
