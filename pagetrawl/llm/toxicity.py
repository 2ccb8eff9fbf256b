"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 9).

A word is read twice: as a whole (a hashed embedding) and by its characters (the mean of
embeddings of its hashed heads, tail and length). Two gated recurrent networks read each window of
words from both ends, attention pools their states, and a linear layer scores the window. Windows
overlap by half and cover the whole text; a document's score is that of its most toxic
window, calibrated on documents.

The network is small and trained here in numpy, on a bounded sample of labelled rows. A label
says that some window is toxic, not which: after warm-up rounds on random windows, toxic
documents train on the windows that score highest, others on random ones and the highest.

Scoring is one narrow pass over the documents; the weights (about 1 MB at any input size) go
with the task.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.llm.common import held_out, numbered
from pagetrawl.llm.learn import calibration, only, score_texts, sigmoid, training_sample

WINDOW, STRIDE = 24, 12
HIDDEN, ATTENTION, WIDTH = 8, 8, 8
BUCKETS = 1 << 13
PARTS = 6
#: A padded position keeps the state: its update gate is shut.
SHUT = 30.0
CHUNK = 4096
FAR = np.float32(-1e9)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_inputs(words: list[str]) -> np.ndarray:
    """Per word: the bucket of the whole, then those of its heads of 3 to 6 characters, tail and length."""
    found = np.empty((len(words), 1 + PARTS), np.int32)
    for k, word in enumerate(words):
        bare = word.strip("\"'.,;:!?()[]{}<>*#$%&|-") or word
        keys = (bare, "^" + bare[:3], "^" + bare[:4], "^" + bare[:5], "^" + bare[:6], bare[-3:] + "$", str(min(len(bare), 20)) + "#")
        found[k] = [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in keys]
    return found


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows over texts of some lengths laid end to end (-1 is padding), and each one's text."""
    starts, first, owner, ends = [], 0, [], []
    for k, n in enumerate(lengths):
        at = list(range(0, max(n - WINDOW + STRIDE, 1), STRIDE))
        starts.extend(first + a for a in at)
        owner.extend([k] * len(at))
        first += n
        ends.extend([first] * len(at))
    where = np.array(starts, np.int64)[:, None] + np.arange(WINDOW)
    where[where >= np.array(ends, np.int64)[:, None]] = -1
    return where.reshape(-1, WINDOW), np.array(owner, np.int64)


class Network:
    """Weights, forward and backward passes. ``g`` are the input gates of distinct words, the last one padding."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        h = HIDDEN
        self.w = {
            "word": normal(BUCKETS, WIDTH, scale=0.1), "part": normal(BUCKETS, WIDTH, scale=0.1),
            "wx": normal(2 * WIDTH, 6 * h, scale=0.3), "bx": np.zeros(6 * h, np.float32),
            "uf": normal(h, 3 * h, scale=0.3), "ub": normal(h, 3 * h, scale=0.3),
            "wa": normal(2 * h, ATTENTION, scale=0.3), "ba": np.zeros(ATTENTION, np.float32),
            "v": normal(ATTENTION, scale=0.3), "wo": normal(2 * h, scale=0.3), "bo": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def gates(self, inputs: np.ndarray):
        w = self.w
        x = np.concatenate([w["word"][inputs[:, 0]], w["part"][inputs[:, 1:]].mean(1)], axis=1)
        g = np.concatenate([x @ w["wx"] + w["bx"], np.zeros((1, 6 * HIDDEN), np.float32)])
        g[-1, :HIDDEN] = g[-1, 3 * HIDDEN : 4 * HIDDEN] = SHUT
        return x, g

    def _read(self, g, u, index, order, saved=None):
        h, size = np.zeros((len(index), HIDDEN), np.float32), HIDDEN
        states = np.empty((WINDOW, len(index), HIDDEN), np.float32)
        for t in order:
            x = g[index[:, t]]
            a = h @ u
            zr = sigmoid(x[:, : 2 * size] + a[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            n = np.tanh(x[:, 2 * size :] + r * a[:, 2 * size :])
            if saved is not None:
                saved[t] = (h, z, r, n, a[:, 2 * size :])
            h = n + z * (h - n)
            states[t] = h
        return states

    def forward(self, g, index, saved=None):
        """Scores of windows of word numbers (the last number is padding)."""
        w, keep = self.w, saved if saved is not None else {}
        sf, sb = ({}, {}) if saved is not None else (None, None)
        f = self._read(g[:, : 3 * HIDDEN], w["uf"], index, range(WINDOW), sf)
        b = self._read(g[:, 3 * HIDDEN :], w["ub"], index, range(WINDOW - 1, -1, -1), sb)
        states = np.concatenate([f, b], axis=2)
        q = np.tanh(states @ w["wa"] + w["ba"])
        u = q @ w["v"] + np.where(index.T == len(g) - 1, FAR, np.float32(0))
        u = np.exp(u - u.max(0))
        alpha = u / u.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        if saved is not None:
            keep.update(sf=sf, sb=sb, states=states, q=q, alpha=alpha, pooled=pooled)
        return pooled @ w["wo"] + w["bo"][0]

    def backward(self, inputs, x, g, index, saved, slope):
        """Gradients by name; ``slope`` is that of the loss in each window's score."""
        w, d = self.w, {}
        states, q, alpha, pooled = (saved[k] for k in ("states", "q", "alpha", "pooled"))
        d["wo"], d["bo"] = pooled.T @ slope, slope.sum(keepdims=True)
        dp = slope[:, None] * w["wo"]
        da = (states * dp).sum(2)
        du = alpha * (da - (alpha * da).sum(0))
        ds = alpha[:, :, None] * dp
        dq = du[:, :, None] * w["v"] * (1 - q * q)
        d["v"] = (q * du[:, :, None]).sum((0, 1))
        d["ba"] = dq.sum((0, 1))
        d["wa"] = np.einsum("tbi,tbj->ij", states, dq)
        ds = ds + dq @ w["wa"].T
        dg = np.zeros_like(g)
        for name, part, kept, order in (("uf", 0, saved["sf"], range(WINDOW - 1, -1, -1)), ("ub", 1, saved["sb"], range(WINDOW))):
            u, own = w[name], ds[:, :, part * HIDDEN : (part + 1) * HIDDEN]
            dh, grad = np.zeros_like(own[0]), np.zeros_like(u)
            for t in order:
                h, z, r, n, an = kept[t]
                dh = dh + own[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                back = np.concatenate([dz, dr, dn * r], axis=1)
                grad += h.T @ back
                np.add.at(dg[:, part * 3 * HIDDEN : (part + 1) * 3 * HIDDEN], index[:, t], np.concatenate([dz, dr, dn], axis=1))
                dh = dh * z + back @ u.T
            d[name] = grad
        dg = dg[:-1]
        d["wx"], d["bx"] = x.T @ dg, dg.sum(0)
        dx = dg @ w["wx"].T
        d["word"], d["part"] = np.zeros_like(w["word"]), np.zeros_like(w["part"])
        np.add.at(d["word"], inputs[:, 0], dx[:, :WIDTH])
        for k in range(PARTS):
            np.add.at(d["part"], inputs[:, 1 + k], dx[:, WIDTH:] / PARTS)
        return d

    def highest(self, lists: list[list[str]]) -> np.ndarray:
        """The highest window score of each list of words."""
        words, numbers = numbered(lists)
        _, g = self.gates(word_inputs(words))
        where, owner = windows([len(x) for x in lists])
        index = np.append(np.array(numbers, np.int64), len(words))[where]
        scores = np.concatenate([self.forward(g, index[k : k + CHUNK]) for k in range(0, len(index), CHUNK)])
        best = np.full(len(lists), -np.inf, np.float32)
        np.maximum.at(best, owner, scores)
        return best

    def score(self, lists: list[list[str]]) -> np.ndarray:
        return sigmoid(self.scale * self.highest(lists).astype(float) + self.shift)


def fit(texts: list[str], labels: list[int], rounds: int = 7, seed: int = 7) -> Network:
    """A network trained on whole texts; without labels of both kinds it scores everything near 0."""
    net, draw = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.scale, net.shift = 0.0, 10.0 if len(y) and y.min() == 1 else -10.0
        return net
    lists = [words_of(t) for t in texts]
    words, numbers = numbered(lists)
    inputs = word_inputs(words)
    where, owner = windows([len(x) for x in lists])
    index = np.append(np.array(numbers, np.int64), len(words))[where]
    firsts = np.searchsorted(owner, np.arange(len(lists) + 1))
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    var, step = {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    for turn in range(rounds):
        chosen, goal = [], []
        if turn >= 2:
            _, g = net.gates(inputs)
            now = np.concatenate([net.forward(g, index[k : k + CHUNK]) for k in range(0, len(index), CHUNK)])
        for k in range(len(lists)):
            own = np.arange(firsts[k], firsts[k + 1])
            some = draw.choice(own, min(len(own), 4), replace=False)
            if turn >= 2:
                top = own[np.argsort(-now[own])[:2]]
                some = top if y[k] else np.union1d(top, some)
            chosen.extend(some)
            goal.extend([y[k]] * len(some))
        chosen, goal = np.array(chosen), np.array(goal, np.float32)
        weight = np.where(goal == 1, 0.5 / goal.mean(), 0.5 / (1 - goal.mean())).astype(np.float32)
        mixed = draw.permutation(len(chosen))
        for at in range(0, len(mixed), 512):
            pick = mixed[at : at + 512]
            window = index[chosen[pick]]
            own, local = np.unique(window, return_inverse=True)
            if own[-1] == len(words):
                own = own[:-1]
            saved = {}
            x, g = net.gates(inputs[own])
            scores = net.forward(g, local.reshape(window.shape), saved)
            slope = (weight[pick] * (sigmoid(scores) - goal[pick]) / len(pick)).astype(np.float32)
            step += 1
            for k, d in net.backward(inputs[own], x, g, local.reshape(window.shape), saved, slope).items():
                mean[k] += 0.1 * (d - mean[k])
                var[k] += 0.001 * (d * d - var[k])
                net.w[k] -= 0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    net.scale, net.shift = calibration(net.highest(lists).astype(float), y)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Learns from at most ``per_class`` rows of either class of ``labels`` (doc_id, toxic) that are not held
    out. Null and empty texts are scored as a window of padding; repeated rows score alike; rows without
    an id count as held out. Other columns are ignored.
    """
    net = fit(*training_sample(docs, labels, "toxic", per_class))
    scored = score_texts(docs, lambda texts: net.score([words_of(t) for t in texts]))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 1500, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all their columns; learns and scores as ``toxicity`` does."""
    net = fit(*training_sample(docs, labels, "toxic", per_class))
    return only(docs, lambda texts: net.score([words_of(t) for t in texts]) < least)
