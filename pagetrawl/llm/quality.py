"""Text quality by a factorisation machine (operator 3).

Features of a document are its hashed words, as shares of its words, and statistics of its structure:
shares of kinds of characters, lengths of words and lines, repetition, and its length as metadata. Every pair
of features interacts through low-rank factors, and the sum over all pairs takes time linear in
the features: half of (sum of v x) squared minus the sum of (v x) squared.

The model is trained here in numpy on a bounded sample of labelled rows. Scoring is one
narrow pass over the documents; the weights (under 1 MB) go with the task.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.llm.common import held_out, numbered
from pagetrawl.llm.learn import calibration, score_texts, sigmoid, training_sample

BUCKETS, RANK = 1 << 13, 8
STATISTICS = 20
#: Word features weigh this much against the standardised statistics.
WORDS_SCALE = 4.0
#: Standardised statistics are cut off at this many deviations.
FARTHEST = 4.0

_CLASSES = np.zeros(256, np.int64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".,", b"!?", b"|", b"#$%&*", b"()[]{}<>"), 1):
    _CLASSES[list(_set)] = _k
_CLASSES[128:] = 11


def features(texts: list[str]):
    """Of each text: its statistics, and the word buckets with their shares as ``(owner, bucket, share)``."""
    lists = [t.split() for t in texts]
    words, numbers = numbered(lists)
    hashed = np.array([zlib.crc32(w.encode("utf-8", "replace")) & (BUCKETS - 1) for w in words] or [0], np.int64)
    sizes = np.array([len(x) for x in lists], np.int64)
    numbers = np.array(numbers, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes, counts = np.unique(owner * BUCKETS + hashed[numbers], return_counts=True) if len(numbers) else (numbers, numbers)
    whose = codes // BUCKETS
    share = (WORDS_SCALE * counts / np.maximum(sizes, 1)[whose]).astype(np.float32)

    found = np.zeros((len(texts), STATISTICS), np.float32)
    distinct = np.bincount(np.unique(owner * max(len(words), 1) + numbers) // max(len(words), 1), minlength=len(texts)) if len(numbers) else np.zeros(len(texts))
    for k, (text, own) in enumerate(zip(texts, lists)):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        n, m = max(len(raw), 1), max(len(own), 1)
        kinds = np.bincount(_CLASSES, np.bincount(raw, minlength=256), 12) / n
        lines = text.split("\n")
        found[k, :12] = np.sqrt(kinds)
        found[k, 12:] = (
            np.log1p(len(raw)), np.log1p(len(own)), len(raw) / m, distinct[k] / m, np.log1p(len(lines)),
            len(set(lines)) / len(lines), len(own) / len(lines) / 100, max(map(len, own), default=0) / 50,
        )
    return found, whose, codes % BUCKETS, share


class Machine:
    """Weights of a factorisation machine; the features are the statistics, then the word buckets."""

    def __init__(self, seed: int = 5):
        draw, size = np.random.default_rng(seed), STATISTICS + BUCKETS
        self.bias, self.w = np.zeros(1, np.float32), np.zeros(size, np.float32)
        self.v = (draw.standard_normal((size, RANK)) * 0.05).astype(np.float32)
        self.middle, self.spread = np.zeros(STATISTICS, np.float32), np.ones(STATISTICS, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def standard(self, statistics):
        return np.clip((statistics - self.middle) / self.spread, -FARTHEST, FARTHEST)

    def raw(self, statistics, owner, bucket, share):
        """Scores, and the sums of v x that the gradient needs."""
        n, i = len(statistics), bucket + STATISTICS
        linear = statistics @ self.w[:STATISTICS] + np.bincount(owner, self.w[i] * share, n)
        vx = self.v[i] * share[:, None]
        sums = statistics @ self.v[:STATISTICS]
        squares = (statistics**2) @ (self.v[:STATISTICS] ** 2)
        for f in range(RANK):
            sums[:, f] += np.bincount(owner, vx[:, f], n)
            squares[:, f] += np.bincount(owner, vx[:, f] ** 2, n)
        return self.bias[0] + linear + 0.5 * (sums**2 - squares).sum(1), sums

    def score(self, texts: list[str]) -> np.ndarray:
        statistics, *words = features(texts)
        return sigmoid(np.clip(self.scale * self.raw(self.standard(statistics), *words)[0] + self.shift, -30, 30))


def fit(texts: list[str], labels: list[int], rounds: int = 12, seed: int = 5) -> Machine:
    """A machine trained on whole texts; without labels of both kinds it gives every text the same score."""
    machine, draw, y = Machine(seed), np.random.default_rng(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        machine.scale, machine.shift = 0.0, 10.0 if len(y) and y.min() == 1 else -10.0
        return machine
    statistics, owner, bucket, share = features(texts)
    machine.middle, machine.spread = statistics.mean(0), statistics.std(0) + 1e-3
    statistics = machine.standard(statistics)
    firsts = np.searchsorted(owner, np.arange(len(texts) + 1))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    params = {"bias": machine.bias, "w": machine.w, "v": machine.v}
    mean = {k: np.zeros_like(p) for k, p in params.items()}
    var, step = {k: np.zeros_like(p) for k, p in params.items()}, 0
    for turn in range(rounds):
        rate = 0.01 if turn < rounds * 2 // 3 else 0.002
        mixed = draw.permutation(len(texts))
        for at in range(0, len(mixed), 128):
            pick = mixed[at : at + 128]
            rows = np.concatenate([np.arange(firsts[k], firsts[k + 1]) for k in pick])
            own = np.repeat(np.arange(len(pick)), firsts[pick + 1] - firsts[pick])
            x, i, stats = share[rows], bucket[rows] + STATISTICS, statistics[pick]
            raw, sums = machine.raw(stats, own, bucket[rows], x)
            slope = (weight[pick] * (sigmoid(np.clip(raw, -30, 30)) - y[pick]) / len(pick)).astype(np.float32)
            grad = {"bias": slope.sum(keepdims=True), "w": 1e-4 * machine.w, "v": 1e-4 * machine.v}
            grad["w"][:STATISTICS] += slope @ stats
            grad["w"][STATISTICS:] += np.bincount(bucket[rows], slope[own] * x, BUCKETS)
            v = machine.v[:STATISTICS]
            grad["v"][:STATISTICS] += stats.T @ (slope[:, None] * sums) - (slope @ stats**2)[:, None] * v
            np.add.at(grad["v"], i, (slope[own] * x)[:, None] * (sums[own] - machine.v[i] * x[:, None]))
            step += 1
            for k, p in params.items():
                mean[k] += 0.1 * (grad[k] - mean[k])
                var[k] += 0.001 * (grad[k] ** 2 - var[k])
                p -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    machine.scale, machine.shift = calibration(machine.raw(statistics, owner, bucket, share)[0].astype(float), y)
    return machine


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Learns from at most ``per_class`` rows of either class of ``labels`` (doc_id, quality) that are not held
    out. Null and empty texts are scored by their (zero) features; repeated rows score alike; rows
    without an id count as held out. Other columns are ignored.
    """
    machine = fit(*training_sample(docs, labels, "quality", per_class))
    scored = score_texts(docs, machine.score)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
