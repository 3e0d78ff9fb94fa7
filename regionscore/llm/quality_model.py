"""Operator 1: quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``passage_words`` words. A passage's features are
hashed pairs of neighbouring bytes, shares of character classes, and lengths; a
tanh layer encodes them, gated attention (tanh times sigmoid) weighs the
passages, and the score is a logistic unit on the weighted mean. Only texts have
labels: the attention learns which passages decide.

Features and scores are made in Arrow batches over all texts, whole. The model
is fitted on a bounded sample: the ``sample`` labelled documents of least hashed
id, at most ``sample_passages`` evenly spaced passages of each, which are all
that the driver ever gets. The sample bounds training only.

Defined results: null text counts as empty; a text without words is one empty
passage and is scored like any other; ids whose labels disagree or are null are
not learned from; without labels of both kinds the score is the share of good
labels (0.5 without any); repeated rows have one score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import named, row_of, whole_text

PAIRS = 512
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def classes() -> np.ndarray:
    """0 space, 1 line feed, 2 lower case, 3 capital, 4 digit, 5 sentence mark, 6 symbol, 7 beyond ASCII."""
    out = np.full(256, 6, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = (7 if b >= 128 else 1 if c == "\n" else 0 if SPACE[b] else 2 if c.islower() else 3 if c.isupper()
                  else 4 if c.isdigit() else 5 if c in ".,;:'\"!?-" else 6)
    return out


CLASS = classes()
WIDTH = PAIRS + 8 + 4


def passage_features(text: str, passage_words: int) -> np.ndarray:
    """One row for each passage of the text."""
    b = np.frombuffer(text.encode("utf-8"), np.uint8)
    word = ~SPACE[b]
    starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1]))) if len(b) else np.array([], np.int64)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    first = starts[::passage_words]
    bag = np.zeros(len(b), np.int64)
    bag[first[1:]] = 1
    bag = np.cumsum(bag)
    n = len(first)
    pair = ((b[:-1].astype(np.int64) * 31 + b[1:]) * 2654435761 >> 7) % PAIRS
    pairs = np.bincount(bag[1:] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    kinds = np.bincount(bag * 8 + CLASS[b], minlength=n * 8).reshape(n, 8)
    words = np.bincount(bag[starts], minlength=n)[:, None]
    chars = kinds.sum(axis=1, keepdims=True)
    letters = kinds[:, 2:].sum(axis=1, keepdims=True)
    shape = np.hstack([letters / np.maximum(words, 1) / 10, words / passage_words,
                       (pairs > 0).sum(axis=1, keepdims=True) / PAIRS, (pairs.astype(float) ** 2).sum(axis=1, keepdims=True)
                       / np.maximum(chars, 1) ** 2])
    return np.hstack([np.sqrt(pairs / np.maximum(chars, 1)), np.sqrt(kinds / np.maximum(chars, 1)), shape]).astype(np.float32)


class GatedAttention:
    """Parameters: mean, scale of features; W, b encoder; V, U, w attention; c, d output."""

    def __init__(self, **parts):
        self.parts = parts

    @staticmethod
    def constant(share: float) -> GatedAttention:
        return GatedAttention(share=share)

    def forward(self, x: np.ndarray, bags: np.ndarray, n: int) -> tuple:
        """x: passages; bags: ascending number of each one's bag, every bag of the n present."""
        p = self.parts
        h = np.tanh((x - p["mean"]) / p["scale"] @ p["W"] + p["b"])
        gate_t, gate_s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (gate_t * gate_s) @ p["w"]
        edges = np.flatnonzero(np.concatenate(([True], bags[1:] != bags[:-1])))
        e = np.exp(a - np.maximum.reduceat(a, edges)[bags])
        weight = e / np.add.reduceat(e, edges)[bags]
        z = np.add.reduceat(weight[:, None] * h, edges)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return h, gate_t, gate_s, weight, edges, z, score

    def scores(self, x: np.ndarray, bags: np.ndarray, n: int) -> np.ndarray:
        if "share" in self.parts:
            return np.full(n, self.parts["share"])
        return self.forward(x, bags, n)[-1]

    @staticmethod
    def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gates: int = 16, epochs: int = 30,
            batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        if not len(labels) or labels.min() == labels.max():
            return GatedAttention.constant(float(labels.mean()) if len(labels) else 0.5)
        rng = np.random.default_rng(seed)
        x = np.vstack(bags)
        sizes = np.array([len(b) for b in bags])
        at = np.concatenate(([0], np.cumsum(sizes)))
        normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        m = GatedAttention(mean=x.mean(axis=0), scale=x.std(axis=0) + 0.02, W=normal(x.shape[1], hidden),
                           b=np.zeros(hidden, np.float32), V=normal(hidden, gates), U=normal(hidden, gates),
                           w=normal(gates), c=normal(hidden), d=np.float32(np.log(labels.mean() / (1 - labels.mean()))))
        p, names = m.parts, ("W", "b", "V", "U", "w", "c", "d")
        first, second, step = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                chosen = order[k:k + batch]
                rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in chosen])
                own = np.repeat(np.arange(len(chosen)), sizes[chosen])
                xs = x[rows]
                h, gt, gs, weight, edges, z, score = m.forward(xs, own, len(chosen))
                err = (score - labels[chosen]) / len(chosen)
                grad = {"c": z.T @ err, "d": err.sum()}
                dz = err[:, None] * p["c"]
                dweight = (h * dz[own]).sum(axis=1)
                dh = weight[:, None] * dz[own]
                da = weight * (dweight - np.add.reduceat(weight * dweight, edges)[own])
                grad["w"] = (gt * gs).T @ da
                dg = da[:, None] * p["w"]
                dt, ds = dg * gs * (1 - gt ** 2), dg * gt * gs * (1 - gs)
                grad["V"], grad["U"] = h.T @ dt, h.T @ ds
                dh += dt @ p["V"].T + ds @ p["U"].T
                du = dh * (1 - h ** 2)
                grad["W"], grad["b"] = ((xs - p["mean"]) / p["scale"]).T @ du, du.sum(axis=0)
                step += 1
                for name in names:  # Adam with weight decay
                    first[name] = 0.9 * first[name] + 0.1 * grad[name]
                    second[name] = 0.999 * second[name] + 0.001 * grad[name] ** 2
                    move = first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
                    p[name] = (p[name] - rate * (move + decay * p[name])).astype(np.float32)
        return m


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = 3000,
          sample_passages: int = 24, passage_words: int = 64) -> GatedAttention:
    """labels: doc_id and label (1 good, 0 bad), only those that may be learned from."""
    agreed = (labels.filter("label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
              .filter("label = most"))
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("labelled_id"), "label")
    rows = (docs.join(F.broadcast(chosen), named(doc_id) == F.col("labelled_id"))
            .select("labelled_id", "label", whole_text(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = []
            for x in part.column(2):
                bag = passage_features(x.as_py(), passage_words)
                picked = np.unique(np.linspace(0, len(bag) - 1, min(len(bag), sample_passages)).astype(int))
                found.append(bag[picked].astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["id", "label", "bag"])

    schema = T.StructType([T.StructField("id", rows.schema["labelled_id"].dataType),
                           T.StructField("label", rows.schema["label"].dataType), T.StructField("bag", T.BinaryType())])
    # repeated rows of one id count once
    got = rows.mapInArrow(run, schema).groupBy("id").agg(F.max("label").alias("label"), F.min("bag").alias("bag")).toArrow()
    got = got.sort_by("id").to_pydict()
    bags = [np.frombuffer(x, "<f2").reshape(-1, WIDTH).astype(np.float32) for x in got["bag"]]
    return GatedAttention.fit(bags, np.array(got["label"], dtype=np.float32))


def score(docs: DataFrame, model: GatedAttention, text: str = "text", passage_words: int = 64,
          keep_text: bool = False) -> DataFrame:
    """row (a struct of the columns of ``docs``, without the text unless kept) and score, 0 to 1."""
    row = row_of(docs) if keep_text else row_of(docs, text)
    rows = docs.select(row.alias("row"), whole_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                bags = [passage_features(x.as_py(), passage_words) for x in part.column(1)]
                own = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
                found = model.scores(np.vstack(bags), own, len(bags)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
