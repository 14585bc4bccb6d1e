"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage of
the whole text is encoded; a gated attention network weighs the passages, and the
weighted sum of their representations is scored. Encoding and scoring run in
Spark's tasks; fitting takes a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, empty_if_null, table

#: Characters of a passage, and hash buckets of its character pairs.
PASSAGE = 512
BUCKETS = 256
SHAPES = 8
PREDICTED_FROM = 0.3


@dataclass(frozen=True)
class Fit:
    """How the network is fitted.

    ``documents`` bounds the sample, half of it for each label, and
    ``characters`` the texts in it, so at most their product reaches the driver.
    Longer texts are left out of the sample only; all texts are scored whole.
    """

    documents: int = 4000
    characters: int = 20_000
    hidden: int = 32
    attention: int = 16
    steps: int = 600
    bags: int = 96
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


def encoded(text: str) -> np.ndarray:
    """Features of each passage; an empty text is one passage without characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    count = max(1, -(-len(codes) // PASSAGE))
    passage = np.arange(len(codes)) // PASSAGE
    out = np.zeros((count, BUCKETS + SHAPES), np.float32)
    if not len(codes):
        return out
    pairs = (codes[:-1] * np.uint32(2654435761)) ^ (codes[1:] * np.uint32(2246822519))
    pairs ^= pairs >> np.uint32(15)
    cells = passage[:-1] * BUCKETS + (pairs % BUCKETS)
    counts = np.bincount(cells, minlength=count * BUCKETS).reshape(count, BUCKETS)
    out[:, :BUCKETS] = np.log1p(counts)
    sizes = np.bincount(passage, minlength=count)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    digit = (codes >= 48) & (codes <= 57)
    upper = (codes >= 65) & (codes <= 90)
    lower = ((codes >= 97) & (codes <= 122)) | (codes >= 192)
    repeat = np.zeros(len(codes), bool)
    repeat[1:] = codes[1:] == codes[:-1]
    for i, mask in enumerate((space, codes == 10, digit, upper, lower, repeat)):
        out[:, BUCKETS + i] = 4 * np.bincount(passage, mask, count) / sizes
    other = ~(space | digit | upper | lower)
    out[:, BUCKETS + 6] = 4 * np.bincount(passage, other, count) / sizes
    out[:, BUCKETS + 7] = (counts > 0).sum(axis=1) / np.maximum(1, np.minimum(sizes, BUCKETS))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(model: dict, x: np.ndarray, bag: np.ndarray, firsts: np.ndarray) -> dict:
    h = np.tanh(x @ model["w"] + model["b"])
    t = np.tanh(h @ model["v"] + model["vb"])
    s = _sigmoid(h @ model["u"] + model["ub"])
    energy = (t * s) @ model["a"]
    energy = np.exp(energy - np.maximum.reduceat(energy, firsts)[bag])
    weight = energy / np.add.reduceat(energy, firsts)[bag]
    z = np.add.reduceat(weight[:, None] * h, firsts)
    return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "p": _sigmoid(z @ model["c"] + model["c0"])}


def _gradients(model: dict, x, bag, firsts, error: np.ndarray, f: dict) -> dict:
    """Gradients of the loss, ``error`` being its derivative by each bag's logit."""
    h, t, s, weight = f["h"], f["t"], f["s"], f["weight"]
    dz = error[:, None] * model["c"]
    toward = (dz[bag] * h).sum(axis=1)
    de = weight * (toward - np.add.reduceat(weight * toward, firsts)[bag])
    dg = de[:, None] * model["a"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = weight[:, None] * dz[bag] + dt @ model["v"].T + ds @ model["u"].T
    dx = dh * (1 - h * h)
    return {
        "w": x.T @ dx, "b": dx.sum(axis=0), "v": h.T @ dt, "vb": dt.sum(axis=0),
        "u": h.T @ ds, "ub": ds.sum(axis=0), "a": (t * s).T @ de,
        "c": f["z"].T @ error, "c0": np.array(error.sum()),
    }


def _bags(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(f) for f in features])
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.concatenate(features), np.repeat(np.arange(len(sizes)), sizes), firsts


def fitted(texts: list[str], labels: list[int], weights: list[float], fit: Fit = Fit()) -> dict:
    """The network fitted to documents, each weighing ``weights``."""
    y, importance = np.array(labels, np.float64), np.array(weights, np.float64)
    base = float((y * importance).sum() / importance.sum()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return {"constant": base}
    features = [encoded(t) for t in texts]
    every = np.concatenate(features)
    mean, spread = every.mean(axis=0), every.std(axis=0) + 0.1
    features = [((f - mean) / spread).astype(np.float32) for f in features]
    r = np.random.default_rng(fit.seed)

    def some(*shape: int) -> np.ndarray:
        return (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    model = {
        "w": some(len(mean), fit.hidden), "b": np.zeros(fit.hidden), "v": some(fit.hidden, fit.attention),
        "vb": np.zeros(fit.attention), "u": some(fit.hidden, fit.attention), "ub": np.zeros(fit.attention),
        "a": some(fit.attention), "c": some(fit.hidden), "c0": np.array(np.log(base / (1 - base))),
    }
    first = {k: np.zeros_like(v, dtype=np.float64) for k, v in model.items()}
    second = {k: np.zeros_like(v, dtype=np.float64) for k, v in model.items()}
    for step in range(1, fit.steps + 1):
        chosen = r.integers(0, len(y), fit.bags)
        x, bag, firsts = _bags([features[i] for i in chosen])
        f = _forward(model, x, bag, firsts)
        error = importance[chosen] * (f["p"] - y[chosen]) / importance[chosen].sum()
        gradients = _gradients(model, x, bag, firsts, error, f)
        rate = fit.rate * (1 - step / (fit.steps + 1))
        for k, g in gradients.items():
            g = g + (fit.decay * model[k] if model[k].ndim == 2 else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            model[k] = model[k] - rate * move
    return {k: np.asarray(v, np.float32) for k, v in model.items()} | {"mean": mean, "spread": spread}


def scored(model: dict, texts: list[str]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    scores = []
    for text in texts:
        x = (encoded(text) - model["mean"]) / model["spread"]
        scores.append(_forward(model, x, np.zeros(len(x), int), np.zeros(1, int))["p"][0])
    return np.array(scores, np.float64)


def held_out(doc_id: str = "doc_id") -> Column:
    """One fifth of the documents, whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> dict:
    """The network fitted to labelled documents that are not held out.

    Each label gives up to half the sample, in the order of a hash of the id. The
    two halves are weighed by how common their labels are, so scores are
    probabilities. A document labelled twice counts as what it was labelled best.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    texts, marks, weights = [], [], []
    for label in (0, 1):
        own = known.filter(F.col("quality") == label)
        # At most half the sample's rows: a bound that does not grow.
        chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.documents // 2)
        text = empty_if_null("text")
        found = docs.select("doc_id", text.alias("text")).filter(F.length("text") <= fit.characters)
        # Of texts that share an id the least is learned.
        rows = found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        sample = sorted((r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect())
        total = own.count()
        texts += [t for _, t in sample]
        marks += [label] * len(sample)
        weights += [total / max(1, len(sample))] * len(sample)
    return fitted(texts, marks, weights, fit)


def quality_scores(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    The score is a function of the text alone; null counts as empty. Without
    labels of both kinds every score is their share, 0.5 without any. Repeated
    rows score alike; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = learn(docs, labels, fit)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scored(model, texts.tolist()))

    rows = docs.select("doc_id", held_out().alias("held_out"), score(empty_if_null("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))


def op7_attention_mil(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
