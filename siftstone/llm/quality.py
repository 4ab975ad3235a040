"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of some 1,500 bytes. A passage is encoded by the
shares of kinds of characters, the compressed size, word lengths and repeated words. An encoder
layer maps it to a vector; gated attention (tanh times sigmoid) weighs the
passages of a document, and the weighted sum gives the score. Only document
labels are learned from, so the attention finds by itself which passages decide.

The model is trained on the driver from at most SAMPLE labelled documents, those
with the least hash of doc_id, of rows with one id one; their features are computed on the executors, and
only these come to the driver. Scoring reads each document once, without a shuffle. Texts of any length are read whole, passage by passage.

A null text counts as empty: one empty passage, which gets a score as well. Labels
that are null are left out; with labels of one kind only, or none, every score is the
share of good ones (1 without any). Repeated rows get equal scores; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import give_back, held_out, id_and_text, small_batches

#: Labelled documents that a model is fitted on at most.
SAMPLE = 4000
PASSAGE = 1500
HIDDEN, ATTENTION, EPOCHS = 24, 12, 100
THRESHOLD = 0.3

_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b",;:", b".?", b"!", b"|", b"#$%&*@^~+=<>\\", b"'\"`", b"()[]{}", b"/-_")
_KIND = np.full(256, len(_KINDS), np.uint8)
for _k, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _k
_KIND[128:192] = len(_KINDS) + 1
_KIND[192:] = len(_KINDS) + 2
N_KINDS = len(_KINDS) + 3
N_FEATURES = N_KINDS + 8
_WORD = re.compile(rb"[^ \t-\r]+")


def passages(text: bytes) -> list[bytes]:
    """Equal parts of about PASSAGE bytes; one, if the text is short or empty."""
    n = max(1, round(len(text) / PASSAGE))
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, one row each, and the number of passages of each text."""
    split = [passages(t) for t in texts]
    flat = [p for s in split for p in s]
    size = np.array([len(p) for p in flat], np.int64)
    kind = _KIND[np.frombuffer(b"".join(flat), np.uint8)]
    row = np.repeat(np.arange(len(flat)), size)
    counts = np.bincount(row * N_KINDS + kind, minlength=len(flat) * N_KINDS).reshape(-1, N_KINDS)
    out = np.zeros((len(flat), N_FEATURES), np.float32)
    out[:, :N_KINDS] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    for k, p in enumerate(flat):
        words = p.split()
        n = max(1, len(words))
        out[k, N_KINDS:] = (
            len(zlib.compress(p, 1)) / (len(p) + 20),
            len(set(words)) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            len(p) / n / 10,
            np.log1p(len(p)) / 10,
            np.log1p(len(words)) / 10,
            max(map(len, words), default=0) / (len(p) + 1),
            len(set(p)) / 100,
        )
    return out, np.array([len(s) for s in split])


class AttentionMIL:
    """sigmoid(w . sum_k a_k h_k + c), h = tanh(xE + e), a = softmax over the bag of v . (tanh(hV) * sigmoid(hU))."""

    def __init__(self, weights: dict[str, np.ndarray] | None, prior: float = 1.0):
        self.weights, self.prior = weights, prior

    def _forward(self, x, bag, n_bags):
        w = self.weights
        z = (x - w["mean"]) / w["scale"]
        h = np.tanh(z @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["v"]
        top = np.full(n_bags, -np.inf)
        np.maximum.at(top, bag, a)
        a = np.exp(a - top[bag])
        a = a / np.bincount(bag, a, n_bags)[bag]
        pooled = np.stack([np.bincount(bag, a * h[:, j], n_bags) for j in range(h.shape[1])], axis=1)
        score = 1 / (1 + np.exp(-np.clip(pooled @ w["w"] + w["c"], -30, 30)))
        return z, h, t, g, a, pooled, score

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x, sizes = encode(texts)
        return self._forward(x.astype(np.float64), np.repeat(np.arange(len(texts)), sizes), len(texts))[-1]

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, seed: int = 42) -> AttentionMIL:
        labels = np.asarray(labels, np.float64)
        if len(labels) == 0 or labels.min() == labels.max():
            return cls(None, float(labels.mean()) if len(labels) else 1.0)
        rng = np.random.default_rng(seed)
        x, bag = np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        d = x.shape[1]
        w = {"mean": x.mean(0), "scale": x.std(0) + 1e-3, "E": rng.normal(0, d**-0.5, (d, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "v": rng.normal(0, 0.1, ATTENTION), "w": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.array(np.log(labels.mean() / (1 - labels.mean())))}
        model = cls(w)
        names = [k for k in w if k not in ("mean", "scale")]
        m, v = {k: np.zeros_like(w[k]) for k in names}, {k: np.zeros_like(w[k]) for k in names}
        n = len(bags)
        for step in range(1, EPOCHS + 1):
            z, h, t, g, a, pooled, score = model._forward(x, bag, n)
            up = (score - labels) / n
            d_pooled = up[:, None] * w["w"]
            d_h = a[:, None] * d_pooled[bag]
            d_a = (h * d_pooled[bag]).sum(1)
            d_a = a * (d_a - np.bincount(bag, a * d_a, n)[bag])
            d_t, d_g = d_a[:, None] * w["v"] * g * (1 - t * t), d_a[:, None] * w["v"] * t * g * (1 - g)
            d_h += d_t @ w["V"].T + d_g @ w["U"].T
            d_z = d_h * (1 - h * h)
            grad = {"E": z.T @ d_z + 1e-4 * w["E"], "e": d_z.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "v": (t * g).T @ d_a, "w": pooled.T @ up + 1e-4 * w["w"], "c": up.sum()}
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(_id, text, y) of at most `sample` labelled documents, none of them held out.

    One row an id, however often it stands in either table: the least label, then the least text.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("y")).filter(F.col("_id").isNotNull() & F.col("y").isNotNull() & ~held_out("_id"))
    known = docs.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    chosen = some.groupBy("_id").agg(F.min("y").alias("y")).join(known, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("y", "text")).alias("m")).select("_id", "m.text", "m.y")


def train(docs: DataFrame, labels: DataFrame) -> AttentionMIL:
    """Fit a model on the labelled rows of `docs` that are not held out."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            x, sizes = encode(texts)
            bags = np.split(x, np.cumsum(sizes)[:-1]) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), pa.array([b.tobytes() for b in bags], pa.binary())], ["_id", "y", "bag"])
            give_back()

    rows = sorted(labelled_sample(docs, labels, "quality").mapInArrow(run, "_id long, y double, bag binary").collect(), key=lambda r: (r["_id"], r["y"], bytes(r["bag"])))
    return AttentionMIL.fit([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows], np.array([float(r["y"] > 0) for r in rows]))


def score_column(model: AttentionMIL, text: str = "text") -> Column:
    """The score of each whole text."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        give_back()
        texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        out = [model.score(texts[k : k + 256]) for k in range(0, len(texts), 256)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(F.col(text).cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = train(docs, labels)
    scored = id_and_text(docs).select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
