"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are training-fold documents labelled 1; the unlabelled web text is training-fold documents without a label.
The class prior is estimated from the two: a first classifier tells positives from unlabelled, and the smallest ratio of the
unlabelled share to the positive share above any score bounds the prior. A linear scorer then minimises
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` on surface features of the text, and a two-parameter sigmoid fitted on the
training fold's labels maps its margin to a probability.

The fit takes at most SAMPLE rows of each kind, the smallest by a keyed hash of ``doc_id``; that bound is the only sample.
Every document is scored, over its whole text, in one narrow pass.

Defined results: a null or empty text has all-zero features and is scored like any other; a very long text is scored whole; without
positives or unlabelled rows in the fold every score is 0.5; with one of either the prior is NO_PRIOR; a score of exactly KEEP is kept;
repeated rows get equal scores; of repeated labels the smallest counts; an empty table gives an empty table; other columns, whatever
their names, are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import boxed, documents, field, forget

#: Rows of each kind (positive, negative, unlabelled) used to fit.
SAMPLE = 20_000
KEEP = 0.7
#: The prior where there is but one positive or one unlabelled row to estimate it from.
NO_PRIOR = 0.5
_MARKS = b"\n \t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER, _LOWER, _DIGIT, _HIGH = range(65, 91), range(97, 123), range(48, 58), range(128, 256)


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text: square roots of byte-class shares, and statistics of words and lines."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    hist = np.empty((n, 256))
    rest = np.empty((n, 7))
    at = 0
    for i, text in enumerate(texts):
        hist[i] = np.bincount(flat[at : at + sizes[i]], minlength=256)
        at += sizes[i]
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        k = max(1, len(words))
        rest[i] = (
            np.log1p(len(words)),
            np.log1p(len(lines)),
            len(set(words)) / k,
            len(set(lines)) / max(1, len(lines)),
            (len(text) - text.count(b" ")) / k / 10,
            len(lines) / k,
            len(set(words)) / np.sqrt(k) / 10,
        )
    share = hist / np.maximum(sizes, 1)[:, None]
    groups = [share[:, list(r)].sum(axis=1) for r in (_UPPER, _LOWER, _DIGIT, _HIGH)]
    return np.column_stack([np.sqrt(share[:, list(_MARKS)]), np.sqrt(np.stack(groups, axis=1)), rest]).astype(np.float32)


WIDTH = len(_MARKS) + 4 + 7


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        margin = np.clip(np.column_stack([z, np.minimum(z * z, 9.0)]) @ self.weights[:-1] + self.weights[-1], -30, 30)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _adam(gradient, size: int, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in ``u``: fit positive against unlabelled on one half, read the tail ratio on the other."""

    def gradient(w: np.ndarray) -> np.ndarray:
        a, b = p[::2], u[::2]
        return a.T @ (_sigmoid(a @ w) - 1) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + 1e-3 * w

    if len(p) < 2 or len(u) < 2:
        return NO_PRIOR
    w = _adam(gradient, p.shape[1], 200)
    sp, su = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    cuts = np.quantile(sp, np.linspace(0, 0.7, 36))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = 1 / np.sqrt(len(su))
    return float(np.clip(((above_u + slack) / (above_p + slack)).min(), 0.05, 0.98))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, penalty: float = 1e-3) -> np.ndarray:
    """Weights that minimise the non-negative risk with the sigmoid loss; below zero, the negative part's gradient is turned back."""

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        push = p.T @ (sp * (1 - sp)) / len(p)
        negative = u.T @ (su * (1 - su)) / len(u) - prior * push
        if su.mean() - prior * sp.mean() < 0:
            return -negative + penalty * w
        return -prior * push + negative + penalty * w

    return _adam(gradient, p.shape[1])


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.column_stack([margin, np.ones(len(margin))])
    good, bad = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))

    def gradient(w: np.ndarray) -> np.ndarray:
        return x.T @ (_sigmoid(x @ w) - target) / len(y) + np.array([1e-4, 0]) * w

    slope, shift = _adam(gradient, 2, 1500, 0.05)
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


def fit(x: np.ndarray, kind: np.ndarray) -> Model | None:
    """``kind``: 1 and 0 for labels, 2 for unlabelled."""
    if not (kind == 1).any() or not (kind == 2).any():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - mean) / scale
    z = np.column_stack([z, np.minimum(z * z, 9.0), np.ones(len(z))])
    p, u = z[kind == 1], z[kind == 2]
    prior = estimate_prior(p, u)
    w = nnpu(p, u, prior)
    known = kind < 2
    slope, shift = _platt(np.clip(z[known] @ w, -30, 30), kind[known].astype(float)) if (kind == 0).any() else (1.0, 0.0)
    return Model(mean, scale, w, slope, shift, prior)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and kinds of the bounded sample, fold rows only."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("kind"))
    order = [F.xxhash64("doc_id", F.lit(11)), "doc_id"]
    ids = documents(docs).where(F.col("doc_id").isNotNull()).select("doc_id")
    picks = [ids.join(known, "doc_id", "left_anti").withColumn("kind", F.lit(2))] + [known.where(F.col("kind") == k) for k in (0, 1)]
    fold = [p.where(~held_out(F.col("doc_id"))).orderBy(*order).limit(sample) for p in picks]
    chosen = fold[0].unionByName(fold[1]).unionByName(fold[2])
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").select("kind", "text")  # broadcast: 3 * sample rows of 12 bytes at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t.encode() for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["kind"], pa.array([r.tobytes() for r in x], pa.binary())], names=["kind", "x"])

    got = rows.mapInArrow(describe, "kind int, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), dtype=np.float32).reshape(-1, WIDTH).astype(float)
    kind = np.asarray(got["kind"]).astype(int)
    order = np.lexsort([*x.T, kind])  # the fit shall not depend on the order of partitions
    return x[order], kind[order]


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (the document as it came) and ``score``; the text crosses to Python once, inside the row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 512):
                piece = batch.slice(lo, 512)
                texts = [(t or "").encode() for t in pc.struct_field(piece["row"], "text").to_pylist()]
                value = np.full(len(texts), 0.5) if model is None or not texts else model.score(features(texts))
                yield pa.RecordBatch.from_arrays([piece["row"], pa.array(value, pa.float64())], names=["row", "score"])

    rows = boxed(docs).select("row")
    return rows.mapInArrow(score, rows.select("row", F.lit(0.0).alias("score")).schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(*training_rows(docs, labels))
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(field("doc_id"), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The documents, unchanged, that the classifier accepts."""
    model = fit(*training_rows(docs, labels))
    return score_documents(docs, model).where(F.col("score") >= least).select(*[field(c) for c in docs.columns])
