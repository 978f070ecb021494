"""Quality classifier from positives and unlabelled text alone.

Trusted positives are labelled 1; everything else, labelled or not, is merely
unlabelled. With the share of positives in the unlabelled text (the class
prior), the risk on negatives is the risk on unlabelled text less that on
positives; a flexible model drives this estimate below zero, which no risk can
be, so it is held at zero (the non-negative risk estimator).

Spark computes the features and the scores; the model is fitted to a bounded
sample of feature rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearly.llm.common import NOT_SPACE, Words, appended, fold_of, grams

#: About so many positives and so many unlabelled texts are used for fitting.
SAMPLE = 10_000
FOLDS, HELD_OUT = 4, 2  # labels of rows whose fold is HELD_OUT are never read
ACCEPT = 0.7
HIDDEN, STEPS, BATCH, RATE = 16, 1200, 512, 0.02

_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
    b".", b",", b"!", b"?", b"|", b"#*$%&", b"<>{}[]/\\=_~^`@+", b"\"'()-:;", bytes(range(0x80, 0x100)),
]
_SHARES = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _SHARES[list(_c), _i] = 1
N_FEATURES = len(_CLASSES) + 8


def features(raw: bytes, h: np.ndarray) -> np.ndarray:
    """Numbers about one text's bytes and word hashes; an empty one has zeros."""
    out = np.zeros(N_FEATURES)
    if not len(h):
        return out
    n = len(h)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out[: len(_CLASSES)] = np.sqrt(counts @ _SHARES / len(raw))
    _, repeats = np.unique(h, return_counts=True)
    three = grams(h, 3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[len(_CLASSES) :] = (
        np.log1p(n),
        len(raw) / n / 10,
        len(repeats) / n,
        repeats.max() / n,
        1 - len(np.unique(three)) / len(three) if len(three) else 0,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        (repeats == 1).sum() / n,
    )
    return out


def _matrix(texts: pa.Array, reader: Words) -> np.ndarray:
    rows = [
        features(value.as_buffer().to_pybytes() if value.is_valid else b"", h)
        for value, h in zip(texts, reader.each(texts))
    ]
    return np.array(rows).reshape(-1, N_FEATURES)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """A one-layer network on standardised features; small enough for a closure."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]  # hidden weights, hidden bias, output weights, output bias
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), 0.5)
        w, b, v, c = self.parts
        return _sigmoid(np.tanh(self.inputs(x) @ w + b) @ v + c)


def _train(gradient, p: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
    """Adam over ``gradient(g of positives, g of unlabelled)``, the slopes in g."""
    rng = np.random.default_rng(7)
    parts = [
        rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    m, s = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    for step in range(1, STEPS + 1):
        x = np.concatenate([p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]])
        w, b, v, c = parts
        hidden = np.tanh(x @ w + b)
        g = hidden @ v + c
        slope = np.concatenate(gradient(g[:BATCH], g[BATCH:]))
        back = np.outer(slope, v) * (1 - hidden**2)
        slopes = [x.T @ back + 1e-3 * w, back.sum(0), hidden.T @ slope + 1e-3 * v, slope.sum(keepdims=True)]
        for i, d in enumerate(slopes):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.999 * s[i] + 0.001 * d**2
            rate = RATE * (1 - step / (STEPS + 1))
            parts[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return parts


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the two samples alone.

    A model that tells positives from unlabelled text is fitted on one half. On
    the other half the unlabelled text above a threshold holds at least the
    prior's share of the positives above it, and hardly more where negatives
    score low, so the smallest ratio over thresholds is the estimate.
    """

    def apart(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -_sigmoid(-gp) / len(gp), _sigmoid(gu) / len(gu)

    fit_p, test_p, fit_u, test_u = p[::2], p[1::2], u[::2], u[1::2]
    if not len(test_p) or not len(test_u):
        return 0.5
    w, b, v, c = _train(apart, fit_p, fit_u)
    sp, su = (np.tanh(x @ w + b) @ v + c for x in (test_p, test_u))
    levels = np.quantile(sp, np.linspace(0, 0.1, 11))
    ratios = [(su >= t).mean() / (sp >= t).mean() for t in levels]
    return float(np.clip(min(ratios), 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """The network with the smallest non-negative risk on the two samples.

    Without positives or unlabelled texts every score is 0.5.
    """
    if not len(p) or not len(u):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [], 0.5)
    model = Model(u.mean(0), u.std(0) + 1e-3, [], 0.5)
    p, u = model.inputs(p), model.inputs(u)
    prior = model.prior = estimated_prior(p, u)

    def non_negative(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        positive = -prior * _sigmoid(-gp) / len(gp)
        as_negative, unlabelled = prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
        if _softplus(gu).mean() >= prior * _softplus(gp).mean():
            return positive - as_negative, unlabelled
        # The estimate fell below zero: walk back up to where it is a risk again.
        return as_negative, -unlabelled

    model.parts = _train(non_negative, p, u)
    return model


def training_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model for ``docs``, from labels outside the held-out fold.

    ``labels`` has doc_id and quality; a doc_id that repeats with different
    labels is not trusted. Only the sampled rows' features reach the driver.
    """
    train = F.coalesce(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False))
    source = docs.select("doc_id", "text").where(train)
    trusted = (
        labels.where(train & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("least"))
        .where("least = 1")
        .select("doc_id")
    )
    # In the order of a hash, the first so many in expectation. The hash has 64 bits, so
    # there is no number of rows of which it would select none.

    def about(df: DataFrame) -> DataFrame:
        share = min(1.0, sample / max(1, df.count()))
        last = min(int(share * 2**64) - 2**63, 2**63 - 1)
        return df.where(F.xxhash64("doc_id") <= F.lit(last))

    def gathered(df: DataFrame) -> np.ndarray:
        def measure(batch: pa.RecordBatch) -> list[pa.Array]:
            x = _matrix(batch.column(1), Words(NOT_SPACE))
            return [pa.array(list(x), pa.list_(pa.float64()))]

        rows = appended(df, "x array<double>", measure).select("doc_id", "x").collect()
        rows.sort(key=lambda r: (r["doc_id"], r["x"]))
        order = np.random.default_rng(3).permutation(len(rows))
        return np.array([rows[i]["x"] for i in order]).reshape(-1, N_FEATURES)

    positives = gathered(source.join(F.broadcast(about(trusted)), "doc_id"))
    return fit(positives, gathered(about(source)))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ACCEPT on).

    Every text is scored by itself, NULL as an empty one; columns of these two
    names are replaced. Nothing but the text goes into the score.
    """
    column = docs.drop("score", "predicted").columns.index(text)

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        score = model.score(_matrix(batch.column(column), Words(NOT_SPACE)))
        return [pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))]

    return appended(docs, "score double, predicted int", judge)
