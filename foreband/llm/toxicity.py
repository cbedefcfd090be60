"""Toxicity by classifier chains (operator 9).

Categories are predicted one after the other by logistic models over words and word beginnings; each model also gets the probabilities of the
categories before it, in training those predicted out of fold. Only the last category is a given label. The two before it are
drawn from it: `abusive`, a document holds a term that the sample ties to the label, and `repeated`, it holds several.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import prepare
from foreband.llm.labelled import held_out, labelled_sample
from foreband.llm.words import word_hashes

CATEGORIES = ("abusive", "repeated", "toxic")
PREFIXES = (None, 4, 5)
BUCKETS = 1 << 20
_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False


def terms(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct term buckets of each text: words and word beginnings of 4 and 5 bytes; A-Z count as a-z."""
    kinds = []
    for k, prefix in enumerate(PREFIXES):
        salt = np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        kinds.append([np.unique((h ^ salt) >> np.uint64(44)) for h in word_hashes(texts, _BREAKS, prefix)])
    return [np.unique(np.concatenate(k)).astype(np.int64) for k in zip(*kinds, strict=True)]


@dataclass
class Chain:
    """chosen: the sorted term buckets that count; one weight vector per category: bias, chosen terms, earlier probabilities."""

    chosen: np.ndarray
    weights: list[np.ndarray]

    def matrix(self, docs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(docs), len(self.chosen)))
        for row, d in zip(x, docs, strict=True):
            at = np.searchsorted(self.chosen, d)
            ok = at < len(self.chosen)
            ok[ok] = self.chosen[at[ok]] == d[ok]
            row[at[ok]] = 1.0
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column per category, each fed to the next."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack((out, _probability(np.column_stack((x, out)), w)))
        return out


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, tolerance: float = 1e-6) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved while they don't help."""
    x = np.column_stack((np.ones(len(x)), x))
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (pull * w * w).sum())

    now = loss(w)
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        w = w + size * step if then < now else w
        if now - then <= tolerance * (1 + abs(now)):
            return w
        now = then


def fit(docs: list[np.ndarray], y: np.ndarray, most: int = 300, folds: int = 5) -> Chain:
    """Chooses at most `most` terms by the strength of their tie to the label and fits the chain."""
    if not len(y):
        return Chain(np.zeros(0, np.int64), [np.zeros(1 + i) for i in range(len(CATEGORIES))])
    flat, counts = np.concatenate(docs), np.array([len(d) for d in docs])
    of = np.repeat(y, counts)
    all_, good = np.bincount(flat, minlength=BUCKETS), np.bincount(flat[of > 0], minlength=BUCKETS)
    share = max(y.mean(), 1e-6)
    # How many standard deviations the label's count is above what its share would give.
    z = (good - all_ * share) / np.sqrt(all_ * share * (1 - share) + 1)
    ranked = np.argsort(-z, kind="stable")[:most]
    chosen = np.sort(ranked[z[ranked] > 3])
    strong = chosen[good[chosen] >= 0.5 * all_[chosen]]
    hits = np.array([len(np.intersect1d(d, strong, assume_unique=True)) for d in docs])
    targets = [((hits >= 1) & (y > 0)).astype(float), ((hits >= 4) & (y > 0)).astype(float), y.astype(float)]
    chain = Chain(chosen, [])
    x = chain.matrix(docs)
    fold = np.arange(len(y)) % folds
    seen = np.zeros((len(y), 0))
    for target in targets:
        inputs = np.column_stack((x, seen))
        out = np.zeros(len(y))
        for f in range(folds):
            out[fold == f] = _probability(inputs[fold == f], logistic(inputs[fold != f], target[fold != f]))
        chain.weights.append(logistic(inputs, target))
        seen = np.column_stack((seen, out))
    return chain


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 10_000, id_col: str = "doc_id", text_col: str = "text", **options) -> Chain:
    """Fits on at most `most` labelled documents that are not held out; only their distinct term buckets reach the driver."""
    prepare(docs.sparkSession)

    def measure(batches):
        for b in batches:
            found = terms([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            packed = pa.array([t.astype(np.int32).tobytes() for t in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), packed], ["id", "label", "terms"])

    got = labelled_sample(docs, labels, label, most, id_col, text_col).mapInArrow(measure, "id long, label int, terms binary").toArrow()
    order = np.lexsort((got.column("label").to_numpy(), got.column("id").to_numpy()))
    found = [np.frombuffer(t, np.int32).astype(np.int64) for t in got.column("terms").to_pylist()]
    return fit([found[i] for i in order], got.column("label").to_numpy()[order].astype(float), **options)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, p_<category> for each category, score (that of the label), predicted (1 from the threshold on).

    A null text is empty. Ids divisible by the held-out rule, and null ones, are never learned from. Rows are scored each by its text alone.
    """
    chain = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            found = terms([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            p = chain.predict(chain.matrix(found))
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c) for c in p.T]], ["id", *[f"p_{c}" for c in CATEGORIES]])

    scored = rows.mapInArrow(run, "id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    last = F.col(f"p_{CATEGORIES[-1]}")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), *[f"p_{c}" for c in CATEGORIES], last.alias("score"), (last >= threshold).cast("int").alias("predicted")
    )
