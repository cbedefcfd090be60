"""Quality classifier (operator 10): histogram gradient-boosted trees over document statistics.

Statistics are taken in one pass over the whole text. Trees are grown level by level on binned statistics of a bounded sample and kept
as flat arrays, so that a batch of documents walks each tree with a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import prepare
from foreband.llm.labelled import held_out, labelled_sample
from foreband.llm.words import CHUNK, distinct, shingles, word_hashes

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _SPACE = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_/"]] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
NAMES = (
    "bytes words lines upper digit symbol stop bang bar wide space entropy word_mean word_spread word_longest symbol_end bang_end capital_words "
    "distinct_words top_word repeated_next distinct_triples distinct_lines line_mean short_lines barred_lines sentence".split()
)


def _chunks(raw: bytes):
    at = 0
    while at < len(raw):
        to = min(at + CHUNK, len(raw))
        while to < len(raw) and not _SPACE[raw[to]]:
            to += 1
        yield np.frombuffer(raw, np.uint8, to - at, at)
        at = to


def statistics(raw: bytes, hashes: np.ndarray) -> list[float]:
    """The document statistics NAMES of one text; hashes: its words'."""
    counts, words, lengths, squares, longest, symbol_end, bang_end, capital = np.zeros(256), 0, 0.0, 0.0, 0, 0, 0, 0
    for data in _chunks(raw):
        counts += np.bincount(data, minlength=256)
        edges = np.flatnonzero(np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, size = edges[::2], edges[1::2] - edges[::2]
        if len(start):
            last = data[start + size - 1]
            words, lengths, squares = words + len(size), lengths + size.sum(), squares + float((size.astype(float) ** 2).sum())
            longest = max(longest, int(size.max()))
            symbol_end, bang_end = symbol_end + int(_SYMBOL[last].sum()), bang_end + int((last == 33).sum())
            second = data[np.minimum(start + 1, len(data) - 1)]
            capital += int((_UPPER[data[start]] & _UPPER[second] & (size > 1)).sum())
    n, w = max(len(raw), 1), max(words, 1)
    share = counts[counts > 0] / n
    different, often = np.unique(hashes, return_counts=True)
    triples = shingles(hashes, 3)
    lines = raw.split(b"\n")
    mean = lengths / w
    return [
        np.log1p(len(raw)), np.log1p(words), np.log1p(len(lines)), counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_SYMBOL].sum() / n,
        counts[_STOP].sum() / n, counts[33] / n, counts[124] / n, counts[128:].sum() / n, counts[_SPACE].sum() / n, float(-(share * np.log2(share)).sum()),
        mean, np.sqrt(max(squares / w - mean * mean, 0.0)), np.log1p(longest), symbol_end / w, bang_end / w, capital / w,
        len(different) / w, (often.max() if len(often) else 0) / w, float((hashes[1:] == hashes[:-1]).sum()) / w, len(distinct(triples)) / max(len(triples), 1),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(len(x) < 40 for x in lines) / len(lines), sum(b"|" in x for x in lines) / len(lines),
        np.log1p(words / (1 + counts[46] + counts[63] + counts[33])),
    ]


def features(texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros((0, len(NAMES)))
    return np.array([statistics(t, h) for t, h in zip(texts, word_hashes(texts), strict=True)])


@dataclass
class Trees:
    """Full binary trees of one depth: inner nodes by level, then leaves. A row goes right where its value is above the cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.leaf.shape[1]).bit_length() - 1 if len(self.leaf) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.08, bins: int = 64, least: int = 20, ridge: float = 2.0) -> Trees:
    """Boosts trees for the logistic loss. Cuts are quantiles; a node without a split worth it sends all rows left."""
    if not len(y):
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    p = np.clip(y.mean(), 0.01, 0.99)
    margin = np.full(n, np.log(p / (1 - p)))
    model = Trees(float(margin[0]), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        slope, bend = y - q, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            gains = np.full((count, width), -np.inf)
            where = np.zeros((count, width), np.int64)
            for j in range(width):
                key = at * bins + codes[:, j]
                g, h, c = (np.bincount(key, weights=w, minlength=count * bins).reshape(count, bins).cumsum(1) for w in (slope, bend, None))
                left, right = g[:, :-1], g[:, -1:] - g[:, :-1]
                gain = left**2 / (h[:, :-1] + ridge) + right**2 / (h[:, -1:] - h[:, :-1] + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(c[:, :-1] < least) | (c[:, -1:] - c[:, :-1] < least)] = -np.inf
                where[:, j] = gain.argmax(1)
                gains[:, j] = gain.max(1)
            best = gains.argmax(1)
            for k in range(count):
                if gains[k, best[k]] > 1e-9:
                    model.feature[t, first + k] = best[k]
                    model.cut[t, first + k] = cuts[best[k]][where[k, best[k]]]
            f, c = model.feature[t, node], model.cut[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > c)
        end = node - (2**depth - 1)
        g, h = (np.bincount(end, weights=w, minlength=2**depth) for w in (slope, bend))
        model.leaf[t] = rate * g / (h + ridge)
        margin += model.leaf[t][end]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **options) -> Trees:
    """Fits on at most `most` labelled documents that are not held out; their statistics, and nothing else, reach the driver."""
    prepare(docs.sparkSession)

    def measure(batches):
        for b in batches:
            x = features([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "label", "x"])

    got = labelled_sample(docs, labels, label, most, id_col, text_col).mapInArrow(measure, "id long, label int, x array<double>").toArrow()
    order = np.lexsort((got.column("label").to_numpy(), got.column("id").to_numpy()))
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))[order]
    return fit(x, got.column("label").to_numpy()[order].astype(float), **options)


def score(docs: DataFrame, model: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `name` added: how likely label 1 is, from the text alone; a null text is empty."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            x = features([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from the threshold on)."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return score(rows, model).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
