"""Quality scores from histogram gradient-boosted trees over document statistics.

The trees are trained in numpy on the driver from at most ``TRAIN_ROWS`` labelled
documents (the smallest hashes of their ids, so the sample is the same at every
run), flattened into arrays of features, thresholds and children, and walked for
all documents of a step at once.

Defined cases: null and empty texts have statistics of zero and get a score like
any other; labels that are null or belong to no document are not used, several
labels of one document count as their mean rounded up; where one class or all
labels are missing the score is the constant base rate (0.5 without labels). An
empty table gives an empty result. Only doc_id and text of the documents are
read, so other columns cannot clash or leak into the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.doc_stats import NAMES, statistics
from pairlight.llm.text_arrays import Texts, steps

#: Bound of the labelled rows that are fitted on.
TRAIN_ROWS = 12_000
TREES, DEPTH, BINS = 80, 4, 64
RATE, RIDGE, LEAST_WEIGHT = 0.12, 1.0, 3.0
THRESHOLD = 0.3


@dataclass
class Forest:
    """Flattened trees: node ``i`` of a tree has children ``2i+1`` and ``2i+2``; leaves are at the last level."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); at or below goes left
    leaf: np.ndarray  # (trees, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boost depth-limited trees on the logistic loss over binned features."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < rate < 1:
        base = 0.0 if not len(y) else np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5))
        return Forest(float(base), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)  # bin b holds values up to cuts[b]
    n, m = code.shape
    edge = np.full((m, bins), np.inf)
    for j, c in enumerate(cuts):
        edge[j, : len(c)] = c
    base = float(np.log(rate / (1 - rate)))
    raw, kept = np.full(n, base), ([], [], [])
    flat_bin = code + np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            where = (flat_bin + (node - first)[:, None] * (m * bins)).ravel()
            g, h = (np.bincount(where, weights=np.repeat(v, m), minlength=width * m * bins).reshape(width, m, bins).cumsum(2) for v in (grad, hess))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT) | ~np.isfinite(edge)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            j, b = best // bins, best % bins
            feature[first : first + width] = np.where(worth, j, 0)
            threshold[first : first + width] = np.where(worth, edge[j, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, weights=grad, minlength=leaves) / (np.bincount(at, weights=hess, minlength=leaves) + RIDGE)
        raw += leaf[at]
        for store, value in zip(kept, (feature, threshold, leaf)):
            store.append(value)
    return Forest(base, *(np.array(k) for k in kept))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def doc_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                x = statistics(Texts(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in x.T)], ["doc_id", *NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """A forest from the labels outside the held-out fold."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("l_id")).agg(F.ceil(F.avg(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    )
    # at most ``rows`` rows of two numbers: small enough to broadcast at any corpus size
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"), "left_semi")
    table = doc_statistics(known).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "y", *NAMES)
    got = table.toPandas().sort_values(["doc_id", *NAMES], kind="stable")
    return fit(got[NAMES].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (default doc_id) and the score of each document, as column ``name``."""
    keep = keep or ["doc_id"]
    chosen = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "__text"):
                values = forest.score(statistics(Texts(batch.column("__text"))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values)], [*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + f", `{name}` double"
    return chosen.mapInArrow(run, schema)


def op9_gradient_boosting(spark, sf_dir: str) -> DataFrame:
    """A quality score for every whole text of ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
