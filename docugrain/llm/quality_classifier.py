"""Quality classifier: naive Bayes support vectors.

Method: features are the indicators of a text's word n-grams (one and two words) and of word shapes, hashed to 2**bits
places. Each is scaled by the log-count ratio of its place between the classes, r = log((p/|p|) / (q/|q|)) with add-one
smoothing; a linear hinge-loss model is then fit on the scaled indicators by dual coordinate descent, and its weights are mixed with
their mean magnitude, as published for NB-SVM. The margin goes through a logistic curve to a score between 0 and 1.

Training rows are a bounded sample: at most ``sample`` labelled rows outside the held-out third, those with the least hash of
doc_id, evenly from both classes as far as there are, and of them as many as hold ``places`` feature places (4 bytes each) in that order: so
the driver holds at most sample * 2**bits or ``places`` of them, whichever is less, and one row at least of each class. Scoring covers every row and the whole text. Features are those of the text alone.

Defined results: null, empty or blank text has no features and scores by the bias; equal rows score alike; with no
labelled row, or one class only, every score is that class's share (0.5 without any). A label row with a null is ignored;
of several labels of a document each counts once, and of several rows of one doc_id the one of least hash is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, cut, free, id_text, mix, table, texts


@dataclass(frozen=True)
class NBSVM:
    bits: int = 18
    #: The bound on the training rows that come to the driver, as rows of feature places (not texts).
    sample: int = 6000
    #: The bound on their feature places: 4 bytes each on the way, 12 in the fit.
    places: int = 20_000_000
    cost: float = 1.0
    epochs: int = 12
    mixture: float = 0.25
    #: Documents with crc32(doc_id as text) % folds = held are never learned from.
    folds: int = 3
    held: int = 1


def shape(word: bytes) -> bytes:
    """A word's kinds of character, runs as one: A for capitals, a for letters (and bytes beyond ASCII), 0 for digits, else itself."""
    out = word.translate(SHAPES)
    return bytes(c for k, c in enumerate(out) if not k or c != out[k - 1])


SHAPES = bytes(ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b > 127 else ord("0") if 48 <= b < 58 else b for b in range(256))


class Features:
    def __init__(self, bits: int):
        self.words, self.shapes, self.shift = WordHashes(), {}, U64(64 - bits)

    def _shape(self, word: bytes) -> int:
        h = self.shapes.get(word)
        if h is None:
            import xxhash

            if len(self.shapes) > 400_000:
                self.shapes.clear()
            h = self.shapes[word] = xxhash.xxh3_64_intdigest(shape(word), 7)
        return h

    def of(self, text: str) -> np.ndarray:
        """Distinct places of the text's n-grams, shapes, shape pairs and length band."""
        words = text.encode().split()
        if not words:
            return np.zeros(0, np.int64)
        w = self.words.of([x.lower() for x in words])
        s = np.fromiter(map(self._shape, words), U64, len(words))
        band = np.array([min(12, len(words).bit_length())], U64) + U64(1000)
        # How often neighbours, and words at all, are the same, in steps: repetition shows in no single n-gram.
        repeat = np.array([int(10 * (1 - len(np.unique(w)) / len(w))), 20 + int(10 * (w[1:] == w[:-1]).mean() if len(w) > 1 else 0)], U64) + U64(2000)
        every = [w, w[1:] * U64(3) + w[:-1], s, s[1:] * U64(5) + s[:-1], band, repeat]
        return np.unique((mix(np.concatenate(every)) >> self.shift).astype(np.int64))


def fit(rows: list[np.ndarray], labels: np.ndarray, how: NBSVM) -> tuple[np.ndarray, float]:
    """Weights of all places and the bias."""
    n = 1 << how.bits
    both = labels.sum(), (1 - labels).sum()
    if not all(both):
        share = float(labels.mean()) if len(labels) else 0.5
        return np.zeros(n), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    p, q = np.ones(n), np.ones(n)
    for x, y in zip(rows, labels, strict=True):
        (p if y else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    y = np.where(labels, 1.0, -1.0)
    scaled = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]  # rows of like length whatever the text's
    norm = np.array([v @ v + 1.0 for v in scaled])
    w, bias, alpha = np.zeros(n), 0.0, np.zeros(len(rows))
    # Both classes weigh the same in all.
    cost = np.where(labels, how.cost * len(labels) / (2 * both[0]), how.cost * len(labels) / (2 * both[1]))
    order = np.random.default_rng(3)
    for _ in range(how.epochs):
        for i in order.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    w = how.mixture * np.abs(w).mean() + (1 - how.mixture) * w if how.mixture < 1 else w
    return w * ratio, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, how: NBSVM, label_col: str) -> DataFrame:
    """(doc_id, text, y): the sample, at most how.sample rows."""
    fold = F.crc32(F.col("doc_id").cast("string")) % how.folds != how.held
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & fold)
    least = lambda y, k: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    chosen = least(0, how.sample // 2).unionByName(least(1, how.sample // 2))
    # At most how.sample rows of two numbers: a proven bound for the broadcast. Of rows that repeat a doc_id one is learned from, so the sample stays within it.
    return docs.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def classify(docs: DataFrame, labels: DataFrame, how: NBSVM = NBSVM(), label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; one scan to fit, one to score, no shuffle of texts."""
    mine = id_text(docs, id_col, text_col)
    spark = docs.sparkSession

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(how.bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([made.of(t).astype(np.int32) for t in texts(batch)], pa.list_(pa.int32()))], names=["doc_id", "y", "x"])

    made = cut(training_rows(mine, labels, how, label_col).select("doc_id", "text", "y").mapInArrow(featured, "doc_id long, y int, x array<int>"), "training")
    # Rows in order of hash while their places, by class, fit the bound: sums of at most 2 * how.sample numbers.
    inside = F.sum(F.size("x")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = made.withColumns({"_sum": inside, "_first": first}).where((F.col("_sum") <= how.places // 2) | (F.col("_first") == 1))
    got = fits.select("doc_id", "y", "x").toPandas().sort_values(["doc_id", "y"], kind="stable")
    free(made)
    weights, bias = fit([np.asarray(x, np.int64) for x in got["x"]], got["y"].to_numpy(np.int64), how)
    model = spark.sparkContext.broadcast((weights.astype(np.float32), bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, (w, b) = Features(how.bits), model.value
        for batch in batches:
            out = []
            for t in texts(batch):
                x = made.of(t)
                margin = float(w[x].sum(dtype=np.float64)) / max(1, len(x)) ** 0.5 + b
                out.append(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    out = mine.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % how.folds == how.held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
