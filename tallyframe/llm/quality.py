"""Quality classifier: hashed word n-gram logistic regression trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features are n-grams of two word streams, hashed to ``2**BITS`` buckets: the words (1 and 2 words) and
their shapes (1 to 3), where a shape keeps the kinds of a word's characters and whether the word
repeats the one before. A document's vector is its n-gram counts over the root of their number.

Training takes a bounded sample of labelled rows (``sample`` rows, those of least id hash), whose ids
alone are broadcast. The sample is dealt into ``models`` groups; each is one task's stream of
updates over ``epochs`` passes, and the models' weights are averaged. The averaged vector (at most
``2**BITS + 1`` numbers) is broadcast to score every document where it lies, without a shuffle.

Defined results: a null text is empty and scores by the bias. A null id is neither held out nor
learnt from. Null labels are left out; a doc_id with several labels is learnt from once for
each. Without any label every score is 0.5. Rows that repeat score alike. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import ROW, column_lists, identified, kept_in_process

BITS = 18
SIZE = 1 << BITS
MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Runs of one kind of character become one character of the shape.
SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[^\W\d_A-Z]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w])\1+"), r"\1"))


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


class Hashes(dict):
    """Of each word, the hash of its lower-case form and that of its shape in one integer."""

    def __missing__(self, word: str) -> int:
        shape = word
        for pattern, to in SHAPES:
            shape = pattern.sub(to, shape)
        value = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape.encode("utf-8", "surrogatepass"))
        if len(self) >= 200_000:
            self.clear()
        self[word] = value
        return value


def buckets(text: str, hashes: Hashes) -> np.ndarray:
    """The bucket of every n-gram of the text, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    packed = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    word, shape = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    shape[1:] += (word[1:] == word[:-1]).astype(np.uint64) * np.uint64(977)
    a, b = MULTIPLIERS

    def grams(stream: np.ndarray, n: int, salt: int) -> np.ndarray:
        mixed = stream[: len(stream) - n + 1] * a
        for k in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * b + stream[k : len(stream) - n + 1 + k] * a
        mixed = (mixed + np.uint64(salt)) * b
        return mixed >> np.uint64(64 - BITS)

    parts = [grams(word, 1, 1), grams(shape, 1, 3)]
    if len(words) > 1:
        parts += [grams(word, 2, 2), grams(shape, 2, 4)]
    if len(words) > 2:
        parts.append(grams(shape, 3, 5))
    return np.concatenate(parts).astype(np.int64)


class FollowTheLeader:
    """Proximal follow-the-regularised-leader with per-bucket rates; the last bucket is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from: Column, sample: int = 12_000, models: int = 4, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The averaged weights; the last is the bias. ``learn_from`` is a condition on labels.doc_id."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .where(learn_from & F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(sample)  # the bound of what is broadcast
    )
    rows = identified(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").withColumn("model", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(models)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        hashes, model, examples = Hashes(), FollowTheLeader(SIZE), []
        for text, y in zip(*(group.sort_values(["doc_id", "y", ROW])[c] for c in ("text", "y"))):
            at, counts = np.unique(buckets(text, hashes), return_counts=True)
            examples.append((np.append(at, SIZE).astype(np.int32), np.append(counts / np.sqrt(max(1, counts.sum())), 1.0).astype(np.float32), y))
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(examples)):
                model.learn(*examples[i])
        w = model.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": at, "w": w[at]})

    found = rows.groupBy("model").applyInPandas(fit, "bucket long, w double").groupBy("bucket").agg(F.sum("w").alias("w"))
    weights = np.zeros(SIZE + 1)
    for r in found.orderBy("bucket").toLocalIterator():  # at most one row a bucket
        weights[r.bucket] = r.w / models
    return weights


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __row and score (0 to 1) for every row of ``docs``."""
    rows = identified(docs, id_col, text_col)
    sent = spark.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = kept_in_process("quality hashes", "", Hashes), sent.value
        for ids, row, text in column_lists(batches, "doc_id", ROW, "text"):
            dots = np.empty(len(text))
            for i, value in enumerate(text):
                at = buckets(value.as_py(), hashes)
                dots[i] = w[at].sum() / np.sqrt(max(1, len(at))) + w[SIZE]
            yield pa.RecordBatch.from_arrays([ids, row, pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], ["doc_id", ROW, "score"])

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ROW} long, score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, **names) -> DataFrame:
    """doc_id, __row, held_out, score and predicted for every row of ``docs``. Labels of ids whose
    remainder is ``held`` are never learnt from."""
    weights = train(spark, docs, labels, remainder(F.col("doc_id"), folds) != held, **names)
    return score(spark, docs, weights).select(
        "doc_id", ROW, F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
