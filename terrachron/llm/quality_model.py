"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax output.

A word that repeats the word before it also counts as a word of its own kind, whichever it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import ship, tidy
from .labelled import held_out, training_sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 4_000
MODULUS, REST = 5, 0
BUCKET_BITS = 17
DIMENSIONS = 8
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
SEED = 20240229
_GRAM_KEYS = spans.mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: Bucket of a word that repeats the one before it.
_AGAIN = int(_GRAM_KEYS[-1] >> np.uint64(64 - BUCKET_BITS))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(block: spans.Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the words, of words that repeat the word before them (one bucket for all of those),
    then of the n-grams of code points, with where each text's begin and end.

    The values of text d are those from the d-th begin to the d-th end.
    """
    first, last, doc = block.words()
    upto = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(block)))))
    words = block.hashed()(first, last)
    yield _bucket(words), upto[:-1], upto[1:]
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    upto = np.concatenate(([0], np.cumsum(np.bincount(doc[again], minlength=len(block)))))
    yield np.full(int(again.sum()), _AGAIN), upto[:-1], upto[1:]
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    upto = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    begin, end = upto[block.starts], upto[block.ends]
    points = points.astype(np.uint64)
    for n in GRAMS:
        size = max(0, len(points) - n + 1)
        grams = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            grams += points[k : k + size] * _GRAM_KEYS[k]
        yield _bucket(spans.mix(grams)), np.minimum(begin, size), np.clip(end - n + 1, np.minimum(begin, size), size)


@dataclass
class Model:
    """Score of each bucket (its vector times the difference of the two outputs) and of no text."""

    weight: np.ndarray
    bias: float

    def scores(self, block: spans.Block) -> np.ndarray:
        total, count = np.zeros(len(block)), np.zeros(len(block))
        for buckets, begin, end in features(block):
            upto = np.concatenate(([0.0], np.cumsum(self.weight[buckets], dtype=np.float64)))
            total += upto[end] - upto[begin]
            count += end - begin
        logit = total / np.maximum(count, 1) + self.bias
        return np.round(1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50))), 6)


@tidy
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its distinct buckets and their shares, for training."""
    for batch in batches:
        label = batch.column("label")
        for block in spans.blocks(batch.column("text")):
            parts = list(features(block))
            buckets, shares = [], []
            for d in range(len(block)):
                own = np.concatenate([f[b[d] : e[d]] for f, b, e in parts])
                found, n = np.unique(own, return_counts=True)
                buckets.append(found.astype(np.int32).tobytes())
                shares.append((n / max(1, len(own))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [label.slice(block.first, len(block)), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
                ["label", "buckets", "shares"],
            )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_ROWS) -> Model:
    """Stochastic gradient descent in numpy over the bags of at most ``bound`` labelled rows.

    Whole texts are turned into bags on the executors; the driver holds the bags of the bounded
    sample and one vector per bucket. With labels of one kind only, or none, every text gets the
    share of label 1.
    """
    sample = training_sample(docs, labels, "quality", MODULUS, REST, bound, id_col, text_col)
    bags = sample.mapInArrow(_bags, "label int, buckets binary, shares binary").collect()
    data = sorted((r["label"], bytes(r["buckets"]), bytes(r["shares"])) for r in bags)
    y = np.array([d[0] for d in data], dtype=np.int64)
    good = int(y.sum())
    prior = float(np.log((good + 0.5) / (len(y) - good + 0.5)))
    rng = np.random.default_rng(SEED)
    if good in (0, len(y)):
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), prior)
    x = [(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for _, b, s in data]
    vectors = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output, bias = np.zeros((DIMENSIONS, 2), dtype=np.float32), np.array([0.0, prior], dtype=np.float32)
    steps, step = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            buckets, shares = x[i]
            rate = RATE * (1.0 - step / steps)
            step += 1
            hidden = shares @ vectors[buckets]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1.0  # gradient of the loss
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # A share is about one over the text's length; steps are relative to the largest.
            if len(shares):
                vectors[buckets] -= (rate * shares / shares.max())[:, None] * back
    weight = vectors @ (output[:, 1] - output[:, 0])
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(b) for b in spans.blocks(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(parts))], ["id", "score"])

    return tidy(run)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, the probability of label 1; a scan, no shuffle.

    Defined cases: a null or empty text has the score of the output's bias alone; ids may be null
    or repeated; other columns are never read.
    """
    rows = ship(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


#: Texts with at least this score are taken as good.
CUT = 0.3


def op3_quality_model(spark, sf_dir):
    """Quality of the whole documents table, learned from the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select(
        "doc_id",
        held_out("doc_id", MODULUS, REST).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
