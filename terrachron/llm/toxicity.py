"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import ship, tidy
from .labelled import held_out, training_sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
MODULUS, REST = 4, 2
#: Dirichlet prior counts: the same for every token, plus a share of the token's own frequency.
FLAT_PRIOR, BACKGROUND = 0.5, 100.0
#: Log-odds count less this many standard deviations; tokens with less than the least are left out.
CAUTION, LEAST_ODDS = 1.64, 1.5
#: Every token costs this much, so that segments end between toxic passages.
DRIFT = 0.25
#: Bytes of a longer token that count as its stem.
STEM = 5
_STEM_KEY = np.uint64(0x5DEECE66D)


def tokens(block: spans.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, stem key (0: none) and text of each token: lower-cased runs without ASCII punctuation."""
    first, last, doc = block.words(spans.PUNCTUATION)
    hashes = block.hashed(lower=True)
    long = last - first > STEM
    stems = np.zeros(len(first), dtype=np.uint64)
    stems[long] = spans.mix(hashes(first[long], first[long] + STEM) ^ _STEM_KEY)
    return hashes(first, last), stems, doc


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, clean): in how many texts of each label a key occurs, per block."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        for block in spans.blocks(batch.column("text")):
            keys, stems, doc = tokens(block)
            some = stems != 0
            keys, doc = np.concatenate((keys, stems[some])), np.concatenate((doc, doc[some]))
            _, at = np.unique(spans.keyed(keys, doc), return_index=True)
            keys, toxic = keys[at], label[block.first + doc[at]]
            found, inverse = np.unique(keys, return_inverse=True)
            n = np.bincount(inverse, minlength=len(found))
            bad = np.bincount(inverse, weights=toxic, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(bad), pa.array(n - bad)], ["key", "toxic", "clean"]
            )


@dataclass
class Model:
    """A lexicon of toxic keys with log-odds, and the calibration of segment scores."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    slope: float = 0.0
    shift: float = 0.0

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.odds = self.keys[order], self.odds[order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    @property
    def informed(self) -> bool:
        """Whether any token speaks for the toxic label; without one all texts have the same score."""
        return len(self.keys) > 0

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Log-odds of each key, 0 for keys outside the lexicon."""
        out = np.zeros(len(keys))
        at = np.flatnonzero(self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        if len(at):
            where = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[where] == keys[at], self.odds[where], 0.0)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Scores of texts with this evidence; 0 for all where no token speaks for the toxic label."""
        if not self.informed:
            return np.zeros(len(evidence))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * evidence + self.shift, -50, 50)))


def segments(positions: list[int], odds: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first token, token after the last, score).

    ``positions`` are the tokens with log-odds; each scores ``odds - drift``, every other token
    ``-drift``. One pass from left to right keeps candidates with the running total before and
    after them; a candidate that can be extended to the right of an earlier, lower one joins it.
    Each candidate is joined or dropped once, so the time is linear.
    """
    found: list[list] = []  # first, end, total before, total after, nearest candidate with a lower start
    total, done = 0.0, 0
    for at, odd in zip(positions, odds):
        before = total - drift * (at - done)
        total, done = before + odd - drift, at + 1
        if total <= before:
            continue
        first, low = at, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([first, done, low, total, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def evidence_of(block: spans.Block, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
    """Per text the sum over significant segments of scale * score - log(tokens), and the segments
    as (first byte, byte after the last, score, expected number of such segments by chance)."""
    n = len(block)
    total, passages = np.zeros(n), [[] for _ in range(n)]
    if not len(model.keys):
        return total, passages
    first, last, doc = block.words(spans.PUNCTUATION)
    keys, stems, _ = tokens(block)
    odds = np.maximum(model.lookup(keys), model.lookup(stems))
    hits = np.flatnonzero(odds)
    counts = np.bincount(doc, minlength=n)
    start = np.concatenate(([0], np.cumsum(counts)))
    for d in np.unique(doc[hits]):
        at = hits[doc[hits] == d] if len(hits) < 64 else hits[np.searchsorted(doc[hits], d) : np.searchsorted(doc[hits], d, "right")]
        for a, b, score in segments((at - start[d]).tolist(), odds[at].tolist()):
            gain = model.scale * score - np.log(counts[d])
            if gain > 0:
                total[d] += gain
                passages[d].append(
                    (int(first[start[d] + a] - block.starts[d]), int(last[start[d] + b - 1] - block.starts[d]), score, float(np.exp(-gain)))
                )
    return total, passages


def _scale(odds: np.ndarray, rate: np.ndarray) -> float:
    """The extreme-value rate of segment scores in clean text: the positive root of
    E[exp(rate * score)] = 1 over the chances of the lexicon's tokens there."""
    rest = max(1e-9, 1.0 - rate.sum())
    excess = lambda x: float(np.sum(rate * np.exp(x * (odds - DRIFT)))) + rest * np.exp(-x * DRIFT) - 1.0
    low, high = 1e-3, 1e-3
    if excess(low) >= 0:
        return low
    while excess(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge."""
    x = np.minimum(x, 50.0)
    w = np.zeros(2)
    design = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _weigh(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [evidence_of(b, model)[0] for b in spans.blocks(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(np.concatenate(parts))], ["label", "evidence"]
                )

    return tidy(run)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_ROWS) -> Model:
    """The model of at most ``bound`` labelled rows that are not held out.

    Keys are counted with partial aggregation; lower bounds of log-odds with Dirichlet priors are
    column expressions, and only the significant lexicon comes to the driver, together with one
    number per row of the bounded sample for the calibration.
    """
    sample = training_sample(docs, labels, "toxic", MODULUS, REST, bound, id_col, text_col)
    sums = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, bad = sums["n"], sums["toxic"] or 0
    if not bad or bad == n:
        return Model()
    counts = sample.mapInArrow(_count, "key bigint, toxic bigint, clean bigint").groupBy("key").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    prior = F.lit(FLAT_PRIOR) + F.lit(BACKGROUND) * (F.col("toxic") + F.col("clean")) / n / n
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (bad + 1.0)) - F.log(c / (n - bad + 1.0))
    lexicon = (
        counts.where("toxic >= 2")
        .select("key", "clean", (odds - CAUTION * F.sqrt(1 / t + 1 / c)).alias("odds"))
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy("key")
        .collect()
    )
    keys = np.array([r["key"] for r in lexicon], dtype=np.int64).view(np.uint64)
    model = Model(keys, np.array([r["odds"] for r in lexicon]))
    if not len(keys):
        return model
    clean = np.array([r["clean"] for r in lexicon]) + FLAT_PRIOR / len(lexicon)
    lengths = sample.where("label = 0").agg(F.sum(F.length("text"))).first()[0] or 1
    model.scale = _scale(np.array([r["odds"] for r in lexicon]), clean / max(1.0, lengths / 6.0))
    rows = sample.mapInArrow(_weigh(model), "label int, evidence double").collect()
    x, y = np.array([r["evidence"] for r in rows]), np.array([r["label"] for r in rows], dtype=float)
    model.slope, model.shift = _logistic(x, y)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, lists = [], []
            for block in spans.blocks(batch.column("text")):
                evidence, passages = evidence_of(block, model)
                scores.append(np.round(model.probability(np.minimum(evidence, 50.0)), 6))
                lists += passages
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            found = np.concatenate(scores) if scores else np.zeros(0)
            kind = pa.list_(
                pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
            )
            items = [[dict(zip(("first_byte", "end_byte", "score", "expected"), p)) for p in ps] for ps in lists]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found), pa.array(items, kind)], [*names, "score", "passages"])

    return tidy(run)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages) of every whole text: the probability of the toxic label, and every
    significant passage as byte range, score and expected number by chance. A scan, no shuffle.

    Defined cases: a null or empty text has no passage and the score of that; without a usable
    label of each kind, or without a telling token, all texts score 0 (``drop_toxic`` then keeps
    all); ids may be null or repeated.
    """
    rows = ship(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (
        f"id {dict(rows.dtypes)['id']}, score double, "
        "passages array<struct<first_byte: bigint, end_byte: bigint, score: double, expected: double>>"
    )
    return rows.mapInArrow(_score(model), schema).withColumnRenamed("id", id_col)


#: Texts with at least this score are taken as toxic.
CUT = 0.3


def _passing(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = [evidence_of(b, model)[0] for b in spans.blocks(batch.column(text_col))]
            if evidence:
                score = np.round(model.probability(np.minimum(np.concatenate(evidence), 50.0)), 6)
                yield batch.filter(pa.array(score < CUT))

    return tidy(run)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``CUT``; all columns as they were, no shuffle.

    A model that is not informed (no labels, labels of one kind only, no telling token) drops nothing.
    """
    if not model.informed:
        return docs
    return ship(docs).mapInArrow(_passing(model, text_col), docs.schema)


def op5_toxicity(spark, sf_dir):
    """Toxicity of the whole documents table, learned from the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out("doc_id", MODULUS, REST).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
