"""Ranked lexical search by bag deduplication: documents that no item can tell apart are scored once."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spans, terms
from .common import ship, tidy, written

#: Documents returned for each item.
DEPTH = 50
#: (item, term) pairs that one pass over the documents serves; more items make more passes.
BLOCK_PAIRS = 1 << 20
#: Scores, and additions to them, that a task holds at a time.
HELD = 1 << 20

_LARGEST = np.iinfo(np.int64).max


class Items:
    """The items of one pass: ids, their vocabulary, and the items of each term of it."""

    def __init__(self, pairs: list[tuple[int | None, str]]):
        self.ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or 0))
        words = sorted({t for _, t in pairs})
        self.vocabulary = terms.Vocabulary(words)
        item, word = {i: k for k, i in enumerate(self.ids)}, {t: k for k, t in enumerate(words)}
        both = np.array(sorted((word[t], item[i]) for i, t in pairs), dtype=np.int64).reshape(-1, 2)
        self.items = both[:, 1].astype(np.int32)
        self.first = np.searchsorted(both[:, 0], np.arange(len(words) + 1))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term) of every item, each once; rows that share an id are one item, null ids too."""
    words = F.regexp_extract_all(F.translate(text_col, terms.UPPER, terms.LOWER), F.lit(f"({terms.PATTERN})"), F.lit(1))
    return items.select(F.col(id_col).cast("bigint").alias("item"), F.explode(words).alias("term")).distinct()


def _bags(vocabulary: terms.Vocabulary):
    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in spans.blocks(batch.column("text")):
                first, last, doc = block.words(terms.APART)
                data = terms.lower(block.data)
                found = vocabulary.find(data, first, last)
                hit = found >= 0
                keys, counts = np.unique(doc[hit] * size + found[hit], return_counts=True)
                ends = np.searchsorted(keys // size, np.arange(len(block)), side="right")
                pairs = np.column_stack((keys % size, counts)).astype("<i4")
                offsets = np.concatenate(([0], ends * 8)).astype(np.int32)
                vectors = pa.Array.from_buffers(
                    pa.binary(), len(block), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())]
                )
                n = np.bincount(doc, minlength=len(block))
                ids = batch.column("id").slice(block.first, len(block))
                rows = pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), vectors], ["id", "n", "vector"])
                yield rows.filter(pa.array(n > 0))

    return tidy(run)


def bags(docs: DataFrame, vocabulary: terms.Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, vector) of each document with a term: its number of terms and, of those in the
    vocabulary, position and count as pairs of 32-bit numbers in rising order. A scan, no shuffle."""
    rows = ship(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_bags(vocabulary), "id bigint, n bigint, vector binary")


def _decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all vectors as rows, and the number of pairs of each vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole.view("<i4").reshape(-1, 2).astype(np.int64), np.diff(at) // 8


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_decoded(batch.column("vector"))[0][:, 0], minlength=size)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["term", "df"])

    return tidy(run)


def classes(rows: DataFrame) -> DataFrame:
    """(class, hash, m, vector, first_id, members): documents with equal vector and m.

    Rows are dealt by a 64-bit hash; equal hashes are verified, since vector and m are grouped
    with it. Each task adds up its own copies first, so a class with a third of all rows is a row a task.
    """
    found = rows.groupBy("hash", "m", "vector").agg(F.min("id").alias("first_id"), F.count("*").alias("members"))
    return written(found.withColumn("class", F.monotonically_increasing_id()))


def _scored(items: Items, weights: np.ndarray, depth: int):
    """Best classes of each item among those a task reads, each class scored once for all items."""
    many = len(items.ids)

    def cuts(work: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of classes whose scores, and additions to them, are few enough to be held."""
        upto, i = np.concatenate(([0], np.cumsum(work))), 0
        while i < len(work):
            j = int(np.searchsorted(upto, upto[i] + HELD, side="right")) - 1
            j = min(max(j, i + 1), i + max(1, HELD // many))
            yield i, j
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, 5), dtype=np.int64)  # item, score, first id, class, members
        bar = np.ones(many, dtype=np.int64)
        for batch in batches:
            pairs, sizes = _decoded(batch.column("vector"))
            term, tf = pairs[:, 0], pairs[:, 1]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            m = batch.column("m").to_numpy()
            gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
            fan = items.first[term + 1] - items.first[term]
            ends = np.cumsum(sizes)
            info = [batch.column(c).fill_null(_LARGEST).to_numpy() for c in ("first_id", "class", "members")]
            for i, j in cuts(np.bincount(owner, weights=fan, minlength=len(sizes)).astype(np.int64)):
                part = slice(ends[i] - sizes[i], ends[j - 1])
                to = items.items[terms.ragged(items.first[term[part]], fan[part])].astype(np.int64)
                scores = np.zeros((many, j - i), dtype=np.int64)
                np.add.at(scores.reshape(-1), to * (j - i) + np.repeat(owner[part] - i, fan[part]), np.repeat(gain[part], fan[part]))
                if j - i > depth:
                    least = np.partition(scores, j - i - depth, axis=1)[:, j - i - depth]
                else:
                    least = bar
                item, row = np.nonzero(scores >= np.maximum(bar, least)[:, None])
                new = np.column_stack((item, scores[item, row], *(x[i + row] for x in info)))
                best = np.concatenate((best, new))
                best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
                start = np.searchsorted(best[:, 0], np.arange(many + 1))
                rank = np.arange(len(best)) - start[best[:, 0]]
                full = np.flatnonzero(np.diff(start) >= depth)
                bar[full] = np.maximum(bar[full], best[start[full] + depth - 1, 1])
                best = best[rank < depth]
        ids = pa.array([items.ids[i] for i in best[:, 0]], pa.int64())
        rest = [pa.array(best[:, c]) for c in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([ids, *rest], ["item", "score", "first_id", "class", "members"])

    return tidy(run)


def _pass(docs: DataFrame, items: Items, depth: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, rank, id, score) of the items of one pass; None without any document."""
    rows = written(bags(docs, items.vocabulary, id_col, text_col))
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    size = len(items.vocabulary)
    counts = rows.where("length(vector) > 0").select("vector").mapInArrow(_frequencies(size), "term bigint, df bigint")
    weights = np.zeros(size, dtype=np.int64)
    for term, df in counts.groupBy("term").agg(F.sum("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    m = f"50 + cast(50 * cast(n as decimal(12,0)) * cast({n_docs} as decimal(16,0)) as decimal(38,0)) div {n_terms}L"
    keyed = (
        rows.where("length(vector) > 0")
        .select("id", F.expr(m).alias("m"), "vector")
        .withColumn("hash", F.xxhash64("vector", "m"))
    )
    every = classes(keyed)
    scored = every.mapInArrow(
        _scored(items, weights, depth), "item bigint, score bigint, first_id bigint, class bigint, members bigint"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first_id")
    higher = Window.partitionBy("item").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, -1)
    top = written(
        scored.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= depth)
        .withColumn("ahead", F.coalesce(F.sum("members").over(higher), F.lit(0)))
        .where(F.col("ahead") < depth)
        .select("item", "score", "class")
    )
    wanted = written(every.join(top.select("class").distinct(), "class").select("class", "hash", "m", "vector"))
    by_id = F.col("id").asc_nulls_last()
    members = (
        keyed.join(wanted, ["hash", "m", "vector"])
        .select("class", "id")
        .withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(by_id)))
        .where(F.col("place") <= depth)
        .drop("place")
    )
    ranked = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), by_id))
    return members.join(top, "class").withColumn("rank", ranked).where(F.col("rank") <= depth).select("item", "rank", "id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    depth: int = DEPTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """(item, rank, document id, score): the ``depth`` best documents of each item with a score above 0.

    Items are dealt into blocks of about ``block_pairs`` (item, term) pairs; each block is one pass
    over all documents and holds its items and vocabulary in every task, which that bound limits.
    A document becomes the vector of its counts of vocabulary terms plus m, the only things a score
    depends on. Documents with equal vector and m form a class, hashed and verified; every class
    is scored once, in integers. Tasks hand on their best classes of each item. The best ``depth``
    classes by score and smallest id hold the best ``depth`` documents, so only their members are
    expanded, by ascending id and only as far as classes with higher scores leave room.

    Defined cases: a null text or one without terms is no document and no item; rows that share an
    item id (null too) are one item of all their terms; rows that repeat a document are documents
    of their own; a null document id comes after all others; ids are integers; empty tables give
    an empty result.
    """
    spark: SparkSession = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text_col))
    total = pairs.count()
    blocks = -(-total // block_pairs)
    found = []
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if mine:
            found.append(_pass(docs, Items([(r["item"], r["term"]) for r in mine]), depth, id_col, text_col))
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], f"{item_col} bigint, rank int, {id_col} bigint, score bigint")
    every = functools.reduce(DataFrame.unionByName, found)
    return every.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


_TERMS = f"regexp_extract_all(translate(text, '{terms.UPPER}', '{terms.LOWER}'), '{terms.PATTERN}')"
SQL = rf"""
with d as (
  select row_number() over () as k, doc_id, coalesce({_TERMS}, []) as t from documents
), tot as (
  select count(*) as big_n, cast(sum(len(t)) as bigint) as big_l from d where len(t) > 0
), it as (
  select distinct item_id, term from (select item_id, unnest({_TERMS}) as term from benchmark)
), tf as (
  select k, doc_id, n, term, count(*) as tf
  from (select k, doc_id, len(t) as n, unnest(t) as term from d)
  where term in (select term from it) group by k, doc_id, n, term
), w as (
  select term, cast(floor(1000 * ln((2 * max(big_n) + 2) / (2 * count(*) + 1))) as bigint) as w
  from tf, tot group by term
), s as (
  select item_id, k, doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) as bigint) as score
  from it join tf using (term) join w using (term), tot
  group by item_id, k, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
where rank <= 50
"""


def op11_lexical_search(spark, sf_dir):
    """The fifty best documents of the whole table for every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
