"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, text_of, written

#: Code points of a text that the second level looks at.
PREFIX_CHARS = 64


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when they agree after each run of blanks became one space. One scan turns each
    text into a row of three short keys; texts themselves are never shuffled. Rows whose length
    occurs once leave first, then rows whose (length, prefix hash) occurs once; full digests are
    read and grouped only for what survives both levels. All levels count with partial aggregation,
    so a group that holds a third of all rows costs one row per task, and the joins back are plain
    equi-joins of short rows that adaptive execution splits when a key is hot.

    Defined cases: a null text equals the empty text; a null id is larger than any id and is kept
    only if its whole group has null ids; rows that repeat the smallest id of a group are the same
    document and are all marked kept (``keep_one`` returns one of them); empty table, empty result.
    """
    normal = F.regexp_replace(text_of(text_col), BLANKS, " ")
    keys = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.length(normal).alias("size"),
            F.xxhash64(F.substring(normal, 1, prefix_chars)).alias("head"),
            F.sha2(normal, 256).alias("digest"),
        )
    )
    sizes = keys.groupBy("size").count().where("count > 1").select("size")
    by_size = keys.join(sizes, "size", "left_semi")
    heads = by_size.groupBy("size", "head").count().where("count > 1").select("size", "head")
    by_head = by_size.join(heads, ["size", "head"], "left_semi")
    groups = (
        by_head.groupBy("size", "head", "digest")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    return keys.join(groups, ["size", "head", "digest"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    The row with the smallest id stays. Ids whose rows all go are joined alone, from a written table
    whose size the planner knows; where an id (null too) has rows that stay beside copies, the copies
    go by id and digest. Of rows that repeat both id and text one stays.
    """
    found = exact_groups(docs, id_col, text_col)
    gone = written(found.where("group_size > 1"))
    mark, digest = fresh("group_digest", docs.columns), fresh("group_of", docs.columns)
    own = fresh("own_digest", docs.columns)
    pair = F.col(id_col).alias(mark), F.col("text_sha256").alias(digest)
    alone = F.col(id_col).eqNullSafe(F.col(mark))
    same = alone & F.col(own).eqNullSafe(F.col(digest))
    losers = gone.where("not kept").select(*pair).distinct()
    ids = written(losers.select(mark).distinct())
    mixed = written(found.where("kept").select(id_col).join(ids, alone, "inner").select(mark).distinct())
    again = written(gone.where("kept").groupBy(*pair).count().where("count > 1").select(mark, digest))
    if mixed.isEmpty() and again.isEmpty():  # ids are unique, as they should be
        return docs.join(ids, alone, "left_anti")
    named = docs.withColumn(own, F.sha2(F.regexp_replace(text_of(text_col), BLANKS, " "), 256))
    stay = named.join(written(losers), same, "left_anti")
    once = stay.join(again, same, "left")
    single = once.where(F.col(digest).isNull()).select(*docs.columns)
    first = once.where(F.col(digest).isNotNull()).dropDuplicates([id_col, digest]).select(*docs.columns)
    return single.unionByName(first)


SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as s from documents
)
select doc_id, min(doc_id) over (partition by s) as keep_id,
       count(*) over (partition by s) as group_size,
       doc_id = min(doc_id) over (partition by s) as kept,
       sha256(s) as text_sha256
from t
"""


def op10_exact_dedup(spark, sf_dir):
    """Exact duplicates of the whole documents table."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
