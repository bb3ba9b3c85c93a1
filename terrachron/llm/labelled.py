"""Labelled training rows for the two classifiers, and the remainder that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, written


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether labels of the row may not be learned from; false for a null id."""
    return F.coalesce(remainder(id_col, modulus) == rest, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, bound: int, id_col: str, text_col: str
) -> DataFrame:
    """(label, text) of at most ``bound`` labelled documents that are not held out, as a table.

    The rows with the smallest hashes of their ids are taken; with fewer labels, all of them. The
    ids are at most ``bound`` pairs of numbers, so they are broadcast and texts are not shuffled.
    An id with several labels counts with the largest; null labels and null ids are left out.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, modulus, rest))
        .groupBy(F.col(id_col).alias("labelled_id"))
        .agg((F.max(label) > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(bound)
    )
    rows = ship(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(rows.join(F.broadcast(chosen), F.col("id") == F.col("labelled_id")).select("label", "text"))
