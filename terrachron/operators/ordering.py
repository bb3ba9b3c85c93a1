"""Exact ranks, dense ids and quantiles without a one-task window.

A window over one key, or over everything, sends that key's rows to one task.
Here rows are first cut into chunks that keep the order. Chunk sizes come from a
partially aggregated count, so a rank is (rows in earlier chunks) + (rank inside
the chunk) and no task ever holds more than one chunk.

Chunks have two levels. The first is a fixed function of the value, of relative
width, so outliers do not widen it and no statistics are joined for it; the second
cuts the range that a first-level chunk really has into equal parts, so values that
lie close together are parted as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First-level chunks per factor e of the value, and second-level chunks.
COARSE = 256
FINE = 4096


def coarse_chunk(value: Column) -> Column:
    """Integer that never decreases along ``value``: its logarithm in steps, with its sign.

    Below 1e-6 the steps are even. A double has fewer than 400,000 of these chunks.
    """
    return F.floor(F.signum(value) * F.asinh(F.abs(value) * 1e6) * COARSE).cast("long")


def fine_chunk(value: Column, low: Column, high: Column, parts: int = FINE) -> Column:
    """Place of ``value`` in [low, high], in equal parts."""
    at = F.floor((value - low) / (high - low) * parts)
    return F.when(high > low, F.least(at, F.lit(parts - 1))).otherwise(F.lit(0)).cast("long")


def chunked_row_number(
    df: DataFrame, chunk: Column, order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """1-based global row number under ``order``.

    ``chunk`` must be an integer that never decreases along ``order``. The chunk
    totals have one row per chunk and are summed by a window over that table.
    """
    marked = df.withColumn("_chunk", chunk)
    totals = marked.groupBy("_chunk").agg(F.count("*").alias("_size"))
    before = totals.withColumn(
        "_before",
        F.sum("_size").over(
            Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        - F.col("_size"),
    ).drop("_size")
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return (
        marked.withColumn("_inside", inside)
        .join(before, "_chunk")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_chunk", "_before", "_inside")
    )


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """The rows with those of a key next to each other in one partition, keys in ascending order there.

    Rows that are later spread from them in place stay so. The number of partitions follows the
    cores, not the bytes, which say little of the work that a row stands for.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key).sortWithinPartitions(key)


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct values of a numeric key with consecutive ids from 0, in key order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    value = F.col(key).cast("double")
    marked = keys.withColumn("_coarse", coarse_chunk(value))
    ranges = marked.groupBy("_coarse").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    chunk = F.col("_coarse") * FINE + fine_chunk(value, F.col("_lo"), F.col("_hi"))
    ranked = chunked_row_number(marked.join(ranges, "_coarse"), chunk, [F.col(key)], "_rank")
    return ranked.select(key, (F.col("_rank") - 1).alias(name))


def weighted_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    count: str,
    levels: Mapping[str, float | Column],
    chunks: int = FINE,
) -> DataFrame:
    """Linear-interpolated quantiles per group of values with multiplicities, and the total ``n``.

    Chunk totals are counted with map-side combining; the chunks that hold a wanted rank are read
    off their running totals, and only rows of those chunks are looked at again, first in finer
    chunks, then by value. Rows meet only the chunks they are in, never a whole group's statistics.
    A level may be a number or a column expression over ``n``. Groups with a null key are left out.
    """
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v"), F.col(count).cast("long").alias("_c")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    if by:
        rows = rows.dropna(subset=by)
    rows = rows.withColumn("_a", coarse_chunk(F.col("_v")))
    names = list(levels)

    def wanted(start: Column, end: Column) -> Column:
        """The wanted ranks (floor and ceiling of level x (n - 1)) that lie in [start, end)."""
        out = []
        for name in names:
            level = levels[name]
            level = level if isinstance(level, Column) else F.lit(float(level))
            at = level * (F.col("n") - 1)
            for side, rank in (("l", F.floor(at)), ("u", F.ceil(at))):
                out.append(
                    F.struct(
                        F.lit(name).alias("q"),
                        F.lit(side).alias("side"),
                        rank.cast("long").alias("r"),
                        (at - F.floor(at)).alias("f"),
                    )
                )
        return F.filter(F.array(*out), lambda t: (t["r"] >= start) & (t["r"] < end))

    def running(counts: DataFrame, keys: list[str], order: str, start: Column) -> DataFrame:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy()
        upto = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("_end", start + F.sum("_m").over(upto)).withColumn(
            "_start", F.col("_end") - F.col("_m")
        )

    coarse = rows.groupBy(*by, "_a").agg(
        F.sum("_c").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    coarse = running(coarse.withColumn("n", F.sum("_m").over(whole)), by, "_a", F.lit(0))
    hit = (
        coarse.where(F.size(wanted(F.col("_start"), F.col("_end"))) > 0)
        .select(*by, "_a", "_lo", "_hi", "n", F.col("_start").alias("_base"))
    )
    if not by:  # at most two chunks per level
        hit = F.broadcast(hit)
    near = rows.join(hit, [*by, "_a"]).withColumn("_b", fine_chunk(F.col("_v"), F.col("_lo"), F.col("_hi"), chunks))
    keys = [*by, "_a"]
    fine = near.groupBy(*keys, "_b").agg(
        F.sum("_c").alias("_m"), F.max("n").alias("n"), F.max("_base").alias("_base")
    )
    fine = running(fine, keys, "_b", F.col("_base"))
    exact = (
        fine.where(F.size(wanted(F.col("_start"), F.col("_end"))) > 0)
        .select(*keys, "_b", F.col("_start").alias("_first"))
    )
    if not by:
        exact = F.broadcast(exact)
    keys = [*keys, "_b"]
    values = near.join(exact, keys).groupBy(*keys, "_v").agg(
        F.sum("_c").alias("_m"), F.max("n").alias("n"), F.max("_first").alias("_first")
    )
    placed = running(values, keys, "_v", F.col("_first"))
    found = placed.select(
        *by, "n", "_v", F.explode(wanted(F.col("_start"), F.col("_end"))).alias("t")
    ).select(*by, "n", "_v", "t.*")

    def level_value(name: str) -> Column:
        low = F.max(F.when((F.col("q") == name) & (F.col("side") == "l"), F.col("_v")))
        high = F.max(F.when((F.col("q") == name) & (F.col("side") == "u"), F.col("_v")))
        part = F.max(F.when(F.col("q") == name, F.col("f")))
        return (low + (high - low) * part).alias(name)

    result = [F.max("n").alias("n"), *[level_value(q) for q in names]]
    if by:
        return found.groupBy(*by).agg(*result)
    return found.agg(*result).where(F.col("n").isNotNull())


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    levels: Mapping[str, float | Column],
    chunks: int = FINE,
) -> DataFrame:
    """Linear-interpolated quantiles of rows per group, plus the group's size ``n``."""
    return weighted_quantiles(df.withColumn("_one", F.lit(1)), by, value, "_one", levels, chunks)


def hash_ranked(df: DataFrame, digest: Column, tie: str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in the order of a hex digest (a reproducible shuffle)."""
    chunk = F.conv(F.substring(digest, 1, 3), 16, 10).cast("long")
    return chunked_row_number(df, chunk, [digest, F.col(tie)], name)
