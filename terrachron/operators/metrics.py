"""Evaluation metrics: points, groups, intervals, bootstrap, conformal, baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordering


def _errors(df: DataFrame, truth: str, prediction: str, by: Sequence[str]) -> DataFrame:
    return df.select(*by, (F.col(prediction) - F.col(truth)).alias("_e"))


def _moments(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    e = F.col("_e")
    grouped = errors.groupBy(*by) if by else errors.groupBy(F.lit(0).alias("_all"))
    return grouped.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.count("*").alias("n"),
    )


def point_metrics(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, median absolute error, bias and count, overall or per group."""
    by = list(by)
    errors = _errors(df, truth, prediction, by)
    moments = _moments(errors, by)
    median = ordering.exact_quantiles(
        errors.withColumn("_a", F.abs("_e")), by, "_a", {"median_ae": 0.5}
    ).drop("n")
    if by:
        return moments.join(median, by)
    one = median.select("median_ae").scalar()
    return moments.drop("_all").withColumn("median_ae", one)


def macro_metrics(per_group: DataFrame) -> DataFrame:
    """Plain average of the group metrics (one row)."""
    return per_group.agg(
        *[F.avg(m).alias(m) for m in ("mae", "rmse", "median_ae", "bias")],
        F.count("*").alias("n_groups"),
    )


def effective_clusters(df: DataFrame, unit: str) -> DataFrame:
    return df.agg(F.count_distinct(unit).alias("effective_clusters"))


#: Multiplicities above this have a chance below 1e-15 and are counted as this.
_MOST = 17


def _poisson_cuts() -> list[float]:
    """Cumulative shares of a Poisson variate of mean 1."""
    share, total, cuts = math.exp(-1.0), 0.0, []
    for k in range(_MOST):
        total += share
        share /= k + 1
        cuts.append(total)
    return cuts


#: Hashes that are worked out side by side; their arrays stay in a core's cache.
_SIDE_BY_SIDE = 32768


def _replicate_sums(n_boot: int, seed: int):
    """Adds up all replicates of the units that a task reads, as vectors; ``n_boot`` rows a task.

    The MD5 of ``seed-replicate-unit`` is worked out for many units and replicates side by side, as its text
    fits one block; only units with longer texts go through ``hashlib``. A nested function without
    globals, so that executors need no copy of this library.
    """
    cuts, side_by_side = _poisson_cuts(), _SIDE_BY_SIDE

    def run(batches):
        import hashlib
        import math

        import numpy as np
        import pyarrow as pa

        word = np.dtype("<u4")
        sines = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
        turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
        start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
        # A mark reaches a cut when it reaches the next whole number.
        marks_of_cuts = [math.ceil(c * 2**32) for c in cuts]
        steps = np.array([c for c in marks_of_cuts if c < 2**32], dtype=np.uint32)
        # Replicates by the length of their text: then all their words lie alike.
        heads = {}
        for k in range(n_boot):
            heads.setdefault(len(f"{seed}-{k}"), []).append(k)
        most = max(heads)

        def words(head_texts, tails):
            """The 16 words of each message: a number, a row by replicate, a column by unit, or a table."""
            h, t = len(head_texts[0]), len(tails[0])
            first = np.zeros((len(head_texts), 64), dtype=np.uint8)
            first[:, :h] = np.frombuffer(b"".join(head_texts), dtype=np.uint8).reshape(-1, h)
            last = np.zeros((len(tails), 64), dtype=np.uint8)
            last[:, h : h + t] = np.frombuffer(b"".join(tails), dtype=np.uint8).reshape(len(tails), t)
            last[:, h + t] = 0x80
            first, last = first.view(word), last.view(word)
            out = []
            for i in range(14):
                if 4 * i >= h + t + 1:
                    out.append(0)
                elif 4 * i + 4 <= h:
                    out.append(first[None, :, i])
                elif 4 * i >= h:
                    out.append(last[:, i, None])
                else:
                    out.append(first[None, :, i] | last[:, i, None])
            return [*out, 8 * (h + t), 0]

        def first_words(message, shape):
            """The first four bytes of every digest, as a big-endian number."""
            a, b, c, d = (np.full(shape, v, dtype=np.uint32) for v in start)
            f, g = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
            for i in range(61):  # the last three steps do not touch these bytes
                part = i // 16
                if part == 0:
                    np.bitwise_xor(c, d, out=f)
                    f &= b
                    f ^= d
                    m = message[i]
                elif part == 1:
                    np.bitwise_xor(b, c, out=f)
                    f &= d
                    f ^= c
                    m = message[(5 * i + 1) % 16]
                elif part == 2:
                    np.bitwise_xor(b, c, out=f)
                    f ^= d
                    m = message[(3 * i + 5) % 16]
                else:
                    np.invert(d, out=f)
                    f |= b
                    f ^= c
                    m = message[7 * i % 16]
                f += a
                if isinstance(m, int):
                    f += np.uint32((sines[i] + m) % 2**32)
                else:
                    f += m + np.uint32(sines[i])
                turn = turns[part][i % 4]
                np.right_shift(f, np.uint32(32 - turn), out=g)
                f <<= np.uint32(turn)
                f |= g
                f += b
                a, b, c, d, f = d, f, b, c, a
            b += np.uint32(start[0])
            return b.byteswap()

        n, sa, sb = np.zeros(n_boot, dtype=np.int64), np.zeros(n_boot), np.zeros(n_boot)

        def add(replicates, marks, amounts):
            times = np.zeros(marks.shape, dtype=np.uint8)
            for cut in steps:
                times += marks >= cut
            total = amounts @ times.astype(np.float64)
            n[replicates] += np.rint(total[0]).astype(np.int64)
            sa[replicates] += total[1]
            sb[replicates] += total[2]

        for batch in batches:
            # A unit without any error to add counts with its rows only.
            amounts = np.array(
                [[v or 0 for v in batch.column(c).to_pylist()] for c in ("n", "sa", "sb")], dtype=np.float64
            )
            alike = {}
            for place, unit in enumerate(batch.column("unit").to_pylist()):
                tail = b"" if unit is None else b"-" + unit.encode()
                alike.setdefault(len(tail), []).append((place, tail))
            for length, members in alike.items():
                for h, replicates in heads.items():
                    texts = [f"{seed}-{k}".encode() for k in replicates]
                    size = max(1, side_by_side // len(replicates))
                    for low in range(0, len(members), size):
                        block = members[low : low + size]
                        tails = [tail for _, tail in block]
                        if most + length <= 55:
                            marks = first_words(words(texts, tails), (len(block), len(replicates)))
                        else:
                            digests = b"".join(hashlib.md5(x + tail).digest()[:4] for tail in tails for x in texts)
                            marks = np.frombuffer(digests, dtype=">u4").reshape(len(block), len(replicates))
                        add(replicates, marks, amounts[:, [place for place, _ in block]])
        columns = [pa.array(np.arange(n_boot, dtype=np.int32)), pa.array(n), pa.array(sa), pa.array(sb)]
        yield pa.RecordBatch.from_arrays(columns, ["b", "n", "sa", "sb"])

    return run


def bootstrap_deltas(
    df: DataFrame, truth: str, a: str, b: str, unit: str, n_boot: int = 2000, seed: int = 0
) -> DataFrame:
    """MAE difference (a - b) per replicate, resampling whole units.

    Rows are reduced to one row per unit first. The law is the Poisson bootstrap: in each replicate
    a unit counts a Poisson(1) number of times, by hashing (seed, replicate, unit) as
    ``hash_uniform`` does. A task adds its units into three vectors of ``n_boot`` numbers, so no
    row per unit and replicate is ever made; ``n_boot`` rows a task are shuffled, nothing is joined.
    """
    y = F.col(truth)
    units = df.groupBy(unit).agg(
        F.count("*").alias("n"),
        F.sum(F.abs(F.col(a) - y)).alias("sa"),
        F.sum(F.abs(F.col(b) - y)).alias("sb"),
    )
    # A few units still make many draws: keep all cores busy, which size alone would not.
    spread = units.repartition(df.sparkSession.sparkContext.defaultParallelism, unit)
    rows = spread.select(
        F.col(unit).cast("string").alias("unit"),
        "n",
        F.col("sa").cast("double").alias("sa"),
        F.col("sb").cast("double").alias("sb"),
    )
    sums = rows.mapInArrow(_replicate_sums(n_boot, seed), "b int, n bigint, sa double, sb double")
    total = F.sum("n")
    return (
        sums.groupBy("b")
        .agg((F.sum("sa") / total - F.sum("sb") / total).alias("delta"), total.alias("_n"))
        .where("_n > 0")
        .drop("_n")
    )


def bootstrap_summary(deltas: DataFrame) -> DataFrame:
    """Mean and central 95 % range of the replicates (``n_boot`` rows at most)."""
    return deltas.agg(
        F.avg("delta").alias("delta_mae_mean"),
        F.percentile("delta", F.lit(0.025)).alias("ci_low"),
        F.percentile("delta", F.lit(0.975)).alias("ci_high"),
    )


# --- intervals ---------------------------------------------------------------


def covered(y="y", lower="lower", upper="upper") -> Column:
    return F.col(y).between(F.col(lower), F.col(upper))


def interval_metrics(df: DataFrame, nominal: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, mean width and interval score of ``lower/upper`` for ``y``."""
    y, lo, hi = F.col("y"), F.col("lower"), F.col("upper")
    alpha = 1.0 - nominal
    miss = F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.avg(covered().cast("double")).alias("coverage"),
        F.avg(hi - lo).alias("mean_width"),
        F.avg(hi - lo + 2.0 / alpha * miss).alias("interval_score"),
        F.count("*").alias("n"),
    )


def coverage_by_bin(df: DataFrame, score: str, bins: int = 5) -> DataFrame:
    """Coverage inside quantile bins of a score; the last bin includes its end."""
    names = [f"q{k}" for k in range(bins + 1)]
    cuts = ordering.exact_quantiles(
        df, [], score, {n: k / bins for k, n in enumerate(names)}
    ).select(F.array(*names).alias("e"))
    edges = cuts.select("e").scalar()
    s = F.col(score)
    marked = df.withColumn("_edges", edges)
    edge = [F.get(F.col("_edges"), F.lit(k)) for k in range(bins + 1)]
    label = F.when((s >= edge[bins - 1]) & (s <= edge[bins]), bins - 1)
    for k in range(bins - 2, -1, -1):
        label = label.when((s >= edge[k]) & (s < edge[k + 1]), k)
    binned = marked.withColumn("bin", label).where(F.col("bin").isNotNull())
    return binned.groupBy("bin").agg(
        F.min(F.get(F.col("_edges"), F.col("bin"))).alias("bin_lo"),
        F.min(F.get(F.col("_edges"), F.col("bin") + 1)).alias("bin_hi"),
        F.avg(covered().cast("double")).alias("coverage"),
        F.count("*").alias("n"),
    )


def conformal_quantile(
    df: DataFrame, truth: str, prediction: str, alpha: float = 0.1
) -> DataFrame:
    """Split-conformal half width: the corrected quantile of the absolute residuals."""
    scores = df.select(F.abs(F.col(prediction) - F.col(truth)).alias("_s"))
    n = F.col("n")
    level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1.0 - alpha)) / n)
    return ordering.exact_quantiles(scores, [], "_s", {"q": level}).select("q", "n")


def conformal_intervals(df: DataFrame, prediction: str, quantile: DataFrame) -> DataFrame:
    q = quantile.select("q").scalar()
    return df.withColumn("_q", q).withColumns(
        {"lower": F.col(prediction) - F.col("_q"), "upper": F.col(prediction) + F.col("_q")}
    ).drop("_q")


def calibration_blocks(
    df: DataFrame, block: str, fraction: float = 0.5, seed: int = 0
) -> DataFrame:
    """Every block once, with ``calibration`` true for the first share in digest order."""
    blocks = df.select(block).distinct()
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(block).cast("string")))
    ranked = ordering.hash_ranked(blocks, digest, block, "_rank")
    share = F.greatest(F.lit(1.0), F.rint(F.col("m") * fraction))
    n = blocks.agg(F.count("*").alias("m")).select(share).scalar()
    return ranked.select(block, (F.col("_rank") <= n).alias("calibration"))


# --- baselines ---------------------------------------------------------------


def robust_centre_scale(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Centre and scale from the 5 % and 95 % quantiles."""
    q = ordering.exact_quantiles(df, by, value, {"p05": 0.05, "p95": 0.95})
    lo, hi = F.col("p05"), F.col("p95")
    return q.select(
        *by,
        (0.5 * (lo + hi)).alias("centre"),
        (F.greatest(hi - lo, F.lit(1e-6)) / 3.29).alias("scale"),
    )


#: Age bins per window width, and value bins per factor e, of the rolling median's histogram.
AGE_BINS, VALUE_BINS = 64, 64


def rolling_age_median(
    train: DataFrame, queries: DataFrame, window_myr: float = 10.0
) -> DataFrame:
    """Median of the training values within +-window of each query age.

    ``train`` has ``age, y``; ``queries`` has ``query_age``, of any values. Training rows are counted
    by age bin and value bin, and the counts are summed up along the age, so two rows of that table
    give a window's counts per value bin. Rows are read for a window only in the age bins at its two
    edges and, once the counts tell in which value bin the middle rank lies, in that bin. Ages with no
    training rows get the overall median; null query ages give no row.
    """
    width = float(window_myr)
    q, distance = F.col("query_age"), F.abs(F.col("age") - F.col("query_age"))

    def bin_of(c: Column) -> Column:
        return F.floor(c / (width / AGE_BINS))

    value_bin = F.floor(ordering.coarse_chunk(F.col("y")) / (ordering.COARSE // VALUE_BINS))
    merged = (
        train.select(F.col("age").cast("double").alias("age"), F.col("y").cast("double").alias("y"))
        .where(F.col("y").isNotNull() & ~F.isnan("y") & F.col("age").isNotNull() & ~F.isnan("age"))
        .groupBy("age", "y")
        .agg(F.count("*").alias("c"))
        .withColumns({"_bin": bin_of(F.col("age")), "_value": value_bin})
    )
    ages = (
        queries.select("query_age")
        .where(q.isNotNull() & ~F.isnan(q.cast("double")))
        .distinct()
        .withColumns({"_from": bin_of(q - width), "_to": bin_of(q + width)})
    )
    # A row beside a bin's border may be rounded into the next bin, so a window is sure of the bins
    # from _from + 2 to _to - 2 and looks at the three at each edge.
    before, upto = F.col("_from") + 1, F.col("_to") - 2
    edges = F.array(*[F.col(c) + k for c in ("_from", "_to") for k in (-1, 0, 1)])

    counts = merged.groupBy("_bin", "_value").agg(F.sum("c").alias("c"))
    values = counts.agg(F.sort_array(F.collect_set("_value")).alias("v")).select("v").scalar()
    by_value = F.map_from_entries(F.collect_list(F.struct("_value", "c")))
    asked_bins = ages.select(F.explode(F.array(before, upto)).alias("_bin")).distinct()
    histogram = (
        counts.groupBy("_bin")
        .agg(by_value.alias("_row"))
        .join(asked_bins.withColumn("_asked", F.lit(True)), "_bin", "full")
        .withColumn("_values", values)
    )
    cells = histogram.select(
        "_bin",
        "_asked",
        F.posexplode(F.transform("_values", lambda v: F.coalesce(F.col("_row")[v], F.lit(0)))).alias("_at", "_c"),
    )
    along = Window.partitionBy("_at").orderBy("_bin")
    sums = (
        cells.withColumn("_c", F.sum("_c").over(along))
        .where("_asked")
        .groupBy("_bin")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_c"))).alias("_sums"))
    )
    at_edges = (
        ages.withColumn("_bin", F.explode(edges))
        .join(merged, "_bin")
        .where(distance <= width)
        .groupBy("query_age", "_value")
        .agg(F.sum("c").alias("c"))
        .groupBy("query_age")
        .agg(by_value.alias("_edge"))
    )
    low = sums.select(F.col("_bin").alias("_low"), F.col("_sums").alias("_before"))
    high = sums.select(F.col("_bin").alias("_high"), F.col("_sums").alias("_upto"))
    inside = F.zip_with("_upto", "_before", lambda x, y: x["_c"] - y["_c"])
    windows = (
        ages.join(low, before == F.col("_low"))
        .join(high, upto == F.col("_high"))
        .join(at_edges, "query_age", "left")
        .withColumn("_values", values)
        .withColumn(
            "_counts",
            F.zip_with(
                inside,
                "_values",
                lambda c, v: F.struct(v.alias("v"), (c + F.coalesce(F.col("_edge")[v], F.lit(0))).alias("c")),
            ),
        )
        .withColumn("_n", F.aggregate("_counts", F.lit(0).cast("long"), lambda n, s: n + s["c"]))
        .where("_n > 0")
        .withColumn("_rank", F.explode(F.array_distinct(F.expr("array((_n - 1) div 2, _n div 2)"))))
    )

    def holder(seen: Column, s: Column) -> Column:
        """The value bin that holds the wanted rank, and the rows in the bins before it."""
        end, rank = seen["end"] + s["c"], F.col("_rank")
        here = (seen["end"] <= rank) & (rank < end)
        return F.struct(
            end.alias("end"),
            F.when(here, s["v"]).otherwise(seen["v"]).alias("v"),
            F.when(here, seen["end"]).otherwise(seen["base"]).alias("base"),
        )

    nothing = F.expr("named_struct('end', 0L, 'v', cast(null as bigint), 'base', 0L)")
    wide = lambda c: F.floor(c / AGE_BINS)
    wanted = windows.withColumn("_hit", F.aggregate("_counts", nothing, holder)).select(
        "query_age",
        "_rank",
        F.col("_hit.v").alias("_value"),
        F.col("_hit.base").alias("_base"),
        F.explode(F.sequence(wide(F.col("_from") - 1), wide(F.col("_to") + 1))).alias("_wide"),
    )
    near = (
        merged.withColumn("_wide", wide(F.col("_bin")))
        .join(wanted, ["_wide", "_value"])
        .where(distance <= width)
        .groupBy("query_age", "_rank", "_base", "y")
        .agg(F.sum("c").alias("c"))
    )
    end = F.col("_base") + F.sum("c").over(Window.partitionBy("query_age", "_rank").orderBy("y"))
    medians = (
        near.withColumn("_end", end)
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("c")))
        .groupBy("query_age")
        .agg((F.min("y") + (F.max("y") - F.min("y")) * 0.5).alias("median"))
    )
    overall = ordering.exact_quantiles(train, [], "y", {"m": 0.5}).select("m").scalar()
    filled = ages.select("query_age").join(medians, "query_age", "left").withColumn("_overall", overall)
    return queries.join(
        filled.select("query_age", F.coalesce("median", "_overall").alias("prediction")),
        "query_age",
    )


def weighted_median(df: DataFrame, by: Sequence[str], value: str, count: str) -> DataFrame:
    """Median of values with multiplicities (linear between the two middle ranks)."""
    return ordering.weighted_quantiles(df, by, value, count, {"median": 0.5}).drop("n")
