"""Age-mixture likelihoods and the terms of the reconstruction objective.

Nodes of a record sit next to each other in the partition that exploded them, so
the map side of ``groupBy(record)`` already merges them: one row per record is
shuffled, not one per node. The t(4) density falls only like the fifth power of
the residual, so summing weight x density cannot underflow and no shift by the
maximum is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chronology as chrono
from ..functions import physics


def weighted_density(y="y", mu="mu", sigma="sigma", weight="node_weight") -> Column:
    """A node's part of ``mixture_density``."""
    return F.col(weight) * chrono.t4_density(y, mu, sigma)


def mixture_density(y="y", mu="mu", sigma="sigma", weight="node_weight") -> Column:
    return F.sum(weighted_density(y, mu, sigma, weight))


def record_scores(nodes: DataFrame, keys=("observation_id",), carry=()) -> DataFrame:
    """Per record: ``nll``, weighted mean ``expected`` and the ``carry`` columns.

    ``nodes`` has ``y, sigma, mu, node_weight``. One record is one unit of
    evidence whatever its node count.
    """
    return nodes.groupBy(*keys).agg(
        (-F.log(mixture_density())).alias("nll"),
        F.sum(F.col("node_weight") * F.col("mu")).alias("expected"),
        F.first("y").alias("y"),
        *[F.first(c).alias(c) for c in carry],
    )


def node_responsibilities(nodes: DataFrame, key: str = "observation_id") -> DataFrame:
    """Add ``responsibility`` and ``nll_gradient`` (d nll / d mu) to every node row.

    The window covers the nodes of one record, at most a handful by contract.
    """
    density = F.col("node_weight") * chrono.t4_density("y", "mu", "sigma")
    total = F.sum(density).over(Window.partitionBy(key))
    d = F.col("mu") - F.col("y")
    pull = 5.0 * d / (4.0 * F.col("sigma") * F.col("sigma") + d * d)
    return nodes.withColumn("responsibility", density / total).withColumn(
        "nll_gradient", F.col("responsibility") * pull
    )


def split_scores(scores: DataFrame, split: str = "split") -> DataFrame:
    """Mean NLL, MAE of the expected value and record count per split."""
    return scores.groupBy(split).agg(
        F.avg("nll").alias("nll"),
        F.avg(F.abs(F.col("expected") - F.col("y"))).alias("age_marginal_mean_mae_km"),
        F.count("*").alias("n_records"),
    )


def huber_term(scores: DataFrame, beta: float) -> DataFrame:
    """Mean smooth absolute error of the expected value, in units of beta."""
    e = F.col("expected") - F.col("y")
    return scores.agg((F.avg(physics.huber(e, beta)) / beta).alias("huber"))


def modern_cell_nll(prediction="prediction", observed="observed", sigma="sigma") -> Column:
    z = (F.col(prediction) - F.col(observed)) / F.col(sigma)
    return 0.5 * z * z + F.log(F.col(sigma)) + 0.5 * math.log(2.0 * math.pi)


def modern_block_mean_loss(cells: DataFrame, block: str = "block") -> DataFrame:
    """Endpoint loss with plain means inside blocks, and the area RMSE (one row)."""
    e2 = F.pow(F.col("prediction") - F.col("observed"), 2)
    blocks = cells.groupBy(block).agg(
        F.avg(modern_cell_nll()).alias("m"),
        F.sum(e2 * F.col("area_km2")).alias("ea"),
        F.sum("area_km2").alias("a"),
    )
    return blocks.agg(
        F.avg("m").alias("modern_nll"),
        F.sqrt(F.sum("ea") / F.sum("a")).alias("modern_area_rmse_km"),
    )


def modern_area_weighted_loss(cells: DataFrame, block: str | None = "block") -> DataFrame:
    """Endpoint loss weighted by area inside blocks, averaged over blocks (one row)."""
    weighted = F.sum(modern_cell_nll() * F.col("area_km2")) / F.sum("area_km2")
    if block is None:
        return cells.agg(weighted.alias("modern_nll"))
    return cells.groupBy(block).agg(weighted.alias("m")).agg(F.avg("m").alias("modern_nll"))


def temporal_roughness(
    field: DataFrame, keys=("i", "j"), order="age_idx", value="value", step: float | None = None
) -> DataFrame:
    """Squared steps between neighbouring anchors.

    With ``step``: mean of ((later - earlier) / step)^2 over cells, as ``smoothness``.
    Without: their plain sum, as ``roughness``. Each series is as long as the
    anchor list.
    """
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    d = field.withColumn("_d", F.col(value) - before)
    if step is None:
        return d.agg(F.sum(F.col("_d") * F.col("_d")).alias("roughness"))
    return d.agg(F.avg(F.pow(F.col("_d") / step, 2)).alias("smoothness"))


def combine_objective(
    parts: dict[str, tuple[DataFrame, str]], weights: dict[str, float]
) -> DataFrame:
    """One row with every part and ``total``, their weighted sum.

    Each part is (one-row DataFrame, column); they are read as scalar subqueries.
    """
    names = list(parts)
    first = names[0]
    frame, column = parts[first]
    row = frame.select(F.col(column).alias(first))
    for name in names[1:]:
        frame, column = parts[name]
        row = row.withColumn(name, frame.select(column).scalar())
    total = sum((F.col(n) * F.lit(float(weights.get(n, 0.0))) for n in names), F.lit(0.0))
    return row.withColumn("total", total)


def selection_score(candidates: DataFrame, metric: str, modern_weight: float = 1.0) -> DataFrame:
    """Best candidate by the declared metric; training loss never enters MAE selection."""
    score = {
        "validation_mae": F.col("age_marginal_mean_mae_km"),
        "validation_nll": F.col("nll"),
        "joint_nll": F.col("nll") + modern_weight * F.col("modern_nll"),
    }
    if metric not in score:
        raise ValueError(f"unknown selection metric {metric!r}")
    ranked = candidates.withColumn("score", score[metric])
    return ranked.agg(
        F.min_by("candidate", F.struct("score", "candidate")).alias("candidate"),
        F.min("score").alias("score"),
    )


def replication_error(nodes: DataFrame, factor: int, key: str = "observation_id") -> DataFrame:
    """Largest change of the record NLL when every node is split into ``factor`` copies."""
    copies = nodes.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.lit(factor)))
    ).withColumn("node_weight", F.col("node_weight") / factor)
    a = nodes.groupBy(key).agg((-F.log(mixture_density())).alias("a"))
    b = copies.groupBy(key).agg((-F.log(mixture_density())).alias("b"))
    return a.join(b, key).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_error"))


def jensen_gap(nodes: DataFrame, key: str = "observation_id") -> DataFrame:
    """Mean of (mixture NLL - expected point NLL); never positive."""
    point = -F.sum(F.col("node_weight") * chrono.t4_log_density("y", "mu", "sigma"))
    rows = nodes.groupBy(key).agg(
        (-F.log(mixture_density())).alias("mix"), point.alias("point")
    )
    return rows.agg(F.avg(F.col("mix") - F.col("point")).alias("jensen_gap"))
