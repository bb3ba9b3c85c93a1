"""Reports on tables of posterior draws and of simulated histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, fields, histories


def decode_draws(
    draws: DataFrame, factors: DataFrame, spatial_rank: int, context_rank: int,
    scale_km: float, epsilon: float,
) -> DataFrame:
    """Core draws (chain, draw, age_idx, r, s, value) and factors per cell -> field draws.

    ``factors`` rows are (age_idx, i, j, spatial, context, base). The cores of one
    draw and age are rank x rank numbers and travel as one array.
    """
    rank = [
        F.array(
            *[
                F.sum(F.when((F.col("r") == r) & (F.col("s") == s), F.col("value")))
                for s in range(context_rank)
            ]
        )
        for r in range(spatial_rank)
    ]
    cores = draws.groupBy("chain", "draw", "age_idx").agg(F.array(*rank).alias("core"))
    value = histories.tucker_value(scale_km=scale_km, epsilon=epsilon)
    return factors.join(cores, "age_idx").select(
        "chain", "draw", "age_idx", "i", "j", value.alias("value")
    )


def posterior_fields(field_draws: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Mean and central interval of every cell over chains and draws."""
    return histories.posterior_summary(field_draws, ["age_idx", "i", "j"], alpha=alpha)


def node_draws(
    nodes: DataFrame, field_draws: DataFrame, nlat: int, nlon: int, step: float, n_anchors: int
) -> DataFrame:
    """Node value of every draw: (node columns, chain, draw, mu).

    The draws of a cell are laid side by side before the join: one array per cell and
    corner, so the join has one row per node and the draws are unpacked after it.
    """
    packed = field_draws.groupBy("age_idx", "i", "j").agg(
        F.array_sort(F.collect_list(F.struct("chain", "draw", "value"))).alias("all")
    )
    at = fields.locate(nodes, "node_lon", "node_lat", "node_age", nlat, nlon, step, n_anchors)
    corners = []
    for da in (0, 1):
        for di in (0, 1):
            for dj in (0, 1):
                w = (
                    (F.col("fa") if da else 1 - F.col("fa"))
                    * (F.col("fi") if di else 1 - F.col("fi"))
                    * (F.col("fj") if dj else 1 - F.col("fj"))
                )
                corners.append(
                    F.struct(
                        (F.col("a") + da).cast("int").alias("age_idx"),
                        (F.col("ci") + di).cast("int").alias("i"),
                        F.pmod(F.col("cj") + dj, F.lit(nlon)).cast("int").alias("j"),
                        w.alias("w"),
                    )
                )
    spread = at.select(*nodes.columns, F.explode(F.array(*corners)).alias("c")).select(
        *nodes.columns, "c.*"
    )
    joined = spread.where(F.col("w") > 0).join(
        packed, ["age_idx", "i", "j"]
    )
    opened = joined.select(*nodes.columns, "w", F.explode("all").alias("e"))
    return opened.groupBy(*nodes.columns, F.col("e.chain").alias("chain"), F.col("e.draw").alias("draw")).agg(
        F.sum(F.col("w") * F.col("e.value")).alias("mu")
    )


def ensemble_report(
    fields_table: DataFrame,
    cores: DataFrame,
    ages: Sequence[float],
    expected: DataFrame,
    lengthscale: float = 10.0,
) -> dict[str, DataFrame]:
    """Per-history errors and train-only statistics of an ensemble of histories.

    ``fields_table`` rows (history_id, group_id, split, age_idx, i, j, value, prediction, observed);
    ``cores`` rows (history_id, split, age_idx, dim, value); ``expected`` the cells (age_idx, i, j) of
    the grid. An ensemble is refused before anything is worked out from it if a field or core history
    breaks its contract, if two histories are the same, or if groups cross splits or are too few.
    """
    heads = fields_table.select("history_id", "group_id", "split").distinct()
    checks.must_be_empty(histories.field_problems(fields_table, expected), "field histories refused")
    checks.must_be_empty(histories.core_problems(cores, ages), "core histories refused")
    checks.must_be_empty(histories.repeated_histories(cores), "duplicate histories refused")
    split = histories.history_split_report(heads)
    checks.must_be_empty(split.where("not passed"), "splits of histories refused")
    white = histories.whiten(cores, ages, lengthscale, ["history_id", "split", "dim"])
    statistics = histories.train_normalisation(white)
    return {
        "split": split,
        "rmse": histories.observed_rmse(fields_table),
        "statistics": statistics,
        "normalised": histories.normalise(white, statistics),
    }
