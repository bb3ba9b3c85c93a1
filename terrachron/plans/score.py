"""Scoring stored fields against frozen records, and comparing candidate fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import fields, scoring


def node_means(
    nodes: DataFrame, records: DataFrame, field: DataFrame, nlat: int, nlon: int,
    step: float, n_anchors: int,
) -> DataFrame:
    """Nodes with the field value ``mu`` and their record's ``y, sigma, split``."""
    at = fields.sample_fields(
        nodes, field, nlat, nlon, step, n_anchors, lon="node_lon", lat="node_lat", age="node_age"
    ).withColumnRenamed("value", "mu")
    labels = records.select(
        "observation_id", F.col("thickness_km").alias("y"), "sigma", "split"
    )
    return at.join(labels, "observation_id")


def score(
    tables: Mapping[str, DataFrame], field: DataFrame, nlat: int, nlon: int, step: float,
    n_anchors: int,
) -> DataFrame:
    """NLL and MAE of train, validation and test records (codes 0, 1, 2)."""
    nodes = node_means(tables["nodes"], tables["records"], field, nlat, nlon, step, n_anchors)
    scores = scoring.record_scores(nodes, carry=["split"])
    return scoring.split_scores(scores.where(F.col("split") >= 0))


def compare_models(
    tables: Mapping[str, DataFrame],
    candidates: Mapping[str, DataFrame],
    truth: DataFrame,
    nlat: int,
    nlon: int,
    step: float,
    n_anchors: int,
) -> DataFrame:
    """One row per candidate field: split scores and errors outside the training support.

    The support comes from the training nodes and is the same for every candidate.
    """
    train = tables["nodes"].join(
        tables["records"].where("split = 0").select("observation_id"), "observation_id", "left_semi"
    )
    support = fields.query_support(
        train, nlat, nlon, step, n_anchors, lon="node_lon", lat="node_lat", age="node_age"
    )
    area = grids.gauss_cell_area("i", nlat, nlon)
    out = None
    for name, field in candidates.items():
        by_split = score(tables, field, nlat, nlon, step, n_anchors)
        row = by_split.agg(
            *[
                F.max(F.when(F.col("split") == code, F.col(metric))).alias(f"{label}_{short}")
                for code, label in ((1, "validation"), (2, "test"))
                for metric, short in (("nll", "nll"), ("age_marginal_mean_mae_km", "mae_km"))
            ]
        )
        missing = fields.missing_scores(truth, field, support, area).select(
            F.struct("*").alias("m")
        )
        row = row.withColumn("_m", missing.scalar()).select(
            F.lit(name).alias("candidate"), "*", "_m.*"
        ).drop("_m")
        out = row if out is None else out.unionByName(row)
    return out
