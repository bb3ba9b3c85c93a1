"""Spherical-harmonic analysis and the variational objective."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import harmonics, temporal
from ..functions.physics import softplus


def normal_equations(rows: DataFrame, lmax: int, by: str | None = None) -> DataFrame:
    """Entries (a, b, value) of Y'WY and of Y'Wf (b = -1) for rows (lon, lat, w, f).

    With ``by``, a number column such as the anchor, there is one system per value, all in one pass.
    Each Arrow batch stream is reduced to small matrices before anything is shuffled, so the
    shuffle carries (terms^2) numbers per task and value.
    """
    k = harmonics.coefficient_count(lmax)
    key = by or "_all"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        systems: dict[int, list[np.ndarray]] = {}
        for whole in batches:
            for value, b in whole.groupby(key):
                gram, right = systems.setdefault(value, [np.zeros((k, k)), np.zeros(k)])
                y = harmonics.basis_matrix(lmax, b["lon"].to_numpy(), b["lat"].to_numpy())
                w = b["w"].to_numpy()
                gram += y.T @ (y * w[:, None])
                right += y.T @ (w * b["f"].to_numpy())
        a, c = np.divmod(np.arange(k * k), k)
        for value, (gram, right) in systems.items():
            yield pd.DataFrame({key: value, "a": a, "b": c, "value": gram.ravel()})
            yield pd.DataFrame({key: value, "a": np.arange(k), "b": -1, "value": right})

    group = F.col(by).cast("long").alias(by) if by else F.lit(0).cast("long").alias(key)
    clean = rows.select(group, *[F.col(c).cast("double").alias(c) for c in ("lon", "lat", "w", "f")])
    return (
        clean.dropna()
        .mapInPandas(partial, f"{key} long, a long, b long, value double")
        .groupBy(key, "a", "b")
        .agg(F.sum("value").alias("value"))
    )


def solve(equations: DataFrame, lmax: int, by: str | None = None) -> DataFrame:
    """Least-squares coefficients ((by,) term, degree, ord, kind, coefficient).

    A system has (lmax + 1)^2 unknowns whatever the data, so one small task solves it.
    """
    k = harmonics.coefficient_count(lmax)
    names = harmonics.terms(lmax)
    key = by or "_all"

    def least_squares(pdf: pd.DataFrame) -> pd.DataFrame:
        gram, right = np.zeros((k, k)), np.zeros(k)
        m = pdf["b"].to_numpy() >= 0
        gram[pdf["a"].to_numpy()[m], pdf["b"].to_numpy()[m]] = pdf["value"].to_numpy()[m]
        right[pdf["a"].to_numpy()[~m]] = pdf["value"].to_numpy()[~m]
        c = np.linalg.lstsq(gram, right, rcond=None)[0]
        return pd.DataFrame(
            {
                key: pdf[key].iloc[0],
                "term": np.arange(k),
                "degree": [t[0] for t in names],
                "ord": [t[1] for t in names],
                "kind": [t[2] for t in names],
                "coefficient": c,
            }
        )

    schema = f"{key} long, term long, degree long, ord long, kind string, coefficient double"
    found = equations.groupBy(key).applyInPandas(least_squares, schema)
    return found if by else found.drop(key)


def analyse(field: DataFrame, lmax: int, weight: Column, by: str | None = None) -> DataFrame:
    """Quadrature-weighted least-squares coefficients of ``field`` (lon, lat, value), per ``by``."""
    keys = [by] if by else []
    rows = field.select(*keys, "lon", "lat", weight.alias("w"), F.col("value").alias("f"))
    return solve(normal_equations(rows, lmax, by), lmax, by)


def coefficient_array(coefficients: DataFrame, by: str | None = None) -> DataFrame:
    """The coefficients in term order as one array ((lmax + 1)^2 numbers), a row per ``by``."""
    packed = F.array_sort(F.collect_list(F.struct("term", "coefficient")))
    return coefficients.groupBy(*([by] if by else [])).agg(F.transform(packed, lambda t: t["coefficient"]).alias("c"))


def synthesise(
    points: DataFrame, coefficients: DataFrame, lmax: int, out: str = "value", by: str | None = None
) -> DataFrame:
    """The field of the coefficients at each point; with ``by``, of the point's own anchor."""
    y = points.withColumn("_y", harmonics.basis(lmax))
    if by:
        arrays = coefficient_array(coefficients, by).select(F.col(by).alias("_by"), F.col("c").alias("_c"))
        # A row per anchor: broadcast, so that points are not dealt to as many tasks as there are anchors.
        y = y.join(F.broadcast(arrays), F.col(by) == F.col("_by")).drop("_by")
    else:
        y = y.withColumn("_c", coefficient_array(coefficients).select("c").scalar())
    return y.withColumn(out, harmonics.synthesis("_y", "_c")).drop("_y", "_c")


def poisson_coefficients(coefficients: DataFrame) -> DataFrame:
    solved = harmonics.inverse_laplacian("degree", "coefficient")
    return coefficients.withColumn("coefficient", solved)


# --- variational model -------------------------------------------------------


def anchor_fields_at(
    points: DataFrame, coefficients: DataFrame, lmax: int, step: float, n_anchors: int
) -> DataFrame:
    """Add ``_y`` (basis), ``_w`` (anchor weights) and ``z``, the field before softplus.

    ``coefficients`` rows are (anchor, term, value); anchors x terms is the model
    size, so the table is one array of arrays read as a scalar.
    """
    packed = (
        coefficients.groupBy("anchor")
        .agg(F.array_sort(F.collect_list(F.struct("term", "value"))).alias("t"))
        .select("anchor", F.transform("t", lambda e: e["value"]).alias("c"))
        .agg(F.array_sort(F.collect_list(F.struct("anchor", "c"))).alias("all"))
        .select(F.transform("all", lambda e: e["c"]).alias("all"))
        .select("all")
        .scalar()
    )
    staged = points.withColumns(
        {
            "_y": harmonics.basis(lmax),
            "_w": temporal.anchor_weights("age", step, n_anchors),
        }
    ).withColumn("_all", packed)
    z = F.aggregate(
        "_w",
        F.lit(0.0),
        lambda acc, e: acc
        + e["w"] * harmonics.synthesis(F.col("_y"), F.get(F.col("_all"), e["anchor"])),
    )
    return staged.withColumn("z", z).drop("_all")


def node_gradient(nodes: DataFrame, n_records: Column | float, positive: bool = True) -> DataFrame:
    """Gradient (anchor, term, gradient) of the mean record NLL.

    ``nodes`` comes from ``anchor_fields_at`` with ``nll_gradient`` attached. The
    per-node outer product is summed on the map side into anchors x terms numbers.
    """
    slope = 1.0 / (1.0 + F.exp(-F.col("z"))) if positive else F.lit(1.0)
    g = F.col("nll_gradient") * slope / n_records
    rows = nodes.select(g.alias("g"), "_y", F.explode("_w").alias("w")).select(
        F.col("w.anchor").alias("anchor"), (F.col("g") * F.col("w.w")).alias("gw"), "_y"
    )
    spread = rows.select("anchor", "gw", F.posexplode("_y").alias("term", "basis"))
    return spread.groupBy("anchor", "term").agg(
        F.sum(F.col("gw") * F.col("basis")).alias("gradient")
    )


def modern_gradient(cells: DataFrame, positive: bool = True) -> DataFrame:
    """Gradient of the area-weighted endpoint loss; it reaches anchor 0 only.

    ``cells`` has ``_y, z, observed, sigma, area_km2, block`` at age 0.
    """
    h = softplus("z") if positive else F.col("z")
    slope = 1.0 / (1.0 + F.exp(-F.col("z"))) if positive else F.lit(1.0)
    g = F.col("area_km2") * (h - F.col("observed")) / F.pow("sigma", 2) * slope
    by_block = (
        cells.select("block", "area_km2", g.alias("g"), F.posexplode("_y").alias("term", "basis"))
        .groupBy("block", "term")
        .agg(F.sum(F.col("g") * F.col("basis")).alias("ga"), F.sum("area_km2").alias("a"))
    )
    return by_block.groupBy("term").agg(F.avg(F.col("ga") / F.col("a")).alias("gradient")).select(
        F.lit(0).alias("anchor"), "term", "gradient"
    )


def roughness_gradient(coefficients: DataFrame) -> DataFrame:
    """Gradient of the summed squared steps between neighbouring anchors."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("term").orderBy("anchor")
    v = F.col("value")
    back = F.coalesce(v - F.lag("value").over(w), F.lit(0.0))
    ahead = F.coalesce(v - F.lead("value").over(w), F.lit(0.0))
    return coefficients.select("anchor", "term", (2.0 * (back + ahead)).alias("gradient"))


def total_gradient(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """Weighted sum of gradient tables."""
    scaled = [
        df.select("anchor", "term", (F.col("gradient") * float(w)).alias("gradient"))
        for w, df in parts
    ]
    union = scaled[0]
    for df in scaled[1:]:
        union = union.unionByName(df)
    return union.groupBy("anchor", "term").agg(F.sum("gradient").alias("gradient"))


def initial_level(mean_km: float = 30.0) -> float:
    """Constant-term start value that gives ``mean_km`` under softplus."""
    return math.log(math.expm1(mean_km))
