"""Data contracts: each check is a job that returns rows; violations must be zero."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ContractError(ValueError):
    """A table breaks its contract."""


# --- schema ------------------------------------------------------------------


def require_columns(df: DataFrame, columns: Sequence[str], boolean: Sequence[str] = ()) -> DataFrame:
    """Raise when columns are absent or a flag is not boolean; reads no data."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ContractError(f"missing columns: {absent}")
    types = dict(df.dtypes)
    wrong = [c for c in boolean if c in types and types[c] != "boolean"]
    if wrong:
        raise ContractError(f"flags must be boolean: {wrong}")
    return df


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def identity_report(df: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """One row: rows, repeated ids, missing or blank group ids."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("c"),
        *(
            [F.count_if(F.coalesce(F.trim(F.col(group).cast("string")) == "", F.lit(True))).alias("g")]
            if group
            else [F.lit(0).alias("g")]
        ),
    )
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("c") > 1).alias("repeated_ids"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("blank_groups"),
    )


def must_be_empty(df: DataFrame, problem: str) -> None:
    """Action: raise with one example row when the frame is not empty."""
    example = df.limit(1).collect()
    if example:
        raise ContractError(f"{problem}: {example[0].asDict()}")


# --- grids and ages ----------------------------------------------------------


def grid_report(
    field: DataFrame, nlat: int, nlon: int, n_anchors: int, values: Sequence[str]
) -> DataFrame:
    """One row: cell count, expected count, repeats, out-of-range cells, unusable values."""
    inside = (
        F.col("age_idx").between(0, n_anchors - 1)
        & F.col("i").between(0, nlat - 1)
        & F.col("j").between(0, nlon - 1)
    )
    unusable = F.lit(False)
    for v in values:
        unusable = unusable | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))
    cells = field.groupBy("age_idx", "i", "j").agg(
        F.count("*").alias("c"),
        F.count_if(unusable).alias("bad"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("out"),
    )
    expected = nlat * nlon * n_anchors
    return cells.agg(
        F.count("*").alias("n_cells"),
        F.count_if(F.col("c") > 1).alias("repeated_cells"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("outside_cells"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("unusable_values"),
    ).withColumn(
        "passed",
        (F.col("n_cells") == expected)
        & (F.col("repeated_cells") + F.col("outside_cells") + F.col("unusable_values") == 0),
    )


def age_list_report(ages: DataFrame, step: float, max_age: float) -> DataFrame:
    """One row: are the (age_idx, age) pairs 0, step, 2 step, ... up to the oldest age?"""
    a, k = F.col("age"), F.col("age_idx")
    off = F.abs(a - k * step) > 1e-6
    return ages.select("age_idx", "age").distinct().agg(
        F.count("*").alias("n_ages"),
        F.count_distinct("age_idx").alias("n_index"),
        F.min("age").alias("youngest"),
        F.max("age").alias("oldest"),
        F.count_if(F.coalesce(off, F.lit(True))).alias("off_step"),
    ).withColumn(
        "passed",
        (F.col("n_ages") >= 2)
        & (F.col("n_ages") == F.col("n_index"))
        & (F.col("n_ages") == F.lit(round(max_age / step) + 1))
        & (F.col("youngest") == 0)
        & (F.abs(F.col("oldest") - max_age) < 1e-6)
        & (F.col("off_step") == 0),
    )


def usable_field(field: DataFrame, value: str = "value") -> DataFrame:
    """One row: values that are missing, not finite or not positive."""
    v = F.col(value)
    good = F.coalesce((v > 0) & (v < float("inf")) & ~F.isnan(v), F.lit(False))
    return field.agg(F.count("*").alias("n_cells"), F.count_if(~good).alias("bad_values"))


# --- protocol ----------------------------------------------------------------


def protocol_differences(frozen: DataFrame, requested: Mapping[str, str] | DataFrame) -> DataFrame:
    """Rows (name, frozen, requested) where a frozen manifest differs from a request.

    ``frozen`` has (name, value) text rows; a request is a mapping or (name, requested) rows.
    """
    asked = requested
    if not isinstance(requested, DataFrame):
        asked = frozen.sparkSession.createDataFrame(
            [(k, str(v)) for k, v in requested.items()], "name string, requested string"
        )
    both = asked.join(frozen.withColumnRenamed("value", "frozen"), "name", "left")
    return both.where(~F.col("frozen").eqNullSafe(F.col("requested")))


def window_status(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested windows with their registry status; ``usable`` false if unknown or reserved."""
    joined = requested.join(registry, "window_key", "left")
    usable = F.coalesce(~F.col("status").startswith("reserved"), F.lit(False))
    return joined.withColumn("usable", usable)


# --- evidence ----------------------------------------------------------------


def double_use(factors: DataFrame, key: str = "evidence_id", role: str = "role") -> DataFrame:
    """Evidence ids that appear under more than one role."""
    return (
        factors.groupBy(key)
        .agg(F.min(role).alias("first_role"), F.max(role).alias("last_role"))
        .where(F.col("first_role") != F.col("last_role"))
    )


def unbalanced_weights(
    nodes: DataFrame, key: str = "observation_id", weight: str = "node_weight"
) -> DataFrame:
    """Records whose age weights do not sum to one."""
    return (
        nodes.groupBy(key)
        .agg(F.sum(weight).alias("total"))
        .where(F.abs(F.col("total") - 1.0) > 1e-8)
    )


def factor_report(
    steps: DataFrame, positive: Sequence[str], factor: str = "factor_id", age: str = "age"
) -> DataFrame:
    """Factors that are unusable: fewer than two ages, repeated ages, or nonpositive scales."""
    bad = F.lit(False)
    for c in positive:
        bad = bad | F.coalesce(~(F.col(c) > 0) | F.isnan(c), F.lit(True))
    per = steps.groupBy(factor, age).agg(F.count("*").alias("c"), F.count_if(bad).alias("b"))
    return (
        per.groupBy(factor)
        .agg(
            F.count("*").alias("n_ages"),
            F.count_if(F.col("c") > 1).alias("repeated_ages"),
            F.sum("b").alias("bad_scales"),
        )
        .where(
            (F.col("n_ages") < 2) | (F.col("repeated_ages") > 0) | (F.col("bad_scales") > 0)
        )
    )


def decreasing_age_violations(
    steps: DataFrame, factor: str = "factor_id", order: str = "step", age: str = "age"
) -> DataFrame:
    """Steps whose age does not fall below the step before it."""
    w = Window.partitionBy(factor).orderBy(order)
    before = F.lag(age).over(w)
    return steps.withColumn("_before", before).where(F.col(age) >= F.col("_before")).drop("_before")


# --- arguments ---------------------------------------------------------------


def checked_number(name: str, value: float, low: float, high: float = math.inf, *, open_low=False, open_high=False) -> float:
    """``value`` if it is a finite number within its range; the error names it and the range."""
    good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    good = good and (value > low if open_low else value >= low)
    if not (good and (value < high if open_high else value <= high)):
        ends = f"{'(' if open_low else '['}{low:g}, {high:g}{')' if open_high else ']'}"
        raise ValueError(f"{name} = {value!r} is outside {ends}")
    return float(value)


def anchor_count(max_age: float, step: float, oldest: float = 60.0) -> int:
    """Anchors from 0 to ``max_age``, which is a whole number of steps."""
    checked_number("max_age", max_age, 0, oldest, open_low=True)
    checked_number("step", step, 0, open_low=True)
    steps = max_age / step
    if round(steps) < 1 or abs(steps - round(steps)) > 1e-7:
        raise ValueError(f"max_age = {max_age!r} is no whole number of steps of {step!r}")
    return round(steps) + 1


def checked_window(window: Sequence[float], max_age: float) -> tuple[float, float]:
    """(low, high) of an age window that lies inside the domain and has a width."""
    low, high = (checked_number("window", x, 0, max_age) for x in window)
    if low >= high:
        raise ValueError(f"window {low:g} to {high:g} is empty")
    return low, high
