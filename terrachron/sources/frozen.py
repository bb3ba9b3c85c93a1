"""Frozen datasets: one Parquet folder per table and a manifest of name-value rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks

SCHEMA_VERSION = "2"


def write_dataset(
    spark: SparkSession, path: str, tables: Mapping[str, DataFrame], protocol: Mapping[str, str]
) -> None:
    """Write every table, then the manifest; a dataset without a manifest is unfinished.

    Fields are stored by age, so a query that needs some anchors reads only those.
    """
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        if "age_idx" in df.columns:
            writer = writer.partitionBy("age_idx")
        writer.parquet(f"{path}/{name}")
    rows = [(k, str(v)) for k, v in {**protocol, "schema_version": SCHEMA_VERSION}.items()]
    manifest = spark.createDataFrame(rows, "name string, value string").withColumn(
        "generated_utc", F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()),
                                       "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    )
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, value string, generated_utc string").json(
        f"{path}/manifest"
    )


def read_dataset(
    spark: SparkSession, path: str, names, protocol: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """Tables of a finished dataset whose protocol equals the requested one."""
    manifest = read_manifest(spark, path)
    asked = {**(protocol or {}), "schema_version": SCHEMA_VERSION}
    checks.must_be_empty(
        checks.protocol_differences(manifest.drop("generated_utc"), asked),
        "frozen protocol differs from the request",
    )
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
