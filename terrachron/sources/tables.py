"""Observation, point-query, trajectory, draw and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks, records

_D, _S, _I, _L, _B = (
    T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(),
)


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OBS = _schema(
    observation_id=_S, present_lon=_D, present_lat=_D, age_lower_ma=_D, age_upper_ma=_D,
    thickness_km=_D,
)
NODE = _schema(
    observation_id=_S, node_idx=_I, node_age=_D, node_weight=_D, node_lon=_D, node_lat=_D
)
FIELD = _schema(age_idx=_I, i=_I, j=_I, value=_D)
POINT_QUERY = _schema(longitude=_D, latitude=_D, age_ma=_D)
DRAWS = _schema(chain=_I, draw=_I, dim=_I, value=_D)
HISTORY = _schema(
    history_id=_S, group_id=_S, split=_S, age_idx=_I, i=_I, j=_I, value=_D, observed=_B
)

# Column headers of the raw observation table.
RAW_HEADERS = {
    "lat": "纬度",
    "lon": "经度",
    "age_lo": "年龄_起始 (Ma)",
    "age_hi": "年龄_结束 (Ma)",
    "age_rep": "年龄_代表值 (Ma)",
    "epoch": "时间段",
    "thickness": "平均厚度 (km)",
}


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text (headers decide the schema)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation CSV with typed required columns, optional extras and boolean flags."""
    return typed_observations(_csv_text(spark, path))


def _bad_flag(name: str):
    return F.col(name).isNotNull() & F.col(name).try_cast("boolean").isNull()


def flag_rejects(raw: DataFrame) -> DataFrame:
    """(observation_id, flag, text) of flags that are neither true nor false."""
    flags = [c for c in raw.columns if c.startswith("qc_")]
    found = F.array(
        *[F.when(_bad_flag(c), F.struct(F.lit(c).alias("flag"), F.col(c).alias("text"))) for c in flags]
    )
    return raw.select("observation_id", F.explode(F.array_compact(found)).alias("f")).select("observation_id", "f.*")


def typed_observations(raw: DataFrame) -> DataFrame:
    """Text columns -> observation table. A flag that cannot be read stops the job with its record;
    ``flag_rejects`` lists all of them."""
    checks.require_columns(raw, records.REQUIRED)
    columns = []
    for c in raw.columns:
        if c in records.REQUIRED[1:] or c == "age_representative_ma":
            number = F.col(c).try_cast("double")
            columns.append(F.when(~F.isnan(number), number).alias(c))
        elif c.startswith("qc_"):
            told = F.concat_ws(" ", F.lit(f"unreadable {c}:"), F.col(c), F.lit("in record"), "observation_id")
            refusal = F.raise_error(told).cast("boolean")
            columns.append(F.when(_bad_flag(c), refusal).otherwise(F.col(c).try_cast("boolean")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return raw.select(*columns)


def read_raw_observations(spark: SparkSession, path: str, headers=RAW_HEADERS) -> DataFrame:
    """Raw table under its original headers -> standard observation table."""
    raw = _csv_text(spark, path)
    checks.require_columns(raw, [headers[k] for k in headers if k != "epoch"])
    present = {k: v for k, v in headers.items() if v in raw.columns}
    return records.standardise(raw, present)


def read_point_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT_QUERY).option("header", True).csv(path)


def parse_rows(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """CSV lines (``value``) under a declared schema; a line that does not fit has null columns."""
    parsed = F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"mode": "PERMISSIVE"})
    return lines.select(parsed.alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet table under a declared schema; never inferred."""
    return checks.require_columns(
        spark.read.schema(schema).parquet(path), [f.name for f in schema.fields]
    )
