"""Feature collections in XML: plate id, name, valid time and rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One feature member as text: element names carry any prefix, so patterns skip it.
_OPEN = r"(?is)<(?:\w+:)?{tag}\b[^>]*>"
_ANY_PREFIX_CLOSE = r"</(?:\w+:)?{tag}\s*>"


def _inner(text: Column, tag: str, group: int = 1) -> Column:
    pattern = _OPEN.format(tag=tag) + r"(.*?)" + _ANY_PREFIX_CLOSE.format(tag=tag)
    found = F.regexp_extract(text, pattern, group)
    return F.when(F.trim(found) != "", F.trim(found))


def _all_inner(text: Column, tag: str) -> Column:
    pattern = _OPEN.format(tag=tag) + r"(.*?)" + _ANY_PREFIX_CLOSE.format(tag=tag)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _plain(text: Column) -> Column:
    """Text of an element that may wrap its value in child elements."""
    return F.trim(F.regexp_replace(text, r"(?s)<[^>]*>", " "))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features with a plate id and at least one ring.

    Columns ``path, feature, feature_type, plate_id, name, begin, end, rings``; a ring
    is an array of (lon, lat) structs. Files are cut at their feature members while
    they are read, so one large file is many rows and not one. Compressed files must
    end in ``.gz``.
    """
    members = (
        spark.read.option("lineSep", "featureMember>")
        .text(path)
        .select(
            F.col("value").alias("xml"),
            F.col("_metadata.file_path").alias("path"),
            F.monotonically_increasing_id().alias("feature"),
        )
    )
    return parse_features(members)


def feature_rejects(members: DataFrame) -> DataFrame:
    """(path, feature, text) of coordinate lists with text that is no number, or an odd count."""
    lists = F.explode(_all_inner(_without_marks(F.col("xml")), "posList")).alias("text")
    return members.select("path", "feature", lists).where(_malformed(F.col("text")))


def _numbers(text: Column) -> Column:
    return F.transform(
        F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double")
    )


def _malformed(text: Column) -> Column:
    values = _numbers(text)
    return F.exists(values, lambda v: v.isNull()) | (F.size(values) % 2 == 1)


def _without_marks(xml: Column) -> Column:
    """XML without comments, with the text of CDATA sections in place."""
    plain = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(plain, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")


def parse_features(members: DataFrame) -> DataFrame:
    """(path, feature, xml) pieces that end at each feature member's end -> features.

    A malformed coordinate list stops the job; ``feature_rejects`` lists all of them.
    """
    # A piece that ends in "</gml:" closed a member; anything else is outside one.
    body = members.where(F.col("xml").rlike(r"(?s)</(?:\w+:)?$"))
    xml = _without_marks(F.col("xml"))
    plate_text = F.coalesce(_inner(xml, "reconstructionPlateId"), _inner(xml, "plateid"))
    numbers = F.regexp_extract(_plain(plate_text), r"([-+]?\d+(?:\.\d+)?)\s*$", 1)

    def pairs(text: Column) -> Column:
        told = F.concat_ws(" ", F.lit("malformed coordinates in"), "path", F.col("feature").cast("string"))
        values = F.when(_malformed(text), F.raise_error(told).cast("array<double>")).otherwise(_numbers(text))
        return F.transform(
            F.sequence(F.lit(0), F.floor(F.size(values) / 2) - 1),
            lambda k: F.struct(
                F.get(values, (2 * k).cast("int")).alias("lon"),
                F.get(values, (2 * k + 1).cast("int")).alias("lat"),
            ),
        )

    lists = F.filter(
        _all_inner(xml, "posList"), lambda t: F.size(F.split(F.trim(t), r"\s+")) >= 6
    )
    parsed = body.select(
        "path",
        "feature",
        F.regexp_extract(xml, r"^[\s>]*<(?:\w+:)?(\w+)", 1).alias("feature_type"),
        F.when(numbers != "", numbers.cast("double").cast("int")).alias("plate_id"),
        F.coalesce(_plain(_inner(xml, "name")), F.lit("")).alias("name"),
        _plain(_inner(xml, "beginPosition")).alias("begin"),
        _plain(_inner(xml, "endPosition")).alias("end"),
        F.transform(lists, pairs).alias("rings"),
    )
    return parsed.where((F.size("rings") > 0) & F.col("plate_id").isNotNull())


def outlines(features: DataFrame) -> DataFrame:
    """First ring of every feature as a polygon table (priority = file order)."""
    return features.select(
        F.concat_ws("#", "path", F.col("feature").cast("string")).alias("feature_id"),
        F.lit(1).alias("part"),
        F.lit(1).alias("ring"),
        F.lit("exterior").alias("role"),
        "plate_id",
        F.struct("path", "feature").alias("priority"),
        F.posexplode(F.get("rings", F.lit(0))).alias("vertex", "p"),
    ).select("*", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")).drop("p")
