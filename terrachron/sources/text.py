"""Plain-text sources: modern grid, rotation files, polygon snapshots, grid export.

Every reader is a distributed text scan with column expressions. Lines that do not
parse are either skipped by contract (rotations) or returned as rejects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import grids
from ..operators import splits


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _number(fields: Column, k: int) -> Column:
    return F.get(fields, F.lit(k)).try_cast("double")


# --- modern grid -------------------------------------------------------------


def read_modern_grid(spark: SparkSession, path: str) -> DataFrame:
    """The modern grid of a text file."""
    return parse_modern_grid(spark.read.text(path))


def parse_modern_grid(lines: DataFrame) -> DataFrame:
    """``lon lat -thickness`` lines (``value``) -> (i, j, lon, lat, encoded, value, area_km2).

    Row and column numbers come from the coordinates, not from line order.
    """
    f = _fields(F.col("value"))
    rows = lines.where(F.trim("value") != "").select(
        _number(f, 0).alias("lon"), _number(f, 1).alias("lat"), _number(f, 2).alias("encoded")
    )
    return rows.select(
        F.rint(F.col("lat") + 89.5).cast("int").alias("i"),
        F.rint(F.col("lon") - 0.5).cast("int").alias("j"),
        "lon",
        "lat",
        "encoded",
        (-F.col("encoded")).alias("value"),
    ).withColumn("area_km2", grids.native_cell_area("i"))


def modern_grid_report(grid: DataFrame) -> DataFrame:
    """One row: cell count, repeated cells, off-centre coordinates, wrong signs."""
    off = (F.abs(F.col("lat") - grids.native_latitude("i")) > 1e-5) | (
        F.abs(F.col("lon") - grids.native_longitude("j")) > 1e-5
    )
    outside = ~(F.col("i").between(0, 179) & F.col("j").between(0, 359))
    cells = grid.groupBy("i", "j").agg(
        F.count("*").alias("c"),
        F.count_if(F.coalesce(off | outside, F.lit(True))).alias("off"),
        F.count_if(F.coalesce(F.col("encoded") >= 0, F.lit(True))).alias("sign"),
    )
    return cells.agg(
        F.count("*").alias("n_cells"),
        F.count_if(F.col("c") > 1).alias("repeated_cells"),
        F.sum("off").alias("off_centre"),
        F.sum("sign").alias("wrong_sign"),
    ).withColumn(
        "passed",
        (F.col("n_cells") == grids.NATIVE_NLAT * grids.NATIVE_NLON)
        & (F.col("repeated_cells") + F.col("off_centre") + F.col("wrong_sign") == 0),
    )


def modern_endpoint(grid: DataFrame, sigma_km: float = 3.0) -> DataFrame:
    """Endpoint cells with a constant sigma and their spatial block."""
    return grid.withColumns(
        {"sigma": F.lit(float(sigma_km)), "block": splits.spatial_block("lon", "lat")}
    )


# --- rotations ---------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of text files; ``n`` keeps the order of a file's lines."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("line"),
    )


def read_rotations(spark: SparkSession, path: str) -> DataFrame:
    """The rotations of text files."""
    return parse_rotations(numbered_lines(spark, path))


def parse_rotations(lines: DataFrame) -> DataFrame:
    """(path, n, line) rotation lines -> (plate_id, age, lat, lon, angle, conjugate_id).

    Comment lines and lines that do not parse are skipped; the first line of a
    (plate, age) wins; a missing or unreadable parent is plate 0.
    """
    numbered = lines.select(F.trim("line").alias("line"), F.col("path").alias("file"), "n")
    f = _fields(F.col("line"))
    parent = F.get(f, F.lit(5)).try_cast("int")
    rows = numbered.where(
        (F.col("line") != "") & ~F.col("line").startswith("!") & ~F.col("line").startswith("#")
    ).select(
        F.get(f, F.lit(0)).try_cast("int").alias("plate_id"),
        _number(f, 1).alias("age"),
        _number(f, 2).alias("lat"),
        _number(f, 3).alias("lon"),
        _number(f, 4).alias("angle"),
        F.coalesce(parent, F.lit(0)).alias("conjugate_id"),
        "file",
        "n",
    )
    parsed = rows.dropna(subset=["plate_id", "age", "lat", "lon", "angle"])
    first = F.min_by(F.struct("lat", "lon", "angle", "conjugate_id"), F.struct("file", "n"))
    return parsed.groupBy("plate_id", "age").agg(first.alias("r")).select("plate_id", "age", "r.*")


# --- polygon snapshots -------------------------------------------------------


def list_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(path, age) of the snapshot files of a folder; age null if the name has none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gmt").load(folder)
    return snapshot_ages(files)


def snapshot_ages(files: DataFrame) -> DataFrame:
    """(path, age) of paths; age null if the name has none."""
    name = F.element_at(F.split("path", "/"), -1)
    # Fixed pattern: the age stands right before "Ma.gmt" and is not part of a longer number.
    text = F.regexp_extract(name, r"(?<![\d.\-])(\d+(?:\.\d+)?)Ma\.gmt$", 1)
    return files.select("path", F.when(text != "", text.cast("double")).alias("age"))


def snapshot_report(snapshots: DataFrame, ages: Sequence[float]) -> DataFrame:
    """One row per requested age with the number of files at exactly that age."""
    if any(not 0 <= a <= 60 for a in ages):
        raise ValueError("snapshot ages must lie in 0-60 Ma")
    wanted = snapshots.sparkSession.createDataFrame([(float(a),) for a in ages], "want double")
    hit = F.abs(F.col("age") - F.col("want")) <= 1e-6
    # Equal ages meet on a rounded key; the tolerance is checked exactly.
    keyed = snapshots.withColumn("_k", F.explode(_age_keys("age")))
    return (
        wanted.withColumn("_k", F.rint(F.col("want") * 1e5).cast("long"))
        .join(keyed, "_k", "left")
        .groupBy("want")
        .agg(
            F.count_if(F.coalesce(hit, F.lit(False))).alias("n_files"),
            F.min(F.when(hit, F.col("path"))).alias("path"),
        )
        .select(F.col("want").alias("age"), "n_files", "path")
    )


def _age_keys(age: str) -> Column:
    k = F.rint(F.col(age) * 1e5).cast("long")
    return F.array(k - 1, k, k + 1)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of polygon snapshot files."""
    return parse_snapshots(numbered_lines(spark, path))


# A bar outside quotes: an even number of quotes follows.
_BAR = r'\|(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _attributes(text: str) -> Column:
    """Fields between bars; a quoted field may hold bars, and doubled quotes stand for one."""
    def plain(a: Column) -> Column:
        inner = F.regexp_extract(a, r'(?s)^"(.*)"$', 1)
        return F.when(a.rlike(r'(?s)^".*"$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(a)

    return F.transform(F.split(text, _BAR), plain)


def parse_snapshots(lines: DataFrame) -> DataFrame:
    """(path, n, line) of polygon snapshots -> one row per vertex.

    Columns: ``path, age, feature, meta, ring, role, vertex, lon, lat, problem``.
    Lines keep their order through a running number, so a file may be split among
    tasks when read line by line; feature and ring numbers are running counts per
    file. A line that breaks the format yields a row with ``problem`` set, and its
    whole file belongs to the rejects.
    """
    lines = lines.select(F.trim(F.regexp_replace("line", "^\ufeff", "")).alias("line"), "path", "n")
    line = F.col("line")
    is_feature = line.startswith("# @D")
    is_break = line.startswith(">")
    is_role = line.isin("# @P", "# @H")
    is_names = line.startswith("# @N")
    is_point = (line != "") & ~line.startswith("#") & ~is_break
    w = Window.partitionBy("path").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumns(
        {
            "feature": F.sum(is_feature.cast("int")).over(so_far),
            # Fields are named once per file, before the features.
            "names": F.last(F.when(is_names, F.substring(line, 5, 1 << 20)), True).over(so_far),
            "attributes": F.last(F.when(is_feature, F.substring(line, 5, 1 << 20)), True).over(
                so_far
            ),
            "is_point": is_point,
        }
    )
    v = Window.partitionBy("path", "feature").orderBy("n")
    v_so_far = v.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A break always opens a ring; a role mark opens one only if the current ring has
    # points. Both reduce to: a ring starts at the first point after any mark.
    marked = numbered.withColumns(
        {
            "_mark": F.coalesce(F.sum((is_break | is_role).cast("int")).over(v_so_far), F.lit(0)),
            "_role": F.when(line == "# @P", "exterior").when(line == "# @H", "hole"),
        }
    )
    previous_mark = F.lag("_mark").over(v)
    points = marked.where("is_point").withColumn("_prev", previous_mark)
    starts = F.coalesce(F.col("_mark") != F.col("_prev"), F.lit(True))
    rings = points.withColumn("ring", F.sum(starts.cast("int")).over(v_so_far))
    # The role mark seen since the previous point names the ring (none: unspecified).
    roles = marked.where(F.col("_role").isNotNull()).groupBy("path", "feature", "_mark").agg(
        F.first("_role").alias("_role_here")
    )
    f = _fields(line)
    lon, lat = _number(f, 0), _number(f, 1)
    clean = _attributes("attributes")
    name_list = F.split("names", r"\|")
    counts_match = F.size(clean) == F.size(name_list)
    duplicate_names = F.size(F.array_distinct(name_list)) != F.size(name_list)
    problem = (
        F.when(F.col("feature") == 0, "coordinates before a feature")
        .when(F.col("names").isNull() | ~counts_match, "attribute count differs from the names")
        .when(duplicate_names, "repeated attribute names")
        .when(lon.isNull() | lat.isNull(), "expected longitude and latitude")
        .when(F.isnan(lon) | F.isnan(lat) | (F.abs(lat) > 90), "coordinate out of range")
    )
    meta = F.when(counts_match & ~duplicate_names, F.map_from_arrays(name_list, clean))
    file_name = F.element_at(F.split("path", "/"), -1)
    age_text = F.regexp_extract(file_name, r"(?<![\d.\-])(\d+(?:\.\d+)?)Ma\.gmt$", 1)
    return (
        rings.drop("_role")
        .join(roles, ["path", "feature", "_mark"], "left")
        .select(
            "path",
            F.when(age_text != "", age_text.cast("double")).alias("age"),
            "feature",
            meta.alias("meta"),
            F.col("ring").cast("int").alias("ring"),
            F.coalesce("_role_here", F.lit("unspecified")).alias("role"),
            F.col("n").alias("vertex"),
            lon.alias("lon"),
            lat.alias("lat"),
            problem.alias("problem"),
        )
    )


def snapshot_polygons(vertices: DataFrame) -> DataFrame:
    """Snapshot vertices -> polygon table with cleaned rings and part numbers.

    A part is an exterior with the holes that follow it; the only ring of a feature
    may have no role and is then its exterior. Columns ``feature_id, part, ring,
    role, vertex, lon, lat, plate_id, age, path, meta``; a feature without an id of
    its own is named by file and position.
    """
    from ..operators import polygons

    # A file with any problem is left out whole; a ring without its bad line is another ring.
    bad = vertices.where(F.col("problem").isNotNull()).select("path").distinct()
    ok = vertices.join(bad, "path", "left_anti")
    named = ok.withColumn(
        "feature_id",
        F.coalesce(
            F.nullif(F.try_element_at("meta", F.lit("FEATURE_ID")), F.lit("")),
            F.concat_ws("#", "path", F.col("feature").cast("string")),
        ),
    )
    ring_key = ["path", "feature", "ring"]
    tidy = polygons.clean_rings(named.drop("problem"), ring_key)
    ring_rows = tidy.groupBy("path", "feature", "ring").agg(F.min("role").alias("role"))
    w = Window.partitionBy("path", "feature").orderBy("ring")
    alone = F.count("*").over(Window.partitionBy("path", "feature")) == 1
    role = F.when((F.col("role") == "unspecified") & alone, "exterior").otherwise(F.col("role"))
    parts = (
        ring_rows.withColumn("_role", role)
        .withColumn(
            "part",
            F.sum((F.col("_role") == "exterior").cast("int")).over(
                w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .select(*ring_key, F.col("_role").alias("part_role"), F.col("part").cast("int"))
    )
    return tidy.join(parts, ring_key).select(
        "feature_id",
        "part",
        "ring",
        F.col("part_role").alias("role"),
        "vertex",
        "lon",
        "lat",
        F.try_element_at("meta", F.lit("PLATEID1")).try_cast("int").alias("plate_id"),
        "age",
        "path",
        "meta",
    )


def snapshot_rejects(vertices: DataFrame, polygons_table: DataFrame | None = None) -> DataFrame:
    """(path, problem, rows) for unreadable lines, short rings and rings without a part."""
    bad = (
        vertices.where(F.col("problem").isNotNull())
        .groupBy("path", "problem")
        .agg(F.count("*").alias("rows"))
    )
    if polygons_table is None:
        return bad
    short = (
        polygons_table.groupBy("path", "feature_id", "part", "ring")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") < 3)
        .groupBy("path")
        .agg(F.count("*").alias("rows"))
        .select("path", F.lit("ring has fewer than three vertices").alias("problem"), "rows")
    )
    loose = (
        polygons_table.where((F.col("part") == 0) | (F.col("role") == "unspecified"))
        .groupBy("path")
        .agg(F.count("*").alias("rows"))
        .select("path", F.lit("ring without an exterior").alias("problem"), "rows")
    )
    return bad.unionByName(short).unionByName(loose)


# --- export ------------------------------------------------------------------


def grid_lines(predictions: DataFrame) -> DataFrame:
    """(age, text line) rows ``lon lat thickness`` with six decimals, south to north.

    ``predictions`` has ``age, lon, lat, value``.
    """
    text = F.format_string("%.6f %.6f %.6f", "lon", "lat", "value")
    return predictions.select("age", "lat", "lon", text.alias("value"))


def write_grid_text(predictions: DataFrame, path: str) -> None:
    """One folder per age of sorted text lines; a global grid per age is one file.

    The rows of an age are a fixed grid, so one partition per age is bounded.
    """
    lines = grid_lines(predictions)
    (
        lines.repartition("age")
        .sortWithinPartitions("age", "lat", "lon")
        .select("age", "value")
        .write.mode("errorifexists")
        .partitionBy("age")
        .text(path)
    )
