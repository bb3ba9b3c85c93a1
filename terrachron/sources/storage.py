"""Where a job may put intermediate tables, and how files are fingerprinted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a temporary one.

    Only a ``local`` master may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="terrachron-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame that several later jobs read (reliable checkpoint)."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later plans read it and know its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unweighed_batches(df: DataFrame) -> DataFrame:
    """The frame, for Python tasks on many narrow rows; its session cuts batches for Python by rows alone from now on.

    By default Spark also limits their bytes and weighs the batch again after every row, which takes several
    times as long as writing the row. The limit of rows stays.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))
    return df


#: Bytes that one task hashes. A longer file is hashed piece after piece, in as many jobs.
PIECE_BYTES = 512 << 20


def _hash_pieces(budget: int):
    """Takes files on from the hash state that their last piece left; a task reads ``budget`` bytes at most.

    A nested function without globals, so that executors need no copy of this library.
    """

    def run(batches):
        import _hashlib
        import ctypes

        import pyarrow as pa
        from pyarrow import fs

        # hashlib can't store a state; the library that it is built on can.
        crypto = ctypes.CDLL(_hashlib.__file__)
        crypto.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        state_bytes, digest_bytes, block = 112, 32, 4 << 20

        def advanced(row, left):
            """The row after its next ``left`` bytes; a finished file's state is its digest."""
            context = ctypes.create_string_buffer(row["state"] or b"", state_bytes)
            if row["state"] is None:
                crypto.SHA256_Init(context)
            scheme, _, rest = row["path"].partition(":")
            place = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(row["path"])
            end = min(row["bytes"], row["done"] + left)
            with place[0].open_input_file(place[1]) as source:
                source.seek(row["done"])
                while row["done"] < end:
                    piece = source.read(min(block, end - row["done"]))
                    if not piece:
                        raise OSError(f"file became shorter: {row['path']}")
                    crypto.SHA256_Update(context, piece, len(piece))
                    row["done"] += len(piece)
            row["state"] = context.raw
            if row["done"] == row["bytes"]:
                digest = ctypes.create_string_buffer(digest_bytes)
                crypto.SHA256_Final(digest, context)
                row["state"] = digest.raw
            return row

        left = budget
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                before = row["done"]
                if left and before < row["bytes"]:
                    advanced(row, left)
                    left -= row["done"] - before
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def _long_file_hashes(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files (path, bytes) that are too long for one task.

    The digest is that of the whole file, so its pieces follow each other; different files go on side by side.
    """
    tasks = files.sparkSession.sparkContext.defaultParallelism
    states = files.select(
        "path", "bytes", F.lit(0).cast("long").alias("done"), F.lit(None).cast("binary").alias("state")
    )
    while not states.where("done < bytes").isEmpty():
        spread = states.repartition(tasks, "path")
        states = stored(spread.mapInArrow(_hash_pieces(PIECE_BYTES), states.schema))
    return states.select("path", "bytes", F.lower(F.hex("state")).alias("sha256"))


def file_hashes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, file_name, bytes, sha256) of every file under ``path`` but empty ones, which Spark's readers pass over."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    hashes = files.where(F.col("length") <= PIECE_BYTES).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    long = files.where(F.col("length") > PIECE_BYTES).select("path", F.col("length").alias("bytes"))
    if not long.isEmpty():
        hashes = hashes.unionByName(_long_file_hashes(long))
    return hashes.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "bytes", "sha256")


# Files that belong to a shapefile of the same stem.
SIDECARS = (".dbf", ".shx", ".prj", ".shp.gplates.xml")


def geometry_hashes(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """(source, file_name, bytes, sha256) for several geometry files or folders.

    A shapefile is hashed with its sidecars; a folder with its polygon files.
    """
    out = None
    for name, path in sources.items():
        if path.lower().endswith(".shp"):
            stem = path[: -len(".shp")]
            pattern = "{" + ",".join(
                [path.rsplit("/", 1)[-1]] + [stem.rsplit("/", 1)[-1] + s for s in SIDECARS]
            ) + "}"
            rows = file_hashes(spark, path.rsplit("/", 1)[0], pattern)
        elif "." in path.rsplit("/", 1)[-1]:
            rows = file_hashes(spark, path)
        else:
            rows = file_hashes(spark, path, "*.{gpml,gpmlz,gmt}")
        part = rows.select(F.lit(name).alias("source"), "file_name", "bytes", "sha256")
        out = part if out is None else out.unionByName(part)
    return out
