"""Shared helpers of the text operators: tables between steps, tie-safe columns."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; the same six bytes in SQL, Java and Python patterns.
BLANKS = r"[\x20\x09-\x0D]+"


def table_folder(spark: SparkSession) -> str:
    """Folder for tables between steps: ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="terrachron-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage is cut, columns stay prunable.

    The files survive the loss of any executor and stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{table_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """The frame, after its session's executors were sent this library for their Python workers.

    Spark distributes the file itself; once per application.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        library = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(library)
        path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, files in os.walk(library):
                for f in sorted(x for x in files if x.endswith(".py")):
                    full = os.path.join(folder, f)
                    archive.write(full, os.path.join(name, os.path.relpath(full, library)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df


def tidy(run):
    """The generator ``run`` for a Python worker, which at its end hands freed memory back.

    Workers are kept for later steps; without this they also keep what the largest one needed.
    """

    @functools.wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return held


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of the input has it (names differ in case too)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
