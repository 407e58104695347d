"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsense.session import ensure_checkpoint_dir

# Arrow batches handed to Python hold at most this many rows and bytes, so a
# run of very long texts cannot fill a worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library: its zip goes to them through
    Spark's own file distribution, once per application. Nothing to do where the
    workers have it on their path already."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_fieldsense_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="fieldsense-py-")             # the driver's; Spark sends the zip on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/fieldsense", "zip", root_dir=root, base_dir="fieldsense"))
    sc._fieldsense_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes, and make
    the library importable on the workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that a task no longer uses to the system; the worker stays
    for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):         # other C libraries keep it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its
    lineage is cut and a lost executor costs no recomputation of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (NULL: empty): other columns of the input
    cannot clash with those an operator adds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def packed(docs: DataFrame, *needed: Column) -> DataFrame:
    """The whole row as the struct ``_row`` beside the ``needed`` columns, so
    that names added on the way cannot clash with columns of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *needed)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def keep_rows(docs: DataFrame, decisions: DataFrame, key_of: Callable[[DataFrame], DataFrame],
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, with all their columns.

    ``decisions`` has one row per (doc_id, key): ``doc_id, key, kept, n``
    where ``n`` counts the rows of ``docs`` with that id and key. Usually an
    id stands on one row; then only the ids to drop are joined (Spark
    broadcasts them when they are small). An id on several rows is decided by
    the key, which ``key_of(rows)`` adds as column ``_key`` to rows with a
    ``text``; of rows with equal
    id and key the smallest by all columns stays.
    """
    per_id = (decisions.groupBy("doc_id")
              .agg(F.bool_or("kept").alias("_any"), F.sum("n").alias("_rows"))
              .where(~F.col("_any") | (F.col("_rows") > 1))
              .select(F.col("doc_id").alias("_id"), "_any"))
    marked = packed(docs, F.col(id_col).alias("doc_id")).join(per_id, same(F.col("doc_id"), F.col("_id")), "left")
    plain = marked.where(F.col("_any").isNull()).select("_row.*")
    several = marked.where(F.col("_any")).select("_row", "doc_id", F.col(f"_row.{text_col}").alias("text"))
    kept = decisions.where("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_kept_key"))
    picked = (key_of(several).select("_row", "doc_id", "_key")
              .join(kept, same(F.col("doc_id"), F.col("_id")) & same(F.col("_key"), F.col("_kept_key")), "left_semi")
              .groupBy("doc_id", "_key").agg(F.min("_row").alias("_row"))
              .select("_row.*"))
    return plain.unionByName(picked)
