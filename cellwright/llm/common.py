"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of a batch that goes to a Python worker; Spark's default of 10,000 rows may be gigabytes of long texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
SPACES = " \t\n\x0b\x0c\r"


def one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset a temporary one in a session of one machine (tests), an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="cellwright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives executors.

    The shuffle files behind it aren't needed any more then, and Spark is told to delete them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what is sent to Python workers at once, unless the session has a number of rows of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        for key, value in BATCH.items():
            spark.conf.set(key, value)


def lean(run: Callable) -> Callable:
    """A function over a partition's batches that gives unused memory back to the system at its end, as workers live on."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
