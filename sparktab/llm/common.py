"""Helpers shared by the corpus operators: row keys, shared storage, fresh column names."""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import tempfile
import uuid
import weakref

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table; columns, if given, prunes the scan."""
    df = table(spark, sf_dir, "documents")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_dir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparktab-"))
    return _LOCAL[0]


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The files outlive a lost executor and are deleted by release(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparktab-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[out] = path
    return out


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*written: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in written:
        if path := _WRITTEN.pop(df, None):
            _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(OSError, Py4JError):  # the session may have gone first
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    lower() does that alone where no other character of the text has a lower case; the slower translate() serves the rest.
    """
    other = text.rlike("[[^\\x00-\\x7F]&&[\\p{IsUppercase}\\p{Lt}]]")
    return F.when(other, F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that df reads; used to choose numbers of partitions, never to drop rows."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def shards_for(df: DataFrame, per_shard: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many shards of about per_shard estimated bytes df makes."""
    return max(least, min(most, math.ceil(input_bytes(df) / per_shard)))


