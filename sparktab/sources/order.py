"""The order in which a source holds its rows: files by path, rows as they stand in each.

Parquet tells a row's index in its file, so a row's position is that index and the rows of the files before it; only files
are counted, no window runs over rows. Text files tell the place of a split in its file; rows of a split are read in order,
so (file, split, running number) orders them, though it doesn't number them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.profile import q


def source_order(df: DataFrame) -> list[Column]:
    """Expressions that order rows as their source does, for a table as it was scanned (projections and filters may follow).

    Tables that aren't scanned from files are ordered by partition, then within it.
    """
    try:
        kind = dict(df.select("_metadata").dtypes)["_metadata"]
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    file = F.col("_metadata.file_path")
    if "row_index" in kind:
        return [file, F.col("_metadata.row_index")]
    return [file, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def positioned(df: DataFrame, out: str = "position") -> DataFrame:
    """df with each row's position, from 0, in the source; df must be a scan of Parquet without a filter."""
    rows = df.select(*map(q, df.columns), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # the index alone is read, and one row a file comes out
    files = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(files, "_file").withColumn(out, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of the source."""
    order = source_order(df)
    if len(order) == 2:
        return positioned(df, "_position").where(F.col("_position") < n).drop("_position")
    if len(order) == 1:
        return df.limit(n)
    kept = df.select(*map(q, df.columns), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    return kept.orderBy(*[f"_o{i}" for i in range(len(order))]).limit(n).select(*map(q, df.columns))
