"""Scans of one table, with the guards that come before any work."""

from __future__ import annotations

import csv
import hashlib
import os
import re
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NA_TOKENS, nan_to_null

EDA_SUFFIXES = {".parquet", ".pq", ".csv", ".tsv", ".txt", ".gz", ".bz2"}
PREFLIGHT_SUFFIXES = {".parquet", ".pq", ".csv", ".tsv", ".txt"}
_SNIFF_BYTES, _HASH_BYTES = 1 << 16, 1 << 20


class InputError(ValueError):
    """The request can't be served; nothing was written."""


def suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def delimiter(path: str, given: str | None = None, sample: str | None = None) -> str:
    """The given one (a written \\t is a tab), a tab for .tsv, or what the first bytes look like."""
    if given:
        return "\t" if given == "\\t" else given
    if suffix(path) == ".tsv":
        return "\t"
    try:
        return csv.Sniffer().sniff(sample or "", delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def _sample(spark: SparkSession, path: str) -> str:
    """The first lines as Spark reads them, so that every store and codec works."""
    return "\n".join(r[0] or "" for r in spark.read.text(path).limit(50).collect())[:_SNIFF_BYTES]


def typed(df: DataFrame) -> DataFrame:
    """Text columns become whole numbers, numbers, booleans or stay text, by what all their values allow; NA tokens go.

    One aggregate over all columns decides; no second inference scan per column.
    """
    clean = df.select([F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    tests, names = [], list(df.columns)
    for i, c in enumerate(names):
        v = F.trim(F.col(f"`{c}`"))
        tests += [F.count(v).alias(f"n{i}"), F.count(v.try_cast("long")).alias(f"l{i}"), F.count(v.try_cast("double")).alias(f"d{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}")]
    got = clean.agg(*tests).first().asDict() if names else {}
    out = []
    for i, c in enumerate(names):
        v, n = F.trim(F.col(f"`{c}`")), got[f"n{i}"]
        kind = "string" if not n else "boolean" if got[f"b{i}"] == n else "long" if got[f"l{i}"] == n else "double" if got[f"d{i}"] == n else "string"
        out.append((F.col(f"`{c}`") if kind == "string" else v.try_cast(kind)).alias(c))
    return nan_to_null(clean.select(out))


def scan(spark: SparkSession, path: str, sep: str | None = None, max_rows: int | None = None, suffixes: set[str] = EDA_SUFFIXES) -> DataFrame:
    """A Parquet or delimited table by its last suffix; a row cap if one is asked for."""
    kind = suffix(path.rstrip("/"))
    if kind not in suffixes:
        raise InputError(f"unsupported input suffix {kind or '(none)'}")
    if max_rows is not None and max_rows <= 0:
        raise InputError("the row cap must be positive")
    if kind in (".parquet", ".pq"):
        df = nan_to_null(spark.read.parquet(path))
    else:
        df = spark.read.csv(path, header=True, sep=delimiter(path, sep, None if sep or kind == ".tsv" else _sample(spark, path)), multiLine=False)
    if max_rows is not None:
        from .order import head  # operators read sources

        df = head(df, max_rows)
    return df if kind in (".parquet", ".pq") else typed(df)


def guard(df: DataFrame, named: list[str | None] = (), allow_empty: bool = False) -> None:
    """Errors for no columns, clashing names, unknown columns and no rows."""
    if not df.columns:
        raise InputError("the input has no columns")
    if len(set(df.columns)) != len(df.columns):
        raise InputError("column names are not unique")
    if missing := [c for c in named if c is not None and c not in df.columns]:
        raise InputError(f"unknown columns: {', '.join(missing)}")
    if not allow_empty and df.isEmpty():
        raise InputError("the input has no rows")


def guard_paths(source: str, output: str | None = None, caps: dict[str, int] | None = None, allow_remote: bool = False) -> None:
    """Errors for remote sources (unless allowed), missing files, outputs that aren't HTML or are the source, and caps below 1."""
    scheme = urlparse(source).scheme
    if scheme not in ("", "file") and not allow_remote:
        raise InputError(f"only local files are read, not {scheme}://")
    local = urlparse(source).path if scheme == "file" else source
    if scheme in ("", "file") and not os.path.exists(local):
        raise InputError(f"no such file: {source}")
    if output is not None:
        if suffix(output) not in (".html", ".htm"):
            raise InputError("the output must be an HTML file")
        if os.path.realpath(output) == os.path.realpath(local):
            raise InputError("the output would replace the input")
    if bad := [k for k, v in (caps or {}).items() if v <= 0]:
        raise InputError(f"must be positive: {', '.join(bad)}")


def fingerprint(path: str) -> str:
    """sha256 of a local file's bytes, or of a folder's sorted (path, sha256) lines."""
    if os.path.isdir(path):
        inner = sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)
        return hashlib.sha256("\n".join(f"{p} {fingerprint(os.path.join(path, p))}" for p in inner).encode()).hexdigest()
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_HASH_BYTES):
            digest.update(block)
    return digest.hexdigest()


def memory_estimate(df: DataFrame, file_bytes: int, available: int) -> dict:
    """Catalyst's size of the plan, four times the larger of it and the file, and whether that passes 70 % of what there is."""
    frame = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    projected = 4 * max(frame, file_bytes)
    return {"frame_bytes": frame, "projected_bytes": projected, "available_bytes": available, "pressure": projected > 0.7 * available}


def write_atomic(path: str, text: str) -> None:
    """Write beside the place and move into it; nothing is left where that fails."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of objects, or the envelope {columns, rows}, as a table; only the envelope may be without rows."""
    df = spark.read.json(path, multiLine=True)
    if {"columns", "rows"} <= set(df.columns):
        head = df.select("columns").first()[0]
        rows = df.select(F.explode("rows").alias("r"))
        kind = rows.schema["r"].dataType.simpleString()
        pick = (lambda i, c: F.col("r")[c]) if kind.startswith("struct") else (lambda i, c: F.col("r")[i])
        return rows.select([pick(i, c).alias(c) for i, c in enumerate(head)])
    return df


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet, ORC, JSON lines or CSV with a header."""
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif re.fullmatch("parquet|orc|json", kind):
        writer.format(kind).save(path)
    else:
        raise InputError(f"unknown format {kind}")
