"""Listing and reading through Spark's own file systems, so job data may lie in any store Spark reaches."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def files_in(spark: SparkSession, path: str, recursive: bool = False) -> list[str]:
    """Paths of the files in a folder, sorted; none if there is no such folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    found, it = [], fs.listFiles(p, recursive)
    while it.hasNext():
        found.append(it.next().getPath().toString())
    return sorted(found)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def whole_texts(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Contents of small files by path."""
    if not paths:
        return {}
    rows = spark.read.text(paths, wholetext=True).selectExpr("value", "_metadata.file_path AS path").collect()
    bare = lambda p: re.sub(r"^[a-zA-Z][\w+.-]*:", "", p).lstrip("/")
    names = {bare(p): p for p in paths}
    return {names[bare(unquote(r["path"]))]: r["value"] for r in rows}


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, value): one row per line."""
    return spark.read.text(paths).selectExpr("_metadata.file_path AS file", "value")
