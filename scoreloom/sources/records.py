"""Records from files of several formats, and lines with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys under which a JSON object may hold its list of records, in the order in which they are tried.
LISTS = ["items", "records", "data"]


def _json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or an object that holds one under one of ``LISTS``; anything else is an error."""
    sign = spark.read.text(path).select(F.substring(F.ltrim("value"), 1, 1).alias("sign")).where("sign <> ''").first()
    whole = spark.read.json(path, multiLine=True, mode="FAILFAST")
    if sign is None or sign["sign"] == "[":
        return whole
    types = dict(whole.dtypes)
    for name in LISTS:
        if types.get(name, "").startswith("array<struct"):
            return whole.select(F.inline(name))
        if types.get(name, "").startswith("array"):
            return spark.createDataFrame([], "struct<>")
    raise ValueError(f"no list of records in {path}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One file as rows, by its suffix: jsonl, json, csv or tsv. Values of csv and tsv are texts, missing ones empty."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return spark.read.json(path, mode="FAILFAST")
    if suffix == "json":
        return _json(spark, path)
    if suffix in ("csv", "tsv"):
        rows = spark.read.csv(path, header=True, sep="\t" if suffix == "tsv" else ",", multiLine=True, escape='"', encoding="UTF-8")
        return rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).na.fill("")
    raise ValueError(f"unknown kind of file: {path}")


def load_dataset(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files below ``root`` that fit the pattern, columns by name; no rows and no columns where there are no such files."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    out = None
    for path in sorted(f.getPath().toString() for f in found):
        rows = read_records(spark, path)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return spark.createDataFrame([], "struct<>") if out is None else out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files, numbered from 1 in each file, blank ones counted.

    A file is read in blocks by several tasks; a line's number is its place in its block after the lines of earlier blocks."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    offsets = blocks.select("path", "block", (before - F.col("start") + 1).alias("offset"))
    return rows.join(offsets, ["path", "block"]).select("file", (F.col("at") + F.col("offset")).alias("line"), "value")
