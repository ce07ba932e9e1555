"""Scans of parquet tables, shards, id ranges, pages, JSON lines and source files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of a batch answer's lines.
RESPONSE = "custom_id string, response struct<status_code: int, body: struct<data: array<struct<embedding: array<double>>>>>, error string"


def scan_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only these columns are read."""
    return spark.read.parquet(path).select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cluster's cores if its splits are fewer: for costly work on each row of a small table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_batches(df: DataFrame, rows: int) -> DataFrame:
    """df with ``batch_rows``, the size of the batch that a row was handled in: at most ``rows``."""

    def sized(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                yield batch.append_column("batch_rows", pa.array([batch.num_rows] * batch.num_rows, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(sized, f"{fields}, batch_rows long")


def scan_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all readable shards of a folder, whatever their columns, and file and rows of each shard that gave any."""
    rows = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(path)
    return rows, rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))


def id_ranges(df: DataFrame, column: str, parts: int) -> DataFrame:
    """df with ``part``, one of equal half-open ranges between the smallest and the largest id."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    part = F.floor((F.col(column) - F.col("_low")) * parts / (F.col("_high") - F.col("_low") + 1)).cast("int")
    return df.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("_low", "_high")  # one row of ends


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page by key."""
    return df.where(F.col(key) > last).orderBy(key).limit(size)


def page_offset(df: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(size)


def page_where(df: DataFrame, condition: Column, key: str, size: int) -> DataFrame:
    """The newest rows that fulfil a condition."""
    return df.where(condition).orderBy(F.desc(key)).limit(size)


def parse_responses(lines: DataFrame, value: str = "value") -> DataFrame:
    """custom_id, status, embedding and failed of each line; broken lines and a status other than 200 failed."""
    row = F.from_json(value, RESPONSE, {"mode": "PERMISSIVE"})
    parsed = lines.withColumn("_row", row)
    vector = F.try_element_at("_row.response.body.data", F.lit(1))["embedding"]
    failed = ~F.coalesce((F.col("_row.response.status_code") == 200) & vector.isNotNull(), F.lit(False))
    return parsed.select(
        *[c for c in lines.columns if c != value], F.col("_row.custom_id").alias("custom_id"), F.col("_row.response.status_code").alias("status"), vector.alias("embedding"), failed.alias("failed")
    )


def scan_source_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """full_path and code of every file below a folder whose name ends with suffix."""
    named = "*" + re.sub(r"([*?\[\]{}\\])", r"\\\1", suffix)  # others are listed, not read
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=named)
    return files.select(F.input_file_name().alias("full_path"), F.col("value").alias("code"))
