"""Sinks.  None overwrites what it reads: changes go to a new path, which then takes the old one's place."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of local sessions that name no shared folder, by application; removed when the process ends.
LOCAL: dict[str, str] = {}


def work_top(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the cluster's shared folder; the setting is only read.

    Local sessions that name none, as in tests, use a temporary folder."""
    top, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if top:
        return f"{top}/corpusloom-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in LOCAL:
        LOCAL[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, LOCAL[app], True)
    return f"file://{LOCAL[app]}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path among this application's intermediate tables."""
    return f"{work_top(spark)}/{name}-{uuid.uuid4().hex}"


def drop_work(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results not yet written can no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_top(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_capped_files(df: DataFrame, path: str, rows: int = 20_000) -> DataFrame:
    """Parquet files of at most this many rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_request_batches(requests: DataFrame, path: str, number: str = "batch_no", body: str = "body") -> DataFrame:
    """JSON lines, one folder for each batch, whose rows one task writes; reads them back as (batch_no, value)."""
    requests.select(F.col(number).alias("batch_no"), F.col(body).alias("value")).repartition("batch_no").write.mode("overwrite").partitionBy("batch_no").text(path)
    return requests.sparkSession.read.schema("value string, batch_no long").text(path)


def write_lookup_table(df: DataFrame, path: str, key: str) -> DataFrame:
    """A table for point look-ups: ranges of the key, sorted in each file, with Bloom filters of the key."""
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(spark: SparkSession, path: str, to: str, files: int) -> DataFrame:
    """All files of a folder as so many files in another, read by as many tasks as there are splits; the old ones may go
    after this has returned."""
    rows = spark.read.parquet(path)
    rows.repartition(files).write.mode("overwrite").parquet(to)
    return spark.read.schema(rows.schema).parquet(to)


def export_vectors(points: DataFrame, path: str, rows: int = 20_000) -> DataFrame:
    """Vectors with typed defaults, in capped files: '' for a text, 0 for a depth, no components for a vector."""
    typed = points.select(
        "id", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("full_path", F.lit("")).alias("full_path"), F.coalesce("ast_depth", F.lit(0)).cast("long").alias("ast_depth"),
        F.coalesce("ast_data", F.lit("")).alias("ast_data"), F.coalesce("vector", F.array().cast("array<float>")).alias("vector"),
    )
    return write_capped_files(typed, path, rows)
