"""Queries of scans, pages and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scans, sinks
from .fixtures import CODE_FILES, CORPUS, RESPONSES, code_files, corpus, responses, table
from .register import query


@query("SELECT doc_id, n_chars FROM documents")
def scan_columns(spark, sf_dir):
    return scans.scan_columns(spark, f"{sf_dir}/documents.parquet", ["doc_id", "n_chars"])


@query("SELECT doc_id, n_chars, true AS bounded FROM documents")
def scan_batches(spark, sf_dir):
    rows = scans.scan_batches(scans.scan_columns(spark, f"{sf_dir}/documents.parquet", ["doc_id", "n_chars"]), 500)
    return rows.select("doc_id", "n_chars", (F.col("batch_rows") <= 500).alias("bounded"))


@query("SELECT count(*) AS rows, 1::BIGINT AS shards FROM lineitem")
def scan_shards(spark, sf_dir):
    _, shards = scans.scan_shards(spark, f"{sf_dir}/lineitem.parquet")
    return shards.agg(F.sum("rows").alias("rows"), F.count("*").alias("shards"))


@query("SELECT part, min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS n FROM (SELECT l_orderkey, ((l_orderkey - min(l_orderkey) OVER ()) * 22 // (max(l_orderkey) OVER () - min(l_orderkey) OVER () + 1))::INTEGER AS part FROM lineitem) GROUP BY part")
def scan_id_range(spark, sf_dir):
    ranged = scans.id_ranges(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", 22)
    return ranged.groupBy("part").agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.count("*").alias("n"))


@query("SELECT row_id, code FROM corpus WHERE row_id > 100 ORDER BY row_id LIMIT 50", CORPUS)
def page_keyset(spark, sf_dir):
    return scans.page_after(corpus(spark, sf_dir).select("row_id", "code"), "row_id", 100, 50)


@query("SELECT row_id, full_path FROM corpus ORDER BY row_id LIMIT 50 OFFSET 120", CORPUS)
def page_offset(spark, sf_dir):
    return scans.page_offset(corpus(spark, sf_dir).select("row_id", "full_path"), "row_id", 120, 50)


@query("SELECT row_id, full_path FROM corpus WHERE class = 'ai' ORDER BY row_id DESC LIMIT 25", CORPUS)
def page_status(spark, sf_dir):
    return scans.page_where(corpus(spark, sf_dir).select("row_id", "full_path", "class"), F.col("class") == "ai", "row_id", 25).drop("class")


@query(
    """SELECT vec_id, CASE WHEN vec_id % 97 > 0 THEN 'v' || vec_id END AS custom_id, CASE WHEN vec_id % 97 > 0 THEN CASE WHEN vec_id % 10 = 0 THEN '500' ELSE '200' END END AS status,
    CASE WHEN vec_id % 97 > 0 THEN vec_id + 0.5::DOUBLE END AS first, vec_id % 97 = 0 OR vec_id % 10 = 0 AS failed FROM responses""",
    RESPONSES,
)
def scan_jsonl_responses(spark, sf_dir):
    return scans.parse_responses(responses(spark, sf_dir)).select("vec_id", "custom_id", F.col("status").cast("string").alias("status"), F.col("embedding")[0].alias("first"), "failed")


@query("SELECT template, sum(length(code) + 1)::BIGINT AS chars FROM code_files GROUP BY template", CODE_FILES)
def scan_source_files(spark, sf_dir):
    """Code written as one text file for each template and task, then found again below the folder."""
    path = sinks.work_path(spark, "sources")
    code_files(spark, sf_dir).select("template", "code").write.partitionBy("template").text(path)
    files = scans.scan_source_files(spark, path, ".txt")
    template = F.regexp_extract("full_path", "template=([0-9]+)", 1).cast("int")
    return files.select(template.alias("template"), F.length("code").alias("n")).groupBy("template").agg(F.sum("n").cast("long").alias("chars"))


@query("SELECT row_id, code, full_path FROM corpus", CORPUS)
def write_parquet(spark, sf_dir):
    return sinks.write_parquet(corpus(spark, sf_dir).select("row_id", "code", "full_path"), sinks.work_path(spark, "parquet"))


@query("SELECT row_id, full_path, class FROM corpus", CORPUS)
def write_json(spark, sf_dir):
    return sinks.write_json(corpus(spark, sf_dir).select("row_id", "full_path", "class"), sinks.work_path(spark, "json"))


@query("SELECT vec_id, label FROM embeddings")
def write_capped_files(spark, sf_dir):
    return sinks.write_capped_files(table(spark, sf_dir, "embeddings").select("vec_id", "label"), sinks.work_path(spark, "capped"), 200)


@query("""SELECT row_id // 300 AS batch_no, '{"custom_id":"r' || row_id || '","method":"POST","url":"/v1/embeddings","body":{"model":"m","messages":[{"role":"user","content":"' || full_path || '"}]}}' AS value FROM corpus""", CORPUS)
def write_request_batches(spark, sf_dir):
    body = T.request_json(F.concat(F.lit("r"), F.col("row_id").cast("string")), "/v1/embeddings", "m", F.col("full_path"))
    rows = corpus(spark, sf_dir).select(F.floor(F.col("row_id") / 300).alias("batch_no"), body.alias("body"))
    return sinks.write_request_batches(rows, sinks.work_path(spark, "requests"))


@query("SELECT row_id, full_path FROM corpus", CORPUS)
def write_lookup_table(spark, sf_dir):
    return sinks.write_lookup_table(corpus(spark, sf_dir).select("row_id", "full_path"), sinks.work_path(spark, "lookup"), "full_path")


@query("SELECT row_id, class FROM corpus", CORPUS)
def stage_results(spark, sf_dir):
    """Results appended class by class to one staging folder."""
    path, rows = sinks.work_path(spark, "stage"), corpus(spark, sf_dir).select("row_id", "class")
    for name in ("ai", "human"):
        rows.where(F.col("class") == name).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT row_id, class FROM corpus", CORPUS)
def compact_checkpoints(spark, sf_dir):
    path = sinks.work_path(spark, "many")
    corpus(spark, sf_dir).select("row_id", "class").repartition(20, "row_id").write.parquet(path)
    return sinks.compact(spark, path, sinks.work_path(spark, "one"), 2)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'c' || vec_id END AS code, CASE WHEN vec_id % 2 = 0 THEN '' ELSE 'p' END AS full_path, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE label END::BIGINT AS ast_depth, '' AS ast_data, len(embedding)::INTEGER AS dims FROM embeddings")
def export_vectors(spark, sf_dir):
    point = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("c"), F.col("vec_id").cast("string"))).alias("code"), F.when(F.col("vec_id") % 2 > 0, "p").alias("full_path"),
        F.when(F.col("vec_id") % 5 > 0, F.col("label")).alias("ast_depth"), F.lit(None).cast("string").alias("ast_data"), F.col("embedding").alias("vector"),
    )
    return sinks.export_vectors(point, sinks.work_path(spark, "vectors")).select("id", "code", "full_path", "ast_depth", "ast_data", F.size("vector").alias("dims"))
