"""Tables in the shapes that the operators expect, derived from the given ones by expressions that Spark and SQL share.

Each builder returns a DataFrame; the string of the same name in upper case is its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scans import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code corpus: row_id, code, full_path, and a class of ai or human."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("code"), F.concat("source", F.lit("/"), "doc_id", F.lit(".py")).alias("full_path"),
        F.when(F.col("doc_id") % 3 == 0, "ai").otherwise("human").alias("class"), "source", "lang",
    )


CORPUS = """corpus AS (SELECT doc_id AS row_id, text AS code, source || '/' || doc_id || '.py' AS full_path,
  CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'human' END AS class, source, lang FROM documents)"""

#: Python files by number, with {k} for a key.
TEMPLATES = (
    "def f{k}(x):\n    return x + {k}\n",
    "def f{k}(n):\n    total = 0\n    for i in range(n):\n        if i > {k}:\n            total += i\n        else:\n            total -= {k}\n    return total\n",
    "class C{k}:\n    def __init__(self):\n        self.v = {k}\n    def run(self, n):\n        for i in range(n):\n            if i > {k}:\n                self.v += i\n        return self.v\n",
    "def f{k}(:\n    return {k}\n",
    "import a{k}\nimport b{k}\nimport c{k}\nimport d{k}\nfrom e{k} import e\nfrom g{k} import g\nfrom h{k} import h\nfrom i{k} import i\n",
    "def f{k}(n):\n    b = b'{k}'\n    for i in range(n):\n        if i > {k}:\n            b = b + b'{k}'\n        else:\n            b = b\n    return b\n",
    "t{k} = 0\nfor i in range({k}):\n    if i > {k}:\n        t{k} += i\n    else:\n        t{k} -= i\nu{k} = t{k}\nprint(u{k})\n",
    "\n\nx{k} = {k}\n\n@deco\nasync def f{k}(n):\n    total = {k}\n    for i in range(n):\n        if i > {k}:\n            total += i\n        else:\n            total -= i\n    return total\n",
)
#: template: valid, nodes, depth, node types, constructs, complex, blocks, normalised blocks.
SHAPES = (
    (True, 10, 6, 10, 2, True, 0, 1), (True, 36, 7, 18, 6, True, 1, 1), (True, 42, 9, 19, 8, True, 1, 1), (False, 0, 0, 0, 0, False, 0, 0),
    (True, 17, 3, 4, 0, False, 0, 0), (True, 38, 8, 17, 8, True, 1, 1), (True, 41, 6, 15, 6, True, 1, 1), (True, 43, 7, 18, 6, True, 1, 1),
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, template, code, full_path: a Python file for each part; every third has a comment line, keys repeat."""
    filled = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    code = F.replace(filled, F.lit("{k}"), (F.col("p_partkey") % 200).cast("string"))
    note = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# note "), F.col("p_partkey").cast("string"), F.lit("\n"))).otherwise("")
    return spread(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") % 8).cast("int").alias("template"), F.concat(code, note).alias("code"),
        F.concat(F.lit("part/"), "p_partkey", F.lit(".py")).alias("full_path"),
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CODE_FILES = f"""code_files AS (SELECT p_partkey::BIGINT AS id, (p_partkey % 8)::INTEGER AS template, 'part/' || p_partkey || '.py' AS full_path,
  replace([{', '.join(map(quoted, TEMPLATES))}][p_partkey % 8 + 1], '{{k}}', (p_partkey % 200)::VARCHAR)
  || CASE WHEN p_partkey % 3 = 0 THEN '# note ' || p_partkey || chr(10) ELSE '' END AS code FROM part)"""
SHAPE_ROWS = "shapes(template, valid, nodes, depth, node_types, constructs, complex, blocks, normal_blocks) AS (VALUES " + ", ".join(f"({i}, {', '.join(str(x).lower() for x in s)})" for i, s in enumerate(SHAPES)) + ")"

ANSWERS = ("'Here:\\\\n```python\\\\nx = ' || n || '\\\\n```\\\\nBye'", "'```\\\\ny = ' || n || '\\\\n```'", "'z = ' || n", "'```python\\\\nf(:\\\\n```'")
RESULTS_SQL = f"""
SELECT id, n, turn,
  CASE n % 4 WHEN 0 THEN 'FALSE ' WHEN 1 THEN NULL WHEN 2 THEN 'true' ELSE 'No' END AS success,
  CASE n % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'Llama-3-3-70B-Instruct' END AS model_used,
  CASE n % 6 WHEN 0 THEN '5d' WHEN 1 THEN '1e3' WHEN 2 THEN NULL ELSE CAST(turn AS STRING) END AS Score,
  'w = ' || n AS AiAnswer, CASE WHEN n % 11 > 0 THEN 'question ' || n END AS Body, CASE WHEN n % 13 > 0 THEN 'title ' || n END AS Title,
  CASE WHEN n % 5 = 0 THEN NULL WHEN n % 17 = 0 THEN '{{"Body": ' ELSE '{{"Body":"asked ' || n || '","AiAnswer":"' ||
    CASE n % 4 WHEN 0 THEN {ANSWERS[0]} WHEN 1 THEN {ANSWERS[1]} WHEN 2 THEN {ANSWERS[2]} ELSE {ANSWERS[3]} END ||
    '","Score":' || CASE WHEN n % 7 = 0 THEN '0' ELSE CAST(turn AS STRING) END || CASE WHEN n % 2 = 0 THEN ',"success":' || CASE n % 6 WHEN 0 THEN 'false' WHEN 2 THEN 'null' ELSE 'true' END ELSE '' END ||
    ',"model_used":"gpt-4o-mini","full_path":"p/' || n || '","code":"x = 1","analysis":"' || CASE n % 3 WHEN 0 THEN {ANSWERS[0]} WHEN 1 THEN {ANSWERS[1]} ELSE 'none' END || '"}}' END AS data
FROM (SELECT CAST(conv_id AS BIGINT) * 100 + turn AS id, CAST(conv_id AS BIGINT) + turn AS n, CAST(turn AS BIGINT) AS turn FROM conversations)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model results: id, n, turn; success, model_used, Score, AiAnswer, Body, Title as columns, and most again in data, as JSON."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(RESULTS_SQL)


# DuckDB takes backslashes in quotes as they stand; Spark reads two of them as one.
RESULTS = "results AS (" + RESULTS_SQL.replace("\\\\", "\\").replace("AS STRING", "AS VARCHAR") + ")"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a batch answer, one for each vector: status 500 for every tenth, every 97th line broken."""
    line = F.when(F.col("vec_id") % 97 == 0, "{broken").otherwise(
        F.concat(
            F.lit('{"custom_id":"v'), F.col("vec_id").cast("string"), F.lit('","response":{"status_code":'), F.when(F.col("vec_id") % 10 == 0, "500").otherwise("200"),
            F.lit(',"body":{"data":[{"embedding":['), F.col("vec_id").cast("string"), F.lit('.5,1.0]}]}},"error":null}'),
        )
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", line.alias("value"))


RESPONSES = """responses AS (SELECT vec_id, CASE WHEN vec_id % 97 = 0 THEN '{broken' ELSE '{"custom_id":"v' || vec_id || '","response":{"status_code":' ||
  CASE WHEN vec_id % 10 = 0 THEN '500' ELSE '200' END || ',"body":{"data":[{"embedding":[' || vec_id || '.5,1.0]}]}},"error":null}' END AS value FROM embeddings)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in progress: all vectors but every fiftieth."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 50 <> 0")
    return rows.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("custom_id"), (F.col("vec_id") % 7).alias("batch_id"), F.col("label").alias("ast_depth"))


REQUESTS = "requests AS (SELECT 'v' || vec_id AS custom_id, vec_id % 7 AS batch_id, label AS ast_depth FROM embeddings WHERE vec_id % 50 <> 0)"


def ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Completed, blacklisted and skipped ids; they overlap."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    return ids.where("row_id % 4 = 0"), ids.where("row_id % 10 = 0"), ids.where("row_id % 15 = 0")


LEDGERS = """completed AS (SELECT doc_id AS row_id FROM documents WHERE doc_id % 4 = 0), blacklisted AS (SELECT doc_id AS row_id FROM documents WHERE doc_id % 10 = 0),
skipped AS (SELECT doc_id AS row_id FROM documents WHERE doc_id % 15 = 0)"""


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of work batches: batch_id, client, event (assign, submit, return, none), ts and its number."""
    event = F.when(F.col("event_type") == "view", "assign").when(F.col("event_type") == "purchase", "submit").when(F.col("event_type") == "error", "return").otherwise("none")
    rows = table(spark, sf_dir, "events")
    return rows.select((F.col("event_id") % 500).alias("batch_id"), F.col("user_id").alias("client"), event.alias("event"), "ts", "event_id")


LEASES = """leases AS (SELECT event_id % 500 AS batch_id, user_id AS client, CASE event_type WHEN 'view' THEN 'assign' WHEN 'purchase' THEN 'submit' WHEN 'error' THEN 'return' ELSE 'none' END AS event, ts, event_id FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))


PREDICTIONS = "predictions AS (SELECT quality AS label, toxic AS pred FROM labels)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of trials: customers as trials, their orders as epochs, prices as metric."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_custkey AS trial, o_custkey % 3 AS bracket, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch, o_totalprice AS f1 FROM orders")


TRIALS = "trials AS (SELECT o_custkey AS trial, o_custkey % 3 AS bracket, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch, o_totalprice AS f1 FROM orders)"

#: The first python fence of a column, else its first fence, stripped.
FENCES_SQL = """SELECT id, trim(coalesce(nullif(regexp_extract_all({column}, '(?s)```python\n(.*?)```', 1), [])[1], nullif(regexp_extract_all({column}, '(?s)```\n(.*?)```', 1), [])[1]), ' ' || chr(10)) AS code FROM {source}"""
