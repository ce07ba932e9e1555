"""Composite pipelines: the entry points that a user runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import syntax as S
from ..functions import text as T
from ..operators import ledgers as L
from ..operators import ranks as R
from ..operators import sampling as P
from ..operators import similarity as N
from ..operators import stats as A
from ..sources.scans import parse_responses
from ..sources.sinks import work_path, write_parquet
from .fixtures import CODE_FILES, CORPUS, REQUESTS, RESPONSES, RESULTS, SHAPE_ROWS, code_files, corpus, requests, responses, results
from .register import query
from .scalars import JSON_VALUE, REWRITES, complexity, measured

FIELDS = "Body string, AiAnswer string, model_used string, Score string, Title string"


def clean_ai_results(rows: DataFrame) -> DataFrame:
    """Model answers that succeeded: body, code, model, score, title and whether the code parses.

    Fields come from the JSON in ``data`` where it has them; the syntax check runs on what the native filters leave.
    """
    ok = rows.where(T.is_success(F.col("success"))).withColumn("j", F.from_json("data", FIELDS))
    names = ("Body", "AiAnswer", "model_used", "Score", "Title")
    merged = ok.select("id", *[F.coalesce(F.col(f"j.{n}"), F.col(n)).alias(n) for n in names]).na.drop(how="all", subset=list(names))
    code = T.without_fence(F.coalesce(T.fenced_code(F.col("AiAnswer")), F.col("AiAnswer")))
    shaped = merged.select("id", F.col("Body").alias("body"), code.alias("code"), T.renamed_model(F.col("model_used")).alias("model"), T.number_or_null(F.col("Score")).alias("score"), F.col("Title").alias("title"))
    return shaped.where(F.col("code").isNotNull()).withColumn("valid", S.is_valid_code("code"))


def clean_question_results(rows: DataFrame, falsy_is_missing: bool = True) -> DataFrame:
    """Complete question rows under the column names of the corpus."""
    kept = rows.where(T.success_not_false(F.col("success") == "true")).withColumn("j", F.from_json("data", FIELDS))
    held = T.truthy if falsy_is_missing else (lambda c: c)
    fields = {n: F.coalesce(held(F.col(f"j.{n}")), held(F.col(n))) for n in ("Body", "AiAnswer", "model_used", "Title")}
    named = kept.select("id", *[c.alias(n) for n, c in fields.items()]).withColumn("model_used", T.renamed_model(F.col("model_used")))
    return named.withColumnsRenamed({"model_used": "ModelUsed"}).na.drop(subset=["Body", "AiAnswer", "Title", "ModelUsed"])


def rewrite_pairs(rows: DataFrame) -> DataFrame:
    """original, rewritten, model_used and full_path of JSON rewrite rows, with ``reason``: kept, or why a row is skipped."""
    keys = F.json_object_keys("data")
    parsed = rows.withColumn("j", F.from_json("data", "code string, full_path string, analysis string, model_used string"))
    value = F.get_json_object("data", "$.success")
    failed = F.array_contains(keys, "success") & F.coalesce(value != "true", F.lit(True))
    code = T.fenced_code(F.col("j.analysis"))
    reason = F.when(keys.isNull(), "error").when(failed, "success=False").when(code.isNull() | F.col("j.code").isNull(), "no code").otherwise("kept")
    return parsed.select("id", F.col("j.code").alias("original"), code.alias("rewritten"), T.renamed_model(F.col("j.model_used")).alias("model_used"), "j.full_path", reason.alias("reason"))


FLAG = """SELECT id, coalesce({a}, AiAnswer) AS answer, coalesce({b}, Body) AS body, coalesce({m}, model_used) AS m, coalesce({s}, Score) AS s, Title AS title FROM results
  WHERE success IS NULL OR lower(trim(success)) NOT IN ('no', 'false', 'fail', 'failed', 'failure', '0', 'none')""".format(
    a=JSON_VALUE.format("AiAnswer"), b=JSON_VALUE.format("Body"), m=JSON_VALUE.format("model_used"), s=JSON_VALUE.format("Score")
)
PYTHON, ANY = ("nullif(regexp_extract_all(answer, '(?s)```{}\n(.*?)```', 1), [])[1]".format(t) for t in ("python", ""))


@query(
    f"""SELECT id, body, trim(coalesce({PYTHON}, {ANY}, answer), ' ' || chr(10)) AS code, CASE m WHEN 'gpt-4o' THEN 'gpt-4o-2024-11-20' WHEN 'gpt-4o-mini' THEN 'gpt-4o-mini-2024-07-18' WHEN 'Llama-3-3-70B-Instruct' THEN 'Llama-3.3-70B-Instruct' ELSE m END AS model,
    CASE WHEN s = '5d' THEN NULL ELSE try_cast(s AS DOUBLE) END AS score, title, coalesce({PYTHON}, '') NOT LIKE 'f(:%' AS valid FROM ({FLAG})""",
    RESULTS,
)
def clean_ai_results_query(spark, sf_dir):
    return clean_ai_results(results(spark, sf_dir))


TRUTHY = "coalesce(nullif(nullif({j}, ''), '0'), nullif(nullif({c}, ''), '0'))"
QUESTION = ", ".join(f"{TRUTHY.format(j=JSON_VALUE.format(n), c=n)} AS {n}" for n in ("Body", "AiAnswer", "model_used", "Title"))


@query(
    f"SELECT id, Body, AiAnswer, CASE model_used WHEN 'gpt-4o' THEN 'gpt-4o-2024-11-20' WHEN 'gpt-4o-mini' THEN 'gpt-4o-mini-2024-07-18' WHEN 'Llama-3-3-70B-Instruct' THEN 'Llama-3.3-70B-Instruct' ELSE model_used END AS ModelUsed, Title "
    f"FROM (SELECT id, {QUESTION} FROM results WHERE (success = 'true') IS NOT FALSE) WHERE Body IS NOT NULL AND AiAnswer IS NOT NULL AND model_used IS NOT NULL AND Title IS NOT NULL",
    RESULTS,
)
def clean_question_results_query(spark, sf_dir):
    return clean_question_results(results(spark, sf_dir))


@query("SELECT id, 'x = 1' AS original, CASE n % 3 WHEN 0 THEN 'x = ' || n ELSE 'y = ' || n END AS rewritten, 'gpt-4o-mini-2024-07-18' AS model_used, full_path FROM rewrites WHERE reason = 'kept'", RESULTS, REWRITES)
def clean_rewrite_pairs(spark, sf_dir):
    return rewrite_pairs(results(spark, sf_dir)).where("reason = 'kept'").drop("reason")


def block_rows(files: DataFrame, normalised: bool = False) -> DataFrame:
    split = S.normalised_blocks("code") if normalised else S.blocks("code")
    return files.select("id", "full_path", F.posexplode(split).alias("no", "b")).select("id", "full_path", "no", "b.code", "b.normal", "b.ast", F.col("b.depth").alias("ast_depth"))


@query(
    "SELECT min(id) AS id, count(*) AS copies FROM (SELECT id, template, (id % 200) AS k FROM code_files) JOIN shapes USING (template) WHERE blocks > 0 GROUP BY template, k",
    CODE_FILES, SHAPE_ROWS,
)
def build_block_corpus(spark, sf_dir):
    """Each distinct block once, with the first file that has it."""
    rows = block_rows(code_files(spark, sf_dir).where(F.col("code").isNotNull() & (F.col("code") != "")))
    hashed = rows.select("id", F.md5("code").alias("code_hash"))
    first = L.upsert_ignore(hashed, hashed.where(F.lit(False)), "code_hash", "id")
    copies = hashed.groupBy("code_hash").agg(F.count("*").alias("copies"))
    return first.join(copies, "code_hash").select("id", "copies")


@query(
    "SELECT count(*) AS groups, avg(n) AS mean_size, max(n) AS max_size, sum(n - 1)::BIGINT AS removed FROM (SELECT count(*) AS n FROM (SELECT id, template, (id % 200) AS k FROM code_files) JOIN shapes USING (template) WHERE normal_blocks > 0 GROUP BY template, k)",
    CODE_FILES, SHAPE_ROWS,
)
def build_unique_blocks(spark, sf_dir):
    return A.dup_group_stats(block_rows(code_files(spark, sf_dir), True), F.col("normal"))


@query(None)
def most_unique_code(spark, sf_dir):
    metrics = measured(spark, sf_dir)
    hard = complexity(metrics, "m").where("complex").select("id", "m.nodes")  # a file is parsed once
    scored = write_parquet(N.uniqueness_score(hard, "id", "nodes", N.PARTNERS, 42), work_path(spark, "scored"))  # to be ranked in two passes
    return R.top_percent(scored, "uniqueness", "id", 90)


@query(
    """SELECT row_id, class, bin, row_number() OVER (PARTITION BY class ORDER BY md5('123-' || row_id), row_id) <= floor(0.1 * count(*) OVER (PARTITION BY class)) AS is_test FROM (SELECT row_id, class, bin, row_number() OVER (PARTITION BY class, bin ORDER BY md5('42-' || row_id), row_id) AS place
    FROM (SELECT row_id, class, len(list_filter(e, lambda x: x < chars - 1e-7))::INTEGER AS bin FROM kept JOIN edges USING (class))) WHERE place <= 15""",
    CORPUS,
    "kept AS (SELECT row_id, class, length(code) AS chars FROM corpus WHERE length(code) BETWEEN 100 AND 5000), edges AS (SELECT class, quantile_cont(chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM kept GROUP BY class)",
)
def prepare_training_set(spark, sf_dir):
    """Filter by length, bin by deciles of each class, sample each bin alike, and split."""
    kept = corpus(spark, sf_dir).where(F.length("code").between(100, 5000)).select("row_id", "class", F.length("code").alias("chars"))
    binned = R.quantile_bins(kept, F.col("chars") - F.lit(1e-7), "bin", by=["class"]).select("row_id", "class", "bin")
    return P.split(P.stratified_sample(binned, ["class", "bin"], "row_id", 150, 10, 42), "class", "row_id", 0.1, 123)


@query(
    "SELECT count(*) AS processed, count(*) FILTER (failed OR r.custom_id IS NULL) AS failed, count(r.custom_id) FILTER (NOT failed) AS loaded FROM (SELECT CASE WHEN vec_id % 97 > 0 THEN 'v' || vec_id END AS custom_id, vec_id % 97 = 0 OR vec_id % 10 = 0 AS failed FROM responses) LEFT JOIN requests r USING (custom_id)",
    RESPONSES, REQUESTS,
)
def load_embeddings(spark, sf_dir):
    joined = L.join_responses(parse_responses(responses(spark, sf_dir)), requests(spark, sf_dir))
    return A.success_rate(joined).select("processed", "failed", (F.col("processed") - F.col("failed")).alias("loaded"))
