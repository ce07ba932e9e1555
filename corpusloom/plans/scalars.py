"""Queries of projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import syntax as S
from ..functions import text as T
from .fixtures import CODE_FILES, CORPUS, FENCES_SQL, RESULTS, SHAPE_ROWS, code_files, corpus, results, table
from .register import query
from .shapes import BLOCK_ROWS, NORMAL_ROWS, TREE_ROWS, filled, literal


@query("SELECT page_id, url FROM pages WHERE url LIKE '%.html' AND NOT (page_id % 7 = 0) AND length(html) BETWEEN 1024 AND 10000000")
def select_py_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").like("%.html") & ~(F.col("page_id") % 7 == 0) & F.length("html").between(1024, 10_000_000)).select("page_id", "url")


@query("SELECT doc_id, source || '/' || lang AS full_path FROM documents")
def full_path(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("full_path"))


@query("SELECT row_id FROM corpus WHERE code IS NOT NULL AND code <> ''", CORPUS)
def filter_nonempty(spark, sf_dir):
    return corpus(spark, sf_dir).where(F.col("code").isNotNull() & (F.col("code") != "")).select("row_id")


@query("SELECT row_id, length(code)::INTEGER AS chars FROM corpus WHERE length(code) BETWEEN 100 AND 5000", CORPUS)
def filter_code_length(spark, sf_dir):
    return corpus(spark, sf_dir).where(F.length("code").between(100, 5000)).select("row_id", F.length("code").alias("chars"))


@query("SELECT id, success IS NULL OR lower(trim(success)) NOT IN ('no', 'false', 'fail', 'failed', 'failure', '0', 'none') AS ok, coalesce(turn <> 0, true) AS ok_number FROM results", RESULTS)
def is_success(spark, sf_dir):
    return results(spark, sf_dir).select("id", T.is_success(F.col("success")).alias("ok"), T.is_success(F.col("turn"), "number").alias("ok_number"))


@query("SELECT id FROM results WHERE (success = 'true') IS NOT FALSE", RESULTS)
def success_not_false(spark, sf_dir):
    return results(spark, sf_dir).where(T.success_not_false(F.col("success") == "true")).select("id")


@query(
    """SELECT id, CASE WHEN json_valid(data) THEN CASE WHEN NOT json_exists(data, '$.success') THEN true ELSE coalesce(json_extract_string(data, '$.success') = 'true', false) END END AS ok FROM results""",
    RESULTS,
)
def json_success_default(spark, sf_dir):
    has = F.array_contains(F.json_object_keys("data"), "success")
    value = F.get_json_object("data", "$.success")
    return results(spark, sf_dir).select("id", F.when(~has, True).otherwise(F.when(has, F.coalesce(value == "true", F.lit(False)))).alias("ok"))


FIELDS = ("Body", "AiAnswer", "model_used", "Score")
JSON_VALUE = "CASE WHEN json_valid(data) THEN json_extract_string(data, '$.{}') END"


@query("SELECT id, " + ", ".join(f"coalesce({JSON_VALUE.format(f)}, {f}) AS {f.lower()}" for f in FIELDS) + " FROM results", RESULTS)
def json_fields_coalesce(spark, sf_dir):
    data = F.from_json("data", "Body string, AiAnswer string, model_used string, Score string")
    rows = results(spark, sf_dir).withColumn("j", data)
    return rows.select("id", *[F.coalesce(F.col(f"j.{f}"), F.col(f)).alias(f.lower()) for f in FIELDS])


@query(
    "SELECT id, " + ", ".join(f"coalesce(nullif(nullif({JSON_VALUE.format(f)}, ''), '0'), nullif(nullif({f}, ''), '0')) AS {f.lower()}" for f in FIELDS) + " FROM results", RESULTS
)
def json_fields_truthy(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("j", F.from_json("data", "Body string, AiAnswer string, model_used string, Score string"))
    return rows.select("id", *[F.coalesce(T.truthy(F.col(f"j.{f}")), T.truthy(F.col(f))).alias(f.lower()) for f in FIELDS])


@query(
    FENCES_SQL.format(column="AiAnswer", source=f"(SELECT id, {JSON_VALUE.format('AiAnswer')} AS AiAnswer FROM results)"), RESULTS
)
def extract_fenced_code(spark, sf_dir):
    answer = F.from_json("data", "AiAnswer string")["AiAnswer"]
    return results(spark, sf_dir).select("id", T.fenced_code(answer).alias("code"))


@query("SELECT id, trim(regexp_replace(regexp_replace('```python' || chr(10) || coalesce(Body, '') || chr(10) || '```', '^```[^\\n]*\\n?', ''), '```$', ''), ' ' || chr(10)) AS code FROM results", RESULTS)
def strip_residual_fence(spark, sf_dir):
    fenced = F.concat(F.lit("```python\n"), F.coalesce("Body", F.lit("")), F.lit("\n```"))
    return results(spark, sf_dir).select("id", T.without_fence(fenced).alias("code"))


@query("SELECT id, CASE model_used WHEN 'gpt-4o' THEN 'gpt-4o-2024-11-20' WHEN 'Llama-3-3-70B-Instruct' THEN 'Llama-3.3-70B-Instruct' ELSE model_used END AS model FROM results", RESULTS)
def rename_models(spark, sf_dir):
    return results(spark, sf_dir).select("id", T.renamed_model(F.col("model_used")).alias("model"))


@query("SELECT id, CASE WHEN Score = '5d' THEN NULL ELSE try_cast(Score AS DOUBLE) END AS score FROM results", RESULTS)
def to_numeric_coerce(spark, sf_dir):
    return results(spark, sf_dir).select("id", T.number_or_null(F.col("Score")).alias("score"))


@query("SELECT id FROM results WHERE NOT (Body IS NULL AND Title IS NULL AND Score IS NULL)", RESULTS)
def drop_all_null(spark, sf_dir):
    return results(spark, sf_dir).na.drop(how="all", subset=["Body", "Title", "Score"]).select("id")


@query("SELECT id FROM results WHERE Body IS NOT NULL AND Title IS NOT NULL AND Score IS NOT NULL AND model_used IS NOT NULL", RESULTS)
def drop_any_null(spark, sf_dir):
    return results(spark, sf_dir).na.drop(how="any", subset=["Body", "Title", "Score", "model_used"]).select("id")


@query("SELECT id, model_used AS ModelUsed, AiAnswer AS code FROM results", RESULTS)
def rename_columns(spark, sf_dir):
    return results(spark, sf_dir).select("id", "model_used", "AiAnswer").withColumnsRenamed({"model_used": "ModelUsed", "AiAnswer": "code"})


COMMENT_FREE = "array_to_string(list_filter([regexp_replace(split_part(l, '#', 1), '\\s+$', '') FOR l IN string_split({}, chr(10))], lambda x: x <> ''), chr(10))"


@query(f"SELECT id, {COMMENT_FREE.format('code')} AS code FROM code_files", CODE_FILES)
def remove_comments(spark, sf_dir):
    return code_files(spark, sf_dir).select("id", T.comment_free(F.col("code")).alias("code"))


@query("SELECT row_id, substr(split_part(code, chr(10), 1), 1, 100) AS line FROM corpus", CORPUS)
def first_line(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", T.first_line(F.col("code")).alias("line"))


@query("SELECT row_id, to_base64(unhex(sha256(code))) AS hash FROM corpus", CORPUS)
def hash_sha256_b64(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", T.sha256_base64(F.col("code")).alias("hash"))


@query("SELECT row_id, md5(code) AS hash FROM corpus", CORPUS)
def hash_md5(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", F.md5("code").alias("hash"))


@query("""SELECT row_id, substr(sha256('{"class":"' || class || '","row_id":' || row_id || '}'), 1, 32) AS batch FROM corpus""", CORPUS)
def batch_id(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", T.batch_id(F.col("class"), F.col("row_id")).alias("batch"))


@query(
    f"SELECT id, replace({literal(T.ASK)}, '{{}}', coalesce(Body, '')) AS ask, replace({literal(T.REWRITE)}, '{{}}', coalesce(Title, '')) AS rewrite FROM results",
    RESULTS,
)
def render_prompt(spark, sf_dir):
    return results(spark, sf_dir).select("id", T.prompt(F.col("Body"), T.ASK).alias("ask"), T.prompt(F.col("Title"), T.REWRITE).alias("rewrite"))


@query("""SELECT id, '{"custom_id":"q' || id || '","method":"POST","url":"/v1/chat","body":{"model":"m","messages":[{"role":"user","content":"' || coalesce(Body, '') || '"}]}}' AS request FROM results""", RESULTS)
def build_request_json(spark, sf_dir):
    custom = F.concat(F.lit("q"), F.col("id").cast("string"))
    return results(spark, sf_dir).select("id", T.request_json(custom, "/v1/chat", "m", F.coalesce("Body", F.lit(""))).alias("request"))


@query("""SELECT event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","n":' || user_id || '}' AS row FROM events""")
def json_safe_values(spark, sf_dir):
    row = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("user_id").alias("n")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "events").select("event_id", row.alias("row"))


@query("SELECT vec_id, '[' || array_to_string([(floor(x * 1000))::BIGINT::VARCHAR FOR x IN embedding], ',') || ']' AS key FROM embeddings")
def stringify_key(spark, sf_dir):
    """Thousandths of each component, multiplied in the vector's own four bytes: 0.29 as a float gives 290, in doubles 289."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.to_json(F.transform("embedding", lambda x: F.floor(x * F.lit(1000).cast("float")))).alias("key"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, '' AS code FROM events""")
def payload_with_defaults(spark, sf_dir):
    payload = F.try_parse_json("props")
    rows = table(spark, sf_dir, "events").withColumn("p", payload)
    return rows.select("event_id", F.coalesce(F.try_variant_get("p", "$.k", "bigint"), F.lit(0)).alias("k"), F.coalesce(F.try_variant_get("p", "$.code", "string"), F.lit("")).alias("code"))


@query("SELECT vec_id, len(CASE WHEN vec_id % 3 = 0 THEN embedding WHEN vec_id % 3 = 1 THEN embedding[1:2] ELSE [] END)::INTEGER AS dims FROM embeddings")
def first_named_vector(spark, sf_dir):
    """A plain vector, else that of the smallest name, else none."""
    named = F.when(F.col("vec_id") % 3 == 1, F.create_map(F.lit("b"), F.col("embedding"), F.lit("a"), F.slice("embedding", 1, 2)))
    plain = F.when(F.col("vec_id") % 3 == 0, F.col("embedding"))
    first = F.element_at("named", F.array_min(F.map_keys("named")))
    rows = table(spark, sf_dir, "embeddings").withColumn("plain", plain).withColumn("named", named)
    return rows.select("vec_id", F.size(F.coalesce("plain", first, F.array().cast("array<float>"))).alias("dims"))


@query("SELECT row_id, substr(sha256(code), 1, 32) AS point_id FROM corpus", CORPUS)
def point_ids(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", F.substring(F.sha2("code", 256), 1, 32).alias("point_id"))


REWRITES = """rewrites AS (SELECT id, n, json_extract_string(data, '$.full_path') AS full_path, CASE WHEN NOT json_valid(data) OR data IS NULL THEN 'error'
  WHEN json_exists(data, '$.success') AND coalesce(json_extract_string(data, '$.success') <> 'true', true) THEN 'success=False' WHEN n % 3 = 2 THEN 'no code' ELSE 'kept' END AS reason
  FROM (SELECT id, n, CASE WHEN json_valid(data) THEN data END AS data FROM results))"""


@query(
    "SELECT id, original, CASE WHEN original IS NOT NULL THEN CASE n % 3 WHEN 0 THEN 'x = ' || n WHEN 1 THEN 'y = ' || n END END AS rewritten, CASE WHEN original IS NOT NULL THEN 'gpt-4o-mini-2024-07-18' END AS model_used, full_path, reason "
    "FROM (SELECT *, CASE WHEN full_path IS NOT NULL THEN 'x = 1' END AS original FROM rewrites)",
    RESULTS, REWRITES,
)
def json_rewrite_pairs(spark, sf_dir):
    from .pipelines import rewrite_pairs

    return rewrite_pairs(results(spark, sf_dir))


@query(
    "SELECT id, CASE WHEN answer NOT LIKE '%f(:%' THEN trim(coalesce(nullif(regexp_extract(answer, '(?s)```(?:python)?(.*?)```', 1), ''), answer), ' ' || chr(10)) END AS code FROM "
    f"(SELECT id, {JSON_VALUE.format('AiAnswer')} AS answer FROM results)",
    RESULTS,
)
def extract_answer_code(spark, sf_dir):
    rows = results(spark, sf_dir).select("id", F.from_json("data", "AiAnswer string")["AiAnswer"].alias("answer"))
    return rows.select("id", S.extract_answer("answer").alias("code"))


SHAPED = (CODE_FILES, SHAPE_ROWS)


def measured(spark, sf_dir):
    return code_files(spark, sf_dir).withColumn("m", S.metrics_in_place("code"))


@query("SELECT id, valid FROM code_files JOIN shapes USING (template)", *SHAPED)
def validate_code(spark, sf_dir):
    return code_files(spark, sf_dir).select("id", S.is_valid_code("code").alias("valid"))


@query("SELECT id, depth::INTEGER AS depth FROM code_files JOIN shapes USING (template)", *SHAPED)
def ast_depth(spark, sf_dir):
    return measured(spark, sf_dir).select("id", "m.depth")


@query("SELECT id, greatest(depth - 1, 0)::INTEGER AS depth FROM code_files JOIN shapes USING (template)", *SHAPED)
def ast_edge_depth(spark, sf_dir):
    return measured(spark, sf_dir).select("id", F.greatest(F.col("m.depth") - 1, F.lit(0)).alias("depth"))


@query("SELECT id, node_types::INTEGER AS node_types FROM code_files JOIN shapes USING (template)", *SHAPED)
def ast_node_types(spark, sf_dir):
    return measured(spark, sf_dir).select("id", "m.node_types")


@query("SELECT id, constructs::INTEGER AS constructs FROM code_files JOIN shapes USING (template)", *SHAPED)
def prog_constructs(spark, sf_dir):
    return measured(spark, sf_dir).select("id", "m.constructs")


def complexity(metrics, *others, min_depth=3, min_types=4, min_constructs=2):
    """Edge depth, node types, constructs and whether all reach their least; 0 for imports only and unparsable code.  Other
    columns may be kept."""
    real = F.col("m.valid") & ~F.col("m.only_imports")
    counts = {"depth": F.col("m.depth") - 1, "node_types": F.col("m.node_types"), "constructs": F.col("m.constructs")}
    rows = metrics.select("id", *others, *[F.when(real, c).otherwise(0).alias(k) for k, c in counts.items()])
    return rows.withColumn("complex", (F.col("depth") >= min_depth) & (F.col("node_types") >= min_types) & (F.col("constructs") >= min_constructs))


@query(
    "SELECT id, CASE WHEN template IN (3, 4) THEN 0 ELSE depth - 1 END::INTEGER AS depth, CASE WHEN template IN (3, 4) THEN 0 ELSE node_types END::INTEGER AS node_types, CASE WHEN template IN (3, 4) THEN 0 ELSE constructs END::INTEGER AS constructs, complex FROM code_files JOIN shapes USING (template)",
    *SHAPED,
)
def code_complexity(spark, sf_dir):
    return complexity(measured(spark, sf_dir))


@query("SELECT id, nodes FROM code_files JOIN trees USING (template) WHERE nodes IS NOT NULL", CODE_FILES, TREE_ROWS)
def ast_node_seq(spark, sf_dir):
    """Node types in preorder, joined by spaces."""
    return measured(spark, sf_dir).where("m.valid").select("id", F.array_join("m.nodes", " ").alias("nodes"))


@query(f"SELECT id, {filled('ast')} AS ast FROM code_files JOIN trees USING (template)", CODE_FILES, TREE_ROWS)
def ast_json(spark, sf_dir):
    return code_files(spark, sf_dir).select("id", S.code_json("code").alias("ast"))


@query(f"SELECT id, {filled('alternative')} AS ast FROM code_files JOIN trees USING (template)", CODE_FILES, TREE_ROWS)
def ast_json_alt(spark, sf_dir):
    return code_files(spark, sf_dir).select("id", S.code_json_alternative("code").alias("ast"))


@query(f"SELECT id, 0 AS block, {filled('b.code')} AS code, {filled('ast')} AS ast, depth FROM code_files JOIN blocks b USING (template)", CODE_FILES, BLOCK_ROWS)
def split_code_blocks(spark, sf_dir):
    found = code_files(spark, sf_dir).select("id", F.posexplode(S.blocks("code")).alias("block", "b"))
    return found.select("id", "block", "b.code", "b.ast", "b.depth")


@query(f"SELECT id, 0 AS block, {filled('b.code')} AS code, {filled('b.code')} AS normal, depth FROM code_files JOIN blocks b USING (template)", CODE_FILES, NORMAL_ROWS)
def split_code_blocks_norm(spark, sf_dir):
    found = code_files(spark, sf_dir).select("id", F.posexplode(S.normalised_blocks("code")).alias("block", "b"))
    return found.select("id", "block", "b.code", "b.normal", "b.depth")
