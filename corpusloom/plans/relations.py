"""Queries of joins, statistics, ranks, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import syntax as S
from ..functions import text as T
from ..operators import ledgers as L
from ..operators import ranks as R
from ..operators import sampling as P
from ..operators import stats as A
from ..sources.keyed import KeyedTable
from ..sources.scans import parse_responses
from ..sources.sinks import work_path
from .fixtures import CODE_FILES, CORPUS, LEASES, LEDGERS, PREDICTIONS, REQUESTS, RESPONSES, RESULTS, SHAPE_ROWS, TRIALS
from .fixtures import code_files, corpus, leases, ledgers, predictions, requests, responses, results, table, trials
from .register import query
from .shapes import SUBTREE_ROWS, TREE_ROWS, VOCABULARY
from .scalars import COMMENT_FREE, REWRITES, complexity, measured

NOW = "TIMESTAMP '2024-01-20 00:00:00'"


# Joins


@query("SELECT DISTINCT p.url AS path, d.n_chars AS size FROM pages p JOIN documents d ON p.page_id = d.doc_id WHERE p.url LIKE '%.html'")
def join_files_contents(spark, sf_dir):
    files = table(spark, sf_dir, "pages").where("url LIKE '%.html'").select(F.col("page_id").alias("id"), F.col("url").alias("path"))
    contents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return files.join(contents, "id").select("path", "size").distinct()


RESPONDED = """ok AS (SELECT vec_id, CASE WHEN vec_id % 97 > 0 THEN 'v' || vec_id END AS custom_id, vec_id % 97 = 0 OR vec_id % 10 = 0 AS failed FROM responses)"""


@query("SELECT vec_id, ok.failed OR r.custom_id IS NULL AS failed, r.batch_id::VARCHAR AS batch_id FROM ok LEFT JOIN requests r USING (custom_id)", RESPONSES, RESPONDED, REQUESTS)
def join_responses(spark, sf_dir):
    return L.join_responses(parse_responses(responses(spark, sf_dir)), requests(spark, sf_dir)).select("vec_id", "failed", F.col("batch_id").cast("string").alias("batch_id"))


@query("SELECT doc_id AS row_id FROM documents WHERE doc_id % 4 > 0 AND doc_id % 10 > 0 AND doc_id % 15 > 0")
def pending_work(spark, sf_dir):
    return L.pending(corpus(spark, sf_dir).select("row_id"), "row_id", *ledgers(spark, sf_dir))


STATES = f"""last AS (SELECT batch_id, arg_max({{'event': event, 'client': client, 'ts': ts}}, (ts, event_id)) AS x FROM leases WHERE event <> 'none' GROUP BY batch_id),
states AS (SELECT batch_id, x.client AS client, CASE WHEN x.event = 'submit' THEN 'completed' WHEN x.event = 'return' THEN 'pending'
  WHEN epoch({NOW})::BIGINT - floor(epoch(x.ts))::BIGINT <= 900000 THEN 'assigned' ELSE 'expired' END AS state FROM last)"""


def states(spark, sf_dir):
    return L.lease_state(leases(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 900_000)


@query("SELECT batch_id, client, state FROM states", LEASES, STATES)
def lease_state_batch(spark, sf_dir):
    return states(spark, sf_dir)


@query("SELECT row_id FROM corpus WHERE row_id NOT IN (SELECT batch_id FROM states WHERE state IN ('completed', 'assigned')) ORDER BY md5('9-' || row_id), row_id LIMIT 40", CORPUS, LEASES, STATES)
def next_work(spark, sf_dir):
    return L.next_work(corpus(spark, sf_dir).select("row_id"), states(spark, sf_dir), "row_id", 40, T.draw_key(9, F.col("row_id")))


@query("SELECT min(row_id) AS row_id, md5(code) AS hash FROM corpus WHERE md5(code) NOT IN (SELECT md5(code) FROM corpus WHERE row_id % 4 = 0) GROUP BY md5(code)", CORPUS)
def skip_known_hashes(spark, sf_dir):
    hashed = corpus(spark, sf_dir).select("row_id", F.md5("code").alias("hash"))
    return L.upsert_ignore(hashed, hashed.where("row_id % 4 = 0"), "hash", "row_id")


@query("SELECT row_id FROM corpus WHERE row_id % 4 = 0", CORPUS)
def accept_known_batches(spark, sf_dir):
    return L.accept_known(corpus(spark, sf_dir).select("row_id"), ledgers(spark, sf_dir)[0], "row_id")


@query("SELECT min(row_id) AS row_id, md5(code) AS hash FROM corpus WHERE row_id % 2 = 1 AND md5(code) NOT IN (SELECT md5(code) FROM corpus WHERE row_id % 2 = 0) GROUP BY md5(code)", CORPUS)
def upsert_ignore(spark, sf_dir):
    """The rows added to a keyed table: of its buckets only files for the new keys are written."""
    hashed = corpus(spark, sf_dir).select("row_id", F.md5("code").alias("hash"))
    held = KeyedTable.create(hashed.where("row_id % 2 = 0"), work_path(spark, "hashes"), "hash", 16)
    held.insert_new(hashed.where("row_id % 2 = 1"), "row_id")
    return held.read().where("row_id % 2 = 1").select("row_id", "hash")


@query("SELECT md5(text) AS hash, bool_or(doc_id % 2 = 1) AS completed, min(doc_id) AS created_at FROM documents GROUP BY 1")
def upsert_flag(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("row_id", F.md5("code").alias("hash"), (F.col("row_id") % 2 == 1).alias("completed"), F.col("row_id").alias("created_at"))
    first = rows.where("NOT completed").groupBy("hash").agg(F.bool_or("completed").alias("completed"), F.min("created_at").alias("created_at"))
    held = KeyedTable.create(first, work_path(spark, "flags"), "hash", 16)
    held.combine(rows.where("completed").drop("row_id"), {"completed": F.bool_or, "created_at": F.min})
    return held.read()


@query("SELECT custom_id, batch_id FROM requests WHERE custom_id NOT IN (SELECT custom_id FROM ok WHERE NOT failed)", RESPONSES, RESPONDED, REQUESTS)
def delete_matched(spark, sf_dir):
    done = parse_responses(responses(spark, sf_dir)).where("NOT failed")
    held = KeyedTable.create(requests(spark, sf_dir).select("custom_id", "batch_id"), work_path(spark, "requests"), "custom_id", 16)
    held.delete(done.select("custom_id"))
    return held.read()


# Statistics


@query(
    """SELECT class, count(x) AS n_all, round(avg(x), 6) AS mean_all, median(x) AS median_all, round(stddev_samp(x), 6) AS std_all, count(y) AS n_kept, round(avg(y), 6) AS mean_kept, median(y) AS median_kept, round(stddev_samp(y), 6) AS std_kept
    FROM (SELECT class, length(code) AS x, CASE WHEN length(code) BETWEEN 100 AND 5000 THEN length(code) END AS y FROM corpus) GROUP BY class""",
    CORPUS,
)
def length_stats(spark, sf_dir):
    found = A.length_stats(corpus(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) if c.startswith(("mean", "std")) else F.col(c) for c in found.columns])


@query(
    """SELECT class, bin::INTEGER AS bin, count(*) AS n, round(count(*) / (total * (hi - lo) / 50), 9) AS density FROM (SELECT class, lo, hi, total, least(floor((x - lo) * 50 / (hi - lo)), 49) AS bin FROM
    (SELECT class, length(code) AS x, min(length(code)) OVER w AS lo, max(length(code)) OVER w AS hi, count(*) OVER w AS total FROM corpus WINDOW w AS (PARTITION BY class))) GROUP BY class, bin, lo, hi, total""",
    CORPUS,
)
def length_histogram(spark, sf_dir):
    return A.length_histogram(corpus(spark, sf_dir)).withColumn("density", F.round("density", 9))


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in ("success", "model_used", "Score", "Body", "Title", "data")) + " FROM results", RESULTS)
def null_counts(spark, sf_dir):
    return A.null_counts(results(spark, sf_dir).select("success", "model_used", "Score", "Body", "Title", "data"))


@query("SELECT model_used, count(*) AS n FROM results GROUP BY 1 ORDER BY n DESC, 1", RESULTS)
def value_counts(spark, sf_dir):
    return A.value_counts(results(spark, sf_dir), "model_used")


@query("SELECT count(*) AS groups, avg(n) AS mean_size, max(n) AS max_size, sum(n - 1)::BIGINT AS removed FROM (SELECT count(*) AS n FROM code_files GROUP BY " + COMMENT_FREE.format("code") + ")", CODE_FILES)
def dup_group_stats(spark, sf_dir):
    return A.dup_group_stats(code_files(spark, sf_dir), T.comment_free(F.col("code")))


@query("SELECT count(*) AS original, count(DISTINCT code) AS kept, count(*) - count(DISTINCT code) AS removed FROM corpus", CORPUS)
def dedup_report(spark, sf_dir):
    return A.dedup_report(corpus(spark, sf_dir), F.sha2("code", 256))


COMPLEXITY = "m AS (SELECT id, CASE WHEN template IN (3, 4) THEN 0 ELSE depth - 1 END AS depth, CASE WHEN template IN (3, 4) THEN 0 ELSE node_types END AS node_types, CASE WHEN template IN (3, 4) THEN 0 ELSE constructs END AS constructs, complex FROM code_files JOIN shapes USING (template))"


@query(
    "SELECT count(*) AS n, count(*) FILTER (complex) AS n_complex, round(100.0 * count(*) FILTER (complex) / count(*), 6) AS percent_complex, round(avg(depth), 6) AS mean_depth, round(avg(node_types), 6) AS mean_types, round(avg(constructs), 6) AS mean_constructs FROM m",
    CODE_FILES, SHAPE_ROWS, COMPLEXITY,
)
def complexity_summary(spark, sf_dir):
    found = A.complexity_summary(complexity(measured(spark, sf_dir)))
    return found.select("n", "n_complex", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query("SELECT reason, count(*) AS n FROM rewrites GROUP BY reason", RESULTS, REWRITES)
def skip_reasons(spark, sf_dir):
    from .pipelines import rewrite_pairs

    return A.value_counts(rewrite_pairs(results(spark, sf_dir)), "reason")


TOKENS = "coalesce(sum(len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'))), 0)::BIGINT"


@query(f"SELECT {TOKENS.format('Body')} AS prompt_tokens, {TOKENS.format('AiAnswer')} AS answer_tokens FROM results", RESULTS)
def token_totals(spark, sf_dir):
    return results(spark, sf_dir).agg(*A.token_totals(F.col("Body"), F.col("AiAnswer")))


@query("SELECT label, pred, count(*) AS n FROM predictions GROUP BY 1, 2", PREDICTIONS)
def confusion_matrix(spark, sf_dir):
    return A.confusion_matrix(predictions(spark, sf_dir))


CLASSES = """s AS (SELECT c.class, count(*) FILTER (pred = class AND label = class) AS tp, count(*) FILTER (pred = class AND label <> class) AS fp, count(*) FILTER (pred <> class AND label = class) AS fn,
  count(*) FILTER (pred <> class AND label <> class) AS tn FROM predictions, (VALUES (0), (1)) c(class) GROUP BY c.class),
m AS (SELECT class, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity FROM s)"""


@query("SELECT * FROM m", PREDICTIONS, CLASSES)
def class_metrics(spark, sf_dir):
    found = A.class_metrics(predictions(spark, sf_dir))
    return found.select("class", *[F.round(c, 9).alias(c) for c in found.columns[1:]])


@query("SELECT round(avg(f1), 6) AS macro_f1, (SELECT round(avg((label = pred)::INTEGER), 6) FROM predictions) AS accuracy FROM m", PREDICTIONS, CLASSES)
def macro_f1_accuracy(spark, sf_dir):
    return A.macro_f1_accuracy(predictions(spark, sf_dir)).select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


@query("SELECT label, round(sum(count(*)) OVER () / count(*), 9) AS weight FROM predictions GROUP BY label", PREDICTIONS)
def class_weights(spark, sf_dir):
    return A.class_weights(predictions(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query("SELECT count(*) FILTER (regexp_matches(id::VARCHAR, '^[0-9]+$')) AS numeric_ids, count(*) FILTER (regexp_matches(id, '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$')) AS uuid_ids FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN vec_id::VARCHAR ELSE substr(md5(vec_id::VARCHAR), 1, 8) || '-0000-0000-0000-' || substr(md5(vec_id::VARCHAR), 1, 12) END AS id FROM embeddings)")
def id_kind_counts(spark, sf_dir):
    number = F.col("vec_id").cast("string")
    uuid = F.concat(F.substring(F.md5(number), 1, 8), F.lit("-0000-0000-0000-"), F.substring(F.md5(number), 1, 12))
    rows = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 3 == 0, number).otherwise(uuid).alias("id"))
    return rows.agg(*A.id_kinds(F.col("id")))


@query("SELECT 500::BIGINT AS total, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'assigned') AS active, 500 - count(*) FILTER (state = 'completed') AS remaining FROM states", LEASES, STATES)
def work_status(spark, sf_dir):
    return A.work_status(states(spark, sf_dir), F.lit(500).cast("long"))


@query("SELECT max(l_orderkey) AS max_id, count(*) AS n FROM lineitem")
def max_id_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("max_id"), F.count("*").alias("n"))


@query("SELECT count(*) AS processed, count(*) FILTER (failed) AS failed, round(count(*) FILTER (NOT failed) / count(*), 9) AS rate FROM ok", RESPONSES, RESPONDED)
def batch_success_rate(spark, sf_dir):
    return A.success_rate(parse_responses(responses(spark, sf_dir))).withColumn("rate", F.round("rate", 9))


@query(
    """SELECT round(avg(n), 6) AS mean_nodes, round(stddev_pop(n), 6) AS std_nodes, round(avg(trees), 6) AS mean_trees, round(avg(n) / (70 * 150), 9) AS fill
    FROM (SELECT coalesce(n, 0) AS n, coalesce(trees, 0) AS trees FROM code_files LEFT JOIN (SELECT template, sum(len(string_split(nodes, ' '))) AS n, count(*) AS trees FROM subtrees GROUP BY template) USING (template))""",
    CODE_FILES, SUBTREE_ROWS,
)
def encoding_stats(spark, sf_dir):
    from .models import encoded_files

    found = A.encoding_stats(encoded_files(spark, sf_dir))
    return found.select(*[F.round(c, 9 if c == "fill" else 6).alias(c) for c in found.columns])


@query("SELECT node_type, count(*) AS n FROM seen GROUP BY node_type ORDER BY n DESC, node_type LIMIT 10", CODE_FILES, TREE_ROWS, VOCABULARY)
def node_type_topk(spark, sf_dir):
    return A.node_type_topk(measured(spark, sf_dir).select("m.nodes"))


# Duplicates, ranks and logs


@query("SELECT row_id, full_path FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_id) AS rn FROM corpus) WHERE rn = 1", CORPUS)
def dedup_rows(spark, sf_dir):
    return R.dedup_rows(corpus(spark, sf_dir).select("row_id", "full_path", F.md5("code").alias("code")), ["code"], "row_id").select("row_id", "full_path")


@query("SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_id DESC) AS rn FROM corpus) WHERE rn = 1", CORPUS)
def dedup_rows_last(spark, sf_dir):
    return R.dedup_rows(corpus(spark, sf_dir).select("row_id", F.md5("code").alias("code")), ["code"], "row_id", "last").select("row_id")


@query("SELECT min(row_id) AS row_id FROM corpus GROUP BY code HAVING count(*) = 1", CORPUS)
def dedup_rows_none(spark, sf_dir):
    return R.dedup_rows(corpus(spark, sf_dir).select("row_id", F.md5("code").alias("code")), ["code"], "row_id", None).select("row_id")


@query("SELECT min(id) AS id, arg_min(full_path, id) AS full_path FROM code_files GROUP BY " + COMMENT_FREE.format("code"), CODE_FILES)
def dedup_normalized(spark, sf_dir):
    return R.dedup_by(code_files(spark, sf_dir).select("id", "full_path", "code"), T.comment_free(F.col("code")), "id").select("id", "full_path")


EDGES = "edges AS (SELECT [quantile_cont(length(code), i / 10) FOR i IN [1, 2, 3, 4, 5, 6, 7, 8, 9]] AS e FROM corpus)"
DECILES = """e AS (SELECT unnest(range(1, 10)) AS i), edges AS (SELECT quantile_cont(length(code), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM corpus),
deciles AS (SELECT row_id, class, len(list_filter(e, lambda x: x < length(code) - 1e-7))::INTEGER AS bin FROM corpus, edges)"""


@query("SELECT row_id, bin FROM deciles", CORPUS, DECILES)
def length_deciles(spark, sf_dir):
    return R.quantile_bins(corpus(spark, sf_dir).select("row_id", F.length("code").alias("x")), F.col("x") - F.lit(1e-7), "bin").select("row_id", "bin")


@query("SELECT full_path, row_number() OVER (ORDER BY full_path) AS row_id FROM corpus", CORPUS)
def assign_row_ids(spark, sf_dir):
    return L.row_ids(corpus(spark, sf_dir).select("full_path"), "full_path").withColumn("row_id", F.col("row_id").cast("long"))


@query("SELECT row_id, row_id // 64 AS batch_no FROM corpus", CORPUS)
def assign_batches(spark, sf_dir):
    return L.assign_batches(corpus(spark, sf_dir).select("row_id", (F.col("row_id") + 1).alias("n")), "n", 64).select("row_id", "batch_no")


@query("SELECT row_id, (row_id + 1) % 7 AS round_robin, least(row_id // 100, 6) AS ranged FROM corpus", CORPUS)
def assign_workers(spark, sf_dir):
    return L.assign_workers(corpus(spark, sf_dir).select("row_id", (F.col("row_id") + 1).alias("n")), "n", 7, 100).select("row_id", "round_robin", F.col("ranged").cast("long").alias("ranged"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT (SELECT floor(count(*) * 0.9)::BIGINT FROM documents)")
def topk_percent(spark, sf_dir):
    return R.top_percent(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 90)


@query("SELECT source, doc_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 100")
def topk_per_group(spark, sf_dir):
    return R.top_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 100)


STOPS = """r AS (SELECT *, max(f1) OVER (PARTITION BY trial ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past, max(f1) OVER (PARTITION BY trial ORDER BY epoch) AS best FROM trials),
s AS (SELECT *, epoch - max(CASE WHEN past IS NULL OR f1 > past THEN epoch END) OVER (PARTITION BY trial ORDER BY epoch) AS since FROM r),
t AS (SELECT trial, epoch, best, since, since = 5 AND sum((since >= 5)::INTEGER) OVER (PARTITION BY trial ORDER BY epoch) = 1 AS stops FROM s)"""


@query("SELECT trial, epoch, best, since, stops FROM t", TRIALS, STOPS)
def early_stopping(spark, sf_dir):
    rows = trials(spark, sf_dir).withColumn("epoch", F.col("epoch").cast("long"))
    return R.early_stopping(rows, "trial", "epoch", "f1", 5).select("trial", "epoch", "best", "since", "stops")


@query("SELECT trial, arg_max(epoch, (f1, -epoch)) AS best_epoch, max(f1) AS best FROM trials GROUP BY trial", TRIALS)
def best_epoch(spark, sf_dir):
    return R.best_epoch(trials(spark, sf_dir).withColumn("epoch", F.col("epoch").cast("long")), "trial", "epoch", "f1")


@query("SELECT trial AS best_trial, f1 FROM trials ORDER BY f1 DESC, trial LIMIT 1", TRIALS)
def best_trial(spark, sf_dir):
    return trials(spark, sf_dir).agg(F.max_by("trial", F.struct(F.col("f1"), -F.col("trial"))).alias("best_trial"), F.max("f1").alias("f1"))


@query(
    "SELECT bracket, epoch, trial, f1, rank FROM (SELECT *, count(*) OVER (PARTITION BY bracket, epoch) AS n, row_number() OVER (PARTITION BY bracket, epoch ORDER BY f1 DESC, trial) AS rank FROM trials WHERE epoch IN (1, 3, 9)) WHERE rank <= ceil(n / 3)",
    TRIALS,
)
def rung_promotions(spark, sf_dir):
    rows = trials(spark, sf_dir).withColumn("epoch", F.col("epoch").cast("long"))
    return R.rung_promotions(rows, "bracket", "epoch", "trial", "f1", [1, 3, 9], 3).select("bracket", "epoch", "trial", "f1", F.col("rank").cast("long").alias("rank"))


@query("SELECT row_id FROM corpus ORDER BY md5('42-' || row_id), row_id LIMIT 100", CORPUS)
def random_sample_n(spark, sf_dir):
    return P.sample_n(corpus(spark, sf_dir).select("row_id"), "row_id", 100, 42)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def sort_desc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


# Sets, samples and splits


@query("SELECT row_id FROM completed UNION SELECT row_id FROM blacklisted UNION SELECT row_id FROM skipped", LEDGERS)
def processed_ids(spark, sf_dir):
    return L.processed(*ledgers(spark, sf_dir))


@query("SELECT row_id, row_id % 4 = 0 AS completed, row_id % 10 = 0 AS blacklisted, row_id % 15 = 0 AS skipped FROM corpus", CORPUS)
def processed_probe(spark, sf_dir):
    done, black, skip = ledgers(spark, sf_dir)
    return L.probe(corpus(spark, sf_dir).select("row_id"), "row_id", completed=done, blacklisted=black, skipped=skip)


@query("SELECT text AS code, 0 AS label, lang FROM documents UNION ALL SELECT text AS code, 1 AS label, NULL AS lang FROM benchmark")
def concat_tables(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("text").alias("code"), F.lit(0).alias("label"), "lang")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.col("text").alias("code"), F.lit(1).alias("label")), allowMissingColumns=True)


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("SELECT md5(text) AS hash FROM documents EXCEPT SELECT md5(text) FROM documents WHERE doc_id % 4 = 0")
def new_hashes(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    return hashed.select("hash").subtract(hashed.where("doc_id % 4 = 0").select("hash"))


@query("SELECT row_id FROM corpus WHERE ('0x' || substr(md5('5-' || row_id), 1, 8))::BIGINT < 1073741824", CORPUS)
def sample_percent(spark, sf_dir):
    return P.sample_percent(corpus(spark, sf_dir).select("row_id"), "row_id", 25, 5)


PLACED = "placed AS (SELECT row_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('{seed}-' || row_id), row_id) AS place, count(*) OVER (PARTITION BY class) AS size FROM {source})"
LEAST = "(SELECT min(size) FROM placed)"


def classes(spark, sf_dir):
    return corpus(spark, sf_dir).select("row_id", "class")


@query(f"SELECT row_id, class FROM placed WHERE place <= {LEAST}", CORPUS, PLACED.format(seed=1, source="corpus"))
def balance_classes(spark, sf_dir):
    return P.balance_classes(classes(spark, sf_dir), "class", "row_id", 1)


@query("SELECT row_id, bin FROM (SELECT row_id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42-' || row_id), row_id) AS place FROM deciles) WHERE place <= 20", CORPUS, DECILES)
def stratified_sample(spark, sf_dir):
    binned = R.quantile_bins(corpus(spark, sf_dir).select("row_id", F.length("code").alias("x")), F.col("x") - F.lit(1e-7), "bin").select("row_id", "bin")
    return P.stratified_sample(binned, ["bin"], "row_id", 200, 10, 42)


@query("SELECT row_id, class, place <= floor(0.1 * size) AS is_test FROM placed", CORPUS, PLACED.format(seed=123, source="corpus"))
def train_test_split(spark, sf_dir):
    return P.split(classes(spark, sf_dir), "class", "row_id", 0.1, 123)


@query(f"SELECT row_id, class, place <= floor(0.1 * {LEAST}) AS is_test FROM placed", CORPUS, PLACED.format(seed=7, source="corpus"))
def balanced_test_split(spark, sf_dir):
    return P.balanced_test_split(classes(spark, sf_dir), "class", "row_id", 0.1, 7)


@query(
    f"SELECT row_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('4-' || row_id), row_id) <= floor(0.1 * {LEAST}) AS is_test FROM placed WHERE place <= {LEAST}",
    CORPUS, PLACED.format(seed=3, source="corpus"),
)
def balanced_split(spark, sf_dir):
    return P.balanced_split(classes(spark, sf_dir), "class", "row_id", 0.1, 3)


@query("SELECT row_id, class, place <= floor(0.1 * size) AS is_val FROM placed", CORPUS, PLACED.format(seed=5, source="corpus"))
def train_val_split(spark, sf_dir):
    return P.split(classes(spark, sf_dir), "class", "row_id", 0.1, 5, "is_val")
