"""Loaders of graded answers applied to the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.plans.proxy import table
from scoreloom.sources import graded


def short_answer_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as short answers of the sets 0 to 11, of which nations give 1 to 9 a prompt; some scores are no numbers or too high."""
    d = table(spark, sf_dir, "documents")
    score = lambda k: F.when(F.col("n_chars") % 13 == k, "nan").when(F.col("n_chars") % 11 == k, "7").otherwise((F.col("n_chars") % 3).cast("string"))
    rows = d.select(F.col("doc_id").cast("string").alias("Id"), (F.col("doc_id") % 12).cast("string").alias("EssaySet"), score(0).alias("Score1"), score(1).alias("Score2"), F.when(F.col("n_chars") % 17 > 0, F.col("text")).otherwise(" ").alias("EssayText"))
    prompts = table(spark, sf_dir, "nation").where("n_nationkey BETWEEN 1 AND 9").select(F.col("n_nationkey").cast("string").alias("essay_set"), F.col("n_name").alias("prompt"), F.lit("r").alias("rubric"))
    return graded.short_answers(rows, prompts).select("source_id", "item_id", "essay_set", "prompt", "gold", "score_max", "reason")


def essay_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as essays with three dimensions and a total that is wrong, missing or no number now and then."""
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    total = F.when(n % 7 == 0, "").when(n % 7 == 1, "six").when(n % 7 == 2, "1").otherwise((n % 5 + n % 6 + n % 4).cast("string"))
    rows = d.select(
        F.concat("source", F.lit(".tsv")).alias("file"), F.when(n % 19 > 0, F.col("doc_id").cast("string")).otherwise("").alias("id"), F.when(n % 23 > 0, F.col("lang")).otherwise(" ").alias("prompt"), F.col("text").alias("essay"),
        (n % 5).cast("string").alias("content"), F.when(n % 29 > 0, (n % 6).cast("string")).otherwise("5.5").alias("organization"), F.when(n % 31 > 0, (n % 4).cast("string")).otherwise("-").alias("language"), total.alias("total"),
    )
    return graded.essays(rows).groupBy("file", "reason", "total_status").agg(F.count("*").alias("essays"), F.sum("gold").alias("gold"), F.min("item_id").alias("first_item"))


def indexed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON records by type, whose ids are users and values: kept lines, and the rest by reason."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    ident = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor("value").cast("string"))
    value = F.when(k % 41 == 0, "{").when(k % 43 == 0, "[1]").when(k % 47 == 0, '{"x": 1}').when(k % 53 == 0, " ").otherwise(F.to_json(F.struct(ident.alias("id"))))
    kept, bad = graded.indexed_records(e.select(F.col("event_type").alias("file"), k.alias("line"), value.alias("value")), "text")
    return kept.select("file", "line", "id", F.lit("kept").alias("reason")).unionByName(bad.select("file", "line", "id", "reason"))


QUERIES = {f.__name__: f for f in (short_answer_loading, essay_loading, indexed_lines)}
ORACLES = {
    "short_answer_loading": """WITH d AS (SELECT doc_id, doc_id % 12 AS s, n_chars AS n, CASE WHEN n_chars % 13 = 0 THEN NULL WHEN n_chars % 11 = 0 THEN 7 ELSE n_chars % 3 END AS s1,
          CASE WHEN n_chars % 13 = 1 THEN NULL WHEN n_chars % 11 = 1 THEN 7 ELSE n_chars % 3 END AS s2, CASE WHEN n_chars % 17 > 0 THEN coalesce(trim(text, ' '), '') ELSE '' END AS answer FROM documents),
        r AS (SELECT d.*, CASE WHEN s BETWEEN 1 AND 10 THEN CASE WHEN s IN (1, 2, 5, 6) THEN 3 ELSE 2 END END::DOUBLE AS top, n_name FROM d LEFT JOIN nation ON n_nationkey = s AND s BETWEEN 1 AND 9),
        j AS (SELECT *, CASE WHEN top IS NULL THEN 'unsupported_essay_set' WHEN n_name IS NULL THEN 'missing_official_prompt_or_rubric' WHEN answer = '' THEN 'missing_student_answer'
          WHEN s1 IS NULL OR s2 IS NULL THEN 'invalid_score' WHEN s1 > top THEN 'score1_out_of_range' WHEN s2 > top THEN 'score2_out_of_range' END AS reason FROM r)
        SELECT doc_id::VARCHAR AS source_id, CASE WHEN reason IS NULL THEN 'semantic_v2_set_' || lpad(s::VARCHAR, 2, '0') || '_' || doc_id END AS item_id, s::VARCHAR AS essay_set, n_name AS prompt,
        CASE WHEN reason IS NULL THEN s1::DOUBLE END AS gold, top AS score_max, reason FROM j""",
    "essay_loading": """WITH d AS (SELECT source || '.tsv' AS file, source, doc_id, n_chars AS n, coalesce(trim(text, ' '), '') AS answer, (n_chars % 5 + n_chars % 6 + n_chars % 4)::DOUBLE AS gold FROM documents),
        j AS (SELECT *, CASE WHEN n % 19 = 0 THEN 'missing_source_record_id' WHEN n % 23 = 0 THEN 'missing_prompt' WHEN answer = '' THEN 'missing_student_essay' WHEN n % 31 = 0 THEN 'invalid_dimension_score'
          WHEN n % 29 = 0 THEN 'dimension_score_out_of_range' END AS reason,
          CASE WHEN n % 7 = 0 THEN 'missing' WHEN n % 7 = 1 THEN 'invalid' WHEN n % 7 = 2 AND gold <> 1 THEN 'conflict' ELSE 'match' END AS status FROM d),
        s AS (SELECT *, CASE WHEN reason IS NULL THEN status END AS total_status, CASE WHEN reason IS NULL THEN gold END AS g, CASE WHEN reason IS NULL THEN 'semantic_v2_' || source || '_' || doc_id END AS item FROM j)
        SELECT file, reason, total_status, count(*) AS essays, sum(g) AS gold, min(item) AS first_item FROM s GROUP BY ALL""",
    "indexed_lines": """WITH e AS (SELECT event_type AS file, event_id AS line, CASE WHEN event_id % 41 = 0 THEN 'invalid_text_json' WHEN event_id % 43 = 0 THEN 'invalid_text_record_type'
          WHEN event_id % 47 = 0 THEN 'missing_text_record_id' WHEN event_id % 53 = 0 THEN 'blank' END AS fault, user_id || '-' || floor(value)::BIGINT AS id FROM events),
        g AS (SELECT file, line, id, CASE WHEN count(*) OVER (PARTITION BY file, id) = 1 THEN 'kept' WHEN line > min(line) OVER (PARTITION BY file, id) THEN 'duplicate_text_record_id' END AS reason FROM e WHERE fault IS NULL)
        SELECT file, line, id, reason FROM g WHERE reason IS NOT NULL UNION ALL SELECT file, line, NULL, fault FROM e WHERE fault <> 'blank'""",
}
