"""Normalisation, identity, leakage, audit and set queries over text items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import score, text
from scoreloom.operators import audit, components
from scoreloom.plans.proxy import table


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: dataset, prompt group, answer, gold, and a split by id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("dataset"), F.col("source").alias("prompt_group"), F.col("text").alias("answer"), F.col("quality").alias("gold"), "n_chars", split.alias("split")
    )


def normalize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under other names: aliases in their order, texts trimmed, defaults, identifiers, group hashes and derived lengths.

    A document is a record with the fields response (its text), question (its first line), question_id (null for every fifth
    length), id (empty for documents without a label), domain1_score and min_score; max_score and rubric are missing."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    r = d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row"), F.col("lang").alias("dataset"), F.col("text").alias("response"), F.split("text", "\n")[0].alias("question"),
        F.when(F.col("n_chars") % 5 > 0, F.col("source")).alias("question_id"), F.when(F.col("quality").isNull(), "").otherwise(F.col("doc_id").cast("string")).alias("id"),
        F.col("quality").cast("double").alias("domain1_score"), F.lit(0.0).alias("min_score"),
    )
    pick = lambda name, default=None: text.first_present(r.columns, text.ALIASES[name], default)
    prompt, answer, rubric = F.trim(pick("prompt", "")), F.trim(pick("student_answer", "")), pick("rubric", "score by the rules of the dataset")
    group = F.trim(F.coalesce(pick("prompt_group"), F.substring(prompt, 1, 80)))
    low, high = pick("score_min", 0.0).cast("double"), pick("score_max", 1.0).cast("double")
    fault = F.when(~(high > low), "score_range").when(pick("gold_score").isNull(), "gold_score").when(~pick("gold_score").between(low, high), "gold_range")
    return r.select(
        "row", text.stable_id(F.col("dataset"), F.trim(pick("item_id", "")), group, answer).alias("item_id"), F.md5(text.normalize_text(answer).cast("binary")).alias("normalized_md5"),
        text.group_hash(group).alias("group_hash"), F.length(prompt).cast("long").alias("prompt_length"), F.length(answer).cast("long").alias("answer_length"), F.length(rubric).cast("long").alias("rubric_length"),
        pick("gold_score").alias("gold_score"), low.alias("score_min"), high.alias("score_max"), (F.trim(pick("reference_answer", "")) != "").alias("has_reference"), fault.alias("fault"),
    )


def static_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = text_items(spark, sf_dir)
    c = text.static_complexity(F.col("prompt_group"), F.col("answer"), F.lit(""), F.col("dataset"), F.col("dataset") == "en")
    return i.select("item_id", F.floor(c * 1_000_000 + 0.5).alias("complexity_millionths"))


def stable_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = text_items(spark, sf_dir)
    return i.select("item_id", text.stable_unit(F.concat_ws(":", "dataset", "item_id")).alias("unit"), text.stable_hash(F.col("dataset"), F.col("item_id"), F.col("split")).alias("hash"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of a cached call from nine parts."""
    i = text_items(spark, sf_dir)
    parts = [F.col("item_id"), F.lit("cheap"), F.lit("run1"), F.col("split"), F.lit("fixture"), F.lit("model-1"), F.lit("v1"), F.sha2(F.col("answer").cast("binary"), 256), F.lit("schema1")]
    return i.select("item_id", text.stable_hash(*parts).alias("cache_key"))


def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = text_items(spark, sf_dir)
    marked = F.concat_ws(" ", "answer", F.when(F.col("n_chars") % 7 == 0, "see  Data_Set_Descriptions.zip").when(F.col("n_chars") % 7 == 1, "TBD").when(F.col("n_chars") % 7 == 2, "todo"))
    return i.groupBy("dataset").agg(F.count_if(text.is_placeholder(F.col("answer"))).alias("placeholders"), F.count_if(text.is_placeholder(marked)).alias("marked"), F.count_if(F.col("answer").rlike(r"(?i)license")).alias("licensed"))


def api_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of calls: token counts from the text, rates by exact model name or by its name without a trailing version."""
    t = table(spark, sf_dir, "conversations")
    calls = t.select("conv_id", "turn", F.concat(F.lit("m-a-b"), F.when(F.col("turn") % 2 == 0, "-20260101").otherwise("")).alias("model"), (F.length("text") * 400).cast("long").alias("inputs"), F.floor(F.length("text") / 2).cast("long").alias("cached"), F.col("turn").cast("long").alias("written"), F.length("role").cast("long").alias("outputs"))
    rates = spark.createDataFrame([("m-a-b", 2.0, 0.5, 2.5, 8.0)], "model string, r_in double, r_cached double, r_write double, r_out double")
    base = F.when(F.size(F.split("model", "-")) > 3, F.regexp_replace("model", r"-\d+$", "")).otherwise(F.col("model"))
    exact = calls.join(F.broadcast(rates), "model", "left").withColumn("base", base)
    loose = rates.select(F.col("model").alias("base"), *[F.col(c).alias(f"{c}_b") for c in rates.columns[1:]])
    priced = exact.join(F.broadcast(loose), "base", "left")
    pick = lambda c: F.coalesce(c, f"{c}_b")
    cost = score.api_cost(F.col("inputs"), F.col("cached"), F.col("written"), F.col("outputs"), {"input": pick("r_in"), "cached": pick("r_cached"), "write": pick("r_write"), "output": pick("r_out")})
    return priced.select("conv_id", "turn", "model", F.floor(cost * 1e6 + 0.5).alias("cost_millionths"))


def leakage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share any of five keys are never separated: dataset and prompt group, the prompt's normalised text, prompt and
    answer, dataset, file and record, dataset and an existing component. Documents give them: a text's first line, where it has more
    than one, is the prompt, source and length are the group, toxic ones of a language are an existing component."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lines = F.split("text", "\n")
    prompt = F.when(F.size(lines) > 1, text.normalize_text(lines[0]))
    i = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("dataset"), F.concat_ws("/", "source", "n_chars").alias("prompt_group"), prompt.alias("prompt"),
        text.normalize_text(F.col("text")).alias("answer"), F.col("source").alias("file"), F.col("doc_id").cast("string").alias("record"), F.when(F.col("toxic") == 1, "toxic").alias("existing"),
    )
    labels = components.leakage_components(i, [["dataset", "prompt_group"], ["prompt"], ["prompt", "answer"], ["dataset", "file", "record"], ["dataset", "existing"]])
    return labels.join(components.component_names(labels), "component").select("item_id", "component", "component_id", "size")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key values that occur in more than one split, by family."""
    i = text_items(spark, sf_dir)
    normal = F.md5(text.normalize_text(F.col("answer")).cast("binary"))
    return audit.spanning(i, {"item_id": [F.col("item_id").cast("string")], "prompt_group": [F.col("dataset"), F.col("prompt_group")], "answer": [normal], "source": [F.col("prompt_group"), F.col("n_chars").cast("string")]})


def item_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = text_items(spark, sf_dir)
    return audit.violations(
        i,
        {"item_id": F.col("item_id") >= 0, "answer": audit.not_blank("answer"), "gold_missing": F.col("gold").isNotNull(), "gold_range": F.col("gold").isNull() | F.col("gold").between(0, 1), "length": F.length("answer") == F.col("n_chars"), "dataset": F.col("dataset").isin("en", "de", "fr", "es"), "short": F.length("answer") >= 50},
        ["item_id"],
    )


def paper_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with too many lines, repeated parts or a negative total."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_linenumber").alias("numbers"))
    o = table(spark, sf_dir, "orders").join(line, "o_orderkey", "left")
    return audit.violations(o, {"items": F.col("n").between(1, 7), "unique_parts": F.col("n") == F.col("parts"), "positions": F.col("n") == F.col("numbers"), "budget": audit.finite("o_totalprice") & (F.col("o_totalprice") >= 0)}, ["o_orderkey"])


def output_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scorer outputs: value finite and not negative, known type, JSON props, user present."""
    e = table(spark, sf_dir, "events")
    rules = {"value": audit.finite("value") & (F.col("value") >= 0), "range": F.col("value") <= 100, "type": F.col("event_type").isin("click", "view", "purchase"), "props": F.try_parse_json("props").isNotNull(), "user": F.col("user_id").isNotNull()}
    return audit.violations(e, rules, ["event_id"])


def set_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled, unlabelled and all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return audit.accounting(labels, docs.join(labels, "doc_id", "left_anti"), docs, "doc_id")


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def drop_all_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose id repeats are all quarantined; the others are kept."""
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))
    return keys.groupBy(F.when(F.col("copies") > 1, "duplicate_record_id").otherwise("accepted").alias("reason")).agg(F.sum("copies").alias("records"))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as expected from customers against nations as found at suppliers."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count_if(F.col("c_acctbal") > 0).alias("v"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count_if(F.col("s_acctbal") > 0).alias("v"))
    return audit.reconcile(c, s, ["k"], ["v"])


def asset_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a nation's customers and orders name the same market segments."""
    c = table(spark, sf_dir, "customer")
    used = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_mktsegment")
    return audit.same_sets(c.select("c_nationkey", "c_mktsegment"), used, "c_nationkey", "c_mktsegment")


def scope_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the scope of the manifest (large lines), and orders without any."""
    o = table(spark, sf_dir, "orders")
    scope = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    inside, outside = o.join(scope, "o_orderkey", "left_semi"), o.join(scope, "o_orderkey", "left_anti")
    count = lambda df, name: df.groupBy("o_orderpriority").agg(F.count("*").alias("orders")).withColumn("part", F.lit(name))
    return count(inside, "inside").unionByName(count(outside, "outside"))


def several_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are sold under every return flag."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags"))
    return flags.groupBy("flags").agg(F.count("*").alias("parts"))


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, groups and score sums per dataset and split, with ALL rows."""
    i = text_items(spark, sf_dir)
    all_ = lambda c: F.when(F.grouping(c) == 1, "ALL").otherwise(F.col(c)).alias(c)
    return i.cube("dataset", "split").agg(F.count("*").alias("items"), F.count_distinct("prompt_group").alias("groups"), F.sum("gold").cast("long").alias("gold"), all_("dataset").alias("d"), all_("split").alias("s")).select("d", "s", "items", "groups", "gold")


def mix_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of each order as 'A:1;R:2', and how often each mix occurs."""
    mix = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text.mix_label(F.collect_list("l_returnflag")).alias("mix"))
    return mix.groupBy("mix").agg(F.count("*").alias("papers"))


def semantic_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, passed, detail): every check once, passed or not."""
    i = text_items(spark, sf_dir)
    counts = i.agg(F.count("*").alias("items"), F.count_if(F.trim("answer") == "").alias("blank"), (F.count("*") - F.count_distinct("item_id")).alias("repeated"), F.count_if(F.col("gold").isNull()).alias("unlabelled"))
    long = counts.unpivot([], ["blank", "repeated", "unlabelled"], "check", "detail")
    return long.select("check", (F.col("detail") == 0).alias("passed"), F.col("detail").alias("detail"))


_ITEMS = """items AS (
  SELECT d.doc_id AS item_id, lang AS dataset, source AS prompt_group, text AS answer, quality AS gold, n_chars,
         CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
def _placeholders(c: str) -> str:
    tests = [rf"regexp_matches({c}, '{p}', 'i')" for p in (r"see\s+data_set_descriptions\.zip", r"see\s+training_materials\.zip", r"\bplaceholder(\s+text)?\b")]
    return f"count(*) FILTER ({' OR '.join(tests)} OR {c} IS NULL OR regexp_matches({c}, '" + r"\b(TODO|TBD)\b" + "'))"


_NORMAL = r"trim(regexp_replace(lower(answer), '[\s\x0B\x85\p{Z}]+', ' ', 'g'))"

QUERIES = {
    f.__name__: f
    for f in (
        normalize_items, static_complexity, stable_unit, cache_key, placeholder_filter, api_cost, leakage_components, split_leakage, item_violations, paper_violations, output_violations,
        set_accounting, duplicate_ids, drop_all_copies, manifest_diff, asset_sets, scope_semi_anti, several_splits, distribution, mix_labels, semantic_readiness,
    )
}
ORACLES = {
    "normalize_items": rf"""WITH r AS (SELECT d.doc_id AS row, lang AS dataset, trim(text) AS answer, trim(split_part(text, chr(10), 1)) AS prompt, CASE WHEN n_chars % 5 > 0 THEN source END AS question_id,
          CASE WHEN quality IS NULL THEN '' ELSE d.doc_id::VARCHAR END AS id, quality::DOUBLE AS gold_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
        g AS (SELECT *, trim(coalesce(question_id, substr(prompt, 1, 80))) AS grp FROM r)
        SELECT row, dataset || '_' || CASE WHEN id <> '' THEN id ELSE substr(sha1(concat_ws(chr(10), dataset, grp, answer)), 1, 16) END AS item_id, md5({_NORMAL}) AS normalized_md5,
        substr(sha256({_NORMAL.replace("answer", "grp")}), 1, 20) AS group_hash, length(prompt)::BIGINT AS prompt_length, length(answer)::BIGINT AS answer_length, 33::BIGINT AS rubric_length, gold_score,
        0.0::DOUBLE AS score_min, 1.0::DOUBLE AS score_max, false AS has_reference, CASE WHEN gold_score IS NULL THEN 'gold_score' WHEN gold_score NOT BETWEEN 0 AND 1 THEN 'gold_range' END AS fault FROM g""",
    "static_complexity": rf"""WITH {_ITEMS}, w AS (SELECT *, list_filter(regexp_split_to_array(lower(answer), '[\s\x0B\x85\p{{Z}}]+'), lambda x: x <> '') AS words FROM items)
        SELECT item_id, floor((0.15::DOUBLE * least(1.0::DOUBLE, length(prompt_group) / 600.0::DOUBLE) + 0.35::DOUBLE * least(1.0::DOUBLE, length(answer) / 1800.0::DOUBLE) + 0.15::DOUBLE * 0
            + 0.10::DOUBLE * least(1.0::DOUBLE, length(dataset) / 900.0::DOUBLE) + 0.10::DOUBLE * (len(list_distinct(words)) / greatest(1, len(words))::DOUBLE)
            + 0.05::DOUBLE * ((contains(answer, chr(10))::INT + contains(answer, '=')::INT + contains(answer, '{{')::INT + contains(answer, '}}')::INT + contains(answer, '```')::INT) / 5.0::DOUBLE)
            + 0.10::DOUBLE * CASE WHEN dataset = 'en' THEN 1.0 ELSE 0.0 END) * 1000000 + 0.5)::BIGINT AS complexity_millionths FROM w""",
    "stable_unit": f"""WITH {_ITEMS} SELECT item_id, ('0x' || substr(sha256(dataset || ':' || item_id), 1, 16))::UBIGINT::DOUBLE / 1.8446744073709552e19 AS unit,
        sha256(concat_ws(chr(31), dataset, item_id, split)) AS hash FROM items""",
    "cache_key": f"WITH {_ITEMS} SELECT item_id, sha256(concat_ws(chr(31), item_id, 'cheap', 'run1', split, 'fixture', 'model-1', 'v1', sha256(answer), 'schema1')) AS cache_key FROM items",
    "placeholder_filter": rf"""WITH {_ITEMS}, m AS (SELECT *, concat_ws(' ', answer, CASE n_chars % 7 WHEN 0 THEN 'see  Data_Set_Descriptions.zip' WHEN 1 THEN 'TBD' WHEN 2 THEN 'todo' END) AS marked FROM items)
        SELECT dataset, {_placeholders("answer")} AS placeholders, {_placeholders("marked")} AS marked, count(*) FILTER (regexp_matches(answer, 'license', 'i')) AS licensed FROM m GROUP BY dataset""",
    "api_cost": """WITH c AS (SELECT conv_id, turn, 'm-a-b' || CASE WHEN turn % 2 = 0 THEN '-20260101' ELSE '' END AS model, length(text) * 400 AS i, length(text) // 2 AS k, turn AS w, length(role) AS o FROM conversations)
        SELECT conv_id, turn, model, floor(((CASE WHEN i > 272000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) * ((i - k - w) * 2.0::DOUBLE + k * 0.5::DOUBLE + w * 2.5::DOUBLE)
            + (CASE WHEN i > 272000 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * o * 8.0::DOUBLE) / 1e6::DOUBLE * 1e6::DOUBLE + 0.5)::BIGINT AS cost_millionths FROM c""",
    "leakage_components": rf"""WITH RECURSIVE i AS (SELECT d.doc_id AS item_id, lang, source, n_chars, toxic, {_NORMAL.replace("answer", "text")} AS answer,
          CASE WHEN contains(text, chr(10)) THEN {_NORMAL.replace("answer", "split_part(text, chr(10), 1)")} END AS prompt FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
        k AS (SELECT item_id, concat_ws(chr(31), 'g', lang, source, n_chars) AS key FROM i UNION ALL SELECT item_id, 'p' || prompt FROM i WHERE prompt <> ''
          UNION ALL SELECT item_id, 'a' || prompt || chr(31) || answer FROM i WHERE prompt <> '' AND answer <> '' UNION ALL SELECT item_id, concat_ws(chr(31), 'r', lang, source, item_id) FROM i
          UNION ALL SELECT item_id, 'x' || lang FROM i WHERE toxic = 1),
        h AS (SELECT item_id, min(item_id) OVER (PARTITION BY key) AS hub FROM k), e AS (SELECT item_id AS a, hub AS b FROM h UNION SELECT hub, item_id FROM h),
        r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
        l AS (SELECT node AS item_id, min(seen) AS component FROM r GROUP BY node),
        b AS (SELECT component, substr(sha256(item_id::VARCHAR), 1, 3) AS bucket, sha256(string_agg(item_id::VARCHAR, chr(10) ORDER BY item_id::VARCHAR)) AS d, count(*) AS c FROM l GROUP BY ALL),
        n AS (SELECT component, 'leakage_' || substr(sha256(string_agg(d, chr(10) ORDER BY bucket)), 1, 20) AS component_id, sum(c)::BIGINT AS size FROM b GROUP BY component)
        SELECT item_id, component, component_id, size FROM l JOIN n USING (component)""",
    "split_leakage": f"""WITH {_ITEMS}, f AS (SELECT 'item_id' AS family, item_id::VARCHAR AS key, split FROM items UNION ALL SELECT 'prompt_group', dataset || chr(31) || prompt_group, split FROM items
        UNION ALL SELECT 'answer', md5({_NORMAL}), split FROM items UNION ALL SELECT 'source', prompt_group || chr(31) || n_chars, split FROM items)
        SELECT family, key, count(DISTINCT split) AS splits FROM f GROUP BY family, key HAVING count(DISTINCT split) > 1""",
    "item_violations": f"""WITH {_ITEMS}, v AS (SELECT item_id, concat_ws(';', CASE WHEN NOT item_id >= 0 THEN 'item_id' END, CASE WHEN trim(answer) = '' THEN 'answer' END, CASE WHEN gold IS NULL THEN 'gold_missing' END,
        CASE WHEN gold NOT BETWEEN 0 AND 1 THEN 'gold_range' END, CASE WHEN length(answer) <> n_chars THEN 'length' END, CASE WHEN dataset NOT IN ('en', 'de', 'fr', 'es') THEN 'dataset' END,
        CASE WHEN length(answer) < 50 THEN 'short' END) AS failed FROM items) SELECT item_id, failed FROM v WHERE failed <> ''""",
    "paper_violations": """WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_orderkey),
        v AS (SELECT o_orderkey, concat_ws(';', CASE WHEN coalesce(n NOT BETWEEN 1 AND 7, true) THEN 'items' END, CASE WHEN coalesce(n <> parts, true) THEN 'unique_parts' END,
        CASE WHEN coalesce(n <> numbers, true) THEN 'positions' END, CASE WHEN NOT (o_totalprice >= 0 AND isfinite(o_totalprice)) THEN 'budget' END) AS failed FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
        SELECT o_orderkey, failed FROM v WHERE failed <> ''""",
    "output_violations": """WITH v AS (SELECT event_id, concat_ws(';', CASE WHEN coalesce(NOT (isfinite(value) AND value >= 0), true) THEN 'value' END, CASE WHEN coalesce(value > 100, true) THEN 'range' END,
        CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'type' END, CASE WHEN NOT coalesce(json_valid(props), false) THEN 'props' END, CASE WHEN user_id IS NULL THEN 'user' END) AS failed FROM events)
        SELECT event_id, failed FROM v WHERE failed <> ''""",
    "set_accounting": """SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS used, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS left_over, count(*) AS total, 0::BIGINT AS in_both, 0::BIGINT AS missing,
        (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown FROM (SELECT DISTINCT doc_id FROM documents)""",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "drop_all_copies": """WITH c AS (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
        SELECT CASE WHEN n > 1 THEN 'duplicate_record_id' ELSE 'accepted' END AS reason, count(*) AS records FROM c GROUP BY 1""",
    "manifest_diff": """WITH c AS (SELECT c_nationkey AS k, count(*) FILTER (c_acctbal > 0) AS v FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) FILTER (s_acctbal > 0) AS v FROM supplier GROUP BY 1),
        j AS (SELECT coalesce(c.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' WHEN c.k IS NULL THEN 'stale' WHEN c.v IS DISTINCT FROM s.v THEN 'mismatch' END AS fault FROM c FULL JOIN s ON c.k = s.k)
        SELECT k, fault FROM j WHERE fault IS NOT NULL""",
    "asset_sets": """WITH a AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), b AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey, bool_and(a.c_nationkey IS NOT NULL AND b.c_nationkey IS NOT NULL) AS equal
        FROM a FULL JOIN b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment GROUP BY 1""",
    "scope_semi_anti": """SELECT o_orderpriority, count(*) AS orders, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) THEN 'inside' ELSE 'outside' END AS part FROM orders GROUP BY ALL""",
    "several_splits": """WITH f AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) SELECT flags, count(*) AS parts FROM f GROUP BY 1""",
    "distribution": f"""WITH {_ITEMS} SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS d, CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS s, count(*) AS items,
        count(DISTINCT prompt_group) AS groups, sum(gold)::BIGINT AS gold FROM items GROUP BY CUBE (dataset, split)""",
    "mix_labels": """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, string_agg(l_returnflag || ':' || n, ';' ORDER BY l_returnflag) AS mix FROM c GROUP BY 1)
        SELECT mix, count(*) AS papers FROM m GROUP BY mix""",
    "semantic_readiness": f"""WITH {_ITEMS}, c(blank, repeated, unlabelled) AS (SELECT count(*) FILTER (trim(answer) = ''), count(*) - count(DISTINCT item_id), count(*) FILTER (gold IS NULL) FROM items)
        SELECT 'blank' AS "check", blank = 0 AS passed, blank AS detail FROM c UNION ALL SELECT 'repeated', repeated = 0, repeated FROM c UNION ALL SELECT 'unlabelled', unlabelled = 0, unlabelled FROM c""",
}
