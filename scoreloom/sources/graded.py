"""Loaders of graded answers: every record is accepted or quarantined under the first rule that it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lowest and highest score of the essay sets.
SET_RANGES = {"1": (0, 3), "2": (0, 3), "3": (0, 2), "4": (0, 2), "5": (0, 3), "6": (0, 3), "7": (0, 2), "8": (0, 2), "9": (0, 2), "10": (0, 2)}
# Dimensions of an essay, and their highest score.
TRAITS, TRAIT_MAX = ["content", "organization", "language"], 5.0
# Fixed value: how far sums may differ from stated totals.
TOLERANCE = 1e-6

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(x: Column) -> Column:
    """A text as a finite number, else null."""
    n = F.when(x.rlike(_NUMBER), F.trim(x).try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds; null where none does. A condition that is null does not hold."""
    out = F
    for name, holds in rules:
        out = out.when(holds, name)
    return out


def _blank(x: str) -> Column:
    return F.coalesce(F.trim(F.col(x)), F.lit("")) == ""


def subject_of(file: Column) -> Column:
    """Second part of a file's name between underscores, or empty."""
    return F.coalesce(F.get(F.split(F.split(file, r"\.translated\.jsonl")[0], "_"), F.lit(1)), F.lit(""))


def question_type_of(file: Column) -> Column:
    name = F.lower(file)
    return F.when(name.contains("choice"), "choice").when(name.contains("gapfilling"), "gap_filling").otherwise("short_answer")


def short_answers(rows: DataFrame, resources: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Rows (Id, EssaySet, Score1, Score2, EssayText, all texts) with the prompt and rubric of ``resources`` (essay_set, prompt, rubric):
    (item_id, source_id, essay_set, prompt, rubric, answer, gold, score_min, score_max, reason). Gold is the first score; ``reason`` is null for
    accepted rows, whose ``item_id`` is not. An empty Id gives a null ``source_id``."""
    ranges = F.create_map(*[F.lit(v) for k, (a, b) in SET_RANGES.items() if required is None or k in required for v in (k, f"{a},{b}")])
    r = rows.select(F.trim("Id").alias("_id"), F.trim("EssaySet").alias("essay_set"), finite(F.col("Score1")).alias("s1"), finite(F.col("Score2")).alias("s2"), F.col("EssayText").alias("answer"))
    r = r.withColumn("_range", F.split(F.try_element_at(ranges, F.coalesce("essay_set", F.lit(""))), ","))
    low, high = F.col("_range")[0].cast("double"), F.col("_range")[1].cast("double")
    r = r.withColumn("score_min", low).withColumn("score_max", high)
    j = r.join(resources.select("essay_set", "prompt", "rubric", F.lit(True).alias("_there")), "essay_set", "left")
    inside = lambda c: F.col(c).between(F.col("score_min"), F.col("score_max"))
    reason = first_reason([
        ("unsupported_essay_set", F.col("_range").isNull()), ("missing_official_prompt_or_rubric", F.col("_there").isNull()), ("missing_student_answer", _blank("answer")),
        ("invalid_score", F.col("s1").isNull() | F.col("s2").isNull()), ("score1_out_of_range", ~inside("s1")), ("score2_out_of_range", ~inside("s2")),
    ])
    source = F.when(F.col("_id") != "", F.col("_id"))
    item = F.concat(F.lit("semantic_v2_set_"), F.lpad("essay_set", 2, "0"), F.lit("_"), F.coalesce(source, F.lit("")))
    return j.withColumn("reason", reason).select(
        F.when(F.col("reason").isNull(), item).alias("item_id"), source.alias("source_id"), "essay_set", "prompt", "rubric", "answer", F.when(F.col("reason").isNull(), F.col("s1")).alias("gold"), "score_min", "score_max", "reason"
    )


def essays(rows: DataFrame) -> DataFrame:
    """Rows (file, id, prompt, essay, content, organization, language, total, all texts):
    (item_id, file, source_id, prompt, answer, gold, raw_total, total_status, reason). Gold is the sum of the dimensions; the stated total only
    gets a status: match, conflict, missing or invalid. Both are null for quarantined rows."""
    r = rows.select("file", F.trim("id").alias("id"), F.trim("prompt").alias("prompt"), F.trim("essay").alias("answer"), *[finite(F.col(t)).alias(t) for t in TRAITS], F.trim("total").alias("total"))
    missing = F.lit(False)
    outside = F.lit(False)
    for t in TRAITS:
        missing, outside = missing | F.col(t).isNull(), outside | ~F.col(t).between(0.0, TRAIT_MAX)
    reason = first_reason([
        ("missing_source_record_id", _blank("id")), ("missing_prompt", _blank("prompt")), ("missing_student_essay", _blank("answer")), ("invalid_dimension_score", missing), ("dimension_score_out_of_range", outside)
    ])
    gold, raw = F.col("content") + F.col("organization") + F.col("language"), finite(F.col("total"))
    status = F.when(_blank("total"), "missing").when(raw.isNull(), "invalid").when(F.abs(raw - gold) <= TOLERANCE, "match").otherwise("conflict")
    good = lambda x: F.when(F.col("reason").isNull(), x)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return r.withColumn("reason", reason).select(
        good(F.concat_ws("_", F.lit("semantic_v2"), stem, "id")).alias("item_id"), "file", F.when(~_blank("id"), F.col("id")).alias("source_id"), "prompt", "answer",
        good(gold).alias("gold"), good(raw).alias("raw_total"), good(status).alias("total_status"), "reason",
    )


def indexed_records(lines: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """Lines (file, line, value) of JSON objects with an id as (file, id, line, value), and what is quarantined as (file, line, id, reason).

    An id that repeats in its file keeps no copy; each copy but the first gets a row. Blank lines are no records. The kept record comes out of the
    aggregation by id itself, so nothing is sorted or joined for it."""
    v = F.try_parse_json("value")
    shape = F.schema_of_variant(v)
    typed = lines.where(~_blank("value")).select("file", "line", "value", v.isNull().alias("broken"), shape.startswith("OBJECT").alias("object"), F.trim(F.try_variant_get(v, "$.id", "string")).alias("id"))
    reason = first_reason([(f"invalid_{role}_json", F.col("broken")), (f"invalid_{role}_record_type", ~F.col("object")), (f"missing_{role}_record_id", _blank("id"))])
    judged = typed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("file", "id", "line", "value")
    ids = good.groupBy("file", "id").agg(F.count("*").alias("copies"), F.min("line").alias("first"), F.min("value").alias("value"))
    kept = ids.where("copies = 1").select("file", "id", F.col("first").alias("line"), "value")
    repeats = good.drop("value").join(ids.where("copies > 1").select("file", "id", "first"), ["file", "id"]).where("line > first")
    bad = judged.where("reason IS NOT NULL").select("file", "line", F.when(~_blank("id"), F.col("id")).alias("id"), "reason")
    return kept, bad.unionByName(repeats.select("file", "line", "id", F.lit(f"duplicate_{role}_record_id").alias("reason")))


def aligned_steps(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Kept records of texts and of labels (both file, id, value; a file has one name on both sides) side by side:
    (file, id, question, answer, gold, score_max, n_steps, reason).

    Texts give the question and the response of every step, labels the total, the manual label and a label for every step. The answer joins the
    steps with a response, under their numbers. Every id of either side has a row; ``answer``, ``gold`` and ``score_max`` are null where ``reason`` is not."""
    t = texts.select("file", "id", F.try_parse_json("value").alias("t"), F.lit(True).alias("has_t"))
    a = labels.select("file", "id", F.try_parse_json("value").alias("a"), F.lit(True).alias("has_a"))
    part = lambda c, path, kind: F.try_variant_get(c, path, kind)
    j = t.join(a, ["file", "id"], "full").select(
        "file", "id", "has_t", "has_a", F.trim(part("t", "$.question", "string")).alias("question"), part("t", "$.steps", "array<variant>").alias("ts"), part("a", "$.steps", "array<variant>").alias("as_"),
        finite(part("a", "$.total", "string")).alias("total"), finite(part("a", "$.manual_label", "string")).alias("manual"),
    )
    is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    step = lambda x, y: F.struct(
        (is_object(x) & is_object(y)).alias("typed"), F.coalesce(F.trim(F.try_variant_get(x, "$.response", "string")), F.lit("")).alias("said"), finite(F.try_variant_get(y, "$.label", "string")).alias("label")
    )
    j = j.withColumn("steps", F.zip_with("ts", "as_", step))
    fault = lambda s: F.when(~s.typed, "invalid_step_record_type").when(s.label.isNull(), "invalid_step_label").when((s.said == "") & (s.label != 0), "empty_step_with_nonzero_label")
    said = F.filter(F.transform("steps", lambda s, i: F.when(s.said != "", F.concat(F.lit("[Step "), (i + 1).cast("string"), F.lit("]\n"), s.said))), lambda x: x.isNotNull())
    total = F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s.label)
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    steps_fault = F.get(F.filter(F.transform("steps", fault), lambda x: x.isNotNull()), F.lit(0))
    head = [
        ("annotation_without_english_record", F.col("has_t").isNull()), ("missing_aligned_annotation_record", F.col("has_a").isNull()), ("missing_question_text", _blank("question")), ("missing_english_steps", empty("ts")),
        ("missing_annotation_steps", empty("as_")), ("step_count_mismatch", F.size("ts") != F.size("as_")), ("invalid_total_or_manual_label", F.col("total").isNull() | F.col("manual").isNull()),
        ("nonpositive_total_score", F.col("total") <= 0), ("manual_label_out_of_range", ~F.col("manual").between(F.lit(0.0), F.col("total"))),
    ]
    tail = [("empty_whole_response", F.size(said) == 0), ("manual_label_step_sum_mismatch", F.abs(total - F.col("manual")) > TOLERANCE)]
    good = lambda x: F.when(F.col("reason").isNull(), x)
    return j.withColumn("reason", F.coalesce(first_reason(head), steps_fault, first_reason(tail))).select(
        "file", "id", "question", good(F.array_join(said, "\n\n")).alias("answer"), good(F.col("manual")).alias("gold"), good(F.col("total")).alias("score_max"), F.size("steps").alias("n_steps"), "reason"
    )
