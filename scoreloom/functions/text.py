"""Column expressions over text and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which a field may come, in the order in which they are tried.
ALIASES = {
    "item_id": ["item_id", "id", "response_id", "essay_id"],
    "prompt": ["prompt", "question", "question_text", "essay_prompt"],
    "student_answer": ["student_answer", "answer", "response", "essay", "student_response"],
    "reference_answer": ["reference_answer", "reference", "model_answer"],
    "rubric": ["rubric", "scoring_rubric", "criteria"],
    "gold_score": ["gold_score", "score", "label", "domain1_score"],
    "score_min": ["score_min", "min_score"],
    "score_max": ["score_max", "max_score"],
    "prompt_group": ["prompt_group", "prompt_id", "question_id", "essay_set"],
    "subject": ["subject", "domain"],
}
# Patterns of placeholder texts.
PLACEHOLDERS = [r"(?i)see\s+data_set_descriptions\.zip", r"(?i)see\s+training_materials\.zip", r"(?i)\bplaceholder(?:\s+text)?\b", r"\b(?:TODO|TBD)\b"]
# Marks of structure in an answer.
STRUCTURE = ["\n", "=", "{", "}", "```"]


def normalize_text(x: Column) -> Column:
    """Trimmed, lower case, any Unicode white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def first_present(columns: list[str], names: list[str], default: object = None) -> Column:
    """The first of ``names`` that is a column and not null; an empty text is present."""
    return F.coalesce(*[F.col(n) for n in names if n in columns], F.lit(default))


def stable_id(dataset: Column, fallback: Column, group: Column, answer: Column) -> Column:
    """The source's own id after the dataset's name; where it is null or empty, a digest of dataset, group and answer."""
    digest = F.substring(F.sha1(F.concat_ws("\n", dataset, group, answer).cast("binary")), 1, 16)
    return F.concat_ws("_", dataset, F.when(fallback != "", fallback).otherwise(digest))


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by U+001F."""
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary"), 256)


def stable_unit(x: Column) -> Column:
    """A number in [0, 1] from the first 64 bits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 16), 16, 10).cast("double") / 1.8446744073709552e19


def group_hash(x: Column) -> Column:
    """Twenty hexadecimal digits that name a prompt group."""
    return F.substring(F.sha2(normalize_text(x).cast("binary"), 256), 1, 20)


def words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: w != "")


def static_complexity(prompt: Column, answer: Column, rubric: Column, reference: Column, essay: Column) -> Column:
    """Weighted, bounded sizes of the parts of an item, the variety of the answer's words and its marks of structure, in [0, 1]."""
    bounded = lambda x, most: F.least(F.lit(1.0), F.length(F.coalesce(x, F.lit(""))) / float(most))
    w = words(F.coalesce(answer, F.lit("")))
    variety = F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w))
    marks = sum((F.coalesce(answer.contains(m), F.lit(False)).cast("int") for m in STRUCTURE), F.lit(0)) / 5.0
    return (
        0.15 * bounded(prompt, 600) + 0.35 * bounded(answer, 1800) + 0.15 * bounded(rubric, 900) + 0.10 * bounded(reference, 900)
        + 0.10 * variety + 0.05 * marks + 0.10 * F.when(essay, 1.0).otherwise(0.0)
    )


def is_placeholder(x: Column) -> Column:
    out = x.isNull()
    for p in PLACEHOLDERS:
        out = out | x.rlike(p)
    return out


def mix_label(datasets: Column) -> Column:
    """'a:2;b:1' of an array of names."""
    names = F.array_sort(F.array_distinct(datasets))
    return F.array_join(F.transform(names, lambda n: F.concat_ws(":", n, F.size(F.filter(datasets, lambda d: d == n)).cast("string"))), ";")


def visible(columns: list[str], allowed: list[str]) -> list[str]:
    """The columns a model may see, in their own order."""
    return [c for c in columns if c in allowed]
