"""Readers and loaders of graded answers on small files."""

import json

import pytest

from scoreloom.sources import graded, records


def test_records_by_suffix(spark, tmp_path):
    rows = [{"id": "a", "score": 1}, {"id": "b", "score": 2}]
    (tmp_path / "l.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "held.json").write_text(json.dumps({"data": [], "records": rows, "n": 2}))
    (tmp_path / "c.csv").write_text('id,score\na,"1\n""x"""\nb,\n', encoding="utf-8-sig")
    (tmp_path / "t.tsv").write_text("id\tscore\na\t1\n")
    read = lambda name: [tuple(r) for r in records.read_records(spark, str(tmp_path / name)).orderBy("id").collect()]
    assert read("l.jsonl") == read("list.json") == read("held.json") == [("a", 1), ("b", 2)]
    assert read("c.csv") == [("a", '1\n"x"'), ("b", "")] and read("t.tsv") == [("a", "1")]
    (tmp_path / "bad.json").write_text('{"x": 1}')
    for name in ("bad.json", "x.xml"):
        with pytest.raises(ValueError):
            records.read_records(spark, str(tmp_path / name))
    assert records.load_dataset(spark, str(tmp_path / "none")).count() == 0
    assert records.load_dataset(spark, str(tmp_path), "[ct].?sv").count() == 3


def test_numbered_lines_over_blocks(spark, tmp_path):
    lines = {f"f{i}.txt": [f"{i} {'x' * (n % 37)} {n}" if n % 5 else "" for n in range(1000 * (i + 1))] for i in range(3)}
    for name, content in lines.items():
        (tmp_path / name).write_text("\n".join(content) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {(r.file, r.line): r.value for r in records.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(f, n): v for f, content in lines.items() for n, v in enumerate(content, 1)}


def test_short_answers(spark):
    rows = [
        ("1", "1", "2", "3", "good"), ("2", "11", "1", "1", "x"), ("3", "2", "1", "1", "x"), ("4", "1", "1", "1", "  "), ("5", "1", "nan", "1", "x"), ("6", "1", "1", None, "x"),
        ("7", "1", "4", "9", "x"), ("8", "1", "3", "4", "x"), ("", "1", "0", "0", "x"), ("9", None, "0", "0", "x"), ("10", "1", "1d", "1", "x"),
    ]
    df = spark.createDataFrame(rows, "Id string, EssaySet string, Score1 string, Score2 string, EssayText string")
    out = {r.source_id: r for r in graded.short_answers(df, spark.createDataFrame([("1", "p", "r")], "essay_set string, prompt string, rubric string")).collect()}
    assert {k: r.reason for k, r in out.items()} == {
        "1": None, "2": "unsupported_essay_set", "3": "missing_official_prompt_or_rubric", "4": "missing_student_answer", "5": "invalid_score", "6": "invalid_score",
        "7": "score1_out_of_range", "8": "score2_out_of_range", None: None, "9": "unsupported_essay_set", "10": "invalid_score",
    }
    assert (out["1"].item_id, out["1"].gold, out["1"].score_max, out["1"].prompt) == ("semantic_v2_set_01_1", 2.0, 3.0, "p")


def test_essays(spark):
    rows = [
        ("a.tsv", "1", "p", "e", "1", "2", "3", "6"), ("a.tsv", "2", "p", "e", "1", "2", "3", "7"), ("a.tsv", "3", "p", "e", "1", "2", "3", ""), ("a.tsv", "4", "p", "e", "1", "2", "3", "six"),
        ("a.tsv", "", "p", "e", "1", "2", "3", "6"), ("a.tsv", "5", " ", "e", "1", "2", "3", "6"), ("a.tsv", "6", "p", None, "1", "2", "3", "6"), ("a.tsv", "7", "p", "e", "x", "2", "9", "6"), ("a.tsv", "8", "p", "e", "1", "5.5", "3", "6"),
    ]
    out = graded.essays(spark.createDataFrame(rows, "file string, id string, prompt string, essay string, content string, organization string, language string, total string")).collect()
    assert [(r.source_id, r.gold, r.total_status, r.reason) for r in out] == [
        ("1", 6.0, "match", None), ("2", 6.0, "conflict", None), ("3", 6.0, "missing", None), ("4", 6.0, "invalid", None), (None, None, None, "missing_source_record_id"),
        ("5", None, None, "missing_prompt"), ("6", None, None, "missing_student_essay"), ("7", None, None, "invalid_dimension_score"), ("8", None, None, "dimension_score_out_of_range"),
    ]
    assert out[0].item_id == "semantic_v2_a_1"


def test_indexed_records(spark):
    values = ['{"id": "a"}', "", "{", "[1]", '{"id": " "}', '{"id": "b"}', '{"id": "b", "x": 1}', '{"id": 7}', '{"x": 2}', '{"id": "b"}']
    kept, bad = graded.indexed_records(spark.createDataFrame([("f", i, v) for i, v in enumerate(values, 1)], "file string, line long, value string"), "text")
    assert sorted((r.id, r.line) for r in kept.collect()) == [("7", 8), ("a", 1)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [
        (3, "invalid_text_json"), (4, "invalid_text_record_type"), (5, "missing_text_record_id"), (7, "duplicate_text_record_id"), (9, "missing_text_record_id"), (10, "duplicate_text_record_id"),
    ]


def test_aligned_steps(spark):
    t = lambda steps, question="q": {"question": question, "steps": steps}
    a = lambda steps, total=5, manual=3: {"steps": steps, "total": total, "manual_label": manual}
    said, got = [{"response": "x"}, {"response": ""}], [{"label": 3}, {"label": 0}]
    cases = {
        "ok": (t(said), a(got), None), "text": (t(said), None, "missing_aligned_annotation_record"), "label": (None, a(got), "annotation_without_english_record"), "q": (t(said, " "), a(got), "missing_question_text"),
        "no": (t([]), a(got), "missing_english_steps"), "nolabel": (t(said), a("x"), "missing_annotation_steps"), "count": (t(said), a(got[:1]), "step_count_mismatch"), "total": (t(said), a(got, "x"), "invalid_total_or_manual_label"),
        "zero": (t(said), a(got, 0, 0), "nonpositive_total_score"), "range": (t(said), a(got, 2), "manual_label_out_of_range"), "type": (t(said), a([{"label": 3}, 4]), "invalid_step_record_type"),
        "bad": (t(said), a([{"label": "x"}, 4]), "invalid_step_label"), "hidden": (t(said), a([{"label": 2}, {"label": 1}]), "empty_step_with_nonzero_label"),
        "blank": (t([{}]), a([{"label": 0}], 5, 0), "empty_whole_response"), "sum": (t(said), a([{"label": 2}, {"label": 0}]), "manual_label_step_sum_mismatch"),
    }
    side = lambda n: spark.createDataFrame([("f", k, json.dumps(v[n])) for k, v in cases.items() if v[n] is not None], "file string, id string, value string")
    out = {r.id: r for r in graded.aligned_steps(side(0), side(1)).collect()}
    assert {k: r.reason for k, r in out.items()} == {k: v[2] for k, v in cases.items()}
    assert (out["ok"].answer, out["ok"].gold, out["ok"].score_max, out["ok"].n_steps) == ("[Step 1]\nx", 3.0, 5.0, 2)


def test_names_of_files(spark):
    df = spark.createDataFrame([("0_Physics_ShortAns.translated.jsonl",), ("3_Math_gapFilling.jsonl",), ("x_choice",), ("plain",)], "f string")
    assert [tuple(r) for r in df.select(graded.subject_of(df.f), graded.question_type_of(df.f)).collect()] == [("Physics", "short_answer"), ("Math", "gap_filling"), ("choice", "choice"), ("", "short_answer")]
