"""Corpus loading, rules, repairs, sinks and streaming on a hand-made tree of papers."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stemquarry.operators import repairs, rules, windows
from stemquarry.sources import corpus, sinks, tables


def q(number, kind="choice", stem="題幹文字足夠長", options=None, answer="A", **more):
    options = {"A": "a", "B": "b", "C": "c", "D": "d"} if options is None and kind == "choice" else options
    return {"number": number, "type": kind, "stem": stem, **({"options": options} if options is not None else {}), **({"answer": answer} if answer is not None else {}), **more}


PAPERS = {
    "資訊/112年/作業系統": {"year": 112, "metadata": {"subject": "作業系統", "exam_name": "特考", "category": "資訊", "exam_time": "2小時"}, "notes": ["共 3 題", "申論題"], "questions": [q(1), q(2), q(4), q(4, stem="", passage="文")]},
    "資訊/111年/網路": {"year": 110, "metadata": {"exam_time": "2小時 座號：", "subject": "網路", "exam_name": "x", "category": "y"}, "questions": [q(2, options={"A": "a", "B": ""}, answer="C或D"), q(3, answer="*", stem="答案：B camelCase"), q("一", "essay", "短", answer=None)]},
    "警察/112年/空": {"metadata": {}, "notes": "單一字串", "questions": []},
    "警察/112年/複本": {"metadata": {"_is_duplicate": True}, "questions": [q(1)]},
    "警察/112年/複本二": {"_is_duplicate": True, "questions": [q(1)]},
    "警察/112年/清單": {"questions": [q(1, options=[{"label": "A", "text": "x"}, {"label": "B", "text": "y"}]), q(2, "essay", "題目內容", answer=None)]},
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("考古題")
    for path, doc in PAPERS.items():
        d = Path(root, path)
        d.mkdir(parents=True)
        (d / corpus.PAPER).write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    bad = Path(root, "警察/110年/壞檔")
    bad.mkdir(parents=True)
    (bad / corpus.PAPER).write_text("{not json", encoding="utf-8")
    (root / "download_summary.json").write_text("{}")
    return str(root)


@pytest.fixture(scope="module")
def papers(spark, tree):
    c = corpus.parse_papers(corpus.read_papers(spark, tree))
    return corpus.Corpus(c.files.cache(), c.questions.cache(), c.issues)


def test_load(papers):
    files = {(r.category, r.year, r.subject): r for r in papers.files.collect()}
    assert set(files) == {("資訊", 112, "作業系統"), ("資訊", 111, "網路"), ("警察", 112, "空"), ("警察", 112, "清單")}
    assert sorted(r.file_id for r in files.values()) == [1, 2, 3, 4]
    assert files["警察", 112, "空"].notes == ["單一字串"]
    assert [r.detail for r in papers.issues.collect()] == ["not JSON"]


def test_kinds_and_options(papers):
    rows = papers.questions.join(papers.files.select("file_id", "subject"), "file_id").collect()
    kinds = {(r.subject, r.number): (r.number_kind, r.number_int) for r in rows}
    assert kinds["網路", "一"] == ("string", None) and kinds["網路", "2"] == ("int", 2)
    assert [r.options for r in rows if r.subject == "清單" and r.type == "choice"] == [{"A": "x", "B": "y"}]


def test_question_rules(papers):
    got = rules.apply(papers.questions.join(papers.files.select("file_id", "subject"), "file_id"), rules.question_rules(), "subject", "number")
    hits = {(r.subject, r.number, r.rule) for r in got.collect()}
    for want in [
        ("網路", "2", "options.few"), ("網路", "2", "options.blank"), ("網路", "2", "options.not_four"), ("網路", "2", "answer.letter_not_in_options"), ("網路", "3", "stem.leaks_answer"),
        ("網路", "3", "answer.not_tests"), ("網路", "3", "text.case_border"), ("網路", "一", "essay.short"), ("清單", "2", "text.private_use"), ("清單", "2", "essay.int_number"), ("作業系統", "4", "stem.empty"),
    ]:
        assert want in hits, want
    assert ("作業系統", "4", "stem.empty_without_passage") not in hits
    assert not [h for h in hits if h[:2] == ("作業系統", "1")]


def test_paper_rules(papers):
    got = rules.paper_issues(papers.files, papers.questions).join(papers.files.select("file_id", "subject"), "file_id")
    hits = {(r.subject, r.rule, r.detail) for r in got.collect()}
    assert {("作業系統", "numbers.gap", "3"), ("作業系統", "numbers.repeat", "4"), ("作業系統", "notes.count_differs", "3/4"), ("作業系統", "notes.promise_essay", None), ("網路", "numbers.first", "2"), ("空", "questions.none", None)} <= hits
    meta = {(r.subject, r.rule) for r in rules.apply(papers.files, rules.file_rules(), "subject").collect()}
    assert {("網路", "metadata.seat_in_time"), ("網路", "metadata.year_differs"), ("清單", "metadata.missing")} <= meta


def test_index_round_trip(spark, papers, tmp_path):
    files, questions = sinks.build_index(spark, papers, str(tmp_path / "index"))
    assert files.count() == 4 and questions.where("option_a = 'x'").count() == 1
    assert {"option_a", "option_d", "answer", "passage"} <= set(questions.columns)


def test_repairs_are_idempotent(papers):
    fixed = repairs.star_answers(papers.questions)
    assert fixed.where("answer = '*'").count() == 0
    once = repairs.clean_texts(fixed)
    assert sorted(map(str, repairs.clean_texts(once).collect())) == sorted(map(str, once.collect()))
    log = sinks.change_log(papers.questions, once, ["file_id", "pos"], ["answer", "stem"])
    assert {(r.field, r.after) for r in log.collect()} == {("answer", "送分"), ("stem", "題目內容")}


def test_split_stem(spark):
    df = spark.createDataFrame([(1, "choice", "問什麼？(A)一(B)二(C)三(D)四", None), (2, "choice", "no (B) run (A) here", None)], "id int, type string, stem string, options map<string,string>")
    out = {r.id: (r.stem, r.options) for r in repairs.split_stem(df).collect()}
    assert out[1] == ("問什麼？", {"A": "一", "B": "二", "C": "三", "D": "四"}) and out[2] == ("no (B) run (A) here", None)


def test_text_fields_and_report(papers):
    f = corpus.text_fields(papers.questions, "file_id", "pos")
    assert f.where("field = 'option A'").count() > 0 and f.where("text = ''").count() == 0
    issues = papers.questions.select(F.lit("r").alias("rule"), F.lit("P1").alias("severity"), F.col("file_id").cast("string").alias("path"), F.lit("d").alias("detail"))
    assert json.loads(sinks.issue_report(issues).first().json)["n"] == papers.questions.count()
    assert "P1  r" in sinks.text_report(issues)


def test_find_papers(papers):
    assert corpus.find_papers(papers.files, category="警", subject="清").count() == 1
    assert corpus.find_papers(papers.files, year=112, stem_pattern="試*json").count() == 3


def test_cards_round_trip(papers):
    from stemquarry.functions import udfs

    cards = sinks.rendered_cards(papers.questions, papers.files)
    back = cards.select("subject", F.explode(udfs.question_cards("html")).alias("c")).select("subject", "c.*").collect()
    got = {(r.subject, r.number): (r.answer, r.options) for r in back}
    assert got["作業系統", "1"] == ("A", {"A": "a", "B": "b", "C": "c", "D": "d"}) and len(back) == papers.questions.count()


def test_batch_csv_and_key(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿json_path,number,stem,option_a,option_b,option_c,option_d,answer\np,1,s,a,b,c,d,A\n", encoding="utf-8")
    r = tables.read_batch_csv(spark, str(tmp_path / "b.csv")).first()
    assert r.json_path == "p" and r.answer == "A" and r.passage is None
    (tmp_path / "k.json").write_text('{"1": "A", "2": ""}')
    assert [tuple(x) for x in tables.read_answer_key(spark, str(tmp_path / "k.json")).collect()] == [("1", "A")]


def test_stream(spark, tree, tmp_path):
    from stemquarry.streaming import watch

    watch.run_available(watch.issues_of(watch.paper_stream(spark, tree)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {"load", "numbers.gap", "options.few"} <= {r.rule for r in rows}


def test_event_counts_stream(spark, tmp_path):
    from stemquarry.streaming import watch

    rows = [(f"2024-01-01 0{h}:10:00", "a") for h in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "ts string, k string").selectExpr("cast(ts as timestamp) ts", "k").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    watch.run_available(watch.event_counts(s, "ts", "k"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())[:2] == [(1, 2), (2, 1)]


def test_anchored_lines(spark):
    df = spark.createDataFrame([("d", 1.0, "a"), ("d", 2.5, "b"), ("d", 3.5, "c")], "doc string, y double, text string")
    assert [(r.line, r.text) for r in windows.anchored_lines(df, "doc", "y", "text").orderBy("line").collect()] == [(0, "ab"), (1, "c")]


def test_binary_pages(spark, tmp_path):
    """Any decoder plugs in; here a file's lines are its pages."""
    from stemquarry.sources import pdftext

    (tmp_path / "a.pdf").write_bytes("1. 題目\n(A) 一 (B) 二 (C) 三 (D) 四".encode())
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    files = pdftext.read_binary(spark, str(tmp_path))
    rows = pdftext.pages(files, lambda b: list(enumerate(b.decode().split("\n"), 1)))
    assert [(r.page, r.text[:2]) for r in rows.orderBy("page").collect()] == [(1, "1."), (2, "(A")]
    assert [Path(r.path).name for r in pdftext.failed(files, rows).collect()] == ["b.pdf"]
    assert "題目" in pdftext.page_documents(rows).first().text
    chars = pdftext.glyphs(files.where("path like '%a.pdf'"), lambda b: [(p, 0.0, 5.0, "x", "f", 100.0) for p in (1, 2)])
    assert sorted(r.y for r in chars.collect()) == [5.0, 105.0]
    assert pdftext.images(files.where("path like '%a.pdf'"), lambda b: [(1, 49, 500, b""), (1, 100, 50, b""), (2, 100, 49, b"")]).count() == 1


def test_parse_batch(spark):
    from stemquarry.operators import parsers

    page = "1. 題目\n(A) 一 (B) 二 (C) 三 (D) 四\n2. 說明之"
    docs = spark.createDataFrame([(1, page), (2, page), (3, "1. x\n(A) a (B) b (C) c (D) d")], "doc long, text string")
    answers = spark.createDataFrame([(1, 1, "B"), (3, 1, "D")], "doc long, number int, answer string")
    got = {(r.doc, r.number): (r.type, r.answer) for r in parsers.parse_batch(docs, "doc", answers, {"": "A"}).collect()}
    assert got == {(1, "1"): ("choice", "B"), (1, "2"): ("essay", None), (3, "1"): ("choice", "D")}
    kept = spark.createDataFrame([(1, ["※注意：x", "1. 題目", "(A) 一 (B) 二 (C) 三 (D) 四"])], "file_id long, notes array<string>")
    assert [(r.number, len(r.options)) for r in parsers.questions_from_notes(kept).collect()] == [("1", 4)]
