"""Replies to pages, prompts, cleaned pages and conversations on small tables: nulls, blanks, broken replies, ties."""

import json

from pyspark.sql import functions as F

from lernwerk.functions import replies as R
from lernwerk.operators import conversations as CV
from lernwerk.plans import pages as P


def reply(chapter, section, *questions):
    return json.dumps({"context": {"chapter": chapter, "section": section}, "questions": [{"number": n, "answer": a, "exam_year": y} for n, a, y in questions]})


def test_context_goes_on_to_later_pages(spark):
    rows = [
        ("d", 1, reply("one", "", (1, " a", ""), (2, "", ""))),
        ("d", 2, "broken"),
        ("d", 5000, "```json\n" + reply("", "1.1", (3, "b", "2020")) + "\n```"),
        ("d", 5001, reply("two", None, (4, "C", None))),
        ("e", 1, reply("", "", (5, "d", ""))),
        ("e", 2, None),
        (None, 1, json.dumps({"questions": [{"number": 6, "answer": "a"}]})),
    ]
    got = P.answers_of_pages(spark.createDataFrame(rows, "doc string, page_no long, reply string")).collect()
    assert {r.number: (r.doc, r.page_no, r.answer, r.section, r.knowledge_tag) for r in got} == {
        1: ("d", 1, "A", "one", "one"),
        3: ("d", 5000, "B", "1.1", "1.1,2020"),
        4: ("d", 5001, "C", "1.1", "1.1"),
        5: ("e", 1, "D", None, ""),
        6: (None, 1, "A", None, ""),
    }


QUESTION = "doc string, page_no int, id long, subject string, chapter string, question_text string, option_a string, option_b string, option_c string, option_d string, answer string, analysis string, user_answer string, key string"


def test_prompts_leave_out_what_is_not_there(spark):
    rows = [("d", 1, 1, "s", "c", "q", "x", "", None, "y", "A", "why", "B", "A"), ("d", 1, 2, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, QUESTION).orderBy("id")
    got = df.select(R.answer_prompt().alias("answer"), R.essay_prompt().alias("essay"), R.mistake_prompt().alias("mistake"), R.tutor_prompt().alias("tutor")).collect()
    assert got[0].answer == "Subject: s\nQuestion: q\nA. x\nD. y"
    assert got[0].essay == "【s】\n题目：q"
    assert got[0].mistake == "科目：s\n章节：c\n题目：q\n选项：\nA. x\nD. y\n学生答案：B（错误）\n正确答案：A"
    assert got[0].tutor == "[当前题目] 科目:s 章节:c\n题目: q\nA.x B. C. D.y\n正确答案: A\n解析: why"
    assert [got[1].answer, got[1].essay, got[1].mistake] == ["", "", "章节：未知\n选项："]
    assert got[1].tutor == "[当前题目] 科目: 章节:\n题目: "


def test_corrections_are_asked_for_by_page_and_range_of_ids(spark):
    rows = [("d", 1, i, "s", "c", f"q{i}", "x", None, None, None, "", "", "", "") for i in (3, 1, 12)] + [("d", 2, 2, "s", "c", "q2", None, None, None, None, "", "", "", "")]
    got = P.correction_blocks(spark.createDataFrame(rows, QUESTION), 10).orderBy("page_no", "first_id").collect()
    assert [(r.page_no, r.first_id, r.n, r.prompt) for r in got] == [
        (1, 1, 2, "[ID=1] 题目: q1\n  A. x\n\n[ID=3] 题目: q3\n  A. x"),
        (1, 12, 1, "[ID=12] 题目: q12\n  A. x"),
        (2, 2, 1, "[ID=2] 题目: q2"),
    ]


def test_pages_are_cleaned_before_they_are_counted(spark):
    rows = [("d", 1, "ab\n\n\n\nc 第 1 页，共 3 页"), ("d", 2, None), ("d", 3, " z ")]
    got = P.scan_pages(spark.createDataFrame(rows, "doc string, page_no long, text string")).orderBy("page_no").collect()
    assert [(r.start, r.n_chars, r.text) for r in got] == [(0, 5, "ab\n\nc"), (6, 0, ""), (7, 1, "z")]


def test_payloads_keep_types(spark):
    rows = [('{"a": 1, "b": [true, null], "m": "old"}', '{"a":1,"b":[true,null],"m":"new"}'), ("plain", "plain"), ("{broken", "{broken"), ("[1]", "[1]"), ("{}", '{"m":"new"}'), (None, None)]
    df = spark.createDataFrame(rows, "x string, want string")
    assert all(r.got == r.want for r in df.select("want", R.merged_payload("x", m=F.lit("new")).alias("got")).collect())


def test_activity_counts_messages_and_bookmarks(spark):
    messages = spark.createDataFrame([(1, 1, "user"), (1, 2, "assistant"), (2, 5, "user"), (2, 5, None), (3, 2, "user"), (None, 0, "user")], "conv_id long, at long, role string")
    marks = spark.createDataFrame([(1, 1, '["a"]'), (1, 4, '["b", "c"]'), (2, 1, '["d"]'), (2, 3, "[broken"), (4, 9, None)], "conv_id long, at long, bookmarks string")
    got = [(r.conv_id, r.last_activity, r.bookmarks, r.questions) for r in CV.activity(messages, marks).collect()]
    assert got == [(4, 9, [], 0), (2, 5, [], 1), (1, 4, ["b", "c"], 1), (3, 2, [], 1), (None, 0, [], 1)]
    said = messages.withColumn("text", F.when(F.col("at") != 2, F.col("at").cast("string")))
    lines = {r.conv_id: (r.transcript, r.n) for r in CV.transcripts(said).collect()}
    assert lines == {1: ("user: 1\nassistant: ", 2), 2: (": 5\nuser: 5", 2), 3: ("user: ", 1), None: ("user: 0", 1)}
