"""Literal rows, worked out by hand: tags, misconceptions, packages, notes, recovered answers, reports, pushed rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lernwerk.functions import replies as R
from lernwerk.operators import attempts as A
from lernwerk.operators import banks as B
from lernwerk.operators import links as L
from lernwerk.operators import quality as Q
from lernwerk.operators import questions as S
from lernwerk.sources import corpora as C
from lernwerk.sources import sync as SY


def test_tags_find_their_subject_in_any_case(spark):
    q = spark.createDataFrame([(3, "s3", "binary tree, heap"), (1, "s1", "Heap sort"), (2, "s2", "数据结构,图"), (4, "s4", None), (5, "s5", " ")], "id long, subject string, knowledge_tag string")
    tags = ["Tree", "tree, HEAP", "he", "h", "heap", "图", "结构", "数据结构", "treee", "absent", "据结构,图"]
    got = {r.tag: r.subject for r in A.tag_subjects(spark.createDataFrame([(t,) for t in tags], "tag string"), q).collect()}
    assert got == {"Tree": "s3", "tree, HEAP": "s3", "he": "s1", "h": "s1", "heap": "s1", "图": "s2", "结构": "s2", "数据结构": "s2", "treee": A.UNKNOWN, "absent": A.UNKNOWN, "据结构,图": "s2"}


def test_tags_equal_a_plain_search(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abAB c") for _ in range(n))
    lists = [(i, f"s{i}", word(r.randint(1, 12))) for i in range(60)]
    tags = sorted({word(r.randint(1, 6)) for _ in range(80)})
    want = {t: next((s for _, s, k in lists if k.strip() and t.lower() in k.lower()), A.UNKNOWN) for t in tags}
    got = A.tag_subjects(spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame(lists, "id long, subject string, knowledge_tag string"))
    assert {x.tag: x.subject for x in got.collect()} == want


def test_what_the_rules_say_of_a_wrong_answer(spark):
    rows = [(1, 1, "s", "c", "a,b", "A", "B", "2024-01-01", False, "because"), (2, 2, "s", "c", "", "A", "C", "2024-01-01", False, None), (3, 3, "s", None, None, None, "D", "2024-01-01", False, "")]
    g = spark.createDataFrame(rows, "id long, question_id long, subject string, chapter string, knowledge_tag string, user_answer string, key string, create_time string, is_correct boolean, analysis string")
    got = {r.question_id: r for r in A.misconceptions(g).collect()}
    assert [got[i].related_knowledge_tag for i in (1, 2, 3)] == ["a,b", "s:c", "s"]
    assert got[1].misconception_summary == "选了A，正确答案是B" and got[1].error_cause == "选择了A，正确答案是B" and got[3].misconception_summary == "选了，正确答案是D"
    assert [(got[i].knowledge_gap, got[i].correct_reasoning_path) for i in (1, 2, 3)] == [("c", "because"), ("c", ""), ("", "")]
    assert json.loads(got[1].recommended_actions_json) == ["复习相关知识点", "重做同类题"] and got[1].confused_concepts_json == "[]" and got[1].remediation == "建议复习该章节相关知识点"


def test_misconceptions_join_weak_points_by_the_whole_tag_or_by_its_parts(spark):
    mastery = spark.createDataFrame([("a", 1, 0, 0.5), ("b", 1, 0, 0.1)], "tag string, wrong_count long, correct_count long, mastery_score double")
    found = spark.createDataFrame([(7, "s", "c", "a, b", "2024-01-01", '["x"]', "[]", "m7"), (8, "s", "c", "b", "2024-01-02", '["y"]', "[]", "m8")], "question_id long, subject string, chapter string, related_knowledge_tag string, created_at string, confused_concepts_json string, recommended_actions_json string, misconception_summary string")
    q = spark.createDataFrame([(1, "s", "c", "z")], "id long, subject string, chapter string, knowledge_tag string")
    plain = lambda rows: {r.tag: (r.misconception_count, r.summary, r.question_ids) for r in rows.collect()}
    assert plain(A.weak_point_enrich(mastery, found, q)) == {"a": (0, "", ""), "b": (1, "m8", "8")}
    assert plain(A.weak_point_enrich(mastery, found, q, split_tags=True)) == {"a": (1, "m7", "7"), "b": (2, "m8", "7,8")}


def test_note_has_all_parts(spark):
    rows = [("栈", "DS", None, 3, 0.125, "mixed up", ["push", "pop"], [4, 9], ["read"]), ("x", "", "c", None, None, "", [], None, [])]
    df = spark.createDataFrame(rows, "tag string, subject string, chapter string, wrong_count long, mastery_score double, summary string, confused_concepts array<string>, question_ids array<long>, recommended_actions array<string>")
    full, bare = (r.n for r in df.select(R.note().alias("n")).collect())
    assert full == "# 栈\n\nSubject: DS\nChapter: uncategorized\nWrong count: 3\nMastery: 12%\n\n## Common Misconceptions\nmixed up\n\n## Confused Concepts\npush, pop\n\n## Related Wrong Questions\n- Q4\n- Q9\n\n## Review Actions\n- read\n"
    assert bare == "# x\n\nSubject: uncategorized\nChapter: c\nWrong count: 0\nMastery: 0%\n\n## Common Misconceptions\nNo AI summary yet.\n\n## Confused Concepts\nNone\n\n## Related Wrong Questions\n- None\n\n## Review Actions\n- Review related wrong questions\n"


def test_tutor_may_not_be_told_the_key(spark):
    q = spark.createDataFrame([("s", "c", "Q?", "1", "2", "3", "4", "A", "why")], "subject string, chapter string, question_text string, option_a string, option_b string, option_c string, option_d string, answer string, analysis string")
    told, not_told = q.select(R.tutor_prompt().alias("a"), R.tutor_prompt(include_key=False).alias("b")).first()
    assert told == not_told + "\n正确答案: A\n解析: why" and "正确答案" not in not_told


def questions(spark, rows):
    return spark.createDataFrame(rows, "id long, subject string, text_hash string, answer string")


def test_package_metadata(spark):
    none = spark.createDataFrame([], "question_id long, path string")
    for answers, some in ((["", None, " "], False), (["", "A"], True), ([], False)):
        row = B.package_metadata(questions(spark, [(i, "s", str(i), a) for i, a in enumerate(answers)]), none, none).first()
        assert (row.has_partial_answers, row.questions, row.has_media) == (some, len(answers), False)


def test_package_is_published_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    assets, candidates = spark.createDataFrame([(1, "p.png"), (2, "q.png"), (3, "r.png")], "question_id long, path string"), spark.createDataFrame([(1, "A")], "question_id long, answer_text string")
    C.write_package(questions(spark, [(1, "s", "h1", "A"), (2, "t", None, "")]), assets, candidates, path, id="ds", name="DS", subject="s")
    read = lambda: (sorted(r.text_hash or "" for r in C.read_package(spark, path).collect()), sorted((r.question_text_hash, r.path) for r in C.read_attached(spark, path, "question_assets").collect()))
    first = (["", "h1"], [("h1", "p.png")])
    assert read() == first
    facts = json.loads(C.published(spark, path).first().metadata)
    assert {k: v for k, v in facts.items() if k != "exported_at"} == {"id": "ds", "name": "DS", "subject": "s", "count": 2, "question_count": 2, "version": "1.0.0", "description": "", "has_media": True, "has_partial_answers": True, "asset_count": 1, "answer_candidate_count": 1, "qc_status": "passed_with_warnings"}
    broken = candidates.withColumn("answer_text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):  # ends after questions and assets were written
        C.write_package(questions(spark, [(3, "s", "h3", "A")]), assets, broken, path)
    assert read() == first
    C.write_package(questions(spark, [(3, "s", "h3", "A")]), assets, candidates, path)
    assert read() == (["h3"], [("h3", "r.png")])
    assert C.read_attached(spark, path, "notes").count() == 0


def test_hash_of_a_package_row_by_either_name(spark):
    rows = spark.createDataFrame([("h1", "h2", 1), (None, "h2", 2), ("", "h3", 3), (None, None, 4)], "question_text_hash string, text_hash string, n long")
    stored = spark.createDataFrame([(10, "h1"), (20, "h2")], "id long, text_hash string")
    assert sorted((r.n, r.question_text_hash, r.question_id) for r in L.relink_by_hash(rows, stored).collect()) == [(1, "h1", 10), (2, "h2", 20)]
    assert sorted((r.n, r.question_id) for r in L.relink_by_hash(rows.drop("question_text_hash"), stored).collect()) == [(1, 20), (2, 20)]


def test_pushed_rows_are_marked_once(spark, tmp_path):
    path = str(tmp_path / "store")
    SY.write_store(spark.range(40).select(F.col("id").alias("question_id")), path, "question_id", parts=8)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    few = spark.createDataFrame([(3,), (3,), (99,)], "question_id long")
    SY.mark_synced(spark, path, few, "question_id", parts=8)
    kept = before.items() & files().items()
    assert len(kept) >= len(before) - 2 and len(kept) < len(before)  # the folders of 3 and 99 at most
    assert SY.counts(SY.read_store(spark, path)).first()[:] == (40, 1)
    push = SY.unsynced(SY.read_store(spark, path))
    assert push.count() == 39
    SY.mark_synced(spark, path, push, "question_id", parts=8)
    assert SY.unsynced(SY.read_store(spark, path)).count() == 0 and SY.counts(SY.read_store(spark, path)).first()[:] == (40, 40)
    SY.mark_synced(spark, path, few, "question_id", parts=8)
    assert SY.counts(SY.read_store(spark, path)).first()[:] == (40, 40)


def test_similar_sets_equal_all_pairs(spark):
    r = random.Random(9)
    text = lambda: "".join(r.choice("abcdefghijkl  ") for _ in range(r.randint(0, 14)))
    answers, found = [(i, r.choice("st"), text()) for i in range(40)] + [(90, "s", None)], [(i, r.choice("st"), text()) for i in range(150)] + [(900, "s", None)]
    for threshold in (0.6, 0.5, 0.8):
        want = {}
        for a, sa, ta in answers:
            for q, sq, tq in found:
                x, y = set((ta or "").replace(" ", "")), set((tq or "").replace(" ", ""))
                score = len(x & y) / len(x | y) if x | y else 0
                if sa == sq and score > threshold and score > want.get(a, (0, 0))[0]:
                    want[a] = (score, q)
        got = {x.answer_id: (x.score, x.question_id) for x in L.fuzzy_answers(*(spark.createDataFrame(rows, "id long, subject string, text string") for rows in (answers, found)), threshold).collect()}
        assert got == want


def test_recovered_answers_fill_what_is_empty(spark):
    q = [(1, "s", "what is a stack", "", None), (2, "s", "what is a queue of jobs", "B", None), (3, "s", "Prüfung zwölf", None, "known"), (4, "t", "what is a stack", "", None)]
    r = [(1, "s", "what is a  stack?", " c", " push and pop "), (2, "s", "what is a stack", "d", "later"), (3, "s", "what is a queue of jobs", "A", "x"), (4, "s", "Prüfung zwölf", "a", "new"), (5, "s", "what is a stack", " ", "no answer"), (6, "t", " ", "A", "")]
    got = L.fill_answers(spark.createDataFrame(r, "id long, subject string, text string, answer string, analysis string"), spark.createDataFrame(q, "id long, subject string, text string, answer string, analysis string"))
    assert {x.question_id: tuple(x)[1:] for x in got.collect()} == {1: (1, "C", "push and pop"), 3: (4, "A", "known")}


def test_reports(spark):
    rows = spark.createDataFrame([(1, "f", 5, " \n"), (2, "f", None, None), (3, "g", 1, "text")], "id long, file string, number int, question_text string")
    assert sorted((r.file, r.id, r.error) for r in B.import_errors(rows).collect()) == [("f", 1, "Q#5: empty question text"), ("f", 2, "Q#None: empty question text")]
    texts = spark.createDataFrame([("a", ""), (None, "")], "question_text string, option_a string")
    assert [tuple(r) for r in Q.pua_histogram(texts, "question_text", "option_a").collect()] == [("", 3, "F0B1", "∑ (U+2211)"), ("", 1, "E000", "?"), ("", 1, "F0E0", ""), ("", 1, "F0EE", "(...) (paired)")]
    before = spark.createDataFrame([(1, "", "x"), (2, "b", None), (3, "c", "y")], "id long, question_text string, analysis string")
    after = spark.createDataFrame([(1, "s", "z"), (2, "b", None), (3, "c2", "y")], "id long, question_text string, analysis string")
    got = {r.field: tuple(r)[1:] for r in Q.change_report(before, after, ["question_text", "analysis"]).collect()}
    assert got == {"question_text": (2, 1, 1, 0), "analysis": (1, 2, 0, 0), "(rows)": (2, 1, 0, 0), "(2 fields)": (1, 0, 0, 0), "(1 fields)": (1, 0, 0, 0), "(0 fields)": (0, 1, 0, 0)}


def test_questions_of_a_chapter(spark):
    rows = [(3, "s", "c", "choice", "1", "2", "3", "4"), (1, "s", "c", "choice", "1", "2", "3", ""), (2, "s", "c", "other", None, None, None, None), (4, "s", None, "other", None, None, None, None), (5, "t", "c", "other", None, None, None, None)]
    q = spark.createDataFrame(rows, "id long, subject string, chapter string, question_type string, option_a string, option_b string, option_c string, option_d string")
    ids = lambda *a: [r.id for r in S.of_chapter(q, *a).collect()]
    assert ids("s", "c") == [1, 2, 3] and ids("s", "c", "choice") == [3] and ids("s", "c", "other") == [2] and ids("s", "x") == []
