"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sink_queries as SK
from .bank_queries import ENTRIES, FILE_IDS, file_of
from .functions import replies as R
from .functions import text as T
from .operators import attempts as A
from .operators import banks as B
from .operators import conversations as CV
from .operators import fingerprints as FP
from .operators import links as L
from .operators import quality as Q
from .operators import questions as S
from .plans import parsing as P
from .plans import regions as G
from .sources.projection import load, with_ctes
from .sources.shared import folder
from .streaming import attempts as ST
from .streaming import ingest as SI
from .streaming import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, needs: str, make: Callable[..., DataFrame], sql: str | None = None, graded: bool = False) -> None:
    """needs: projections, in the order of ``make``'s arguments; graded: SQL may use the table ``graded``."""
    names = needs.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(*(load(spark, sf_dir, n) for n in names))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = with_ctes(f"WITH {GRADED} {sql}" if graded and not sql.startswith("WITH") else (f"WITH {GRADED}, {sql[5:]}" if graded else sql), *names)


BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, created_at DESC, id DESC) AS r FROM candidates WHERE is_verified) WHERE r = 1)"""
GRADED = f"""{BEST}, keyed AS (
  SELECT a.id, a.user_id, a.question_id, a.user_answer, a.create_time, q.subject, q.chapter, q.knowledge_tag, q.question_type,
    coalesce(CASE WHEN trim(q.answer) <> '' THEN trim(q.answer) END, CASE WHEN trim(b.answer_text) <> '' THEN trim(b.answer_text) END) AS key,
    CASE WHEN trim(q.answer) <> '' THEN 'built_in' WHEN trim(b.answer_text) <> '' THEN b.source END AS key_source,
    CASE WHEN trim(q.answer) <> '' THEN 1.0 WHEN trim(b.answer_text) <> '' THEN b.confidence END AS key_confidence,
    (coalesce(trim(q.option_a), '') <> '' OR coalesce(trim(q.option_b), '') <> '' OR coalesce(trim(q.option_c), '') <> '' OR coalesce(trim(q.option_d), '') <> '') AS has_option
  FROM attempts a JOIN questions q ON a.question_id = q.id LEFT JOIN best b ON b.question_id = a.question_id
), graded AS (
  SELECT *, upper(trim(user_answer)) = upper(key) AS is_correct FROM keyed WHERE question_type = 'choice' AND has_option AND key IS NOT NULL
)"""
TAGGED = "tagged AS (SELECT trim(t) AS tag, is_correct FROM (SELECT unnest(string_split(coalesce(knowledge_tag, ''), ',')) AS t, is_correct FROM graded) WHERE trim(t) <> '')"
MASTERY = f"{TAGGED}, mastery AS (SELECT tag, count(*) FILTER (is_correct) AS correct_count, count(*) FILTER (NOT is_correct) AS wrong_count, count(*) FILTER (is_correct) / count(*) AS mastery_score FROM tagged GROUP BY tag)"
SUBJECTS_SQL = "subjects AS (SELECT m.tag, arg_min(q.subject, q.id) AS subject FROM mastery m JOIN questions q ON contains(lower(q.knowledge_tag), lower(m.tag)) GROUP BY 1)"
FIRST = "firsts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS frequency, row_number() OVER (PARTITION BY question_id ORDER BY create_time, id) AS r FROM graded WHERE NOT is_correct) WHERE r = 1)"
BOOK = "book AS (SELECT question_id, subject, chapter, min(create_time) AS added_at, count(*) AS wrong_attempts, CASE WHEN count(*) > 1 THEN 'wrong' ELSE 'unreviewed' END AS last_status FROM graded WHERE NOT is_correct GROUP BY 1, 2, 3)"
REVIEWS = "reviews AS (SELECT a.id, a.question_id, a.create_time, coalesce(trim(q.answer), '') <> '' AND upper(trim(a.user_answer)) = upper(trim(q.answer)) AS ok FROM attempts a JOIN questions q ON q.id = a.question_id WHERE a.id % 4 = 0)"
REVIEWED = f"""{REVIEWS}, events AS (SELECT question_id, create_time, id, false AS is_review, false AS ok FROM graded WHERE NOT is_correct AND id % 4 <> 0 UNION ALL SELECT question_id, create_time, id, true, ok FROM reviews),
  lined AS (SELECT *, count(*) FILTER (NOT is_review) OVER (PARTITION BY question_id ORDER BY create_time, id) AS wrongs FROM events),
  moves AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY create_time DESC, id DESC) AS back FROM lined WHERE wrongs > 0),
  book AS (SELECT m.question_id, any_value(q.subject) AS subject, any_value(q.chapter) AS chapter, min(create_time) AS added_at, count(*) FILTER (NOT is_review) AS wrong_attempts,
    any_value(CASE WHEN is_review THEN CASE WHEN ok THEN 'correct' ELSE 'wrong' END WHEN wrongs > 1 THEN 'wrong' ELSE 'unreviewed' END) FILTER (back = 1) AS last_status, count(*) FILTER (is_review) AS review_count,
    max(create_time) FILTER (is_review) AS last_review_at FROM moves m JOIN questions q ON q.id = m.question_id GROUP BY m.question_id)"""
COMPLETE = "(coalesce(question_type <> 'choice', true) OR (coalesce(trim(option_a), '') <> '' AND coalesce(trim(option_b), '') <> '' AND coalesce(trim(option_c), '') <> '' AND coalesce(trim(option_d), '') <> ''))"
GRADING = "attempts questions candidates"


def on_graded(f: Callable[[DataFrame], DataFrame]) -> Callable[..., DataFrame]:
    return lambda attempts, questions, candidates: f(A.grade(attempts, questions, candidates))


def reviewed_book(attempts: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The error book, every fourth attempt taken as a review."""
    return A.wrong_book(A.grade(attempts.filter("id % 4 <> 0"), questions, candidates), A.grade_reviews(attempts.filter("id % 4 = 0"), questions))


def weak_points(attempts: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    graded = A.grade(attempts, questions, candidates)
    return A.weak_point_enrich(A.tag_mastery(graded), analysed(graded), questions, split_tags=True)


def analysed(graded: DataFrame) -> DataFrame:
    """Misconceptions with what an analysis adds: the confused options, where to read again, a summary."""
    given = F.upper(F.trim("user_answer"))
    return A.misconceptions(graded).withColumns({
        "confused_concepts_json": F.to_json(F.array(given, F.upper("correct_answer"))),
        "recommended_actions_json": F.to_json(F.array(F.concat(F.lit("review "), "chapter"), F.concat(F.lit("practise "), "subject"))),
        "misconception_summary": F.when(F.col("chapter").isNotNull(), F.concat(given, F.lit(" for "), F.col("correct_answer"))),
    })


# attempts
register("grade_attempts", GRADING, on_graded(lambda g: g.select("id", "question_id", "key", "key_source", "key_confidence", "is_correct")), "SELECT id, question_id, key, key_source, key_confidence, is_correct FROM graded", True)
register("attempts_with_candidates", GRADING, lambda a, q, c: A.with_keys(a, q, c).select("id", "question_id", "key", "key_source", "key_confidence"), "SELECT id, question_id, key, key_source, key_confidence FROM keyed", True)
register("join_attempts_questions", "attempts questions", lambda a, q: a.join(q.withColumnRenamed("id", "question_id"), "question_id").select("id", "question_id", "subject", "user_answer"), "SELECT a.id, a.question_id, q.subject, a.user_answer FROM attempts a JOIN questions q ON q.id = a.question_id")
register("total_accuracy", GRADING, on_graded(A.total_accuracy), "SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (is_correct) / count(*), 4) END AS accuracy FROM graded", True)
register("subject_accuracy", GRADING, on_graded(A.subject_accuracy), "SELECT subject, count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_correct) / count(*) AS accuracy FROM graded GROUP BY subject", True)
register("tag_mastery", GRADING, on_graded(A.tag_mastery), f"WITH {MASTERY} SELECT * FROM mastery", True)
register("fallback_tag_wrongs", GRADING, on_graded(A.fallback_tag_wrongs), f"WITH {FIRST} SELECT concat_ws(':', subject, CASE WHEN trim(chapter) <> '' THEN chapter END) AS tag, count(*) AS wrong_count FROM firsts WHERE trim(coalesce(knowledge_tag, '')) = '' GROUP BY 1", True)
register("weak_list", GRADING, on_graded(lambda g: A.weak_list(A.tag_mastery(g))), f"WITH {MASTERY} SELECT * FROM mastery WHERE wrong_count >= 1 ORDER BY mastery_score, tag LIMIT 20", True)
register("weak_summary", GRADING, lambda a, q, c: A.weak_summary(A.tag_mastery(A.grade(a, q, c)), q), f"WITH {MASTERY}, {SUBJECTS_SQL}, w AS (SELECT tag, mastery_score, coalesce(s.subject, '未知') AS subject FROM mastery LEFT JOIN subjects s USING (tag) WHERE wrong_count > 0), k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY mastery_score, tag) AS rank FROM w) SELECT (SELECT count(*) FROM w) AS weak_tags, (SELECT round(coalesce(avg(mastery_score), 0.0), 4) FROM w) AS average_mastery, coalesce(string_agg(concat(subject, ':', tag), ',' ORDER BY subject, rank, tag), '') AS weakest FROM k WHERE rank <= 5", True)
register("tag_subject_lookup", GRADING, lambda a, q, c: A.tag_subjects(A.tag_mastery(A.grade(a, q, c)), q), f"WITH {MASTERY}, {SUBJECTS_SQL} SELECT m.*, coalesce(s.subject, '未知') AS subject FROM mastery m LEFT JOIN subjects s USING (tag)", True)
register("weakest_per_subject", GRADING, lambda a, q, c: A.weakest_per_subject(A.tag_mastery(A.grade(a, q, c)), q), f"WITH {MASTERY}, {SUBJECTS_SQL}, j AS (SELECT m.*, coalesce(s.subject, '未知') AS subject FROM mastery m LEFT JOIN subjects s USING (tag) WHERE wrong_count > 0) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY mastery_score, tag) AS INTEGER) AS rank FROM j) WHERE rank <= 5", True)
register("grade_reviews", "attempts questions", lambda a, q: A.grade_reviews(a.filter("id % 4 = 0"), q).select("id", "question_id", "is_correct"), f"WITH {REVIEWS} SELECT id, question_id, ok AS is_correct FROM reviews")
register("wrong_book_batch", GRADING, reviewed_book, f"WITH {REVIEWED} SELECT * FROM book", True)
register("wrong_stats", GRADING, lambda a, q, c: A.wrong_stats(reviewed_book(a, q, c)), f"WITH {REVIEWED} SELECT subject, last_status, CAST(grouping(subject) AS INTEGER) AS all_subjects, CAST(grouping(last_status) AS INTEGER) AS all_statuses, count(*) AS n, round(count(*) FILTER (last_status <> 'unreviewed') / count(*), 2) AS review_rate FROM book GROUP BY GROUPING SETS ((), (subject), (last_status))", True)
register("wrong_list", GRADING, lambda a, q, c: A.wrong_list(reviewed_book(a, q, c), q, status="wrong", page=2, page_size=10).select("question_id", "subject", "chapter", "wrong_attempts", "preview", "total", "pages"), f"WITH {REVIEWED}, w AS (SELECT * FROM book WHERE last_status = 'wrong') SELECT question_id, w.subject, w.chapter, wrong_attempts, concat(substr(question_text, 1, 80), CASE WHEN length(question_text) > 80 THEN '...' ELSE '' END) AS preview, (SELECT count(*) FROM w) AS total, (SELECT greatest(1, (count(*) + 9) // 10) FROM w) AS pages FROM w JOIN questions q ON q.id = question_id ORDER BY added_at DESC, question_id LIMIT 10 OFFSET 10", True)
register("wrong_chapters", GRADING, on_graded(lambda g: A.wrong_book(g).filter(A.filled("chapter")).select("subject", "chapter").distinct()), f"WITH {BOOK} SELECT DISTINCT subject, chapter FROM book WHERE trim(chapter) <> ''", True)
register("misconception_batch", GRADING, on_graded(lambda g: A.misconceptions(g).select("question_id", "subject", "chapter", "user_answer", "correct_answer", "related_knowledge_tag", "frequency", "misconception_summary", "knowledge_gap", "remediation", "error_cause", "recommended_actions_json")), f"WITH {FIRST} SELECT question_id, subject, chapter, user_answer, key AS correct_answer, CASE WHEN knowledge_tag <> '' THEN knowledge_tag WHEN chapter <> '' THEN concat(subject, ':', chapter) ELSE subject END AS related_knowledge_tag, frequency, concat('选了', user_answer, '，正确答案是', key) AS misconception_summary, coalesce(chapter, '') AS knowledge_gap, '建议复习该章节相关知识点' AS remediation, concat('选择了', user_answer, '，正确答案是', key) AS error_cause, '[\"复习相关知识点\",\"重做同类题\"]' AS recommended_actions_json FROM firsts", True)
register("misconception_summary", GRADING, on_graded(lambda g: A.misconception_summary(A.misconceptions(g))), f"WITH {FIRST} SELECT subject, chapter, count(*) AS n, CAST(sum(frequency) AS BIGINT) AS attempts FROM firsts GROUP BY 1, 2", True)
register("misconception_stats", GRADING, on_graded(lambda g: A.misconception_stats(A.misconceptions(g))), f"WITH {FIRST} SELECT subject, CAST(grouping(subject) AS INTEGER) AS all_subjects, count(DISTINCT chapter) AS chapters, count(*) AS n, CAST(sum(frequency) AS BIGINT) AS attempts FROM firsts GROUP BY ROLLUP (subject)", True)
register("misconception_list", GRADING, on_graded(lambda g: A.misconception_list(A.misconceptions(g), skip=5).select("question_id", "created_at", "frequency", "total")), f"WITH {FIRST} SELECT question_id, create_time AS created_at, frequency, (SELECT count(*) FROM firsts) AS total FROM firsts ORDER BY create_time DESC, question_id LIMIT 20 OFFSET 5", True)
ENRICHED = """each AS (SELECT *, trim(t) AS tag FROM (SELECT *, unnest(list_distinct(list_transform(string_split(coalesce(knowledge_tag, ''), ','), lambda x: trim(x)))) AS t FROM firsts) WHERE trim(t) <> ''),
  found AS (SELECT tag, count(*) AS n, list_distinct(list(question_id)) AS ids, first(subject ORDER BY create_time DESC, question_id) FILTER (trim(subject) <> '') AS subject, first(chapter ORDER BY create_time DESC, question_id) FILTER (trim(chapter) <> '') AS chapter,
    first(concat(upper(trim(user_answer)), ' for ', key) ORDER BY create_time DESC, question_id) FILTER (chapter IS NOT NULL) AS summary FROM each GROUP BY tag),
  items AS (SELECT tag, 'c' AS kind, upper(trim(user_answer)) AS item, create_time, question_id, 0 AS pos FROM each UNION ALL SELECT tag, 'c', upper(key), create_time, question_id, 1 FROM each
    UNION ALL SELECT tag, 'a', 'review ' || chapter, create_time, question_id, 0 FROM each UNION ALL SELECT tag, 'a', 'practise ' || subject, create_time, question_id, 1 FROM each),
  ordered AS (SELECT tag, kind, item, row_number() OVER (PARTITION BY tag, kind ORDER BY create_time DESC, question_id, pos) AS o FROM items WHERE item IS NOT NULL),
  firstly AS (SELECT tag, kind, item, min(o) AS o FROM ordered GROUP BY 1, 2, 3), listed AS (SELECT tag, string_agg(item, '|' ORDER BY o) FILTER (kind = 'c') AS concepts, string_agg(item, '|' ORDER BY o) FILTER (kind = 'a') AS actions FROM firstly GROUP BY 1),
  of_tag AS (SELECT trim(t) AS tag, arg_min(id, id) AS id, first(subject ORDER BY id) AS subject, first(chapter ORDER BY id) AS chapter FROM (SELECT id, subject, chapter, unnest(string_split(coalesce(knowledge_tag, ''), ',')) AS t FROM questions) WHERE trim(t) <> '' GROUP BY 1)"""
WEAK_POINTS = """SELECT m.tag, m.wrong_count, m.correct_count, m.mastery_score, coalesce(f.subject, o.subject) AS subject, coalesce(f.chapter, o.chapter) AS chapter, coalesce(f.summary, '') AS summary, coalesce(f.n, 0) AS misconception_count, coalesce(l.concepts, '') AS confused_concepts, coalesce(l.actions, '') AS recommended_actions, array_to_string(list_sort(list_distinct(list_concat(coalesce(f.ids, []), CASE WHEN f.subject IS NULL OR f.chapter IS NULL THEN [o.id] ELSE [] END))), ',') AS question_ids FROM mastery m LEFT JOIN found f USING (tag) LEFT JOIN listed l USING (tag) LEFT JOIN of_tag o USING (tag) WHERE m.wrong_count > 0"""
ENRICHED = ENRICHED.replace("coalesce(knowledge_tag, '')", "CASE WHEN knowledge_tag <> '' THEN knowledge_tag WHEN chapter <> '' THEN concat(subject, ':', chapter) ELSE subject END", 1)
register("weak_point_enrich", GRADING, weak_points, f"WITH {MASTERY}, {FIRST}, {ENRICHED} {WEAK_POINTS}", True)
register("render_note_markdown", GRADING, lambda a, q, c: SK.notes(weak_points(a, q, c)).select("tag", R.note().alias("note")), f"""WITH {MASTERY}, {FIRST}, {ENRICHED}, e AS ({WEAK_POINTS})
  SELECT tag, concat('# ', tag, chr(10), chr(10), 'Subject: ', coalesce(nullif(subject, ''), 'uncategorized'), chr(10), 'Chapter: ', coalesce(nullif(chapter, ''), 'uncategorized'), chr(10), 'Wrong count: ', wrong_count, chr(10), 'Mastery: ', CAST(round_even(mastery_score * 100, 0) AS INTEGER), '%', chr(10),
    chr(10), '## Common Misconceptions', chr(10), CASE WHEN summary = '' THEN 'No AI summary yet.' ELSE summary END, chr(10), chr(10), '## Confused Concepts', chr(10), CASE WHEN confused_concepts = '' THEN 'None' ELSE replace(confused_concepts, '|', ', ') END, chr(10),
    chr(10), '## Related Wrong Questions', chr(10), CASE WHEN question_ids = '' THEN '- None' ELSE concat('- Q', replace(question_ids, ',', chr(10) || '- Q')) END, chr(10), chr(10), '## Review Actions', chr(10), CASE WHEN recommended_actions = '' THEN '- Review related wrong questions' ELSE concat('- ', replace(recommended_actions, '|', chr(10) || '- ')) END, chr(10)) AS note FROM e""", True)
register("attempt_history", "attempts", lambda a: A.attempt_history(a, 10, 50), "SELECT * FROM attempts ORDER BY create_time DESC, id DESC LIMIT 50 OFFSET 10")
register("best_verified_candidate", "candidates", A.best_verified, f"WITH {BEST} SELECT * EXCLUDE (r) FROM best")
register("latest_candidate", "candidates", lambda c: A.latest(c, "question_id"), "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, id DESC) AS r FROM candidates) WHERE r = 1")

# questions
register("complete_choice_filter", "questions", lambda q: q.filter(A.complete_choice()).select("id"), f"SELECT id FROM questions WHERE {COMPLETE}")
register("gradable_filter", "questions", lambda q: q.filter(A.gradable() & A.filled("answer")).select("id"), "SELECT id FROM questions WHERE question_type = 'choice' AND trim(answer) <> '' AND (coalesce(trim(option_a), '') <> '' OR coalesce(trim(option_b), '') <> '' OR coalesce(trim(option_c), '') <> '' OR coalesce(trim(option_d), '') <> '')")
register("question_search", "questions", lambda q: S.page(S.search(q, tag="RED"), 5, 20).select("id", "knowledge_tag"), "SELECT id, knowledge_tag FROM questions WHERE contains(lower(knowledge_tag), 'red') ORDER BY id LIMIT 20 OFFSET 5")
register("question_search_count", "questions", lambda q: S.search(q, tag="a").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM questions WHERE contains(lower(knowledge_tag), 'a')")
register("chapter_questions", "questions", lambda q: S.of_chapter(q, "LARGE", "Brand#4", "choice").unionByName(S.of_chapter(q, "MEDIUM", "Brand#10")).select("subject", "chapter", "id"), f"SELECT subject, chapter, id FROM questions WHERE (subject = 'LARGE' AND chapter = 'Brand#4' AND question_type = 'choice' AND {COMPLETE}) OR (subject = 'MEDIUM' AND chapter = 'Brand#10') ORDER BY id")
register("chapter_counts", "questions", S.chapter_counts, f"SELECT chapter, count(*) AS n FROM questions WHERE chapter IS NOT NULL AND {COMPLETE} GROUP BY chapter")
register("questions_by_subject", "questions", S.by_subject, "SELECT subject, count(*) AS n FROM questions GROUP BY ROLLUP (subject)")
register("random_questions", "questions", lambda q: S.random_questions(q, 10, 3).select("id"), f"SELECT id FROM questions WHERE {COMPLETE} ORDER BY md5(concat('3:', id)), id LIMIT 10")
register("page_scan", "questions", lambda q: S.page(q, 100, 50).select("id", "question_text"), "SELECT id, question_text FROM questions ORDER BY id LIMIT 50 OFFSET 100")
register("distinct_sources", "questions", lambda q: q.filter(F.col("source_pdf").isNotNull()).select("source_pdf").distinct(), "SELECT DISTINCT source_pdf FROM questions WHERE source_pdf IS NOT NULL")
register("practice_projection", "questions assets", lambda q, a: B.assets_per_question(q, a).select("id", T.strip_images("question_text").alias("question_text"), "option_a", "option_b", "option_c", "option_d", F.coalesce(F.to_json("assets"), F.lit("[]")).alias("assets")), "WITH n AS (SELECT question_id, to_json(list({'id': id, 'path': path, 'asset_type': asset_type} ORDER BY id)) AS assets FROM assets GROUP BY 1) SELECT id, trim(question_text) AS question_text, option_a, option_b, option_c, option_d, coalesce(CAST(n.assets AS VARCHAR), '[]') AS assets FROM questions LEFT JOIN n ON n.question_id = id")

# texts
register("text_hash", "texts", lambda t: t.select("id", T.text_hash("question_text").alias("text_hash")), r"SELECT id, sha256(trim(question_text, concat(' ', chr(9), chr(10), chr(13)))) AS text_hash FROM texts")
register("first_by_hash", "texts", lambda t: S.first_by_hash(t.withColumn("text_hash", T.text_hash("question_text"))).select("id"), "WITH h AS (SELECT id, sha256(trim(question_text, concat(' ', chr(9), chr(10), chr(13)))) AS text_hash FROM texts) SELECT min(id) AS id FROM h GROUP BY text_hash")
HASHED = "h AS (SELECT id, sha256(trim(question_text, concat(' ', chr(9), chr(10), chr(13)))) AS text_hash FROM texts)"
hashed = lambda t: t.withColumn("text_hash", T.text_hash("question_text"))
register("dedup_against_store", "texts", lambda t: S.dedup_against(hashed(t).filter("id % 3 <> 0"), hashed(t).filter("id % 3 = 0")).select("id"), f"WITH {HASHED} SELECT id FROM h WHERE id % 3 <> 0 AND text_hash NOT IN (SELECT text_hash FROM h WHERE id % 3 = 0)")
register("package_import_stats", "texts", lambda t: S.import_stats(hashed(t).filter("id % 3 <> 0"), hashed(t).filter("id % 3 = 0")), f"WITH {HASHED}, n AS (SELECT * FROM h WHERE id % 3 <> 0), k AS (SELECT DISTINCT text_hash FROM n WHERE text_hash NOT IN (SELECT text_hash FROM h WHERE id % 3 = 0)) SELECT (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM k) AS imported, (SELECT count(*) FROM n) - (SELECT count(*) FROM k) AS skipped")
register("pua_detect", "texts", lambda t: t.select("id", T.pua_count("question_text").cast("long").alias("n")), r"SELECT id, CAST(len(regexp_extract_all(question_text, '[\x{E000}-\x{F8FF}]')) AS BIGINT) AS n FROM texts")
register("pua_strip_normalize", "texts", lambda t: t.select("id", T.fingerprint("question_text").alias("fp")), r"SELECT id, substr(regexp_replace(regexp_replace(question_text, '[\x{E000}-\x{F8FF}]', '', 'g'), '[\s\x{3000}\x{00A0}\x{2028}\x{2029}\x{0085}]+', '', 'g'), 1, 40) AS fp FROM texts")
register("pua_repair", "texts", lambda t: t.select("id", F.md5(T.pua_repair("question_text")).alias("h")), "SELECT id, md5(replace(replace(question_text, '', '∑'), '', '')) AS h FROM texts")
register("pua_histogram", "texts", Q.pua_histogram, r"WITH c AS (SELECT unnest(regexp_extract_all(question_text, '[\x{E000}-\x{F8FF}]')) AS ch FROM texts) SELECT ch, count(*) AS n, upper(printf('%x', unicode(ch))) AS code, CASE ch WHEN chr(61617) THEN '∑ (U+2211)' ELSE '?' END AS replacement FROM c GROUP BY ch ORDER BY n DESC, ch")
register("clean_change_report", "questions", lambda q: Q.change_counts(SK.cleaned(q), SK.FIELDS), f"""WITH c AS (SELECT id % 2 = 0 AS even FROM questions) SELECT unnest(['question_text', 'option_a', 'analysis', '(rows)']) AS field, unnest([count(*), count(*) FILTER (even), 0, count(*)]) AS changed, unnest([0, count(*) FILTER (NOT even), count(*), 0]) AS unchanged, CAST(0 AS BIGINT) AS pua_before, CAST(0 AS BIGINT) AS pua_after FROM c
  UNION ALL SELECT CASE WHEN even THEN '(2 fields)' ELSE '(1 fields)' END, count(*), 0, 0, 0 FROM c GROUP BY even""")
register("extract_image_refs", "texts", lambda t: L.resolve_refs(t.select("id", F.explode(T.image_refs("question_text")).alias("ref")), t.filter("id % 2 = 0").select(F.concat(F.lit("images/"), "file", F.lit(".png")).alias("path"))), r"SELECT id, ref, ref IN (SELECT concat('images/', file, '.png') FROM texts WHERE id % 2 = 0) AS found FROM (SELECT id, unnest(regexp_extract_all(question_text, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS ref FROM texts)")
register("extract_html_tables", "texts", lambda t: t.select("id", F.explode(T.html_tables(F.replace("question_text", F.lit("<td>"), F.lit("<td class='x' onClick=\"run('y')\"><b>")))).alias("fragment")), r"SELECT id, replace(fragment, '<td>', '<td class=''x''>') AS fragment FROM (SELECT id, unnest(regexp_extract_all(question_text, '(?is)(<table.*?</table>)', 1)) AS fragment FROM texts)")
register("question_number_extract", "texts", lambda t: t.select("id", T.question_number("question_text").alias("number")), r"SELECT id, CASE WHEN regexp_matches(question_text, '^\s*\d{1,4}\s*[.、．]') THEN CAST(regexp_extract(question_text, '^\s*(\d{1,4})\s*[.、．]', 1) AS INTEGER) END AS number FROM texts")
register("text_preview", "texts", lambda t: t.select("id", T.preview("question_text", 80).alias("preview")), r"WITH c AS (SELECT id, trim(regexp_replace(question_text, '\s+', ' ', 'g')) AS x FROM texts) SELECT id, CASE WHEN length(x) > 80 THEN concat(substr(x, 1, 80), '...') ELSE x END AS preview FROM c")
register("drop_decorative_lines", "texts", lambda t: t.select("id", F.md5(T.drop_rules("question_text")).alias("h")), r"SELECT id, md5(array_to_string(list_filter(string_split(question_text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^[⏟⏞⎵⎴‾_~\-=]{3,}$')), chr(10))) AS h FROM texts")
register("normalize_answer", "attempts", lambda a: a.select("id", T.normalize_answer("user_answer").alias("answer")), "SELECT id, CASE WHEN upper(trim(user_answer)) IN ('A','B','C','D','E') THEN upper(trim(user_answer)) ELSE '' END AS answer FROM attempts")
register("clamp_confidence", "candidates", lambda c: c.select("id", T.clamp_confidence(F.col("confidence") * 2 - 0.5).alias("c")), "SELECT id, greatest(0.0, least(1.0, confidence * 2 - 0.5)) AS c FROM candidates")
register("coerce_bool", "candidates", lambda c: c.select("id", T.coerce_bool("is_verified").alias("b")), "SELECT id, is_verified AS b FROM candidates")
register("safe_name", "questions", lambda q: q.select("id", T.safe_name("chapter").alias("name")), r"""SELECT id, coalesce(nullif(trim(regexp_replace(chapter, '[\\/:*?"<>|]', '_', 'g')), ''), 'uncategorized') AS name FROM questions""")
register("split_tags", "questions", lambda q: q.select("id", F.explode(A.tags()).alias("tag")), "SELECT id, trim(t) AS tag FROM (SELECT id, unnest(string_split(coalesce(knowledge_tag, ''), ',')) AS t FROM questions) WHERE trim(t) <> ''")

# quality
as_questions = lambda t: t.withColumns({"question_type": F.lit("choice"), "answer": F.when(F.col("id") % 2 == 0, "A").otherwise(""), "n_assets": F.when(F.col("id") % 4 == 0, 1).otherwise(0), **{f"option_{k}": F.when((F.col("id") % 5 == 0) & F.lit(k == "b"), " ").otherwise(k) for k in "abcd"}})
ISSUES = r"""issues AS (SELECT id, subject, t.issue_type AS issue_type, t.severity AS severity FROM (SELECT id, subject, unnest(list_filter([
  CASE WHEN id % 5 = 0 THEN {'issue_type': 'choice_missing_option', 'severity': 'high'} END,
  CASE WHEN id % 2 <> 0 THEN {'issue_type': 'empty_answer', 'severity': 'info'} END,
  CASE WHEN regexp_matches(question_text, '!\[[^\]]*\]\(([^)]+)\)') THEN {'issue_type': 'markdown_image_reference', 'severity': CASE WHEN id % 4 = 0 THEN 'info' ELSE 'medium' END} END,
  CASE WHEN contains(lower(question_text), '<table') OR contains(lower(question_text), '</table>') THEN {'issue_type': 'raw_html_table', 'severity': 'medium'} END,
  CASE WHEN len(regexp_extract_all(question_text, '```')) % 2 = 1 THEN {'issue_type': 'unbalanced_code_fence', 'severity': 'high'} END,
  CASE WHEN length(question_text) > 3000 THEN {'issue_type': 'very_long_question_text', 'severity': 'medium'} END], lambda x: x IS NOT NULL)) AS t FROM texts)
  UNION ALL SELECT question_id, NULL, 'missing_asset_file', 'critical' FROM assets WHERE path NOT IN (SELECT path FROM assets WHERE id % 3 = 0))"""
def all_issues(t: DataFrame, a: DataFrame) -> DataFrame:
    """Issues of the texts, and of assets of which every third file is there."""
    return Q.issues(as_questions(t)).unionByName(Q.asset_issues(a, a.filter("id % 3 = 0").select("path").distinct()))


def summed(t: DataFrame, a: DataFrame, found: DataFrame | None = None) -> DataFrame:
    return Q.summary(as_questions(t).withColumn("source", F.col("file")), a, a.filter("id % 3 = 0").select("path").distinct(), found)


register("qc_issues", "texts assets", lambda t, a: all_issues(t, a).drop("preview"), f"WITH {ISSUES} SELECT * FROM issues")
register("qc_summary", "texts assets", summed, f"WITH {ISSUES} SELECT 'issue_type' AS name, issue_type AS a, NULL AS b, count(*) AS n FROM issues GROUP BY issue_type UNION ALL SELECT 'severity', severity, NULL, count(*) FROM issues GROUP BY severity UNION ALL SELECT 'subject_type', subject, 'choice', count(*) FROM texts GROUP BY subject UNION ALL SELECT 'source', file, NULL, count(*) FROM texts GROUP BY file UNION ALL SELECT 'questions', NULL, NULL, count(*) FROM texts UNION ALL SELECT 'assets', NULL, NULL, count(*) FROM assets")
register("qc_top_issues", "texts assets", lambda t, a: Q.top_issues(all_issues(t, a)).drop("preview"), f"WITH {ISSUES} SELECT * FROM issues WHERE severity IN ('high', 'critical') ORDER BY id, issue_type LIMIT 200")

register("write_qc_report", "texts assets", lambda t, a: SK.report(all_issues(t, a), lambda found: summed(t, a, found)), f"WITH {ISSUES}{SK.REPORT}")

for entry in (*ENTRIES, *SK.ENTRIES):
    register(*entry)


# links, over tables of their own
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source; their own beginnings as questions."""
    docs = table(spark, sf_dir, "documents")
    return FP.fingerprint_pages(docs.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("question_text")), docs.select("source", F.col("doc_id").alias("page_no"), "text")).select("id", "page_no")


def fingerprint_any_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions without a source, in all documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("source"), F.col("text").alias("question_text"))
    return FP.fingerprint_pages(items, table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page_no"), "text"), first_only=False)


def image_nearest_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with even numbers as questions, with odd ones as images, placed by quantity."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("y"), F.min("l_suppkey").alias("s"))
    rows = rows.withColumn("page", (F.col("s") % 3).cast("int"))
    return L.nearest_above(rows.filter("n % 2 = 0").select("doc", "page", "y", F.col("n").cast("long").alias("number")), rows.filter("n % 2 = 1").select("doc", "page", "y", F.col("n").alias("image")))


def gap_cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), key.alias("id"), (key * 7 % 400).cast("double").alias("left"), (F.col("o_totalprice") % 1000).alias("top"), F.lit(600.0).alias("page_width"), F.lit(1000.0).alias("page_height"))
    return L.cluster_boxes(rows.withColumn("right", F.col("left") + F.col("id") % 11 * 55).withColumn("bottom", F.col("top") + F.col("id") % 7 * 150))


def offset_page_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page_no"), "text")
    off = docs.select("doc", (F.col("page_no") * 13).alias("off"))
    return L.offset_pages(off, docs)


def parse_markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts put together as a numbered corpus, a file for each brand and range of keys: a chapter of sections, each with a question."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    block = F.concat(
        F.lit("## 1."), "p_size", F.lit(" "), "p_type", F.when(key % 5 == 0, "（重点）").otherwise(""), F.lit("\nno question\n"), key % 1000 + 1, F.lit(". "), "p_name", F.when(key % 4 == 0, "【2020 统考真题】").otherwise(""),
        F.lit("\n3.14 is none（ ）A. one B. "), "p_type", F.lit("\nC. three F8D. no\nD. four\n![x](images/"), "p_size", F.lit(".png)"), F.when(key % 3 == 0, F.concat(F.lit("\n（该节答案见书本P"), key, F.lit("）"))).otherwise(""),
    )
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))), lambda x: x["b"]), "\n")
    corpus = part.groupBy(file_of(F.col("p_brand"), "p_partkey").alias("file")).agg(F.concat(F.lit("## 第3章 "), F.first("p_brand"), F.lit("\n1.5 x\n"), blocks).alias("text"))
    return P.parse(corpus).drop("text_hash")


def transcript_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "at")
    return CV.transcripts(turns).select("conv_id", F.md5("transcript").alias("transcript_md5"), "n")


def conversation_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as times. Every third turn of the assistant is marked a turn later, some of it in broken JSON."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "at")
    marked = turns.filter("role = 'assistant' AND (conv_id + at) % 3 = 0")
    marks = marked.select("conv_id", (F.col("at") + 1).alias("at"), F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("[broken "), "at")).otherwise(F.to_json(F.array(F.substring("text", 1, 40), F.col("at").cast("string")))).alias("bookmarks"))
    return CV.activity(turns.select("conv_id", "at", "role"), marks).select("conv_id", "last_activity", F.array_join("bookmarks", "|").alias("bookmarks"), "questions")


def near_empty_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_empty_ratio(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "text"), 200)


def answer_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as recovered answers to the documents."""
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("subject"), "text")
    return L.fuzzy_answers(answers, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("all").alias("subject"), "text")).select("answer_id", "question_id", F.round("score", 6).alias("score"))


def answer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as recovered answers, some without one, to documents of which every third has an answer already and every fifth an analysis."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("subject"), "text", F.when(F.col("item_id") % 7 != 0, F.concat(F.lit(" b"), "item_id")).alias("answer"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("by item "), "item_id")).alias("analysis"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("all").alias("subject"), "text", F.when(F.col("doc_id") % 3 == 0, "A").alias("answer"), F.when(F.col("doc_id") % 5 == 0, "known").alias("analysis"))
    return L.fill_answers(items, docs)


for f in (answer_fill, fingerprint_page_match, fingerprint_any_source, image_nearest_question, gap_cluster_boxes, offset_page_interval, parse_markdown_corpus, transcript_build, conversation_activity, near_empty_ratio, answer_fuzzy_match):
    QUERIES[f.__name__] = f

BLANKS = r"[\s\x{3000}\x{00A0}\x{2028}\x{2029}\x{0085}]+"
FUZZY = rf"""WITH a AS (SELECT item_id AS id, list_distinct(string_split(substr(regexp_replace(text, '{BLANKS}', '', 'g'), 1, 50), '')) AS s FROM benchmark),
      q AS (SELECT doc_id AS id, list_distinct(string_split(substr(regexp_replace(text, '{BLANKS}', '', 'g'), 1, 50), '')) AS s FROM documents),
      j AS (SELECT a.id AS a, q.id AS q, len(list_intersect(a.s, q.s)) / (len(a.s) + len(q.s) - len(list_intersect(a.s, q.s))) AS score FROM a, q),
      r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, q) AS r FROM j WHERE score > 0.6)"""
ORACLES |= {
    "fingerprint_page_match": rf"WITH n AS (SELECT doc_id, source, regexp_replace(text, '{BLANKS}', '', 'g') AS b FROM documents), f AS (SELECT doc_id AS id, source, substr(b, 1, 40) AS fp FROM n) SELECT f.id, min(n.doc_id) AS page_no FROM f JOIN n ON f.source = n.source AND contains(n.b, f.fp) WHERE length(f.fp) >= 5 GROUP BY f.id",
    "fingerprint_any_source": rf"WITH n AS (SELECT doc_id, source, regexp_replace(text, '{BLANKS}', '', 'g') AS b FROM documents), f AS (SELECT item_id AS id, substr(regexp_replace(text, '{BLANKS}', '', 'g'), 1, 40) AS fp FROM benchmark) SELECT f.id, n.source, n.doc_id AS page_no FROM f JOIN n ON contains(n.b, f.fp) WHERE length(f.fp) >= 5",
    "image_nearest_question": """WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, max(l_quantity) AS y, CAST(min(l_suppkey) % 3 AS INTEGER) AS page FROM lineitem GROUP BY 1, 2),
      q AS (SELECT * FROM r WHERE n % 2 = 0), i AS (SELECT * FROM r WHERE n % 2 = 1),
      j AS (SELECT i.doc, i.n AS image, q.n AS number, row_number() OVER (PARTITION BY i.doc, i.n ORDER BY q.page DESC, q.y DESC, q.n DESC) AS r FROM i LEFT JOIN q ON q.doc = i.doc AND (q.page < i.page OR (q.page = i.page AND q.y <= i.y)))
      SELECT doc, CAST(image AS BIGINT) AS image, CAST(number AS BIGINT) AS number FROM j WHERE r = 1""",
    "gap_cluster_boxes": """WITH o AS (SELECT o_custkey AS page, o_orderkey AS id, CAST(o_orderkey * 7 % 400 AS DOUBLE) AS x0, o_totalprice % 1000 AS y0, x0 + o_orderkey % 11 * 55 AS x1, y0 + o_orderkey % 7 * 150 AS y1 FROM orders),
      s AS (SELECT * FROM o WHERE NOT (x1 - x0 > 480 AND y1 - y0 > 800) AND NOT (x1 - x0 < 5 AND y1 - y0 < 5)),
      l AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM s),
      c AS (SELECT *, sum(CASE WHEN low IS NULL OR y0 - low >= 30.0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, y1, id ROWS UNBOUNDED PRECEDING) AS cluster FROM l),
      g AS (SELECT page, cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM c GROUP BY 1, 2)
      SELECT page, CAST(cluster AS BIGINT) AS cluster, greatest(0.0, x0 - 0.1 * (y1 - y0)) AS left, greatest(0.0, y0 - 0.1 * (y1 - y0)) AS top, least(600.0, x1 + 0.1 * (y1 - y0)) AS right, least(1000.0, y1 + 0.1 * (y1 - y0)) AS bottom, n FROM g WHERE (x1 - x0) * (y1 - y0) >= 0.05 * 600 * 1000 AND y1 - y0 >= 20""",
    "offset_page_interval": """WITH p AS (SELECT source AS doc, doc_id AS page_no, coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) + 1 AS n FROM documents)
      SELECT o.source AS doc, o.doc_id * 13 AS off, p.page_no FROM documents o JOIN p ON p.doc = o.source AND o.doc_id * 13 >= p.s AND o.doc_id * 13 < p.s + p.n""",
    "parse_markdown_corpus": f"""SELECT concat(p_brand, '-', p_partkey // {FILE_IDS}) AS file, CAST(p_partkey % 1000 + 1 AS INTEGER) AS number, concat('第3章 ', p_brand) AS chapter, concat('1.', p_size, ' ', p_type) AS section, CASE WHEN p_partkey % 3 = 0 THEN concat('答案见原书P', p_partkey) END AS answer_ref,
      CASE WHEN p_partkey % 4 = 0 THEN '2020统考真题' END AS exam_year, concat('1.', p_size, ' ', p_type, CASE WHEN p_partkey % 4 = 0 THEN ',2020统考真题' ELSE '' END) AS knowledge_tag,
      concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN '【2020 统考真题】' ELSE '' END, chr(10), '3.14 is none（ ）') AS question_text, 'one' AS option_a, p_type AS option_b, 'three F8D. no' AS option_c, concat('four', chr(10), '![x](images/', p_size, '.png)') AS option_d, concat('images/', p_size, '.png') AS images FROM part""",
    "transcript_build": "SELECT conv_id, md5(string_agg(concat(role, ': ', coalesce(text, '')), chr(10) ORDER BY turn)) AS transcript_md5, count(*) AS n FROM conversations GROUP BY conv_id",
    "conversation_activity": """WITH m AS (SELECT conv_id, turn + 1 AS done, concat_ws('|', substr(text, 1, 40), turn) AS b FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 3 = 0), k AS (SELECT conv_id, max(done) AS done, arg_max(b, done) AS b FROM m GROUP BY 1)
      SELECT conv_id, greatest(max(turn), coalesce(max(k.done), -1)) AS last_activity, CASE WHEN conv_id % 4 = 0 THEN '' ELSE coalesce(max(k.b), '') END AS bookmarks, count(*) FILTER (role = 'user') AS questions FROM conversations LEFT JOIN k USING (conv_id) GROUP BY conv_id ORDER BY last_activity DESC, conv_id""",
    "near_empty_ratio": "SELECT source AS doc, avg(CASE WHEN length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) < 200 THEN 1.0 ELSE 0.0 END) AS ratio, avg(CASE WHEN length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) < 200 THEN 1.0 ELSE 0.0 END) >= 0.5 AS scanned FROM documents GROUP BY source",
    "answer_fill": rf"""{FUZZY}, o AS (SELECT q, min(a) AS a FROM r WHERE r = 1 AND a % 7 <> 0 GROUP BY q)
      SELECT q AS question_id, a AS answer_id, concat('B', a) AS answer, CASE WHEN q % 5 = 0 THEN 'known' WHEN a % 2 = 0 THEN concat('by item ', a) END AS analysis FROM o WHERE q % 3 <> 0""",
    "answer_fuzzy_match": rf"""{FUZZY}
      SELECT a AS answer_id, q AS question_id, round(score, 6) AS score FROM r WHERE r = 1""",
}


# streams over the same events, which arrive in two parts by time; the second run starts from the checkpoint of the first
def streamed(f: Callable[[SparkSession, str, DataFrame], DataFrame], mode: str, keys: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """keys: the table that updates of rows amount to; else all rows that were appended."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = folder(spark)
        for lay in TB.arriving(table(spark, sf_dir, "events"), "ts", 2, f"{root}/events"):
            lay()
            out = f(spark, sf_dir, ST.read_stream(spark, sf_dir, f"{root}/events"))
            TB.run(out, root, mode)
        return TB.current(spark, root, out, keys) if keys else TB.changes(spark, root, out).drop("batch")

    return run


def on_stream(f: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return streamed(lambda spark, sf_dir, attempts: f(ST.grade_stream(attempts, load(spark, sf_dir, "questions"), load(spark, sf_dir, "candidates"))), mode, keys)


def book_events(spark: SparkSession, sf_dir: str, attempts: DataFrame) -> DataFrame:
    """Graded attempts and, every fourth, reviews."""
    questions, fields = load(spark, sf_dir, "questions"), ["id", "question_id", "subject", "chapter", "create_time", "is_correct", "is_review"]
    quiz = ST.grade_stream(attempts.filter("id % 4 <> 0"), questions, load(spark, sf_dir, "candidates")).withColumn("is_review", F.lit(False))
    again = A.grade_reviews(attempts.filter("id % 4 = 0"), questions).withColumns({"subject": F.lit(None).cast("string"), "chapter": F.lit(None).cast("string"), "is_review": F.lit(True)})
    return quiz.select(fields).unionByName(again.select(fields))


def stream_wrong_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = streamed(lambda s, d, attempts: ST.wrong_book_stream(book_events(s, d, attempts)), "update", ["question_id"])(spark, sf_dir)
    return book.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("added_at", "last_review_at")})


def stream_accuracy_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = on_stream(ST.trend_so_far, "update", ["start", "subject"])(spark, sf_dir)
    return days.select(F.col("start").cast("timestamp_ntz").alias("day"), "subject", "total", "correct")


QUERIES |= {
    "stream_grade": on_stream(lambda g: g.select("id", "question_id", "key", "key_source", "key_confidence", "is_correct"), "append"),
    "stream_tag_mastery": on_stream(ST.mastery_stream, "update", ["tag"]),
    "stream_misconception_frequency": on_stream(ST.misconception_stream, "update", ["question_id"]),
    "stream_wrong_book": stream_wrong_book,
    "stream_accuracy_trend": stream_accuracy_trend,
}
ORACLES |= {"stream_grade": ORACLES["grade_attempts"], "stream_tag_mastery": ORACLES["tag_mastery"], "stream_wrong_book": ORACLES["wrong_book_batch"]}
ORACLES["stream_misconception_frequency"] = with_ctes(f"WITH {GRADED}, {FIRST} SELECT question_id, frequency, user_answer FROM firsts", *GRADING.split())
ORACLES["stream_accuracy_trend"] = with_ctes(f"WITH {GRADED} SELECT date_trunc('day', create_time) AS day, subject, count(*) AS total, count(*) FILTER (is_correct) AS correct FROM graded GROUP BY 1, 2", *GRADING.split())


def stream_dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts are in the store, the others arrive."""
    return SI.ingest(hashed(SI.read_texts(spark, sf_dir)).filter("id % 3 <> 0"), hashed(load(spark, sf_dir, "texts")).filter("id % 3 = 0"), folder(spark)).select("id")


QUERIES["stream_dedup_ingest"] = stream_dedup_ingest
ORACLES["stream_dedup_ingest"] = with_ctes(f"WITH {HASHED} SELECT min(id) AS id FROM h WHERE id % 3 <> 0 AND text_hash NOT IN (SELECT text_hash FROM h WHERE id % 3 = 0) GROUP BY text_hash", "texts")
