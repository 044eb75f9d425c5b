"""Queries over packages, imports, replies and corpora with their SQL twins, for ``catalog``: (name, projections, function, SQL, whether SQL uses ``graded``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import replies as R
from .functions import text as T
from .operators import attempts as A
from .operators import banks as B
from .operators import fingerprints as FP
from .operators import links as L
from .operators import quality as Q
from .operators import questions as S
from .plans import pages as PG
from .plans import parsing as P
from .sources import sync as SY
from .sources.shared import folder

WS = "concat(' ', chr(9), chr(10), chr(13))"
HASHED = f"h AS (SELECT *, sha256(trim(question_text, {WS})) AS text_hash FROM texts)"
PUA_SQL = r"[\x{E000}-\x{F8FF}]"


def hashed(t: DataFrame) -> DataFrame:
    return t.withColumn("text_hash", T.text_hash("question_text"))


def shown(assets: DataFrame) -> DataFrame:
    return assets.select("id", F.array_join(F.transform("assets", lambda x: x["path"]), ",").alias("paths"), F.coalesce(F.size("assets"), F.lit(0)).cast("long").alias("n"))


#: Ids of the questions in a made-up file, so that files do not grow with the table.
FILE_IDS = 10_000
FILE = f"concat(regexp_replace(source_pdf, '[.]pdf$', ''), '-', id // {FILE_IDS})"


def file_of(name: Column, key: str) -> Column:
    return F.concat(name, F.lit("-"), F.floor(F.col(key) / FILE_IDS))


def as_corpus(q: DataFrame) -> DataFrame:
    """Questions put together as numbered texts, a file for each brand and range of ids."""
    block = F.concat(F.lit("## 1."), F.col("page_number"), F.lit(" "), F.col("subject"), F.lit("\n"), F.col("id") % 1000 + 1, F.lit(". "), F.col("question_text"), F.lit("\nA. one\nB. two"))
    file = file_of(F.regexp_replace("source_pdf", r"\.pdf$", ""), "id")
    return q.groupBy(file.alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def placed(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets with even ids as questions, with odd ones as images, of a document and page."""
    rows = a.select((F.col("question_id") % 97).alias("doc"), (F.col("question_id") % 7).alias("page"), F.col("id").alias("y"), "id")
    return rows.filter("id % 2 = 0").withColumnRenamed("id", "number"), rows.filter("id % 2 = 1").withColumnRenamed("id", "image")


PLACED = "p AS (SELECT question_id % 97 AS doc, question_id % 7 AS page, id FROM assets), q AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY id) AS k, count(*) OVER (PARTITION BY doc, page) AS n FROM p WHERE id % 2 = 0), i AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY id) AS k FROM p WHERE id % 2 = 1)"


def page_images(a: DataFrame) -> DataFrame:
    questions, images = placed(a)
    return B.images_of_pages(questions, images, questions.filter("doc % 3 = 0").select("doc").distinct())


def fixes(t: DataFrame) -> DataFrame:
    new = F.when(F.col("id") % 10 == 0, F.concat(F.lit("bad \ue000 "), F.col("id"))).when(F.col("id") % 5 == 0, F.concat(F.lit("fixed "), "file"))
    listed = t.filter("id % 5 = 0 OR id % 7 = 0").select("id", new.alias("question_text"), F.when(F.col("id") % 7 == 0, F.concat("file", F.lit("!"))).alias("file"))
    return L.apply_corrections(t, listed).select("id", "n_corrected", "n_refused", "file", F.md5("question_text").alias("h"))


def reply(c: DataFrame) -> DataFrame:
    raw = F.concat(F.lit('```json\n{"answer": " '), F.lower("answer_text"), F.lit('", "confidence": '), F.col("confidence"), F.lit(', "usable": '), F.col("is_verified"), F.lit("}\n```"))
    return c.select("id", R.candidate(F.when(F.col("id") % 9 == 0, F.lit("none")).otherwise(raw)).alias("r")).select("id", "r.*")


def analysed(t: DataFrame) -> DataFrame:
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"cause": "c'), F.col("id"), F.lit('", "concepts": ["a", "b"]}'))).otherwise(F.col("question_text"))
    return t.select("id", R.analysis(raw).alias("r")).select("id", F.md5("r.cause").alias("h"), F.size("r.concepts").cast("long").alias("n"))


def answered(q: DataFrame) -> DataFrame:
    """Replies to pages of a question each: some name a chapter, some a section, some are broken."""
    named = F.to_json(F.struct(F.when(F.col("id") % 5 == 0, F.concat(F.lit("c"), "id")).alias("chapter"), F.when(F.col("id") % 7 == 0, F.col("chapter")).alias("section")))
    asked = F.concat(F.lit('[{"number": '), "id", F.lit(', "answer": " '), F.lower("answer"), F.lit('", "exam_year": "'), F.when(F.col("id") % 4 == 0, "2020").otherwise(""), F.lit('"}, {"number": -1, "answer": " "}]'))
    whole = F.concat(F.lit('```json\n{"context": '), named, F.lit(', "questions": '), asked, F.lit("}\n```"))
    pages = q.select(F.col("source_pdf").alias("doc"), F.col("id").alias("page_no"), F.when(F.col("id") % 11 == 1, "no JSON").otherwise(whole).alias("reply"))
    return PG.answers_of_pages(pages).select("doc", "number", "answer", "section", "knowledge_tag")


#: A page with a section has id % 7 = 0 and a chapter column that is not null.
ANSWERED = """WITH p AS (SELECT *, id % 11 <> 1 AS ok FROM questions), c AS (SELECT *, last_value(CASE WHEN ok AND id % 5 = 0 THEN concat('c', id) END IGNORE NULLS) OVER w AS ch, last_value(CASE WHEN ok AND id % 7 = 0 THEN chapter END IGNORE NULLS) OVER w AS se FROM p WINDOW w AS (PARTITION BY source_pdf ORDER BY id))
  SELECT source_pdf AS doc, id AS number, answer, coalesce(se, ch) AS section, concat_ws(',', coalesce(se, ch), CASE WHEN id % 4 = 0 THEN '2020' END) AS knowledge_tag FROM c WHERE ok AND trim(answer) <> ''"""


def prompts(a: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """Every kind of prompt: on questions by their type, on all for the tutor, on wrong attempts, and on the pages that hold the questions."""
    q = q.withColumn("analysis", F.concat(F.lit("see "), "chapter"))
    wrong = A.grade(a, q, c).filter("NOT is_correct").select(F.col("id").alias("attempt"), "question_id", "user_answer", "key")
    wrong = wrong.join(q.withColumnRenamed("id", "question_id").hint("merge"), "question_id")
    kind = lambda rows, key, name, text: rows.select(F.col(key).alias("id"), F.lit(name).alias("kind"), text.alias("prompt"))
    pages = PG.correction_blocks(q.withColumnsRenamed({"source_pdf": "doc", "page_number": "page_no"}))
    out = kind(q.filter("question_type = 'choice'"), "id", "answer", R.answer_prompt()).union(kind(q.filter("question_type <> 'choice'"), "id", "essay", R.essay_prompt()))
    return out.union(kind(q, "id", "tutor", R.tutor_prompt())).union(kind(q, "id", "tutor without key", R.tutor_prompt(include_key=False))).union(kind(wrong, "attempt", "mistake", R.mistake_prompt())).union(kind(pages, "first_id", "page", F.col("prompt")))


OPTION_LINES = "'A. ' || option_a, 'B. ' || option_b, 'C. ' || option_c, 'D. ' || option_d"
PROMPTS = f"""WITH w AS (SELECT g.id, g.user_answer, g.key, q.* EXCLUDE (id) FROM graded g JOIN questions q ON q.id = g.question_id WHERE NOT is_correct)
  SELECT id, 'answer' AS kind, concat_ws(chr(10), 'Subject: ' || subject, 'Question: ' || question_text, {OPTION_LINES}) AS prompt FROM questions WHERE question_type = 'choice'
  UNION ALL SELECT id, 'essay', concat('【', subject, '】', chr(10), '题目：', question_text) FROM questions WHERE question_type <> 'choice'
  UNION ALL SELECT id, 'tutor', concat_ws(chr(10), concat('[当前题目] 科目:', subject, ' 章节:', chapter), concat('题目: ', question_text), CASE WHEN option_a <> '' THEN concat('A.', option_a, ' B.', option_b, ' C.', option_c, ' D.', option_d) END, '正确答案: ' || nullif(answer, ''), '解析: see ' || chapter) FROM questions
  UNION ALL SELECT id, 'tutor without key', concat_ws(chr(10), concat('[当前题目] 科目:', subject, ' 章节:', chapter), concat('题目: ', question_text), CASE WHEN option_a <> '' THEN concat('A.', option_a, ' B.', option_b, ' C.', option_c, ' D.', option_d) END) FROM questions
  UNION ALL SELECT id, 'mistake', concat_ws(chr(10), concat('科目：', subject), concat('章节：', coalesce(chapter, '未知')), concat('题目：', question_text), '选项：', {OPTION_LINES}, concat('学生答案：', user_answer, '（错误）'), concat('正确答案：', key)) FROM w
  UNION ALL SELECT min(id), 'page', string_agg(concat_ws(chr(10), concat('[ID=', id, '] 题目: ', question_text), '  A. ' || option_a, '  B. ' || option_b, '  C. ' || option_c, '  D. ' || option_d), chr(10) || chr(10) ORDER BY id) FROM questions GROUP BY source_pdf, page_number, id // 1000"""


def scanned(t: DataFrame) -> DataFrame:
    """Pages with blank lines and a counter at their foot."""
    pages = t.select(F.col("file").alias("doc"), F.col("id").alias("page_no"), F.concat("question_text", F.lit("\n\n\n\n· 第 3 页，共 "), "id", F.lit(" 页 ·\n\n")).alias("text"))
    return PG.scan_pages(pages).withColumn("text", F.md5("text"))


def as_list(q: DataFrame) -> DataFrame:
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit('["'), F.col("chapter"), F.lit('", " ", " b "]'))).when(F.col("id") % 3 == 1, F.concat(F.lit('"'), F.col("chapter"), F.lit('"'))).otherwise(F.col("chapter"))
    return q.filter("chapter IS NOT NULL").select("id", F.array_join(T.json_list(raw), "|").alias("items"))


def paths(a: DataFrame) -> DataFrame:
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("/app/"), F.col("path"))).when(F.col("id") % 4 == 1, F.concat(F.lit("a/../"), F.col("path"))).when(F.col("id") % 4 == 2, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    return a.withColumn("raw", raw)


def listing(q: DataFrame) -> DataFrame:
    brand = F.regexp_replace("source_pdf", r"\.pdf$", "")
    return q.select(F.when(F.substring(brand, -1, 1).isin("1", "3"), F.concat(F.lit("/d/"), F.upper(brand), F.lit(".PDF"))).otherwise(F.concat(F.lit("/d/"), brand, F.lit(".md"))).alias("path")).distinct()


def removed(q: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """How many rows stay and go when every third question, and ids that no question has, are removed."""
    ids = q.select((F.col("id") * 3).alias("id"))
    ids = ids.union(q.select((F.col("id") * 3 + 3_000_000_000).alias("id"))).union(c.filter("question_id % 3 = 0").select("question_id"))
    ids = ids.union(a.filter("question_id % 3 = 0").select("question_id"))
    out = None
    for name, (kept, gone) in B.remove_cascade(q, ids, {"assets": a, "candidates": c}).items():
        row = kept.agg(F.lit(name).alias("name"), F.count("*").alias("kept")).join(F.broadcast(gone.agg(F.count("*").alias("removed"))), F.lit(True))  # one row each
        out = row if out is None else out.union(row)
    return out


def grown(q: DataFrame, a: DataFrame) -> DataFrame:
    """The paths of a question with one more, which even ids have already."""
    listed = B.assets_per_question(q, a)
    item = F.when(F.col("id") % 2 == 0, F.get(F.col("assets"), F.lit(0))["path"]).otherwise(F.col("source_pdf"))
    return listed.select("id", R.appended(F.array_join(F.transform("assets", lambda x: x["path"]), ", "), item).alias("paths"))


def leaks(t: DataFrame) -> DataFrame:
    x = F.lower(F.coalesce(T.strip_details("question_text"), F.lit("")))
    has = {"details": r"<details", "summary": r"<summary", "mermaid": r"```mermaid", "images": r"!\[[^\]]*\]\([^)]+\)", "tables": r"<table"}
    return t.agg(*(F.count_if(F.regexp_like(x, F.lit(p))).alias(k) for k, p in has.items()), F.count_if(F.regexp_count(x, F.lit("```")) % 2 == 1).alias("odd_fences"))


BOOK = "book AS (SELECT question_id, subject, chapter, CASE WHEN count(*) > 1 THEN 'wrong' ELSE 'unreviewed' END AS last_status FROM graded WHERE NOT is_correct GROUP BY 1, 2, 3)"
GRADING = "attempts questions candidates"
book = lambda a, q, c: A.wrong_book(A.grade(a, q, c))
DETAIL = ["subject", "chapter", "question_type", "question_text", "option_a", "option_b", "option_c", "option_d"]
SYNCED = "question_id % 4 = 0"

def pushed(a: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """Misconceptions in a store, of which those of every fourth question were pushed and marked."""
    spark, path = q.sparkSession, folder(q.sparkSession)
    SY.write_store(A.misconceptions(A.grade(a, q, c)).select("question_id", "frequency"), path, "question_id")
    SY.mark_synced(spark, path, SY.unsynced(SY.read_store(spark, path)).filter(SYNCED), "question_id")
    return SY.read_store(spark, path)


ENTRIES = [
    # assets and packages
    ("assets_per_question", "questions assets", lambda q, a: shown(B.assets_per_question(q, a)), "SELECT q.id, string_agg(a.path, ',' ORDER BY a.id) AS paths, count(a.id) AS n FROM questions q LEFT JOIN assets a ON a.question_id = q.id GROUP BY q.id"),
    ("qc_asset_counts", "assets", lambda a: a.groupBy("question_id").agg(F.count("*").alias("n")), "SELECT question_id, count(*) AS n FROM assets GROUP BY 1"),
    ("missing_assets", "assets", lambda a: Q.missing_assets(a, a.filter("id % 3 = 0").select("path").distinct()).select("id", "path"), "SELECT id, path FROM assets WHERE path NOT IN (SELECT path FROM assets WHERE id % 3 = 0)"),
    ("insert_absent_assets", "assets", lambda a: B.insert_absent(a.filter("id % 2 = 0").select("question_id", "path"), a.filter("id % 3 = 0").select("question_id", "path"), ["question_id", "path"]), "WITH s AS (SELECT question_id, path FROM assets WHERE id % 2 = 0) SELECT * FROM s UNION ALL SELECT DISTINCT question_id, path FROM assets n WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.question_id = n.question_id AND s.path = n.path)"),
    ("legacy_path_filter", "assets", lambda a: paths(a).filter(B.legacy_path("raw", "images\\1")).select("id", "raw"), r"SELECT * FROM (SELECT id, CASE id % 4 WHEN 0 THEN concat('/app/', path) WHEN 1 THEN concat('a/../', path) WHEN 2 THEN replace(path, '/', '\') ELSE path END AS raw FROM assets) WHERE raw LIKE '/app/%' OR contains(raw, 'images\1')"),
    ("safe_relative_path", "assets", lambda a: paths(a).select("id", T.safe_relative_path("raw").alias("safe")), "SELECT id, CASE WHEN id % 4 >= 2 THEN path END AS safe FROM assets"),
    ("image_ordinal_assign", "assets", lambda a: B.ordinal_images(*placed(a)), f"WITH {PLACED}, m AS (SELECT DISTINCT doc, page, n FROM q) SELECT i.doc, i.page, i.id AS image, q.id AS number FROM i JOIN m USING (doc, page) JOIN q ON q.doc = i.doc AND q.page = i.page AND q.k = least(i.k, m.n)"),
    ("image_page_fallback", "assets", page_images, f"WITH {PLACED} SELECT i.doc, i.page, i.id AS image, q.id AS number FROM i JOIN q ON i.doc = q.doc AND i.page = q.page WHERE q.doc % 3 <> 0"),
    ("package_metadata", "questions assets candidates", B.package_metadata, "SELECT (SELECT count(*) FROM questions) AS questions, (SELECT bool_or(trim(answer) <> '') FROM questions) AS has_partial_answers, (SELECT count(*) FROM assets) AS assets, (SELECT count(*) FROM candidates) AS candidates, (SELECT count(*) > 0 FROM assets) AS has_media"),
    ("resolve_source_file", "questions", lambda q: B.resolve_files(q.select("id", "source_pdf"), listing(q), "source_pdf").select("id", "path"), "SELECT id, CASE WHEN right(b, 1) IN ('1', '3') THEN concat('/d/', upper(b), '.PDF') ELSE concat('/d/', b, '.md') END AS path FROM (SELECT id, regexp_replace(source_pdf, '[.]pdf$', '') AS b FROM questions)"),
    ("batch_select", "questions", lambda q: q.join(q.filter("id % 50 = 1").select("id").hint("merge"), "id", "left_semi").select("id", "question_text"), "SELECT id, question_text FROM questions WHERE id % 50 = 1"),
    ("batch_remove", "questions", lambda q: B.remove_batch(q.select("id", "subject"), q.select((F.col("id") * 3).alias("id")))[0], "SELECT id, subject FROM questions WHERE id NOT IN (SELECT id * 3 FROM questions)"),
    ("batch_remove_cascade", "questions assets candidates", removed, "SELECT 'questions' AS name, count(*) FILTER (id % 3 <> 0) AS kept, count(*) FILTER (id % 3 = 0) AS removed FROM questions UNION ALL SELECT 'assets', count(*) FILTER (question_id % 3 <> 0), count(*) FILTER (question_id % 3 = 0) FROM assets UNION ALL SELECT 'candidates', count(*) FILTER (question_id % 3 <> 0), count(*) FILTER (question_id % 3 = 0) FROM candidates"),
    ("schema_evolution_union", "questions candidates", lambda q, c: q.select("id", "answer").unionByName(c.select("id", F.col("answer_text").alias("answer"), "confidence"), allowMissingColumns=True), "SELECT id, answer, CAST(NULL AS DOUBLE) AS confidence FROM questions UNION ALL SELECT id, answer_text, confidence FROM candidates"),
    ("ordered_union_distinct", "questions", lambda q: S.ordered_list(q.select("subject", "id", F.explode(A.tags()).alias("tag")), "subject", "tag", "id"), "WITH e AS (SELECT subject, id, trim(t) AS tag FROM (SELECT subject, id, unnest(string_split(coalesce(knowledge_tag, ''), ',')) AS t FROM questions) WHERE trim(t) <> ''), f AS (SELECT subject, tag, min(id) AS id, count(*) AS n FROM e GROUP BY 1, 2) SELECT subject, string_agg(tag, ',' ORDER BY id, tag) AS items, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1"),
    ("latest_bank_import", "candidates", lambda c: B.latest_run(c, "source"), "SELECT source, created_at, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) AS r FROM candidates) WHERE r = 1"),
    ("recent_exports", "candidates", lambda c: B.recent_runs(c.select("id", "source", "created_at")), "SELECT id, source, created_at FROM candidates ORDER BY created_at DESC, id DESC LIMIT 20"),
    # error book and misconceptions
    ("join_wrong_questions", GRADING, lambda a, q, c: B.with_question(book(a, q, c).select("question_id", "last_status"), q).select("question_id", "last_status", "question.question_text", "question.source_pdf"), f"WITH {BOOK} SELECT question_id, last_status, question_text, source_pdf FROM book LEFT JOIN questions q ON q.id = question_id", True),
    ("wrong_detail", GRADING, lambda a, q, c: B.with_question(book(a, q, c), q).select("question_id", "last_status", F.to_json(F.struct(*(f"question.{x}" for x in DETAIL)), {"ignoreNullFields": "false"}).alias("question")), f"WITH {BOOK} SELECT question_id, last_status, CAST(to_json({{{', '.join(repr(x) + ': ' + 'q.' + x for x in DETAIL)}}}) AS VARCHAR) AS question FROM book JOIN questions q ON q.id = question_id", True),
    ("unsynced_misconceptions", GRADING, lambda a, q, c: SY.unsynced(pushed(a, q, c)).select("question_id", "frequency"), "SELECT question_id, count(*) AS frequency FROM graded WHERE NOT is_correct AND question_id % 4 <> 0 GROUP BY 1", True),
    ("misconception_sync_counts", GRADING, lambda a, q, c: SY.counts(pushed(a, q, c)), "SELECT count(DISTINCT question_id) AS total, count(DISTINCT question_id) FILTER (question_id % 4 = 0) AS synced FROM graded WHERE NOT is_correct", True),
    # imports and corrections
    ("parse_validity_filter", "texts", lambda t: t.filter(~B.blank("question_text")).select("id"), f"SELECT id FROM texts WHERE trim(coalesce(question_text, ''), {WS}) <> ''"),
    ("import_report", "texts", lambda t: B.import_report(hashed(t).filter("id % 3 <> 0"), hashed(t).filter("id % 3 = 0")), f"WITH {HASHED}, n AS (SELECT * FROM h WHERE id % 3 <> 0), k AS (SELECT min(id) AS id FROM n WHERE trim(question_text, {WS}) <> '' AND text_hash NOT IN (SELECT text_hash FROM h WHERE id % 3 = 0) GROUP BY text_hash) SELECT file, count(*) AS found, count(k.id) AS success, count(*) FILTER (k.id IS NULL AND trim(question_text, {WS}) <> '') AS skipped, count(*) FILTER (trim(question_text, {WS}) = '') AS error FROM n LEFT JOIN k ON k.id = n.id GROUP BY ROLLUP (file)"),
    ("import_errors", "texts", lambda t: B.import_errors(t.withColumn("number", F.col("id") % 50).withColumn("question_text", F.when(F.col("id") % 4 != 0, F.col("question_text")).when(F.col("id") % 8 == 0, " \n"))), "SELECT file, id, concat('Q#', id % 50, ': empty question text') AS error FROM texts WHERE id % 4 = 0"),
    ("relink_by_hash", "texts", lambda t: L.relink_by_hash(hashed(t).filter("id % 2 = 1").select("id", F.col("text_hash").alias("question_text_hash")), S.first_by_hash(hashed(t).filter("id % 3 <> 0"))).select("question_text_hash", "question_id"), f"WITH {HASHED}, k AS (SELECT text_hash, min(id) AS id FROM h WHERE id % 3 <> 0 GROUP BY 1) SELECT k.text_hash AS question_text_hash, k.id AS question_id FROM h JOIN k USING (text_hash) WHERE h.id % 2 = 1"),
    ("apply_corrections", "texts", fixes, "SELECT id, CAST((id % 5 = 0 AND id % 10 <> 0) AS BIGINT) + CAST((id % 7 = 0) AS BIGINT) AS n_corrected, CAST((id % 10 = 0) AS BIGINT) AS n_refused, CASE WHEN id % 7 = 0 THEN concat(file, '!') ELSE file END AS file, md5(CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN concat('fixed ', file) ELSE question_text END) AS h FROM texts"),
    ("pua_repair_report", "texts", B.pua_report, f"WITH c AS (SELECT file, len(regexp_extract_all(question_text, '{PUA_SQL}')) AS a, len(regexp_extract_all(replace(question_text, chr(61617), ''), '{PUA_SQL}')) AS b FROM texts) SELECT file, count(*) FILTER (a > 0) AS affected, CAST(sum(a) AS BIGINT) AS before, CAST(sum(b) AS BIGINT) AS after, count(*) FILTER (b > 0) AS still_affected FROM c GROUP BY file"),
    ("trivial_page_filter", "texts", lambda t: t.groupBy("file").agg(F.count("*").alias("pages"), F.count_if(B.trivial_page("question_text")).alias("trivial"), F.min(F.when(~B.trivial_page("question_text"), F.col("id"))).alias("first_kept")), f"WITH p AS (SELECT id, file, length(trim(question_text, {WS})) < 50 OR len(list_filter(string_split(question_text, chr(10)), lambda x: trim(x, {WS}) <> '')) <= 2 AS trivial FROM texts) SELECT file, count(*) AS pages, count(*) FILTER (trivial) AS trivial, min(id) FILTER (NOT trivial) AS first_kept FROM p GROUP BY 1"),
    ("scan_page_text", "texts", scanned, rf"WITH c AS (SELECT file, id, trim(regexp_replace(question_text, '\n{{3,}}', concat(chr(10), chr(10)), 'g'), {WS}) AS x FROM texts) SELECT file AS doc, id AS page_no, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(x) AS n_chars, md5(x) AS text FROM c"),
    ("carry_last_question", "texts", lambda t: B.carry_last_number(t.select(F.col("file").alias("doc"), F.col("id").alias("page_no"), F.when(T.question_number("question_text").isNotNull(), F.col("id")).alias("number"))).select("doc", "page_no", "carried"), r"SELECT file AS doc, id AS page_no, last_value(CASE WHEN regexp_matches(question_text, '^\s*\d{1,4}\s*[.、．]') THEN id END IGNORE NULLS) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM texts"),
    ("fingerprint_all_pages", "texts", lambda t: FP.fingerprint_pages(t.withColumn("source", F.col("file")), t.select(F.col("file").alias("source"), F.col("id").alias("page_no"), F.col("question_text").alias("text")), first_only=False).select("id", "page_no"), rf"WITH n AS (SELECT id, file, regexp_replace(regexp_replace(question_text, '{PUA_SQL}', '', 'g'), '[\s\x{{3000}}\x{{00A0}}\x{{2028}}\x{{2029}}\x{{0085}}]+', '', 'g') AS b FROM texts), f AS (SELECT id, file, substr(b, 1, 40) AS fp FROM n) SELECT DISTINCT f.id, n.id AS page_no FROM f JOIN n ON f.file = n.file AND contains(n.b, f.fp) WHERE length(f.fp) >= 5"),
    # corpora
    ("section_carry_forward", "questions", lambda q: P.carry_sections(P.lines(as_corpus(q))).filter(F.regexp_like("line", F.lit(P.START))).select("file", F.col("block").cast("long").alias("block"), "section"), f"SELECT {FILE} AS file, row_number() OVER (PARTITION BY source_pdf, id // {FILE_IDS} ORDER BY id) AS block, concat('1.', page_number, ' ', subject) AS section FROM questions"),
    ("question_block_split", "questions", lambda q: P.carry_sections(P.lines(as_corpus(q))).filter((F.col("block") > 0) & ~F.regexp_like("line", F.lit(P.SECTION))).groupBy("file", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n_lines")), f"SELECT {FILE} AS file, row_number() OVER (PARTITION BY source_pdf, id // {FILE_IDS} ORDER BY id) AS block, CAST(3 AS BIGINT) AS n_lines FROM questions"),
    ("parse_summary", "questions", lambda q: P.parse(as_corpus(q)).groupBy("file").agg(F.count("*").alias("parsed"), F.count("option_a").alias("with_options"), F.count_if(F.size(T.image_refs("question_text")) > 0).alias("with_images"), F.count_if(T.pua_count("question_text") > 0).alias("with_pua")), f"SELECT {FILE} AS file, count(*) AS parsed, count(*) AS with_options, CAST(0 AS BIGINT) AS with_images, CAST(0 AS BIGINT) AS with_pua FROM questions GROUP BY 1"),
    ("options_extract", "questions", lambda q: q.select("id", T.inline_options(F.concat("question_text", F.lit("（ ）A. "), "subject", F.lit("  b.two\nC. "), "source_pdf", F.lit("主机D. four F8A. x"))).alias("o")).select("id", "o.stem", *(F.col(f"o.{k}").alias(f"option_{k}") for k in "abcd")), "SELECT id, concat(question_text, '（ ）') AS stem, subject AS option_a, 'two' AS option_b, concat(source_pdf, '主机') AS option_c, 'four F8A. x' AS option_d FROM questions"),
    ("strip_markdown_images", "texts", lambda t: t.select("id", F.md5(T.strip_images("question_text")).alias("h")), rf"SELECT id, md5(trim(regexp_replace(regexp_replace(question_text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\n{{3,}}', concat(chr(10), chr(10)), 'g'), {WS})) AS h FROM texts"),
    ("strip_details_blocks", "texts", lambda t: t.select("id", F.md5(T.strip_details(F.concat(F.substring("question_text", 1, 40), F.lit("<details>\n"), F.substring("question_text", 41, 60), F.lit("</DETAILS>"), F.substr("question_text", F.lit(101))))).alias("h")), "SELECT id, md5(concat(substr(question_text, 1, 40), substr(question_text, 101))) AS h FROM texts"),
    ("render_leak_scan", "texts", leaks, r"SELECT count(*) FILTER (contains(x, '<details')) AS details, count(*) FILTER (contains(x, '<summary')) AS summary, count(*) FILTER (contains(x, '```mermaid')) AS mermaid, count(*) FILTER (regexp_matches(x, '!\[[^\]]*\]\([^)]+\)')) AS images, count(*) FILTER (contains(x, '<table')) AS tables, count(*) FILTER (len(regexp_extract_all(x, '```')) % 2 = 1) AS odd_fences FROM (SELECT lower(regexp_replace(question_text, '(?is)<details.*?</details>', '', 'g')) AS x FROM texts)"),
    ("infer_subject_path", "texts", lambda t: t.select("id", T.infer_subject(F.concat(F.when(F.col("id") % 3 == 0, "x/Operating System/").when(F.col("id") % 3 == 1, "计网/").otherwise(""), F.col("file"))).alias("subject")), "SELECT id, CASE id % 3 WHEN 0 THEN '操作系统' WHEN 1 THEN '计算机网络' ELSE '未知科目' END AS subject FROM texts"),
    ("infer_subject_content", "texts", lambda t: t.select("id", T.infer_subject(F.substring(F.concat(F.when(F.col("id") % 2 == 0, "数据结构 ").otherwise(""), F.col("question_text")), 1, 3000)).alias("subject")), "SELECT id, CASE WHEN id % 2 = 0 THEN '数据结构' ELSE '未知科目' END AS subject FROM texts"),
    ("exam_year_extract", "texts", lambda t: t.select("id", T.exam_year(F.concat("question_text", F.when(F.col("id") % 2 == 0, F.concat(F.lit("【"), F.col("id") % 24 + 2000, F.lit("统考真题】"))).otherwise(""))).alias("year")), "SELECT id, CASE WHEN id % 2 = 0 THEN concat(id % 24 + 2000, '统考真题') END AS year FROM texts"),
    ("answer_ref_extract", "texts", lambda t: t.select("id", T.answer_ref(F.concat("question_text", F.when(F.col("id") % 2 == 0, F.concat(F.lit("（答案见原书P"), F.col("id"), F.lit("）"))).otherwise(""))).alias("ref")), "SELECT id, CASE WHEN id % 2 = 0 THEN concat('答案见原书P', id) END AS ref FROM texts"),
    ("knowledge_tags_build", "questions", lambda q: q.select("id", T.knowledge_tags("chapter", F.when(F.col("page_number") % 3 == 0, F.concat(F.col("page_number") + 2000, F.lit("统考真题")))).alias("tags")), "SELECT id, concat_ws(',', nullif(trim(chapter), ''), CASE WHEN page_number % 3 = 0 THEN concat(page_number + 2000, '统考真题') END) AS tags FROM questions"),
    # replies and prompts
    ("candidate_from_reply", "candidates", reply, "SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE answer_text END AS answer, CASE WHEN id % 9 = 0 THEN 0.0 ELSE confidence END AS confidence, id % 9 <> 0 AND answer_text <> '' AND is_verified AND confidence >= 0.8 AS usable FROM candidates"),
    ("analysis_from_reply", "texts", analysed, "SELECT id, md5(CASE WHEN id % 2 = 0 THEN concat('c', id) ELSE substr(question_text, 1, 500) END) AS h, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n FROM texts"),
    ("answers_from_page_reply", "questions", answered, ANSWERED),
    ("json_list_loads", "questions", as_list, "SELECT id, CASE WHEN id % 3 = 0 THEN concat(chapter, '|b') ELSE chapter END AS items FROM questions WHERE chapter IS NOT NULL"),
    ("payload_merge", "candidates", lambda c: c.select("id", R.merged_payload(F.when(F.col("id") % 5 == 0, "plain").otherwise(F.concat(F.lit('{"k": "'), F.col("source"), F.lit('", "n": ['), F.col("id"), F.lit(', true], "model": "old"}'))), model=F.lit("m"), uncertainty_reason=F.col("answer_text")).alias("p")), "SELECT id, CASE WHEN id % 5 = 0 THEN 'plain' ELSE concat('{\"k\":\"', source, '\",\"n\":[', id, ',true],\"model\":\"m\",\"uncertainty_reason\":\"', answer_text, '\"}') END AS p FROM candidates"),
    ("path_list_append", "questions assets", grown, "SELECT q.id, CASE WHEN q.id % 2 = 0 THEN coalesce(l, '') ELSE concat_ws(',', l, source_pdf) END AS paths FROM questions q LEFT JOIN (SELECT question_id, string_agg(path, ',' ORDER BY id) AS l FROM assets GROUP BY 1) ON question_id = q.id"),
    ("prompt_table", GRADING, prompts, PROMPTS, True),
]
