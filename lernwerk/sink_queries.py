"""Queries over cleaning, page texts, sources and sinks with their SQL twins, for ``catalog``: (name, projections, function, SQL, whether SQL uses ``graded``).

What a sink writes goes to a new shared folder and is read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bank_queries import FILE, FILE_IDS, as_corpus, file_of, hashed
from .functions import cleaning as C
from .functions import text as T
from .operators import attempts as A
from .operators import banks as B
from .plans import pages as PG
from .plans import regions as G
from .sources import corpora as K
from .sources import reports as O
from .sources.shared import folder

WS = "concat(' ', chr(9), chr(10), chr(13))"
#: A text with breaks, code, instructions, numbered parts and a footer, and what becomes of it.
MIXED = "{text}<br/>(1) use mov\nint f() {\n  g();\n}\n(2) x\nmov a, b\nadd a, 1\nend.\n第 1 页，共 {id} 页"
CLEANED = "{text}  \n  \n  \n(1) use `mov````c\nint f() {\n  g();\n}\n```\n  \n  \n(2) x```x86asm\nmov a, b\nadd a, 1\n```\nend."


def filled_in(pattern: str) -> Column:
    return F.replace(F.replace(F.lit(pattern), F.lit("{id}"), F.col("id").cast("string")), F.lit("{text}"), F.col("question_text"))


def sql_text(pattern: str) -> str:
    return "replace(replace('" + pattern.replace("'", "''") + "', '{id}', CAST(id AS VARCHAR)), '{text}', question_text)"


def mixed(q: DataFrame) -> DataFrame:
    return q.select("id", filled_in(MIXED).alias("question_text"), F.when(F.col("id") % 2 == 0, filled_in("{text}<br>b {id}.\n\n")).alias("option_a"), F.lit("").alias("analysis"))


FIELDS = ["question_text", "option_a", "analysis"]


def spread(q: DataFrame) -> DataFrame:
    """Dealt to all cores: a row group of a file is read by one task, and its rows cost far more to clean than to read."""
    return q.select("id", "question_text").repartition(4 * q.sparkSession.sparkContext.defaultParallelism)


def cleaned(q: DataFrame) -> DataFrame:
    """The fields before cleaning, and after it with ``_`` before their names."""
    return G.clean_fields(mixed(spread(q)).withColumns({f"_{f}": F.col(f) for f in FIELDS}), [f"_{f}" for f in FIELDS])


def with_footer(t: DataFrame) -> DataFrame:
    foot = F.when(F.col("id") % 3 == 0, "\n第 1 页，共 2 页").when(F.col("id") % 3 == 1, "\n3.2 part\nkurz ü\n\n").otherwise("\n= x")
    return t.select("id", F.md5(C.footer_lines(F.concat("question_text", foot))).alias("h"))


LETTERS = r"\p{L}\p{M}\p{N}\p{Pc}"
#: The lines from the end, which of them go if all below go, and how many do.
FOOTER = rf"""WITH l AS (SELECT id, string_split(concat(question_text, CASE id % 3 WHEN 0 THEN concat(chr(10), '第 1 页，共 2 页') WHEN 1 THEN concat(chr(10), '3.2 part', chr(10), 'kurz ü', chr(10), chr(10)) ELSE concat(chr(10), '= x') END), chr(10)) AS x FROM texts),
  e AS (SELECT id, x, list_transform(list_reverse(x)[1:10], lambda s: trim(s, {WS})) AS r FROM l),
  g AS (SELECT id, x, list_transform(r, lambda s, i: s = '' OR regexp_matches(s, '第\s*\d+\s*页[，,]\s*共\s*\d+\s*页') OR regexp_matches(s, '^(第\s*\d+\s*章\s*.+|\d+\.\d+\s*.+)$') OR (i > 1 AND length(s) <= 15 AND regexp_matches(s, '^[{LETTERS}\s/·]+$'))) AS good FROM e),
  k AS (SELECT id, array_to_string(x[1:len(x) - coalesce(nullif(list_position(good, false), 0) - 1, len(good))], chr(10)) AS kept FROM g)
  SELECT id, md5(CASE WHEN trim(kept, {WS}) = '' THEN '' ELSE regexp_replace(kept, '\n\s*$', '') END) AS h FROM k"""


def with_instructions(t: DataFrame) -> DataFrame:
    """Instructions after common words, within a fence, and in a fence that does not end."""
    spread = F.regexp_replace("question_text", " (the|de|la|der) ", " mov $1 CALL add ")
    end = F.when(F.col("id") % 3 == 0, " ```x\nmov a``` ret").when(F.col("id") % 3 == 1, " `jmp` or ```ret").otherwise("")
    return t.select("id", F.md5(C.mark_inline_asm(F.concat(spread, end))).alias("h"))


def marked_sql(text: str) -> str:
    """Twice, since two instructions may share the sign between them."""
    pattern = f"(?i)(^|[^{LETTERS}`])({'|'.join(x for x in C.X86 if x not in C.WORDS)})([^{LETTERS}`]|$)"
    once = rf"regexp_replace({text}, '{pattern}', '\1`\2`\3', 'g')"
    return rf"regexp_replace({once}, '{pattern}', '\1`\2`\3', 'g')"


#: Every second part is within a fence if one more follows; else its fence has no end and is prose with the part before.
INLINE = rf"""WITH s AS (SELECT id, string_split(concat(regexp_replace(question_text, ' (the|de|la|der) ', ' mov \1 CALL add ', 'g'), CASE id % 3 WHEN 0 THEN concat(' ```x', chr(10), 'mov a``` ret') WHEN 1 THEN ' `jmp` or ```ret' ELSE '' END), '```') AS p FROM texts),
  j AS (SELECT id, CASE WHEN len(p) % 2 = 0 THEN list_append(p[1:len(p) - 2], concat(p[len(p) - 1], '```', p[len(p)])) ELSE p END AS p FROM s)
  SELECT id, md5(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN x ELSE {marked_sql("x")} END), '```')) AS h FROM j"""


def regions(t: DataFrame) -> DataFrame:
    """Code between every two lines of a text."""
    code = F.when(F.col("id") % 3 == 0, "int f() {\n  g();\n}\n").when(F.col("id") % 3 == 1, "lw a, b\n\nsw a, b\n").otherwise("")
    text = F.concat(F.lit("· "), F.replace("question_text", F.lit("\n"), F.concat(F.lit("\n"), code, F.lit("· "))))
    return G.marked(t.select("id", text.alias("text")), ["id"]).groupBy("id").agg(F.count_if(F.col("lang") == "c").alias("n_c"), F.count_if(F.col("lang") == "x86asm").alias("n_asm"), F.count("*").alias("n_lines"))


REGIONS = "WITH k AS (SELECT id, CAST(length(question_text) - length(replace(question_text, chr(10), '')) AS BIGINT) AS k FROM texts) SELECT id, CASE WHEN id % 3 = 0 THEN 3 * k ELSE 0 END AS n_c, CASE WHEN id % 3 = 1 THEN 3 * k ELSE 0 END AS n_asm, k + 1 + CASE WHEN id % 3 = 2 THEN 0 ELSE 3 * k END AS n_lines FROM k"


def cells(q: DataFrame) -> DataFrame:
    raw = F.concat(F.lit(r"x\begin{array}{cc}\mathrm{"), F.col("chapter"), F.lit("} & "), F.col("question_text"), F.lit(r" \times "), F.col("id"), F.lit(r"\\ \left("), F.col("knowledge_tag"), F.lit(r"\right) & {"), F.col("subject"), F.lit(r"},\end{array}y"))
    rows = q.filter("chapter IS NOT NULL AND knowledge_tag IS NOT NULL").select("id", F.explode(C.array_blocks(raw)).alias("b")).select("id", F.posexplode(F.split("b", r"\\\\")).alias("row", "r"))
    each = rows.select("id", "row", F.posexplode(F.split("r", "&")).alias("cell", "x")).select("id", "row", "cell", C.latex_text("x").alias("text"))
    return each.filter("text <> ''")


def as_pages(q: DataFrame) -> DataFrame:
    """Questions put together as page texts, a document for each source and range of ids."""
    block = F.concat(F.col("id") % 1000 + 1, F.lit(". "), F.when(F.col("id") % 4 == 0, "【2020 统考真题】").otherwise(""), F.col("question_text"), F.when(F.col("question_type") == "choice", F.concat(F.lit("\nA. "), F.col("subject"), F.lit("\nb、two"))).otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]), "\n")
    return q.groupBy(file_of(F.col("source_pdf"), "id").alias("doc"), F.col("page_number").alias("page_no")).agg(F.concat(F.lit("第2章 X\n1."), F.col("page_number") % 9 + 1, F.lit(" part\n"), body, F.lit("\n\n\n第 1 页，共 9 页")).alias("text"))


def markdown_files(q: DataFrame) -> DataFrame:
    path = folder(q.sparkSession)
    as_corpus(q).select("file", F.col("text").alias("value")).repartition("file").write.partitionBy("file").text(path)
    read = K.scan_markdown(q.sparkSession, path, "*.txt")
    name = F.url_decode(F.url_decode(F.regexp_extract("file", "file=([^/]*)/", 1)))  # escaped as a partition, then as a path
    return read.select(name.alias("file"), F.md5(T.strip("text")).alias("h"))


def package(q: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """Two versions, of which the second is read back, with what its metadata say."""
    spark, path = q.sparkSession, folder(q.sparkSession)
    K.write_package(hashed(q.filter("id % 2 = 0")), a, c, path)
    K.write_package(hashed(q), a, c, path, id="all", version="2")
    read = [("questions", K.read_package(spark, path).select(F.col("text_hash").alias("h")))]
    for name in ("question_assets", "answer_candidates", "notes"):
        read.append((name, K.read_attached(spark, path, name).select(F.col("question_text_hash").alias("h"))))
    told = F.from_json("metadata", "count long, asset_count long, answer_candidate_count long").alias("m")
    out = K.published(spark, path).select(told).select(F.lit("metadata").alias("name"), F.col("m.count").alias("n"), (F.col("m.asset_count") + F.col("m.answer_candidate_count")).alias("texts"))
    for name, rows in read:
        out = out.union(rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("h").alias("texts")))
    return out


PACKAGE = f"WITH h AS (SELECT id AS question_id, sha256(trim(question_text, {WS})) AS h FROM questions) SELECT 'questions' AS name, count(*) AS n, count(DISTINCT h) AS texts FROM h UNION ALL SELECT 'question_assets', count(*), count(DISTINCT h) FROM assets JOIN h USING (question_id) UNION ALL SELECT 'answer_candidates', count(*), count(DISTINCT h) FROM candidates JOIN h USING (question_id) UNION ALL SELECT 'notes', CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT 'metadata', (SELECT count(*) FROM questions), (SELECT count(*) FROM assets JOIN h USING (question_id)) + (SELECT count(*) FROM candidates JOIN h USING (question_id))"


def banks(q: DataFrame, version: str) -> DataFrame:
    return q.groupBy(F.col("subject").alias("id")).agg(F.first("subject").alias("subject"), F.count("*").alias("count"), F.lit(version).alias("version"))


def manifest(q: DataFrame) -> DataFrame:
    """Written with the questions of even ids, then with entries of the others that replace or join them."""
    spark, path = q.sparkSession, folder(q.sparkSession)
    O.write_manifest(banks(q.filter("id % 2 = 0"), "1"), f"{path}/first")
    O.write_manifest(K.upsert(K.scan_manifest(spark, f"{path}/first").select("id", "subject", "count", "version"), banks(q.filter("id % 3 = 0"), "2")), f"{path}/second")
    return K.scan_manifest(spark, f"{path}/second").select("id", "subject", "count", "version")


MANIFEST = "WITH a AS (SELECT subject AS id, count(*) AS count FROM questions WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT subject AS id, count(*) AS count FROM questions WHERE id % 3 = 0 GROUP BY 1) SELECT id, id AS subject, count, '2' AS version FROM b UNION ALL SELECT id, id, count, '1' FROM a WHERE id NOT IN (SELECT id FROM b)"


def notes(enriched: DataFrame) -> DataFrame:
    """Weak points with their lists as arrays, as a note takes them."""
    parts = lambda c, sign: F.filter(F.split(c, sign, -1), lambda x: x != "").alias(c)
    return enriched.select("tag", "subject", "chapter", "wrong_count", "mastery_score", "summary", parts("confused_concepts", r"\|"), parts("recommended_actions", r"\|"), parts("question_ids", ","))


def snapshot(a: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    graded = A.grade(a, q, c)
    found = A.misconceptions(graded)
    path = folder(q.sparkSession)
    out = O.write_snapshot(notes(A.weak_point_enrich(A.tag_mastery(graded), found, q, split_tags=True)), found, A.wrong_book(graded), path)
    made = K.scan_markdown(q.sparkSession, f"{path}/markdown", "*.txt").select(F.regexp_count("text", F.lit("\nMastery: ")).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("notes"))
    return out.join(F.broadcast(made), F.lit(True))  # one row each


SNAPSHOT = "WITH t AS (SELECT trim(t) AS tag FROM (SELECT unnest(string_split(coalesce(knowledge_tag, ''), ',')) AS t FROM graded WHERE NOT is_correct) WHERE trim(t) <> ''), n AS (SELECT least(200, count(DISTINCT tag)) AS k FROM t), w AS (SELECT count(DISTINCT question_id) AS k FROM graded WHERE NOT is_correct) SELECT n.k AS weak_points_count, w.k AS misconceptions_count, w.k AS wrong_questions_count, n.k AS notes FROM n, w"


def logged(c: DataFrame) -> DataFrame:
    """Two jobs append their runs; the newest are read."""
    path = folder(c.sparkSession)
    for job in (0, 1):
        O.append_runs(c.filter(F.col("id") % 2 == job).select("id", "source", "created_at"), path)
    return B.recent_runs(c.sparkSession.read.schema(c.select("id", "source", "created_at").schema).parquet(path))


def report(issues: DataFrame, summary: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path = folder(issues.sparkSession)
    O.write_qc_report(issues, summary, path)
    return issues.sparkSession.read.text(f"{path}/report").withColumnRenamed("value", "line")


#: Over the tables ``issues`` and ``texts``.
REPORT = r""", s AS (SELECT i.*, CASE WHEN issue_type = 'missing_asset_file' THEN '' ELSE trim(regexp_replace(question_text, '\s+', ' ', 'g')) END AS x FROM issues i LEFT JOIN texts USING (id) WHERE severity IN ('high', 'critical')),
  g AS (SELECT concat('- Q', id, ': ', issue_type, ' | ', subject, ' | ', CASE WHEN length(x) > 160 THEN concat(substr(x, 1, 160), '...') ELSE x END) AS line FROM s ORDER BY id, issue_type LIMIT 200)
  SELECT unnest(['## Issues by severity', '## Issues by type', '## Grave issues']) AS line UNION ALL SELECT concat('- ', severity, ': ', count(*)) FROM issues GROUP BY severity
  UNION ALL SELECT concat('- ', issue_type, ': ', count(*)) FROM issues GROUP BY issue_type UNION ALL SELECT line FROM g UNION ALL SELECT concat('- ... ', count(*) - 200, ' more') FROM s HAVING count(*) > 200"""

GRADING = "attempts questions candidates"

ENTRIES = [
    ("clean_page_noise", "texts", lambda t: t.select("id", F.md5(C.page_noise(F.concat("question_text", F.lit("\n\n\n\n· 第 3 页，共 "), F.col("id"), F.lit(" 页 ·\n\n")))).alias("h")), rf"SELECT id, md5(trim(regexp_replace(question_text, '\n{{3,}}', concat(chr(10), chr(10)), 'g'), {WS})) AS h FROM texts"),
    ("strip_footer_lines", "texts", with_footer, FOOTER),
    ("restore_breaks_and_spacing", "texts", lambda t: t.select("id", F.md5(C.part_spacing(T.breaks(F.concat(F.regexp_replace("question_text", r"\n(?=[A-Z])", "<BR />("), F.lit("<br>("), F.col("id") + 1, F.lit(") b<br>(0) c"))))).alias("x")), r"SELECT id, md5(regexp_replace(concat(regexp_replace(question_text, '\n([A-Z])', concat(chr(10), '(\1'), 'g'), chr(10), '(', id + 1, ') b', chr(10), '(0) c'), '\n([（(][1-9]\d*[）)])', concat(chr(10), chr(10), chr(10), '\1'), 'g')) AS x FROM texts"),
    ("code_line_regions", "texts", regions, REGIONS),
    ("mark_inline_asm", "texts", with_instructions, INLINE),
    ("clean_question_fields", "questions", lambda q: G.clean_fields(mixed(spread(q)), FIELDS), f"SELECT id, {sql_text(CLEANED)} AS question_text, CASE WHEN id % 2 = 0 THEN concat(question_text, '  ', chr(10), 'b ', id, '.') END AS option_a, '' AS analysis FROM questions"),
    ("latex_cell_text", "questions", cells, "SELECT id, unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 0, 1]) AS cell, unnest([chapter, concat(question_text, ' * ', id), concat('(', knowledge_tag, ')'), subject]) AS text FROM questions WHERE chapter IS NOT NULL AND knowledge_tag IS NOT NULL"),
    ("parse_page_text_corpus", "questions", lambda q: PG.parse_pages(as_pages(q)).drop("answer_ref", "option_c", "option_d", "option_e", "text_hash"), f"SELECT concat(source_pdf, '-', id // {FILE_IDS}) AS doc, CAST(id % 1000 + 1 AS INTEGER) AS number, page_number AS page_no, '第2章 X' AS chapter, concat('1.', page_number % 9 + 1, ' part') AS section, CASE WHEN id % 4 = 0 THEN '2020统考真题' END AS exam_year, question_text, CASE WHEN question_type = 'choice' THEN subject END AS option_a, CASE WHEN question_type = 'choice' THEN 'two' END AS option_b FROM questions"),
    ("scan_markdown_corpus", "questions", markdown_files, f"SELECT {FILE} AS file, md5(string_agg(concat('## 1.', page_number, ' ', subject, chr(10), id % 1000 + 1, '. ', question_text, chr(10), 'A. one', chr(10), 'B. two'), chr(10) ORDER BY id)) AS h FROM questions GROUP BY 1"),
    ("write_bank_package", "questions assets candidates", package, PACKAGE),
    ("scan_bank_package", "questions assets candidates", lambda q, a, c: package(q, a, c).filter("n > 0"), f"SELECT * FROM ({PACKAGE}) WHERE n > 0"),
    ("scan_bank_manifest", "questions", lambda q: manifest(q).filter("version = '1'"), f"SELECT * FROM ({MANIFEST}) WHERE version = '1'"),
    ("upsert_manifest", "questions", manifest, MANIFEST),
    ("write_note_snapshot", GRADING, snapshot, SNAPSHOT, True),
    ("run_log", "candidates", logged, "SELECT id, source, created_at FROM candidates ORDER BY created_at DESC, id DESC LIMIT 20"),
]
