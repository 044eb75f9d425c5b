"""Questions, attempts and answer candidates as projections of the given tables; the same SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTION_COLUMNS = """p_partkey AS id, p_type AS subject,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS chapter,
  CASE WHEN p_partkey % 13 = 0 THEN NULL
       ELSE concat(split_part(p_name,' ',1), ', ', split_part(p_name,' ',2)) END AS knowledge_tag,
  CASE WHEN p_size % 5 = 0 THEN 'other' ELSE 'choice' END AS question_type,
  p_name AS question_text,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN ' ' ELSE concat('A-', p_brand) END AS option_a,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN ' ' ELSE concat('B-', p_brand) END AS option_b,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN ' ' ELSE concat('C-', p_brand) END AS option_c,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN ' ' ELSE concat('D-', p_brand) END AS option_d,
  CASE WHEN p_partkey % 9 = 0 OR p_size % 5 = 0 THEN ''
       ELSE substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) END AS answer,
  concat(p_brand, '.pdf') AS source_pdf, p_size AS page_number"""

ATTEMPT_COLUMNS = """event_id AS id, user_id,
  (event_id * 37) % (SELECT count(*) FROM part) AS question_id,
  CASE WHEN event_id % 3 = 0
       THEN concat(' ', lower(substr('ABCD', CAST((event_id + user_id) % 4 AS INT) + 1, 1)))
       ELSE substr('ABCD', CAST((event_id + user_id) % 4 AS INT) + 1, 1) END AS user_answer,
  ts AS create_time"""

CANDIDATE_COLUMNS = """o_orderkey AS id, o_custkey AS question_id, o_orderstatus AS source,
  substr('ABCDE', CAST(o_orderkey % 6 AS INT) + 1, 1) AS answer_text,
  CAST((o_orderkey % 101) / 100.0 AS DOUBLE) AS confidence,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_verified, o_orderdate AS created_at"""

#: A stand-in for imported question texts: documents with marks injected by id.
TEXT_COLUMNS = """doc_id AS id, lang AS subject, source AS file,
  concat(CASE WHEN doc_id % 7 = 0 THEN concat('12. ', text) WHEN doc_id % 7 = 1 THEN concat(text, ' ![x](images/', source, '.png)')
    WHEN doc_id % 7 = 2 THEN concat('\ue000 ', text, '\uf0b1') WHEN doc_id % 7 = 3 THEN concat('```c\nint a;\n', text)
    WHEN doc_id % 7 = 4 THEN concat('<table><tr><td>', lang, '</td></tr></table>', text) WHEN doc_id % 7 = 5 THEN concat('  ', text, '\n===\n')
    ELSE text END, '') AS question_text"""

#: Assets of questions; (order, line) repeats, so each pair counts once.
ASSET_COLUMNS = """l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS question_id,
  concat('images/', min(l_suppkey), '-', l_linenumber, '.png') AS path, min(l_returnflag) AS asset_type"""
ASSET_GROUPS = "l_orderkey, l_linenumber"

SQL = {
    "questions": f"SELECT {QUESTION_COLUMNS} FROM part",
    "attempts": f"SELECT {ATTEMPT_COLUMNS} FROM events",
    "candidates": f"SELECT {CANDIDATE_COLUMNS} FROM orders",
    "assets": f"SELECT {ASSET_COLUMNS} FROM lineitem GROUP BY {ASSET_GROUPS}",
    "texts": f"SELECT {TEXT_COLUMNS} FROM documents",
}


def with_ctes(body: str, *names: str) -> str:
    """An oracle query over the projections."""
    own = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    rest = body.strip()
    return f"WITH {own}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {own} {rest}"


def attempt_columns(n_questions: int) -> str:
    return ATTEMPT_COLUMNS.replace("(SELECT count(*) FROM part)", str(n_questions))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the projections from the tables of ``sf_dir``."""
    if name == "attempts":
        n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
        return spark.sql(f"SELECT {attempt_columns(n)} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/events.parquet"))
    if name == "assets":
        return spark.sql(f"SELECT {ASSET_COLUMNS} FROM {{t}} GROUP BY {ASSET_GROUPS}", t=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    table, columns = {"questions": ("part", QUESTION_COLUMNS), "candidates": ("orders", CANDIDATE_COLUMNS), "texts": ("documents", TEXT_COLUMNS)}[name]
    return spark.sql(f"SELECT {columns} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
