"""The operators as registered queries: production parameters, whole tables, whole results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, language_id, mixing, ngram_join, packing, pii, prefix_trie, quality, repeats, structure_repair, token_output, tokens, topk, toxicity
from .common import documents, fold, lean, settle

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 5) != 0)
    model = toxicity.train_from(docs, labels)
    scored = toxicity.score(docs, model, keep=["doc_id", "lang"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), toxicity.rejected(model).alias("rejected"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.digest(token_output.pack(documents(spark, sf_dir), TOKENIZER))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = settle(tokens.pieces(documents(spark, sf_dir), TOKENIZER), "pieces")
    placed = packing.place(cut, ["doc_id", "piece"], packing.best_fit)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit_from(docs.filter(fold("doc_id", 4) != 2))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "narrow")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", topk.quantized("embedding").alias("vector"))
    return topk.search(vectors, F.col("vec_id") % 100 == 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    count = [F.size(F.filter("spans", kind_is(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.BASE)]
    return found.select("doc_id", *count, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("highest_score"))


def kind_is(rank: int):
    return lambda s: s["rank"] == rank


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = settle(quality.with_statistics(documents(spark, sf_dir), keep=["doc_id"]), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 5) != 0)
    scored = quality.score_statistics(stats, quality.learn(stats, labels, threshold=0.3))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(conversations(spark, sf_dir))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.reports(structure_repair.damage(conversations(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_source_mixing, op4_token_output, op5_ngram_join, op6_best_fit_packing, op7_language_id, op8_exact_topk, op9_pii, op10_fingerprints, op11_quality, op12_prefix_trie, op13_structure_repair)}

#: crc32 of an ASCII string ``s`` in SQL, by a table of 256 remainders; ``crc`` is a CTE of one row.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
)"""


def crc32_sql(s: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295)"


#: What the SQL of personal data looks for. Its regular expressions cannot look around: an IBAN is sought with the character before it in a text that a blank was put before, and cut from what follows its head.
MATCHES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[^A-Za-z0-9][A-Z]{2}[0-9]{2}",
}


def matches_sql(kind: str, rank: int) -> str:
    body = "' ' || text" if kind == "iban" else "text"
    return f"""SELECT id, text, '{kind}' AS kind, {rank} AS rank, unnest(regexp_extract_all({body}, '{MATCHES[kind]}')) AS m, unnest(string_split_regex({body}, '{MATCHES[kind]}')) AS g, unnest(range(len(string_split_regex({body}, '{MATCHES[kind]}')))) AS i FROM t"""


def case_sql(what: str, values: dict[str, object]) -> str:
    return f"CASE {what} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


PII_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
each AS ({" UNION ALL ".join(matches_sql(k, i) for i, k in enumerate(MATCHES))}),
placed AS (
  SELECT *, CAST(sum(length(g)) OVER (PARTITION BY id, kind ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, regexp_replace(m, '[^0-9]', '', 'g') AS digits
  FROM each
), base AS (
  SELECT id, text, kind, rank, s, s + length(m) AS e FROM placed
  WHERE m IS NOT NULL AND CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19
      AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER) WHEN x > '4' THEN 2 * CAST(x AS INTEGER) - 9 ELSE 2 * CAST(x AS INTEGER) END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15 ELSE false END
), heads AS (
  SELECT id, text, s, string_split(regexp_extract(substr(text, s + 1, 66), '^([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?:[^A-Za-z0-9]|$)', 1), ' ') AS words FROM placed WHERE kind = 'iban' AND m IS NOT NULL
), ends AS (
  SELECT *, replace(whole, ' ', '') AS bare FROM (SELECT id, text, s, unnest(list_transform(range(1, len(words) + 1), lambda k: array_to_string(words[1:k], ' '))) AS whole FROM heads)
), fine AS (
  SELECT id, text, s, s + length(whole) AS e, length(bare) = coalesce({case_sql("left(bare, 2)", {c: n for n, of in pii.IBAN_CHARS.items() for c in of.split()})}, 0) AS fixed FROM ends
  WHERE length(bare) BETWEEN 15 AND 34
    AND list_reduce(list_prepend(0, list_transform(string_split(bare[5:] || bare[:4], ''), lambda c: CASE WHEN c <= '9' THEN ord(c) - 48 ELSE ord(c) - 55 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
), longest AS (
  SELECT id, text, s, arg_max(e, (CASE WHEN fixed THEN 1000 ELSE 0 END) + e - s) AS e FROM fine GROUP BY id, text, s
), apart AS (
  SELECT id, text, unnest(list_reduce(list([struct_pack(s := s, e := e)] ORDER BY s), lambda a, x: CASE WHEN x[1].s >= a[len(a)].e THEN list_concat(a, x) ELSE a END)) AS x FROM longest GROUP BY id, text
), spans AS (
  SELECT *, kind || ':' || s || ':' || e AS said, CAST({case_sql("kind", pii.SCORES)} AS DOUBLE) + CASE WHEN regexp_matches(substr(text, greatest(s - {pii.CONTEXT_CHARS}, 0) + 1, least(s, {pii.CONTEXT_CHARS})), '(?i)' || {case_sql("kind", {k: f"'{v}'" for k, v in pii.CONTEXT.items()})}) THEN CAST({pii.CONTEXT_GAIN} AS DOUBLE) ELSE 0 END AS score
  FROM (SELECT * FROM base UNION ALL SELECT id, text, 'iban', {len(pii.BASE)}, x.s, x.e FROM apart)
)
SELECT t.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)}, sha256(coalesce(string_agg(said, ',' ORDER BY s, rank) FILTER (rank < {len(pii.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY s, rank), '') AS spans, max(score) AS highest_score
FROM t LEFT JOIN spans ON t.id = spans.id GROUP BY t.id, t.doc_id
"""

#: Every window of 100 bytes, in hexadecimal digits, with the first place that has it. Keys are taken to stand for one text each.
REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, hex(encode(text)) AS h FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
), blocks AS (  -- a place in a short text is found faster
  SELECT r, skipped, substr(h, 2 * skipped + 1, 2 * 1099) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2, 1000)) AS skipped FROM d)
), windows AS (
  SELECT r, skipped + p AS p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT r, skipped, h, unnest(range(least(1000, length(h) // 2 - 99))) AS p FROM blocks)
), later AS (
  SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY k ORDER BY r, p) AS n FROM windows) WHERE n > 1
), runs AS (
  SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM later)
), cuts AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS begin FROM (SELECT r, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY r, run)
), kept AS (
  SELECT d.r, coalesce(string_agg(substr(h, 2 * begin + 1, 2 * (a - begin)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(b), 0) + 1) AS rest, count(a) AS n_spans, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed
  FROM d LEFT JOIN cuts ON d.r = cuts.r GROUP BY d.r
)
SELECT o.doc_id, length(d.h) // 2 AS n_bytes, k.n_removed, k.n_spans, sha256(unhex(k.rest)) AS kept_sha256
FROM documents o JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND d.h = hex(encode(coalesce(o.text, ''))) JOIN kept k ON k.r = d.r
"""


ORACLES = {
    "op2_suffix_dedup": REPEATS_SQL,
    "op9_pii": PII_SQL,
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op12_prefix_trie": f"""
WITH {CRC_TABLE}, turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS own FROM turns GROUP BY conv_id
), heads AS (
  SELECT c.conv_id, c.own, coalesce(b.own, []) AS base, CAST({crc32_sql("CAST(c.conv_id AS VARCHAR)")} % 6 AS INTEGER) AS h
  FROM convs c CROSS JOIN crc LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
), paths AS (
  SELECT conv_id, list_concat(base[1:h], own[h + 1:]) AS path FROM heads
), steps AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM paths
), members AS (
  SELECT path[1:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256
  FROM steps GROUP BY path[1:d], d
), made AS (
  SELECT m.*, p.conv_id AS parent_conv_id, CASE WHEN m.d = 0 THEN 0 ELSE (m.n_convs - 1) * length(m.node[m.d].text) END AS own
  FROM members m LEFT JOIN members p ON m.d = p.d + 1 AND m.node[1:m.d - 1] = p.node
), counted AS (
  SELECT m.*, (SELECT count(*) FROM made c WHERE c.d = m.d + 1 AND c.node[1:m.d] = m.node) AS n_children FROM made m
), up AS (
  SELECT node[1:a] AS node, a AS d, own, n_children = 0 AS leaf FROM (SELECT *, unnest(range(d + 1)) AS a FROM counted)
), summed AS (
  SELECT node, d, sum(own) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM up GROUP BY node, d
)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN summed s ON c.d = s.d AND c.node = s.node
""",
    "op13_structure_repair": f"""
WITH RECURSIVE {CRC_TABLE}, marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS what
  FROM conversations CROSS JOIN crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE what <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM damaged
), seen AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos)) > 1 AS again, left(role, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM placed
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM seen
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), kinds AS (
  SELECT conv_id, pos, initial, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM judged
), best AS (  -- the cheapest rest from row ``pos`` on, as cost in six digits and letters, in the states: nothing yet, after s, after u, after a
  SELECT conv_id, n + 1 AS pos, '000000' AS b0, '000004II' AS b1, '000002I' AS b2, '000000' AS b3 FROM counts
  UNION ALL
  SELECT conv_id, pos,
    least(o0, printf('%06d', CAST(left(least(o2, i3), 6) AS INTEGER) + 2) || 'I' || substr(least(o2, i3), 7)), least(o1, printf('%06d', CAST(left(least(o2, i3), 6) AS INTEGER) + 2) || 'I' || substr(least(o2, i3), 7)), least(o2, i3), least(o3, i2)
  FROM (
    SELECT *, printf('%06d', CAST(left(o3, 6) AS INTEGER) + 2) || 'I' || substr(o3, 7) AS i3, printf('%06d', CAST(left(o2, 6) AS INTEGER) + 2) || 'I' || substr(o2, 7) AS i2
    FROM (
      SELECT k.conv_id, k.pos,
        least(d0, CASE WHEN NOT gone THEN r0 END, CASE WHEN NOT gone THEN CASE initial WHEN 's' THEN k1 WHEN 'u' THEN k2 END END) AS o0,
        least(d1, CASE WHEN NOT gone THEN r0 END, CASE WHEN NOT gone AND initial = 'u' THEN k2 END) AS o1,
        least(d2, CASE WHEN NOT gone THEN r2 END, CASE WHEN NOT gone AND initial = 'a' THEN k3 END) AS o2,
        least(d3, CASE WHEN NOT gone THEN r0 END, CASE WHEN NOT gone AND initial = 'u' THEN k2 END) AS o3
      FROM kinds k JOIN (
        SELECT b.conv_id, b.pos,
          printf('%06d', CAST(left(b0, 6) AS INTEGER) + 3) || 'D' || substr(b0, 7) AS d0, printf('%06d', CAST(left(b1, 6) AS INTEGER) + 3) || 'D' || substr(b1, 7) AS d1,
          printf('%06d', CAST(left(b2, 6) AS INTEGER) + 3) || 'D' || substr(b2, 7) AS d2, printf('%06d', CAST(left(b3, 6) AS INTEGER) + 3) || 'D' || substr(b3, 7) AS d3,
          printf('%06d', CAST(left(b2, 6) AS INTEGER) + 2 + e.extra) || 'R' || substr(b2, 7) AS r0, printf('%06d', CAST(left(b3, 6) AS INTEGER) + 2 + e.extra) || 'R' || substr(b3, 7) AS r2,
          printf('%06d', CAST(left(b1, 6) AS INTEGER) + e.extra) || 'K' || substr(b1, 7) AS k1, printf('%06d', CAST(left(b2, 6) AS INTEGER) + e.extra) || 'K' || substr(b2, 7) AS k2,
          printf('%06d', CAST(left(b3, 6) AS INTEGER) + e.extra) || 'K' || substr(b3, 7) AS k3
        FROM best b JOIN kinds e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.pos = b.pos - 1
      ) f ON k.conv_id IS NOT DISTINCT FROM f.conv_id AND k.pos = f.pos - 1
    )
  )
), audits AS (
  SELECT c.*, CAST(left(b.b0, 6) AS BIGINT) AS cost, substr(b.b0, 7) AS audit FROM counts c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.pos = 1
), letters AS (
  SELECT conv_id, i, substr(audit, i, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM audits)
), walked AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), turns AS (
  SELECT w.conv_id, w.letter, w.place, j.role, j.text, max(CASE WHEN w.letter = 'K' AND w.place = 1 AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS has_s
  FROM walked w LEFT JOIN judged j ON w.letter <> 'I' AND w.conv_id IS NOT DISTINCT FROM j.conv_id AND w.pos = j.pos WHERE w.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS t
  FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(a.gaps, 0) AS gaps, coalesce(a.blank, 0) AS blank, coalesce(a.duplicate, 0) AS duplicate, coalesce(a.truncated, 0) AS truncated, coalesce(a.illegal, 0) AS illegal,
  coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
""",
}
