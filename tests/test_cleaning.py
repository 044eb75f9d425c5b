"""Cleaning, code regions, page texts, the snapshot and the stream's store on small tables."""

import re
import time

import numpy as np

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from lernwerk.functions import text as T
from lernwerk.operators import quality as Q
from lernwerk import sink_queries as SK
from lernwerk.functions import cleaning as C
from lernwerk.plans import pages as PG
from lernwerk.plans import regions as G
from lernwerk.sources import corpora as K
from lernwerk.sources import reports as O
from lernwerk.streaming import ingest as I


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def test_footers_and_noise(spark):
    assert one(spark, C.page_noise, "a 第 2 页, 共 9 页\nb\n\n\n\nc ") == "ab\n\nc" and one(spark, C.page_noise, None) is None
    assert one(spark, C.footer_lines, "stem?\nwords only\n3.2 x\n \n") == "stem?"
    assert one(spark, C.footer_lines, "stem?\nwords only") == "stem?\nwords only"
    assert one(spark, C.footer_lines, " \n\n") == "" and one(spark, C.footer_lines, None) is None
    long = "stem?\n" + "\n".join(f"3.{i} x" for i in range(12))
    assert one(spark, C.footer_lines, long) == "stem?\n3.0 x\n3.1 x"
    assert one(spark, lambda c: C.page_noise(c, [r"shop\S*"]), "a shop.example b") == "a  b"


def test_inline_asm(spark):
    assert one(spark, C.mark_inline_asm, "mov `mov` amov```mov``` jmp") == "`mov` `mov` amov```mov``` `jmp`"
    assert one(spark, C.mark_inline_asm, "mov ```add") == "`mov` ```add" and one(spark, C.mark_inline_asm, None) is None


def test_latex(spark):
    assert one(spark, C.latex_text, r" \mathrm{R1} \leq \left( x \right) \foo y,") == "R1 <= (x) y"
    assert one(spark, C.array_blocks, r"\begin{array}{c}a&b\\c\end{array}") == [r"a&b\\c"]


def langs(spark, text):
    rows = G.marked(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).orderBy("line_no").collect()
    return "".join({"c": "c", "x86asm": "a", None: "-"}[r.lang] for r in rows)


def test_regions(spark):
    assert langs(spark, "int f() {\n g();\n if (x) {\n }\n}\n? end") == "ccccc-"
    assert langs(spark, "int f() { }\n? x") == "c-"
    assert langs(spark, "int a;\n? x\n? y") == "cc-"  # a declaration takes the line below it
    assert langs(spark, "int f() {\n g();\n\n? x") == "cc--"  # never closed
    assert langs(spark, "mov a\n\nadd b\n\n\nsub c\n?") == "aaa----"
    assert langs(spark, "lw a") == "-" and langs(spark, "") == "-"
    assert G.marked(spark.createDataFrame([(1, None)], "id long, text string"), ["id"]).count() == 0


def expected(text):
    """Line by line, as the docstring of ``marked`` says it."""
    lines, out, i = text.split("\n"), [], 0
    braces = lambda x: x.count("{") - x.count("}")
    while i < len(lines):
        if not re.match(r"(int|struct)\b", lines[i].strip()):
            out.append("-")
            i += 1
            continue
        if "{" in lines[i] and braces(lines[i]) <= 0:
            n = 1
        else:
            sums = [sum(map(braces, lines[i : j + 1])) for j in range(i + 1, len(lines))]
            closed = [k for k, x in enumerate(sums) if x <= 0]
            if closed:
                n = closed[0] + 2
            else:
                n = 1
                while i + n < len(lines) and re.search(r"[{};]|^\w", lines[i + n].strip()):
                    n += 1
        out += "c" * n
        i += n
    # ``int`` is an instruction as well: those in sequence, single blank lines between them, are assembly, and regions that touch are one, in the language of the first
    is_asm = [bool(re.match(r"int\b", x.strip())) for x in lines]
    asm = [a or (x.strip() == "" and 0 < k < len(lines) - 1 and is_asm[k - 1] and is_asm[k + 1]) for k, (a, x) in enumerate(zip(is_asm, lines))]
    own = ["c" if o == "c" else "x86asm" if asm[k] and (asm[k - 1 : k] == [True] or asm[k + 1 : k + 2] == [True]) else "-" for k, o in enumerate(out)]
    for k in range(1, len(own)):
        own[k] = own[k - 1] if own[k] != "-" and own[k - 1] != "-" else own[k]
    return "".join(own)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["int f() {", "int a;", "struct {", "}", "{ }", " x = 1;", "", "? no", "} }", "int g() { }", "word"]), min_size=1, max_size=9), min_size=20, max_size=20))
def test_c_regions_equal_line_by_line(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = {i: "" for i, _ in rows}
    for r in G.marked(spark.createDataFrame(rows, "id long, text string"), ["id"]).orderBy("id", "line_no").collect():
        got[r.id] += r.lang or "-"
    assert got == {i: expected(t) for i, t in rows}


def test_pages(spark):
    rows = [("d", 1, "第 1 章 One\n1.1 Sec\n（答案见P7）\n1. stem【2021 真题】\nA. x\nB. y 第 1 页，共 2 页"), ("d", 2, "more\n2、 essay\nA. lone"), ("d", 3, None), ("e", 1, "no numbers")]
    got = PG.parse_pages(spark.createDataFrame(rows, "doc string, page_no int, text string")).orderBy("number").collect()
    assert [(r.number, r.page_no, r.chapter, r.section, r.answer_ref, r.exam_year) for r in got] == [(1, 1, "第1章 One", "1.1 Sec", "（答案见P7）", "2021统考真题"), (2, 2, "第1章 One", "1.1 Sec", "（答案见P7）", None)]
    assert (got[0].question_text, got[0].option_a, got[0].option_b, got[0].option_c) == ("stem", "x", "y\nmore", None)
    assert (got[1].question_text, got[1].option_a) == ("essay\nA. lone", None)


def test_optional_table_and_store(spark, tmp_path):
    assert K.read_optional(spark, f"{tmp_path}/none", "a long").count() == 0
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "c")], "id long, text_hash string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text_hash string").parquet(f"{tmp_path}/in")
    seed = spark.createDataFrame([(0, "c")], "id long, text_hash string")
    assert sorted(r.id for r in I.ingest(stream, seed, f"{tmp_path}/x").collect()) == [1, 3, 4, 5]
    spark.createDataFrame([(7, "a"), (8, "d")], "id long, text_hash string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in I.ingest(stream, seed, f"{tmp_path}/x").collect()) == [1, 3, 4, 5, 8]


def test_regions_of_a_million_lines():
    n = 1_000_000
    bits = np.full(n, G.MORE)
    braces = np.zeros(n, np.int64)
    bits[0], braces[0], braces[n - 10] = G.START | G.OPENS, 1, -1  # one block almost as long as the text
    began = time.time()
    assert G.region_langs(bits, braces).tolist() == [1] * (n - 9) + [0] * 9
    bits[: n // 2 : 2] = G.START
    braces[:] = 0
    found = G.region_langs(bits, braces)
    assert found[: n // 2].all() and time.time() - began < 60


def test_fields_keep_nulls_empty_texts_and_other_columns(spark):
    rows = spark.createDataFrame([(1, None, "", [1], "a<br>b"), (1, "int f() {\n}\nx", "", None, None)], "id long, question_text string, analysis string, other array<int>, untouched string")
    got = G.clean_fields(rows, ["question_text", "analysis"]).collect()
    assert [tuple(r) for r in got] == [(1, None, "", [1], "a<br>b"), (1, "```c\nint f() {\n}\n```\nx", "", None, None)]


def test_issues_are_found_once(spark, tmp_path):
    """a report stores its issues once; counts, lists and the summary come from what is stored."""
    seen = spark.sparkContext.accumulator(0)

    def kind(i):
        seen.add(1)
        return "a" if i % 2 else "b"

    rows = spark.range(12).select("id", F.lit("s").alias("subject"), F.udf(kind, "string")("id").alias("issue_type"), F.lit("high").alias("severity"), F.lit("").alias("preview"))
    questions = spark.createDataFrame([(1, "s", "choice", "f")], "id long, subject string, question_type string, source string")
    assets = spark.createDataFrame([(1, "p")], "question_id long, path string")
    O.write_qc_report(rows, lambda found: Q.summary(questions.withColumns({c: F.lit("x") for c in ("option_a", "option_b", "option_c", "option_d", "answer", "question_text", "n_assets")}), assets, found=found), str(tmp_path))
    assert seen.value == 12
    got = {(r.name, r.a): r.n for r in spark.read.json(f"{tmp_path}/summary").collect()}
    assert got[("issue_type", "a")] == 6 and got[("severity", "high")] == 12 and got[("questions", None)] == got[("assets", None)] == 1
    assert "- high: 12" in [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]


def test_change_report_needs_no_join(spark):
    """cleaned fields stand beside those before; rows of one row group are dealt to all cores."""
    q = spark.range(40).select("id", F.concat(F.lit("q "), "id").alias("question_text")).coalesce(1)
    assert SK.spread(q).rdd.getNumPartitions() > 1
    met = SK.cleaned(q)
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    want = Q.change_report(SK.mixed(q), G.clean_fields(SK.mixed(q), SK.FIELDS), SK.FIELDS)
    assert sorted(map(tuple, Q.change_counts(met, SK.FIELDS).collect())) == sorted(map(tuple, want.collect()))


def test_cleaning_steps_are_worked_out_once(spark):
    """a step's text is not derived anew at each place where the next step uses it."""
    rows = spark.createDataFrame([(1, "x")], "id long, t string")
    for step, splits in ((C.footer_lines, 1), (C.mark_inline_asm, 1), (lambda c: G.line_facts(C.footer_lines(T.drop_rules(c))), 3)):
        assert rows.select(step(F.col("t")).alias("y"))._jdf.queryExecution().analyzed().toString().count("split(") == splits
