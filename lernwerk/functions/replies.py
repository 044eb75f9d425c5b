"""Replies of models as columns, and the texts that ask for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def unfenced(c: str | Column) -> Column:
    """Without the code fence that encloses the whole text."""
    return F.regexp_replace(F.regexp_replace(T.strip(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def candidate(c: str | Column, least: float = 0.8) -> Column:
    """(answer, confidence, usable): usable if it is a letter, said to be usable, and at least that confident. Broken replies: empty, 0, false."""
    read = F.from_json(unfenced(c), "answer string, confidence string, usable string")
    answer = F.coalesce(T.normalize_answer(read["answer"]), F.lit(""))
    sure = T.clamp_confidence(read["confidence"])
    return F.struct(answer.alias("answer"), sure.alias("confidence"), ((answer != "") & T.coerce_bool(read["usable"]) & (sure >= least)).alias("usable"))


def analysis(c: str | Column, most: int = 500) -> Column:
    """(cause, concepts): a reply that is no JSON object is kept as the cause, up to ``most`` characters."""
    read = F.from_json(unfenced(c), "cause string, concepts array<string>")
    return F.struct(F.coalesce(read["cause"], F.substring(T.col(c), 1, most)).alias("cause"), F.coalesce(read["concepts"], F.array().cast("array<string>")).alias("concepts"))


#: What a reply to a page tells.
PAGE_REPLY = "context struct<chapter:string,section:string>, questions array<struct<number:long,answer:string,exam_year:string>>"
NO_ANSWERS = "array<struct<number:bigint,answer:string,exam_year:string>>"


def page_answers(c: str | Column) -> Column:
    """(number, answer, exam_year) of the questions in the reply to a page that have an answer, in capitals; none for broken replies."""
    read = F.from_json(unfenced(c), PAGE_REPLY)["questions"]
    tidy = F.transform(F.coalesce(read, F.array().cast(NO_ANSWERS)), lambda q: F.struct(q["number"].alias("number"), F.upper(T.strip(q["answer"])).alias("answer"), F.nullif(T.strip(q["exam_year"]), F.lit("")).alias("exam_year")))
    return F.filter(tidy, lambda q: F.coalesce(q["answer"], F.lit("")) != "")


def page_context(c: str | Column) -> Column:
    """(chapter, section) that the reply to a page names; null where it names none."""
    read = F.from_json(unfenced(c), PAGE_REPLY)["context"]
    return F.struct(*(F.nullif(read[k], F.lit("")).alias(k) for k in ("chapter", "section")))


def merged_payload(c: str | Column, **more: Column) -> Column:
    """A JSON object with more members; members that are there keep their types, of one name the new one stays. Anything else passes as it is."""
    read = F.from_json(T.col(c), "map<string,variant>")
    new = F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v.cast("variant"))))
    old = F.map_filter(read, lambda k, v: ~k.isin(list(more)))
    return F.when(T.strip(c).startswith("{") & read.isNotNull(), F.to_json(F.map_concat(old, new))).otherwise(T.col(c))


def appended(c: str | Column, item: Column) -> Column:
    """A comma list with the item at its end unless it is there."""
    parts = F.filter(F.transform(F.split(F.coalesce(T.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.when(item.isNull() | F.array_contains(parts, item), parts).otherwise(F.array_append(parts, item)), ",")


def labelled(label: str, c: str | Column) -> Column:
    """The label and the value behind it; null if there is no value."""
    return F.concat(F.lit(label), F.nullif(T.col(c), F.lit("")))


def option_lines(letters: str = "ABCD", indent: str = "") -> list[Column]:
    return [labelled(f"{indent}{k}. ", f"option_{k.lower()}") for k in letters]


# Fixed values within the next five: the labels that prompts give to the parts of a question. Parts that are null or empty are left out.
def answer_prompt(letters: str = "ABCD") -> Column:
    """Asks for the answer of a choice question."""
    return F.concat_ws("\n", labelled("Subject: ", "subject"), F.concat(F.lit("Question: "), "question_text"), *option_lines(letters))


def essay_prompt() -> Column:
    """Asks for a reference answer to an open question."""
    return F.concat_ws("\n", F.concat(labelled("【", "subject"), F.lit("】")), F.concat(F.lit("题目："), "question_text"))


def mistake_prompt(answer: str = "user_answer", key: str = "key") -> Column:
    """Asks why a wrong answer was given; a chapter that is not known is said to be so."""
    about = [labelled("科目：", "subject"), F.concat(F.lit("章节："), F.coalesce(F.nullif(F.col("chapter"), F.lit("")), F.lit("未知"))), F.concat(F.lit("题目："), "question_text")]
    return F.concat_ws("\n", *about, F.lit("选项："), *option_lines(), F.concat(labelled("学生答案：", answer), F.lit("（错误）")), labelled("正确答案：", key))


def tutor_prompt(include_key: bool = True) -> Column:
    """What a tutor is told of the question at hand: options only if there is a first one; null parts are empty. Without the key neither answer nor analysis is told."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    options = F.when(has("option_a"), F.concat_ws(" ", *(F.concat(F.lit(f"{k}."), empty(f"option_{k.lower()}")) for k in "ABCD")))
    head = F.concat(F.lit("[当前题目] 科目:"), empty("subject"), F.lit(" 章节:"), empty("chapter"))
    key = [labelled("正确答案: ", "answer"), labelled("解析: ", "analysis")] if include_key else []
    return F.concat_ws("\n", head, F.concat(F.lit("题目: "), empty("question_text")), options, *key)


def correction_part() -> Column:
    """A question within a prompt that asks for corrections of a page."""
    return F.concat_ws("\n", F.concat(F.lit("[ID="), "id", F.lit("] 题目: "), "question_text"), *option_lines(indent="  "))


def note() -> Column:
    """A Markdown note on a weak point: tag, subject, chapter, wrong_count, mastery_score (in whole percent, halves to the even one), summary, and the lists confused_concepts, question_ids, recommended_actions."""
    or_else = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    listed = lambda c, lead, other: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit(lead), x.cast("string"))), "\n")).otherwise(F.lit(lead[:2] + other))
    mastery = F.bround(F.coalesce("mastery_score", F.lit(0.0)) * 100, 0).cast("int").cast("string")
    facts = [F.concat(F.lit("Subject: "), or_else("subject", "uncategorized")), F.concat(F.lit("Chapter: "), or_else("chapter", "uncategorized")), F.concat(F.lit("Wrong count: "), F.coalesce("wrong_count", F.lit(0)).cast("string")), F.concat(F.lit("Mastery: "), mastery, F.lit("%"))]
    concepts = F.when(F.size("confused_concepts") > 0, F.array_join("confused_concepts", ", ")).otherwise("None")
    parts = [
        ("Common Misconceptions", or_else("summary", "No AI summary yet.")),
        ("Confused Concepts", concepts),
        ("Related Wrong Questions", listed("question_ids", "- Q", "None")),
        ("Review Actions", listed("recommended_actions", "- ", "Review related wrong questions")),
    ]
    sections = [F.concat(F.lit(f"\n## {title}\n"), body, F.lit("\n")) for title, body in parts]
    return F.concat(F.lit("# "), F.col("tag"), F.lit("\n\n"), F.concat_ws("\n", *facts), F.lit("\n"), *sections)
