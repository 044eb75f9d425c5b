"""Column expressions for question texts. Regular expressions on text are Unicode-aware, as white space outside ASCII occurs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters.
PUA = r"[\x{E000}-\x{F8FF}]"

# Private-use codes of a mathematical font that come in pairs, with the opening and closing character they stand for.
PAIRED = [("\uf0ee", "(", ")"), ("\uf0f6", "[", "]"), ("\uf0f4", "|", "|"), ("\uf0f7", "\u230a", "\u230b"), ("\uf0f8", "\u2308", "\u2309")]
# Single private-use codes and what they stand for.
SINGLE = {
    "\uf0e0": "", "\uf0e1": "", "\uf0e2": "", "\uf00a": "'", "\uf0e8": "\u23a7", "\uf0e9": "\u23ab", "\uf0ea": "\u23aa", "\uf0e3": "\u23a7",
    "\uf0e4": "\u222a", "\uf0b1": "\u2211", "\uf0dc": "\u0305", "\uf0fb": "\u23df", "\uf0fc": "\u23df", "\uf0fd": "\u23df",
}
# Fixed value: the characters of ornamental rules.
RULES = "⏟⏞⎵⎴‾_~\\-="
# Subjects and the keywords that name them, in order.
SUBJECTS = {
    "数据结构": ["数据结构", "data structure"],
    "操作系统": ["操作系统", "operating system"],
    "计算机组成原理": ["组成原理", "计算机组成", "机组", "computer organization"],
    "计算机网络": ["计算机网络", "计网", "computer network"],
}
UNKNOWN_SUBJECT = "未知科目"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it uses several times, worked out once for each row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: str | Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def pua_count(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit(PUA))


def pua_normalize(c: str | Column) -> Column:
    """Neither private-use characters nor white space."""
    return F.regexp_replace(F.regexp_replace(col(c), PUA, ""), r"(?U)\s+", "")


def fingerprint(c: str | Column, n: int = 40) -> Column:
    """The first ``n`` normalised characters. A text is normalised as a whole only if its beginning does not give them."""
    head = pua_normalize(F.substring(col(c), 1, 8 * n))
    return F.when((F.length(head) >= n) | (F.length(col(c)) <= 8 * n), F.substring(head, 1, n)).otherwise(F.substring(pua_normalize(c), 1, n))


def pua_repair(c: str | Column, drop_unmapped: bool = True) -> Column:
    """Mapped private-use characters become what they stand for; the others go, or stay."""
    out = col(c)
    for code, opening, closing in PAIRED:
        out = F.regexp_replace(out, rf"(?U){code}\s+{code}", opening + closing)
        out = F.replace(out, F.lit(code), F.lit(opening))
    for code, stands_for in SINGLE.items():
        out = F.replace(out, F.lit(code), F.lit(stands_for))
    out = F.regexp_replace(out, PUA, "") if drop_unmapped else out
    return F.when(F.regexp_like(col(c), F.lit(PUA)), out).otherwise(col(c))


def text_hash(c: str | Column) -> Column:
    return F.sha2(strip(c), 256)


def drop_rules(c: str | Column) -> Column:
    """Lines of three or more rule characters go."""
    return F.array_join(F.filter(F.split(col(c), "\n", -1), lambda x: ~F.regexp_like(strip(x), F.lit(f"^[{RULES}]{{3,}}$"))), "\n")


def image_refs(c: str | Column) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))


def strip_images(c: str | Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"!\[[^\]]*\]\([^)]*\)", ""), r"\n{3,}", "\n\n"))


def strip_details(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?is)<details.*?</details>", "")


def breaks(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?i)<br\s*/?>", "\n")


# The tags that a table fragment may have, and the attributes that run code.
TABLE_TAGS = "table|thead|tbody|tr|th|td"
EVENT_ATTRIBUTE = r"""(?is)\s+on[a-z]+\s*=\s*(['"]).*?\1"""


def html_tables(c: str | Column) -> Column:
    """The table fragments of a text, without event attributes and without tags that are no part of a table."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1))
    return F.transform(found, lambda x: strip(F.regexp_replace(F.regexp_replace(x, EVENT_ATTRIBUTE, ""), rf"<(?!/?(?:{TABLE_TAGS})\b)[^>]+>", "")))


def preview(c: str | Column, n: int = 160) -> Column:
    """White space as single blanks, cut after n characters."""
    one = strip(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n), F.lit("..."))).otherwise(one)


def question_number(c: str | Column) -> Column:
    return F.when(F.regexp_like(col(c), F.lit(r"^\s*\d{1,4}\s*[.、．]")), F.regexp_extract(col(c), r"^\s*(\d{1,4})\s*[.、．]", 1).cast("int"))


# How a reference to the page of the answers and an exam year are written.
ANSWER_REF = r"[（(]\s*(?:该节答案见|答案见|本节答案见)\s*(?:原书|书本)?\s*P\s*(\d+)\s*[)）]"
EXAM_YEAR = r"【\s*(\d{4})\s*(?:统考)?真题\s*】"


def exam_year(c: str | Column) -> Column:
    year = F.regexp_extract(col(c), EXAM_YEAR, 1)
    return F.when(year != "", F.concat(year, F.lit("统考真题")))


def answer_ref(c: str | Column) -> Column:
    page = F.regexp_extract(col(c), ANSWER_REF, 1)
    return F.when(page != "", F.concat(F.lit("答案见原书P"), page))


def normalize_answer(c: str | Column) -> Column:
    """One letter A to E, or empty."""
    letter = F.upper(strip(c))
    return F.when(letter.isin("A", "B", "C", "D", "E"), letter).otherwise("")


def clamp_confidence(c: str | Column, default: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(c).try_cast("double"), F.lit(default))))


def coerce_bool(c: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def safe_name(c: str | Column, default: str = "uncategorized") -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(col(c), r'[\\/:*?"<>|]', "_")), F.lit("")), F.lit(default))


def safe_relative_path(c: str | Column) -> Column:
    """With forward slashes; null for absolute paths, drives and paths with ``..``."""
    path = F.replace(F.trim(col(c)), F.lit("\\"), F.lit("/"))
    bad = F.regexp_like(path, F.lit(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")) | (path == "")
    return F.when(~bad, path)


def infer_subject(c: str | Column, unknown: str = UNKNOWN_SUBJECT) -> Column:
    out = F.lit(None).cast("string")
    for subject, words in reversed(SUBJECTS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.lower(col(c)), F.lit(word))
        out = F.when(hit, subject).otherwise(out)
    return F.coalesce(out, F.lit(unknown))


def json_list(c: str | Column) -> Column:
    """A JSON list, a JSON string or plain text as a list of trimmed non-empty strings."""
    raw = F.trim(col(c))
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.startswith('"'), F.array(F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x"))).otherwise(F.array(raw))
    return F.filter(F.transform(F.coalesce(parsed, F.array(raw)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def knowledge_tags(section: str | Column, year: str | Column) -> Column:
    """The section and the exam year, as far as there are any, comma-joined."""
    filled = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    return F.concat_ws(",", filled(section), filled(year))


def inline_options(c: str | Column) -> Column:
    """(stem, a, b, c, d) of a question: an option reaches from the first label of its letter to the first one of the next letter there is.

    A label is a letter and a full stop, not after a letter, a digit or an underscore of ASCII, so it may follow a character of Chinese. No label A: all is stem, no option.
    """
    text = col(c)
    label = {k: rf"(?<![A-Za-z0-9_])[{k}{k.lower()}]\.\s*" for k in "ABCD"}
    at = {k: F.regexp_instr(text, F.lit(p)) for k, p in label.items()}
    wide = {k: F.length(F.regexp_extract(text, p, 0)) for k, p in label.items()}
    end = {k: F.coalesce(*(F.when(at[n] > 0, at[n]) for n in "ABCD"["ABCD".index(k) + 1 :]), F.length(text) + 1) for k in "ABCD"}
    part = lambda k: F.when((at["A"] > 0) & (at[k] > 0), strip(F.substr(text, at[k] + wide[k], F.greatest(F.lit(0), end[k] - at[k] - wide[k]))))
    stem = strip(F.when(at["A"] > 0, F.substr(text, F.lit(1), at["A"] - 1)).otherwise(text))
    return F.struct(stem.alias("stem"), *(part(k).alias(k.lower()) for k in "ABCD"))
