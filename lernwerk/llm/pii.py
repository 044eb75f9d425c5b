"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges for IP
addresses, digit counts for phones), and context words shortly before a span raise its score. Candidates that a
validator refuses are dropped and not tried again at another start; IBANs are: every start is tried, and from each the ends
at blanks, the length of its country first, then from the longest to the shortest. Offsets count code points; the end is exclusive.

Defined cases: a null text counts as empty and has no spans. Kinds are searched apart, so spans of two kinds may
overlap; of one kind they never do. Columns besides the text stay as they are; a column named ``spans`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# The patterns of the contract for the first four kinds, in its order, and the IBAN format. Against long runs they carry
# look-behinds that change no match (a match can only begin at the start of a run, or where the last one ended) and possessive
# repeats where nothing follows.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # what follows is looked at only, so that starts within it are found too
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}",
}
IBAN_HEAD = 4
# Characters of an IBAN by country.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
BASE = ("email", "ip", "card", "phone")
# Words that speak for a kind when they stand shortly before it, in the languages of the corpus.
CONTEXT = {
    "email": r"e-?mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|direcci",
    "card": r"card|visa|credit|payment|karte|tarjeta|carte",
    "phone": r"phone|tel|call|mobile|fon|anruf|llam",
    "iban": r"iban|bank|account|konto|cuenta|compte",
}
# The score of a confirmed span of each kind, and what a context word adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_GAIN, CONTEXT_CHARS = 0.1, 40


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """From the right, every second digit doubled, 9 taken off above 9; the sum is a multiple of 10."""
    backwards = F.split(F.reverse(digits(s)), "")
    values = F.transform(F.filter(backwards, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.when(x.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(s: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35; the number leaves 1 when divided by 97."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda x: x != ""), lambda x: F.conv(x, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1


def octets(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return octets(s)
    if kind == "card":
        return F.length(digits(s)).between(14, 19) & luhn(s)
    if kind == "phone":
        return F.length(digits(s)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97(s)
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, join) -> Column:
    """For each number what ``join`` makes of those before it, 0 for the first. It is applied within blocks of about the square root of their number and then
    to the blocks, so that arrays that grow stay short."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    cut = lambda i: F.slice(values, i * block + 1, block)
    nothing = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all"))
    within = lambda part: F.aggregate(part, nothing, lambda a, n: F.struct(join(a["last"], n).alias("last"), F.concat(a["all"], F.array(a["last"])).alias("all")))
    blocks = F.transform(F.sequence(F.lit(0), block - 1), lambda i: within(cut(i)))
    base = lambda made, i: F.aggregate(F.slice(made, F.lit(1), i), F.lit(0), lambda a, x: join(a, x["last"]))
    return bound(blocks, lambda made: F.flatten(F.transform(made, lambda x, i: bound(base(made, i), lambda b: F.transform(x["all"], lambda s: join(b, s))))))


def proposals(text: Column, kind: str) -> Column:
    """All matches of a kind with their places. The text between the matches gives the lengths to add up."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind == "iban")))
    width = lambda m: F.lit(IBAN_HEAD) if kind == "iban" else F.length(m)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda p: p["m"].isNotNull())
    nothing = F.array().cast("array<struct<s:int,m:string>>")
    sums = lambda p: before(F.transform(p, lambda x: x["g"] + width(x["m"])), lambda a, n: a + n)
    placed = bound(pairs, lambda p: F.zip_with(p, sums(p), lambda x, at: F.struct((x["g"] + at).alias("s"), x["m"].alias("m"))))
    return F.when(F.regexp_like(text, F.lit(pattern)), apart(placed) if kind == "iban" else placed).otherwise(nothing)


def iban_in(m: Column) -> Column:
    """The beginning of a proposal, up to a blank or its end, that is an IBAN; null if none is."""
    words = F.split(m, " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    fixed = F.lit(0)
    for n, countries in IBAN_CHARS.items():
        fixed = F.when(F.substring(m, 1, 2).isin(countries.split()), n).otherwise(fixed)
    fine = F.filter(ends, lambda e: valid("iban", e))
    best = F.array_max(F.transform(fine, lambda e: F.struct((F.length(F.replace(e, F.lit(" "), F.lit(""))) == fixed).alias("fixed"), F.length(e).alias("n"), e.alias("m"))))
    return best["m"]


def apart(placed: Column) -> Column:
    """The IBANs among the proposals, by start; one that begins inside an earlier one goes."""
    found = F.filter(F.transform(placed, lambda p: F.struct(p["s"].alias("s"), iban_in(p["m"]).alias("m"))), lambda p: p["m"].isNotNull())
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,m:string>>").alias("all")),
        lambda a, p: F.when(p["s"] >= a["at"], F.struct((p["s"] + F.length(p["m"])).alias("at"), F.concat(a["all"], F.array(p)).alias("all"))).otherwise(a),
        lambda a: a["all"],
    )


def valid_of(kind: str):
    return lambda p: valid(kind, p["m"])


def span_of(kind: str, body: str):
    """From a proposal over the text in column ``body`` to a span with its score."""

    def span(p: Column) -> Column:
        before = F.substring(F.col(body), F.greatest(p["s"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(p["s"], F.lit(CONTEXT_CHARS)))
        gain = F.when(F.regexp_like(before, F.lit(f"(?i){CONTEXT[kind]}")), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        rank = list(PATTERNS).index(kind)
        return F.struct(p["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (p["s"] + F.length(p["m"])).alias("end"), (F.lit(SCORES[kind]) + gain).alias("score"))

    return span


def find(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Add ``spans``: array of (start, rank, kind, end, score), by start and then by the order of ``PATTERNS``."""
    body = fresh(df, "body")
    own = {kind: fresh(df, kind) for kind in kinds}
    out = df.drop("spans").withColumn(body, F.coalesce(F.col(text), F.lit("")))
    for kind, name in own.items():
        out = out.withColumn(name, proposals(F.col(body), kind))
    spans = [F.transform(F.filter(F.col(name), valid_of(kind)), span_of(kind, body)) for kind, name in own.items()]
    return out.withColumn("spans", F.array_sort(F.concat(*spans))).drop(body, *own.values())


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """Replace the spans of at least that score by their kind in brackets; a span that begins inside an earlier one is covered with it.

    A null text stays null. Text between spans is copied as it is.
    """
    found = find(df, text)
    kept = F.filter("spans", lambda s: s["score"] >= least)
    body = F.col(text)
    shown = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(body, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    # a span begins after the ends of all before it, or is covered
    pieces = lambda k: F.array_join(F.zip_with(k, before(F.transform(k, lambda s: s["end"]), F.greatest), shown), "")
    rest = lambda k: F.substring(body, F.array_max(F.transform(k, lambda s: s["end"])) + 1, F.length(body))
    done = bound(kept, lambda k: F.when(F.size(k) == 0, body).otherwise(F.concat(pieces(k), rest(k))))
    return found.withColumn(text, F.when(F.size("spans") == 0, body).otherwise(done)).drop("spans")
