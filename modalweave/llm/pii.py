"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

Built-in expressions only: the positions of matches follow from the lengths of
the matches and of the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, documents

#: Kinds in the order that breaks ties between spans with one start.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn"]

# A run of characters that cannot start in its own middle is entered at its
# first character or where the last match ended; repeated groups are possessive
# because nothing after them could use what they give back. Both keep long runs
# linear and leave the matches as they are. Of an IBAN only the first four
# characters are matched: the run after them, perhaps with the first character
# of a word that follows, is looked at (group 1) and its end chosen in iban().
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: Characters of an IBAN by country, as registered under ISO 13616.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_REGISTERED = {n: f"(?:{'|'.join(codes.split())})" for n, codes in IBAN_CHARS.items()}
#: Two letters, two digits and the rest in the length of the country; 15 to 34 characters for other letters.
IBAN_FORM = "^(?:{}|(?!{})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})$".format(
    "|".join(f"{codes}[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, codes in _REGISTERED.items()), "|".join(_REGISTERED.values())
)

#: Score of a confirmed match without context, and words nearby that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"\b(?:ip|address|host|server|client|login)\b",
    "card": r"\b(?:card|credit|debit|visa|mastercard|amex|payment)\b",
    "phone": r"\b(?:phone|tel|telephone|call|mobile|cell|fax)\b",
    "iban": r"\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"\b(?:ssn|social security|tax id|taxpayer)\b",
}
BONUS, WINDOW, THRESHOLD = 0.3, 40, 0.5

SPAN = "struct<start:int,end:int,value:string>"
#: Matches of a text that are collected at a time, see fold.
STEPS = 256
FULL_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def fold(items: Column, element: str, step, last=lambda at, out: out) -> Column:
    """Walk over ``items`` with a position ``at`` from 0 and a list ``out`` of ``element``; ``last`` makes the result of both.

    Adding to a list copies it, so a text with very many matches would cost
    their square. Lists grow to STEPS items here and are chained at the end.
    """
    empty = F.array().cast(f"array<{element}>")

    def cut(held):
        last_chunk = F.greatest(F.floor((F.size(held) - 1) / STEPS), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last_chunk), lambda i: F.slice(held, i * STEPS + 1, F.lit(STEPS)))

    # a variable of a lambda is computed once, an expression inside it once per call
    chunks = F.element_at(F.transform(F.array(items), cut), 1)

    def chunk(acc, part):
        start = F.struct(acc["at"].alias("at"), empty.alias("out"))
        return F.aggregate(
            part, start, step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{element}>>").alias("out"))
    return F.aggregate(chunks, start, chunk, lambda x: last(x["at"], F.flatten(x["out"])))


def matches(text: Column, found: Column, pattern: str) -> Column:
    """start, end (code points) and value of the regular expression's successive matches ``found`` in ``text``."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def step(acc, x):
        begin = acc["at"] + x["g"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(found) == 0, none).otherwise(fold(steps, SPAN, step))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The digits' check sum is a multiple of ten (every second digit from the right doubled)."""
    digits = F.split(F.reverse(digits_of(value)), "")
    doubled = F.transform(
        digits, lambda d, i: d.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """First four characters to the end, letters as 10 to 35: the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(rest, c):
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


def iban(run: Column) -> Column:
    """The IBAN that ``run`` begins with, or null.

    It ends where a group ends, so a word, BIC, amount or currency after it
    stays outside. The country gives the length; of several ends that pass under
    letters without a registered length the last one counts.
    """

    def passes(value):
        return F.regexp_replace(value, " ", "").rlike(IBAN_FORM) & mod97(value)

    def begun(groups):
        return F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))

    # a longer one of two with the same beginning is the greater string
    return F.array_max(F.filter(F.flatten(F.transform(F.array(F.split(run, " ")), begun)), passes))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits_of(value)).between(12, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    if kind == "ssn":  # never issued: area 000, 666 and 9xx, group 00, number 0000
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): kind, start, end, score of all personal data, by start, then kind.

    email, ip, card and phone are reported whenever their check holds; iban and
    ssn only if score and context reach the threshold. Context is looked for in
    the WINDOW code points on either side, not in the match itself. A null or empty text has
    no spans, repeated rows give them again, other columns are not read.
    """
    found = documents(docs).select("doc_id", "text", *[c.alias(n) for n, c in _found(F.col("text")).items()])
    return found.select("doc_id", _spans(list(PATTERNS)).alias("spans"))


def _found(text: Column) -> dict[str, Column]:
    """Matches of each kind as _<kind>, what follows those of an IBAN as _after."""
    found = {f"_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    return found | {"_after": F.regexp_extract_all(text, F.lit(PATTERNS["iban"]), F.lit(1))}


def _ibans(heads: Column) -> Column:
    """Spans of the IBANs that begin with ``heads``."""
    values = F.zip_with(heads, F.col("_after"), lambda s, t: F.struct(s["start"], iban(F.concat(s["value"], t)).alias("value")))
    spans = F.transform(values, lambda s: F.struct(s["start"], (s["start"] + F.length(s["value"])).alias("end"), s["value"]))
    return F.filter(spans, lambda s: s["value"].isNotNull())


def _confirmed(kind: str) -> Column:
    """Scored spans of one kind in the column text, from its matches in the column _<kind>."""
    text = F.col("text")
    held = matches(text, F.col(f"_{kind}"), PATTERNS[kind])
    spans = _ibans(held) if kind == "iban" else F.filter(held, lambda s: valid(kind, s["value"]))

    def scored(s):
        begin = F.greatest(s["start"] - WINDOW, F.lit(0))
        around = F.substring(text, begin + 1, s["start"] - begin), F.substring(text, s["end"] + 1, F.lit(WINDOW))
        near = F.lower(F.concat_ws("\n", *around))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score")
        )

    part = F.transform(spans, scored).cast(f"array<{FULL_SPAN}>")
    return part if kind in BASE_KINDS else F.filter(part, lambda s: s["score"] >= THRESHOLD)


def _spans(kinds: list[str]) -> Column:
    parts = [_confirmed(kind) for kind in kinds]
    order = F.concat(*parts)
    ranked = F.transform(order, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("r"), s.alias("s")))
    return F.transform(F.array_sort(ranked), lambda x: x["s"])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in capitals, e.g. <EMAIL>; n_chars follows the text.

    Overlapping spans become one mark with the kind of the first. Rows, order of
    columns and null texts stay; needs the columns doc_id, text and n_chars.
    """
    kinds = list(PATTERNS)
    held, back = aside(docs, "text", "n_chars")
    held = held.withColumns(_found(F.coalesce("text", F.lit("")))).withColumn("_spans", _spans(kinds))

    def step(acc, s):
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        added = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(before, mark)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], longer).otherwise(added)

    def join(at, out):
        return F.concat(F.array_join(out, ""), F.substring(F.col("text"), at + 1, F.length("text")))

    clean = F.when(F.size("_spans") > 0, fold(F.col("_spans"), "string", step, join)).otherwise(F.col("text"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    out = held.withColumn("text", clean).withColumn("n_chars", F.when(F.size("_spans") > 0, length).otherwise(F.col("n_chars")))
    return back(out)
