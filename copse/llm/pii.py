"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score. DataFrame operations only.

Spans are code points [start, end), leftmost and not overlapping within a kind. A pattern is run as \\G(gap)(match), so the gaps
and matches of a text give all positions in one pass per kind and no place is tried twice; quantifiers are possessive where what
follows can't match what they consumed, so long runs cost linear time and no stack.

Beside the base kinds there are IBANs, cut to the length of their country and confirmed by mod 97, and secrets: long hexadecimal
strings, which no checksum tells from a content hash, so that context words before them decide.

Defined results: a null text counts as empty and has no spans. Repeated rows are treated alike. An empty table gives an empty
result. Extra columns are ignored by pii_report; find_spans adds one column and leaves the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import whole_text

#: Kinds in the order that sorts spans with equal starts.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = KINDS[:4]

# A match may begin where the last one ended (\G) or where no longer one could have begun earlier.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs are maximal, so 14 to 19 digits are asked for at once and other runs are passed over whole.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_EDGES = r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"
_IBAN = _EDGES % ("(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{'|'.join(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values()))) + ")")
_SECRET = _EDGES % "[0-9A-Fa-f]{32,64}+"

#: What a text must show before a kind's pattern is run over it.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"),
    "secret": lambda t: t.rlike(r"[0-9A-Fa-f]{32}"),
}
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "iban": _IBAN, "secret": _SECRET}
#: Hundredths of score a confirmed span starts from; context words add 20, their absence takes 10.
PRIOR = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 70, "secret": 50}
#: Words before a span that speak for its kind, of any case.
CONTEXT = {
    "email": "e-?mail|mailto|contact|write to",
    "ip": "ip|address|host|server|from",
    "card": "card|visa|mastercard|amex|credit|payment",
    "phone": "phone|call|tel|mobile|fax|whatsapp",
    "iban": "iban|account|bank|transfer",
    "secret": "token|secret|password|passwd|pwd|key|api_?key|credentials?|authorization|bearer",
}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _confirmed(kind: str, hit: Column) -> Column:
    """The validator of a kind: octets, Luhn, number length, ISO 7064 mod 97, or digits and letters both."""
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(hit, r"\."), lambda p: F.when(small(p), F.coalesce(p.cast("decimal(38,0)"), F.lit(0)) <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "iban":
        flat = F.replace(hit, F.lit(" "), F.lit(""))
        moved = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
        value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97)
        return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1
    if kind == "secret":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def _proposed(kind: str, text: Column) -> Column:
    """array<struct<start, end, hit>> of a kind's matches, unconfirmed."""
    pattern = F.lit(rf"(?s)\G(.*?)({_PATTERNS[kind]})")
    pieces = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def add(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("hit")))).alias("spans"))

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)["spans"]
    return F.when(_HINTS[kind](text), found).otherwise(empty)


def _validator(kind: str) -> Callable[[Column], Column]:
    return lambda s: _confirmed(kind, s["hit"])


def _scorer(kind: str, rank: int, text: Column, window: int) -> Callable[[Column], Column]:
    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - window, F.lit(0))
        near = F.substring(text, first + 1, s["start"] - first).rlike("(?i)" + _EDGES % CONTEXT[kind])
        score = F.when(near, F.lit((PRIOR[kind] + 20) / 100)).otherwise(F.lit((PRIOR[kind] - 10) / 100))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit"), score.alias("score"))

    return scored


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def spans_of(text: Column, *, window: int = 40, threshold: float = 0.5) -> Column:
    """array<struct<start, rank, end, kind, hit, score>> by start, then kind. Base kinds stay whatever their score; others need the threshold.

    score: the kind's prior, 0.2 higher with context words up to window characters before the span, and 0.1 lower without any.
    """
    lists = []
    for rank, kind in enumerate(KINDS):
        sure = F.transform(F.filter(_proposed(kind, text), _validator(kind)), _scorer(kind, rank, text, window))
        lists.append(sure if kind in BASE_KINDS else F.filter(sure, lambda s: s["score"] >= threshold))
    return F.array_sort(F.concat(*lists))


def find_spans(df: DataFrame, *, text_col: str = "text", into: str = "pii", **options) -> DataFrame:
    """df with one more column: the spans of each whole text."""
    return df.withColumn(into, spans_of(whole_text(text_col), **options))


def redact(df: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """df with every span of the text replaced by <KIND>; of overlapping spans the first stays."""
    text, found = whole_text(text_col), spans_of(whole_text(text_col), **options)

    def put(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return df.withColumn(text_col, F.when(F.col(text_col).isNull(), F.lit(None).cast("string")).otherwise(done))


def pii_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, two decimals, comma-joined)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), spans_of(whole_text(text_col), **options).alias("found"))
    told = lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, told), ",")
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    base = joined(F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS)))
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores.alias("scores"))
