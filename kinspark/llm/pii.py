"""Personal data: patterns propose, checksums confirm, context words adjust.

Patterns are written so that they never backtrack over a run: a candidate starts
at the head of a run or where the previous match ended, and quantifiers are
possessive; the matches equal those of the plain patterns in the comments.

Defined results: a null text counts as empty; every match is reported in place,
so repeated rows and repeated values give repeated spans; ties in start are
ordered by kind as listed; further columns are kept unless they bear the name of
an output; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm import text as T

LOCAL = "A-Za-z0-9._%+-"
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join("|".join(x.split()) for x in IBAN_SIZES.values())
_SIZED = "|".join(rf"(?:{x.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, x in IBAN_SIZES.items())
#: The country's number of characters; for countries without one, a run as long as it goes.
IBAN = rf"(?<![A-Za-z0-9])(?:{_SIZED}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
#: Score of a confirmed pattern, and the words within REACH characters that raise it.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|contact|write|mailto|reach",
    "ip": "ip|address|host|server|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
LIFT, REACH, LEAST = 0.2, 40, 0.5
BLOCK = 1024  # characters


def mod97(account: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN with letters as 10 to 35; 1 for a valid one."""
    turned = F.concat(F.substring(account, 5, 60), F.substring(account, 1, 4))
    value = lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(F.when(value(ch) > 9, a * 100 + value(ch)).otherwise(a * 10 + value(ch)) % 97).cast("int"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.length(_digits(hit)).between(14, 19) & F.coalesce(F.call_function("luhn_check", _digits(hit)), F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return mod97(F.replace(hit, F.lit(" "), F.lit(""))) == 1


def _confirms(kind: str):
    return lambda x: _confirmed(kind, x["hit"])


def _scores(t: Column, rank: int, kind: str, hits: Column) -> Column:
    """The kind's spans with their own score, lifted where a context word stands
    nearby; looked for in blocks of the text, as to find a place in a long string
    takes as long as all that stands before it."""

    def scored(blocks: Column, x: Column) -> Column:
        two = lambda k: F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit("")))
        block = lambda at: F.floor(at / BLOCK).cast("int")
        low = F.greatest(x["start"] - REACH, F.lit(0))
        left = F.substr(two(block(low)), low - block(low) * BLOCK + 1, x["start"] - low)
        right = F.substr(two(block(x["end"])), x["end"] - block(x["end"]) * BLOCK + 1, F.lit(REACH))
        near = F.concat(left, F.lit("\n"), right)
        lift = F.when(near.rlike(rf"(?i)(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"), F.lit(LIFT)).otherwise(F.lit(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), (F.lit(START[kind]) + lift).alias("score"))

    cut = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    some = lambda h: T.let(cut, lambda blocks: F.transform(h, lambda x: scored(blocks, x)))
    return T.let(hits, lambda h: F.when(F.size(h) > 0, some(h)).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,score:double>>")))


def _gate(kind: str, text: Column) -> Column:
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"),
        "phone": F.contains(text, F.lit("+")),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
        "ssn": text.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    }[kind]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii: array of (start, ord, end, kind, score), by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SSN), strict=True))
    found = []
    for i, kind in enumerate(KINDS):
        hits = T.spans(t, patterns[kind], _gate(kind, t))
        if kind in ("ip", "card", "phone", "iban"):
            hits = F.filter(hits, _confirms(kind))
        found.append(_scores(t, i, kind, hits))
    every = F.filter(F.concat(*found), lambda x: x["score"] >= LEAST)
    return docs.withColumn("pii", F.array_sort(every))


def _named(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the base spans' digest, all spans."""
    x = find(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda p: p["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("pii", lambda p: p["kind"] == k)).cast("long").alias(f"n_{k}")
    return x.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        T.digest(_named(base)).alias("base_sha256"),
        F.array_join(_named(F.col("pii")), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda p: p["score"])), F.lit(0.0)).alias("top_score"),
    )
