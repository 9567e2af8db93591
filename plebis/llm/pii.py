"""Operator 13: personal data.

Regular expressions propose spans, checksums confirm them and the words nearby adjust their
score: a kind's own words near a span add to it, words of versions, orders and other numbers
take from it.  The base kinds (email, ip, card by Luhn, phone) are reported whatever their
score; of the others (iban by mod 97, ssn by its number ranges, oib by mod 11 and 10, tel,
which has no checksum and needs its words) those count that score ``bar`` or more and
overlap no base span.  All of it is row-local.

Patterns are written so that a text costs time in proportion to its length: a run that can't
start a match at its first character is not tried again from its later ones, and
repetitions give nothing back.

Defined results.  Null text scans as the empty text.  Offsets are code points, end
exclusive.  Repeated rows and null ids give a row each; an empty table gives no
rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plebis.llm.common import joined, let, located, table

# Fixed patterns of the base kinds.  A local part starts a run of its characters or
# follows the address before; possessive repetitions match what greedy ones would.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "SI", 20: "AT BA EE LT LU", 21: "CH HR LI LV", 22: "BG DE GB IE RS", 24: "CZ ES RO SE SK", 25: "PT", 26: "TR",
    27: "FR GR IT MC SM", 28: "CY HU PL",
}
IBAN = (
    r"(?<![A-Za-z0-9])(?:"
    + "|".join(
        f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, lands in IBAN_LENGTHS.items()
    )
    + r")(?![A-Za-z0-9])"
)
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
OIB = r"(?<![0-9A-Za-z.+-])[0-9]{11}(?![0-9A-Za-z]|[.,-][0-9])"
TEL = r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[\x20/.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.,-][0-9])"

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 24
PIECE = 512
#: What the kind's own words add and what words of other numbers take.
NEAR, AGAINST = 0.3, 0.3
OTHER = r"\b(?:version|release|build|order|invoice|isbn|issn|sku|item|part|serial|page|figure|table|chapter|ticket|verzija|ra[cč]un|narud[zž]ba|stranica)\b"

#: Kind, pattern, score of the shape, score of the confirmation, words that speak for it.
KINDS = (
    ("email", EMAIL, 0.5, 0.4, r"\b(?:e-?mail|mail|contact|write|reach|kontakt|adresa)\b"),
    ("ip", IP, 0.4, 0.2, r"\b(?:ip|host|server|address|client|login|adresa)\b"),
    ("card", CARD, 0.3, 0.4, r"\b(?:card|visa|mastercard|amex|credit|debit|payment|kartica|kreditna)\b"),
    ("phone", PHONE, 0.4, 0.2, r"\b(?:phone|tel|call|mobile|fax|whatsapp|sms|telefon|mobitel|nazovite)\b"),
    ("iban", IBAN, 0.3, 0.5, r"\b(?:iban|account|bank|transfer|konto|ra[cč]un|banka)\b"),
    ("ssn", SSN, 0.2, 0.2, r"\b(?:ssn|social|security|taxpayer|tin)\b"),
    ("oib", OIB, 0.0, 0.4, r"\b(?:oib|jmbg|id|identification|osobni|identifikacijski)\b"),
    ("tel", TEL, 0.3, 0.0, r"\b(?:phone|tel|call|mobile|fax|whatsapp|sms|telefon|mobitel|nazovite)\b"),
)
NAMES = tuple(k[0] for k in KINDS)
BASE = 4


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(m: Column) -> Column:
    """The remainder that account numbers have; 1 where the check digits are right."""
    compact = F.regexp_replace(m, r"\x20", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit(ALNUM), c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v < 0, a).otherwise((a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def mod11_10(m: Column) -> Column:
    """Whether the last of the digits is the check digit of those before."""
    values = F.transform(F.split(m, ""), lambda c: F.instr(F.lit(ALNUM), c) - 1)
    tenth = lambda a: F.when(a == 0, 10).otherwise(a)
    left = F.aggregate(F.slice(values, 1, 10), F.lit(10), lambda a, v: tenth((a + v) % 10) * 2 % 11)
    return (11 - left) % 10 == F.get(values, F.lit(10))


def holds(kind: str, m: Column) -> Column:
    """Whether a match counts: the filters of the base kinds, the checksums of the others."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m) == 1
    if kind == "oib":
        return mod11_10(m)
    return F.lit(True)


def confirmed(kind: str, m: Column) -> Column:
    """What counts as confirmation for the score."""
    if kind == "email":
        return m.rlike(r"\.[A-Za-z]{2,24}$")
    if kind == "ip":
        return ~m.rlike(r"^(?:0|10|127|255)\.")
    return F.lit(True)


def cut(whole: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, as a substring is looked for from the
    start of what it is taken of."""
    return F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def taken(pieces: Column, start: Column, length: Column) -> Column:
    """At most ``PIECE`` code points of the text, from place ``start`` on."""
    k = F.floor(start / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(both, start - k * PIECE + 1, length)


def proposed(whole: Column, pieces: Column, nth: int) -> Column:
    """Spans of one kind: start, nth, end, score."""
    kind, pattern, shape, proof, own = KINDS[nth]
    found = F.filter(located(whole, pattern), lambda s: holds(kind, s["match"]))

    def score(s: Column) -> Column:
        start = F.greatest(s["start"] - BEFORE, F.lit(0))
        near = F.lower(F.concat_ws(" \x01 ", taken(pieces, start, s["start"] - start), taken(pieces, s["end"], F.lit(AFTER))))
        return let(
            near,
            lambda text: F.round(
                F.lit(shape)
                + F.when(confirmed(kind, s["match"]), proof).otherwise(0.0)
                + F.when(text.rlike(own), NEAR).otherwise(0.0)
                - F.when(text.rlike(OTHER), AGAINST).otherwise(0.0),
                2,
            ),
        )

    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), score(s).alias("score")))


def scan(docs: DataFrame, text: str = "text", bar: float = 0.5, into: str = "spans") -> DataFrame:
    """All rows and columns of ``docs`` with ``into``: an array of (kind, start, end, score)
    by start, then kind in the order of KINDS."""
    whole = F.coalesce(docs[text], F.lit(""))

    def both(told: Column, more: Column) -> Column:
        """All base spans, and those others that score enough and overlap none of them."""
        apart = lambda s: ~F.exists(told, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.array_sort(F.concat(told, F.filter(more, lambda s: (s["score"] >= bar) & apart(s))))

    def every(pieces: Column) -> Column:
        base, more = (F.concat(*[proposed(whole, pieces, nth) for nth in r]) for r in (range(BASE), range(BASE, len(KINDS))))
        return let(base, lambda told: both(told, more))

    ordered = let(cut(whole), every)
    names = F.array(*map(F.lit, NAMES))
    spans = F.transform(ordered, lambda s: F.struct(F.get(names, s["nth"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return docs.select(*[docs[c] for c in docs.columns if c != into], spans.alias(into))


def redact(docs: DataFrame, text: str = "text", bar: float = 0.5) -> DataFrame:
    """The same rows with every reported span replaced by its kind in brackets; of spans that
    overlap the first names the mark."""
    spans = "__private_spans"
    while spans in docs.columns:
        spans += "_"  # a name that no column has
    found = scan(docs, text, bar, into=spans)
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text))).select(*docs.columns)


def op13_pii(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*NAMES[:BASE]))
    return found.select(
        "doc_id",
        *[count(k) for k in NAMES[:BASE]],
        F.sha2(joined(F.transform(base, written)), 256).alias("base_sha256"),
        joined(F.transform("spans", written)).alias("spans"),
        joined(F.transform("spans", lambda s: F.format_string("%.2f", s["score"]))).alias("scores"),
        *[count(k) for k in NAMES[BASE:]],
    )
