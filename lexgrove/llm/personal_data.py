"""Personal data: patterns propose spans, checksums and ranges confirm them, nearby words adjust the score.

DataFrame functions only. For each kind of ``KINDS``:

1. the pattern proposes the leftmost matches that do not overlap; one that fails a check is dropped and its characters are
   not tried again. Patterns are written so that no text makes them slow: they begin where a run of their characters
   begins and never give back what they took, which changes no match (tests compare with the plain patterns);
2. checks confirm: Luhn for card numbers, mod 97 for IBANs, ranges for addresses, dates and numbers, digit counts, and what
   may stand beside the span;
3. the score in per cent starts at ``base``; a word of ``good`` within ``BEFORE`` characters before or ``AFTER`` characters
   after the span, but not beyond the neighbouring span of its kind, adds ``RAISE``, one of ``bad`` takes ``LOWER`` away.
   Spans of the first four kinds always stay, those of the added kinds from ``LEAST`` up.

Places are counted in code points, the end is exclusive. A null text is empty and holds nothing; an empty table gives an
empty one. Repeated rows are treated alike, ids are not looked at, and all columns stay; one called ``spans`` is replaced.
A text never leaves its row and nothing is shuffled; running totals over its spans go by blocks of ``STRETCH``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 40, 20
RAISE, LOWER, LEAST = 40, 30, 50
STRETCH = 256
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Length of an IBAN by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG DE GB GE IE ME RS",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY GT HU LB PL", 29: "BR PS QA UA",
    30: "JO KW MU", 31: "MT SC",
}
IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


class Kind(NamedTuple):
    name: str
    pattern: str
    check: Callable[[Column], Column]  # of the candidate: m the match, c and d the characters beside it
    base: int
    good: str
    bad: str
    hint: Callable[[Column], Column]  # of the text: cheap, and true wherever there is a match


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _of_length(low: int, high: int) -> Callable[[Column], Column]:
    return lambda x: F.length(_digits(x["m"])).between(low, high)


def _card(x: Column) -> Column:
    # ``luhn_check`` wants digits alone, and as few as the length allows.
    digits = _digits(x["m"])
    return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)


def _apart(x: Column, kind: str) -> Column:
    """No character of ``kind`` on either side."""
    return ~(x["c"].rlike(kind) | x["d"].rlike(kind))


def _iban(x: Column) -> Column:
    packed = F.replace(x["m"], F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(packed, 5, 100), F.substring(packed, 1, 4))
    value = lambda i: F.instr(F.lit("0123456789" + UPPER), F.substring(turned, i, 1)) - 1
    step = lambda total, i: (total * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97
    return _apart(x, "[A-Za-z0-9]") & (F.aggregate(F.sequence(F.lit(1), F.length(packed)), F.lit(0), step) == 1)


def _ssn(x: Column) -> Column:
    return _apart(x, "[0-9-]") & ~x["m"].rlike("^(?:000|666|9)|-00-|0000$")


def _birth(x: Column) -> Column:
    day_first = x["m"].rlike("^(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|1[0-2])[-/.](?:19|20)[0-9][0-9]$")
    month_first = x["m"].rlike("^(?:0?[1-9]|1[0-2])([-/.])(?:0?[1-9]|[12][0-9]|3[01])[-/.](?:19|20)[0-9][0-9]$")
    year_first = x["m"].rlike("^(?:19|20)[0-9][0-9]([-/.])(?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])$")
    return _apart(x, "[0-9]") & (day_first | month_first | year_first)


# The first four are the base; the order is that of the spans.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), 90, "mail|email|contact|write", "example", lambda t: t.contains("@")),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), 60, "ip|address|host|server|client", "version|release|chapter|section", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 60, "card|visa|mastercard|credit|debit|karte|carte|tarjeta", "isbn|serial|tracking|order", lambda t: t.rlike("[0-9]")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _of_length(8, 15), 60, "phone|tel|call|mobile|fax|telefon|portable|movil", "score|utc|gmt", lambda t: t.contains("+")),
    Kind("iban", f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})", _iban, 80, "iban|bank|konto|compte|cuenta|account", "example", lambda t: t.rlike("[A-Z]{2}[0-9]{2}")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, 40, "ssn|social|security|taxpayer", "order|part|isbn|invoice", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]")),
    Kind("birth", r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}", _birth, 10, "born|birth|birthday|dob|geboren|nacido|nacida", "published|updated|posted", lambda t: t.rlike("[0-9][-/.][0-9]")),
    Kind("account", r"[0-9]{8,17}", lambda x: _apart(x, "[0-9]"), 10, "account|acct|konto|kontonummer|compte|cuenta|passport", "isbn|order|ticket", lambda t: t.rlike("[0-9]{8}")),
)
BASE = tuple(k.name for k in KINDS[:4])


def _once(**columns: Column) -> Column:
    """Columns that later steps read without computing them again."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _says(text: Column, words: str) -> Column:
    return F.translate(text, UPPER, LOWERED).rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")


def _steps(k: Kind) -> Column:
    """Characters from the end of the match before to the end of each match."""
    return F.transform(f"match_{k.name}", lambda m, i: F.length(F.get(f"gap_{k.name}", i)) + F.length(m))


def _run(steps: Column, first: Column) -> Column:
    return F.aggregate(steps, F.array(first), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + s))


def _blocks(k: Kind) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(f"step_{k.name}") / STRETCH).cast("int")), lambda b: F.slice(f"step_{k.name}", b * STRETCH + 1, F.lit(STRETCH)))


def _firsts(k: Kind) -> Column:
    """The place at which each block begins."""
    return _run(F.transform(f"block_{k.name}", lambda blk: F.aggregate(blk, F.lit(0), lambda total, s: total + s)), F.lit(0))


def _places(k: Kind) -> Column:
    """The places at which matches end, block by block, each behind the place at which its block begins."""
    return F.flatten(F.transform(f"block_{k.name}", lambda blk, b: _run(blk, F.get(f"first_{k.name}", b))))


def _judged(k: Kind) -> Column:
    """The confirmed spans of one kind."""
    gap = F.col(f"gap_{k.name}")
    # Every block of places holds one more than matches, its beginning.
    start = lambda i: F.get(F.col(f"place_{k.name}"), i + F.floor(i / STRETCH).cast("int")) + F.length(F.get(gap, i))
    beside = lambda m, i: F.struct(m.alias("m"), i.alias("i"), F.right(F.get(gap, i), F.lit(1)).alias("c"), F.left(F.get(gap, i + 1), F.lit(1)).alias("d"))
    sound = F.filter(F.transform(f"match_{k.name}", beside), k.check)

    def scored(x: Column) -> Column:
        before, after = F.right(F.get(gap, x["i"]), F.lit(BEFORE)), F.left(F.get(gap, x["i"] + 1), F.lit(AFTER))
        said = lambda words: _says(before, words) | _says(after, words)
        score = F.lit(k.base) + F.when(said(k.good), RAISE).otherwise(0) - F.when(said(k.bad), LOWER).otherwise(0)
        at = start(x["i"])
        return F.struct(F.lit(k.name).alias("kind"), at.alias("start"), (at + F.length(x["m"])).alias("end"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"))

    spans = F.transform(sound, scored)
    return spans if k.name in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end, score) by kind as listed, then start."""
    own = docs.drop("spans")
    rows = own.select(F.struct(*own.columns).alias("whole"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    rows = rows.select("whole", "t", F.col("t").rlike("[@0-9]").alias("any"))
    found = lambda k: F.when(F.col("any") & k.hint(F.col("t")), F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).otherwise(none)
    rows = rows.select("whole", "t", _once(**{f"match_{k.name}": found(k) for k in KINDS}))
    gaps = {f"gap_{k.name}": F.when(F.size(f"match_{k.name}") > 0, F.split("t", k.pattern, -1)).otherwise(none) for k in KINDS}
    rows = rows.select("whole", *[f"match_{k.name}" for k in KINDS], _once(**gaps))
    for name, step in (("step", _steps), ("block", _blocks), ("first", _firsts), ("place", _places)):
        rows = rows.select("*", _once(**{f"{name}_{k.name}": step(k) for k in KINDS}))
    return rows.select("whole.*", F.concat(*[_judged(k) for k in KINDS]).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """Per document the counts and the digest of the base spans, and all spans as text."""
    found = find_spans(docs)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
