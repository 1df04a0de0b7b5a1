"""Text cleaning, chunking, clipping and tokenising as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.strip() sees it.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Page markers, and hints of repeated headers and footers.
PAGE_MARKER = r"(?iU)^\s*(pdf\s*page|page\s+\d+\s*(of\s*\d+)?)\b"
HEADER_HINT = r"(?i)(copyright|all rights reserved|confidential|department of|policy platform)"
HEADER_MAX = 80
CHUNK_SIZE = 4000
TOKEN = r"[\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) == 0


def non_blank(c: Column) -> Column:
    """The stripped value, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def strip_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\0"), F.lit(""))


def one_line(c: Column) -> Column:
    return F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))


def clip(c: Column, size: int, tail: str) -> Column:
    """First ``size`` characters on one line, with ``tail`` only where something was cut."""
    return let(
        one_line(c),
        lambda t: F.when(F.length(t) <= size, t).otherwise(F.concat(rstrip(F.substring(t, 1, size)), F.lit(tail))),
    )


def snippet(c: Column, size: int = 280) -> Column:
    return clip(c, size, "...")


def excerpt(c: Column, size: int = 600) -> Column:
    return clip(c, size, "…")


def text_lines(c: Column) -> Column:
    """Unify line ends, strip the text and each line, and drop page-marker lines."""
    unified = strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"))
    return F.filter(F.transform(F.split(unified, "\n"), strip), lambda line: ~line.rlike(PAGE_MARKER))


def first_headers(lines: Column) -> Column:
    """Keep only the first copy of every short header or footer line."""

    def key(line: Column) -> Column:
        return F.when((F.length(line) <= HEADER_MAX) & line.rlike(HEADER_HINT), F.lower(line))

    def keep(ls: Column, keys: Column) -> Column:
        return F.filter(
            ls, lambda _, i: F.get(keys, i).isNull() | (F.array_position(keys, F.get(keys, i)) == i + 1)
        )

    return let(
        lines,
        lambda ls: let(
            F.transform(ls, key),
            lambda keys: F.when(F.exists(keys, lambda k: k.isNotNull()), keep(ls, keys)).otherwise(ls),
        ),
    )


def drop_repeats(lines: Column) -> Column:
    """Drop a line equal to the last non-empty line before it; empty lines stay and do not reset."""

    def rebuilt(numbered: Column, filled: Column) -> Column:
        empty = F.filter(numbered, lambda e: e["line"] == "")
        fresh = F.filter(filled, lambda e, j: (j == 0) | (F.get(filled, j - 1)["line"] != e["line"]))
        return F.transform(F.array_sort(F.concat(empty, fresh)), lambda e: e["line"])

    return let(
        F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line"))),
        lambda numbered: let(
            F.filter(numbered, lambda e: e["line"] != ""), lambda filled: rebuilt(numbered, filled)
        ),
    )


def clean_text(c: Column) -> Column:
    merged = F.array_join(drop_repeats(first_headers(text_lines(c))), "\n")
    squeezed = F.regexp_replace(merged, r"[ \t]+", " ")
    return strip(F.regexp_replace(squeezed, r"\n{3,}", "\n\n"))


def chunks(clean: Column, size: int = CHUNK_SIZE) -> Column:
    """Fixed-size pieces as array<struct<section_path,title,start_offset,end_offset,text>>."""

    def cut(text: Column) -> Column:
        n = F.length(text)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
        return F.transform(
            starts,
            lambda at, i: F.struct(
                F.when(n == 0, "main").otherwise(F.concat(F.lit("chunk-"), (i + 1).cast("string"))).alias("section_path"),
                F.when(n == 0, "Main").otherwise(F.concat(F.lit("Chunk "), (i + 1).cast("string"))).alias("title"),
                at.alias("start_offset"),
                F.least(n, at + size).alias("end_offset"),
                F.substring(text, at + 1, F.lit(size)).alias("text"),
            ),
        )

    return let(clean, cut)


def tokens(c: Column) -> Column:
    """Lower-case letter and digit runs in reading order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
