"""URLs, files and page source as Column expressions."""

from __future__ import annotations

import html as html_lib
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.functions.text import let, non_blank, strip

# Link patterns.
PDF_URL = r"(?i)\.pdf(\?.*)?$"
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))[^>]*>(.*?)(?=</a\s*>|<a\s|$)"
DATA_LINK = r"(?is)<[a-z][^>]*?\sdata-(?:href|url|link)\s*=\s*[\"']([^\"']+)[\"']"
ONCLICK = r"(?is)<[a-z][^>]*?\sonclick\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
ONCLICK_URL = r"https?://[^\s\"']+"
HIDDEN = r"(?is)<(script|style|noscript)\b.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"


@F.pandas_udf(T.StringType())
def unescape(c: pd.Series) -> pd.Series:
    return c.map(html_lib.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute URL of a link on a page."""

    def one(b, h):
        if b is None or h is None:
            return None
        try:
            return urljoin(b, h.strip())
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def drop_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; brackets of IPv6 literals removed."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(
        F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_replace(bare, r":\d*$", "")
        )
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def doc_type(url: Column) -> Column:
    return F.when(F.lower(url_path(url)).endswith(".pdf"), "pdf").otherwise("html")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of_type(content_type: Column) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(ct.contains("pdf"), ".pdf")
        .when(ct.contains("wordprocessingml"), ".docx")
        .when(ct.contains("html"), ".html")
        .when(ct.contains("markdown"), ".md")
        .when(ct.contains("text/plain"), ".txt")
        .otherwise(".bin")
    )


def filename_of_url(url: Column, content_type: Column) -> Column:
    path = F.regexp_replace(url_path(url), "/+$", "")
    base = F.when(path == "", "document").otherwise(last_segment(path))
    return F.when(base.contains("."), base).otherwise(F.concat(base, extension_of_type(content_type)))


def content_type_of_file(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return (
        F.when(ext == ".pdf", "application/pdf")
        .when(ext == ".txt", "text/plain")
        .when(ext.isin(".htm", ".html"), "text/html")
        .when(ext == ".md", "text/markdown")
        .when(ext == ".csv", "text/csv")
        .when(ext == ".json", "application/json")
        .when(ext == ".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .otherwise("application/octet-stream")
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]*$", "")


def title_of_file(path: Column) -> Column:
    """Words of the stem; every letter run starts upper-case, as after digits and apostrophes."""
    words = F.btrim(F.translate(stem(path), "_-", "  "))
    runs = F.regexp_extract_all(words, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def date_of_file(path: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(last_segment(path), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def slug(c: Column) -> Column:
    """Comparable form of a file stem or URL tail."""
    raw = strip(F.coalesce(c, F.lit("")))
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    text = F.regexp_replace(decoded, "(?i)_28|_29|_2b|_20", "-")
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def visible_html(page: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(page, COMMENT, " "), HIDDEN, " ")


def strip_tags(page: Column) -> Column:
    """Readable text of page source, entities still escaped."""
    text = F.regexp_replace(visible_html(page), r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</p\s*>", "\n\n")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def squeeze_blank(text: Column) -> Column:
    text = F.replace(text, F.lit("\r"), F.lit(""))
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def html_to_text(page: Column) -> Column:
    return squeeze_blank(unescape(strip_tags(page)))


def page_title(page: Column, url: Column) -> Column:
    raw = F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")
    return F.coalesce(non_blank(raw), url)


def looks_like_html(prefix: Column) -> Column:
    """Page markup in the first 1024 bytes of a file."""
    head = F.lower(strip(F.substring(prefix, 1, 1024)))
    return head.startswith("<!doctype html") | head.startswith("<html") | head.contains("<body")


def _ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    byte = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    valid = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.greatest(*byte).between(0, 255)
    return F.when(valid, byte[0] * 16777216 + byte[1] * 65536 + byte[2] * 256 + byte[3])


# IPv4 ranges that are not publicly routable, as (network, prefix length, reason).
BLOCKED_V4 = [
    ("127.0.0.0", 8, "loopback"),
    ("169.254.0.0", 16, "link_local"),
    ("0.0.0.0", 8, "private"),
    ("10.0.0.0", 8, "private"),
    ("172.16.0.0", 12, "private"),
    ("192.0.0.0", 29, "private"),
    ("192.0.0.170", 31, "private"),
    ("192.0.2.0", 24, "private"),
    ("192.168.0.0", 16, "private"),
    ("198.18.0.0", 15, "private"),
    ("198.51.100.0", 24, "private"),
    ("203.0.113.0", 24, "private"),
    ("240.0.0.0", 4, "reserved"),
    ("224.0.0.0", 4, "multicast"),
]


def _blocked_range(number: Column) -> Column:
    ranges = []
    for network, bits, name in BLOCKED_V4:
        a, b, c, d = (int(x) for x in network.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        ranges.append(F.struct(F.lit(low).cast("long").alias("low"), F.lit(low + (1 << (32 - bits)) - 1).cast("long").alias("high"), F.lit(name).alias("name")))
    return let(number, lambda n: F.get(F.filter(F.array(*ranges), lambda r: n.between(r["low"], r["high"])), F.lit(0))["name"])


def _blocked_v6(host: Column) -> Column:
    return (
        F.when(host.isin("::1", "0:0:0:0:0:0:0:1"), "loopback")
        .when(host == "::", "private")
        .when(host.rlike("^(64:ff9b:0*1:|64:ff9b:1:|0*100:0*:0*:0*:|0*100::|2001:0*db8:|2001:0*[0-1]?[0-9a-f]{0,2}:|2001::|2002:|3fff:|5f00:)"), "private")
        .when(host.rlike("^(0*[1-9a-f][0-9a-f]?:|[4-9a-e][0-9a-f]{3}:|fe[0-7][0-9a-f]:)") & host.contains(":"), "reserved")
        .when(host.rlike("^fe[89ab][0-9a-f]?:"), "link_local")
        .when(host.rlike("^f[cd][0-9a-f]*:"), "private")
        .when(host.rlike("^ff[0-9a-f]*:"), "multicast")
    )


def url_rejection(url: Column) -> Column:
    """Why a URL may not be fetched; null when its scheme and literal host are fine."""

    def of_host(host: Column) -> Column:
        mapped = F.regexp_extract(host, r"^(?:0*:)*:?ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
        number = _ipv4_number(F.coalesce(F.nullif(mapped, F.lit("")), host))
        return F.when(host == "", "host").otherwise(F.coalesce(_blocked_range(number), _blocked_v6(host)))

    return F.when(~url_scheme(url).isin("http", "https"), "scheme").otherwise(let(url_host(url), of_host))
