"""Links of stored pages, relevance, manifest, page documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.ids import external_id
from lexgrove.functions.text import blank, non_blank, rstrip, strip
from lexgrove.functions.urls import (
    ANCHOR, DATA_LINK, HIDDEN, COMMENT, ONCLICK, ONCLICK_URL, PDF_URL, doc_type, drop_fragment, drop_query, last_segment,
    page_title, resolve_url, unescape, url_host, url_path, url_scheme,
)


@dataclass(frozen=True)
class LinkRules:
    """Which links belong to an agency: hosts, file suffixes and path parts, any of which may differ by agency.

    Hosts are given by the user, no host means any; further path parts of a site are added to ``path_parts``.
    """

    agency: str
    hosts: tuple[str, ...] = ()
    reference_hosts: tuple[str, ...] = ()
    include_references: bool = False
    # Fixed values of the crawl contract.
    blocked: tuple[str, ...] = ("javascript:", "mailto:", "tel:", "linkedin.com", "twitter.com", "google.com/chrome")
    blocked_path: tuple[str, ...] = ("policy-finder/google.com",)
    suffixes: tuple[str, ...] = (".pdf", ".doc", ".docx", ".html", ".htm")
    path_parts: tuple[str, ...] = ("/policies", "/policy-finder/", "policy")
    policy_type: str = "external_policy"


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_relevant(url: Column, rules: LinkRules) -> Column:
    """http(s) link of the agency that looks like a document or a policy page."""
    path, host, full = F.lower(url_path(url)), url_host(url), F.lower(url)
    usable = url_scheme(url).isin("http", "https") & (host != "")
    usable = usable & ~_any([full.contains(b) for b in rules.blocked]) & ~_any([path.contains(b) for b in rules.blocked_path])
    wanted = _any([path.endswith(s) for s in rules.suffixes] + [path.contains(p) for p in rules.path_parts])
    if rules.hosts:
        wanted = wanted & _any([host.contains(h) for h in rules.hosts])
    cited = _any([host.contains(h) for h in rules.reference_hosts])
    ok = usable & F.when(cited, F.lit(rules.include_references)).otherwise(wanted)
    return F.coalesce(ok, F.lit(False))


def is_policy_page(url: Column, host: str) -> Column:
    """Detail pages below a ``policies`` folder of the host."""
    return url.rlike(r"(?i)^https?://" + host.replace(".", r"\.") + r"/.+?/policies/.+")


def is_pdf_link(url: Column) -> Column:
    return url.rlike(PDF_URL)


def anchors(pages: DataFrame) -> DataFrame:
    """One row per anchor with a target: page columns, pos, href, anchor_text."""
    whole = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("html", COMMENT, " "), HIDDEN, " "), F.lit(ANCHOR), F.lit(0))
    a = pages.select(*(c for c in pages.columns if c != "html"), F.posexplode(whole).alias("pos", "_a"))
    target = F.coalesce(*(F.nullif(F.regexp_extract("_a", ANCHOR, i), F.lit("")) for i in (1, 2, 3)))
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("_a", ANCHOR, 4), r"<[^>]*>", " "), r"\s+", " ")
    a = a.select("*", strip(unescape(target)).alias("href"), strip(unescape(text)).alias("anchor_text")).drop("_a")
    return a.where(~blank(F.col("href")))


def page_links(pages: DataFrame) -> DataFrame:
    """Absolute links of every page without query and fragment, in page order."""
    return anchors(pages).withColumn("link", drop_query(resolve_url("url", "href")))


def all_links(pages: DataFrame) -> DataFrame:
    """Distinct links per page from anchors, data attributes and click handlers, without fragments."""
    page = F.regexp_replace("html", COMMENT, " ")
    shown = F.regexp_replace(page, HIDDEN, " ")
    hrefs = F.array_union(
        F.array_union(
            F.array_union(*(F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(i)) for i in (1, 2))),
            F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(3)),
        ),
        F.regexp_extract_all(page, F.lit(DATA_LINK), F.lit(1)),
    )
    clicks = F.concat(*(F.regexp_extract_all(page, F.lit(ONCLICK), F.lit(i)) for i in (1, 2)))
    urls = F.flatten(F.transform(clicks, lambda c: F.regexp_extract_all(c, F.lit(ONCLICK_URL), F.lit(0))))
    keys = [c for c in pages.columns if c != "html"]
    flat = pages.select(*keys, F.explode(F.array_union(F.array_distinct(hrefs), urls)).alias("href")).where(~blank(F.col("href")))
    return flat.select(*keys, drop_fragment(resolve_url("url", unescape("href"))).alias("link")).distinct()


def first_seen(links: DataFrame, order: list[str]) -> DataFrame:
    """First occurrence per link; an aggregate, so a link that every page carries stays cheap."""
    rest = [c for c in links.columns if c != "link" and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("t")
    return links.groupBy("link").agg(first).select("link", "t.*")


def link_manifest(pages: DataFrame, rules: LinkRules, max_docs: int | None = None) -> DataFrame:
    """Relevant links in discovery order with title, type and stable id."""
    found = page_links(pages).where(is_relevant(F.col("link"), rules)).select("link", "page_id", "pos", "anchor_text")
    first = first_seen(found, ["page_id", "pos"])
    title = F.coalesce(non_blank(F.col("anchor_text")), F.nullif(last_segment(url_path(F.col("link"))), F.lit("")), F.col("link"))
    m = first.select(
        F.col("link").alias("source_url"), title.alias("title"), doc_type(F.col("link")).alias("doc_type"),
        external_id(F.col("link"), title).alias("external_id"), F.lit(rules.policy_type).alias("suggested_policy_type"),
        F.lit(None).cast("date").alias("effective_date"), F.lit(rules.agency).alias("agency"), "page_id", "pos",
    )
    return m.orderBy("page_id", "pos").limit(max_docs) if max_docs and max_docs > 0 else m


def expand_links(manifest: DataFrame, pages: DataFrame, rules: LinkRules, follow: Column) -> DataFrame:
    """Open the manifest pages that match ``follow`` and add the links found there, first hop first."""
    to_open = manifest.where(follow).select(F.col("source_url").alias("_open")).distinct()
    opened = pages.withColumn("_open", drop_query(F.col("url"))).join(to_open, "_open", "left_semi").drop("_open")
    second = link_manifest(opened, rules).join(manifest.select("source_url"), "source_url", "left_anti")
    return manifest.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))


def expand_short_manifest(manifest: DataFrame, pages: DataFrame, rules: LinkRules, finder: str = "policy-finder", enough: int = 10) -> DataFrame:
    """Finder pages are opened only while fewer than ``enough`` links are known."""
    few = manifest.limit(enough).count() < enough
    test = F.col("source_url").contains(finder) & (F.col("doc_type") == "html") if few else F.lit(False)
    return expand_links(manifest, pages, rules, test)


def page_documents(pages: DataFrame) -> DataFrame:
    """Text document per page: TITLE / URL / PAGE TEXT / REFERENCES blocks, links sorted."""
    breaks = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", COMMENT, ""), HIDDEN, ""), r"<[^>]+>", "\n")
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(unescape(breaks), "\r\n?", "\n"), r"\n{3,}", "\n\n"), "\n"), rstrip)
    body = strip(F.array_join(lines, "\n"))
    base = pages.select("page_id", "url", unescape(page_title(F.col("html"), F.col("url"))).alias("title"), body.alias("page_text"))
    links = all_links(pages.select("page_id", "url", "html")).groupBy("page_id").agg(F.array_sort(F.collect_list("link")).alias("links"))
    d = base.join(links, "page_id", "left")
    content = F.concat_ws(
        "\n", F.concat(F.lit("TITLE: "), "title"), F.concat(F.lit("URL: "), "url"), F.lit(""), F.lit("===== PAGE TEXT ====="),
        "page_text", F.lit(""), F.lit("===== REFERENCES (ALL LINKS) ====="), F.array_join("links", "\n"),
    )
    return d.select("page_id", "url", "title", F.coalesce(F.size("links"), F.lit(0)).alias("n_links"), F.concat(strip(content), F.lit("\n")).alias("content"))
