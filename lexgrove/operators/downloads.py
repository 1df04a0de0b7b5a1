"""Classification of fetched files, resume state, file plans and slug matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.ids import crawl_blob_path, sha256_hex, stamped_label
from lexgrove.functions.text import blank, non_blank
from lexgrove.functions.urls import (
    content_type_of_file, date_of_file, last_segment, looks_like_html, slug, stem, title_of_file,
)


def classify_downloads(manifest: DataFrame, files: DataFrame, index: DataFrame, max_bytes: int) -> DataFrame:
    """Status per manifest entry: cached_unchanged, missing, too_large, unexpected_html_for_pdf, ok.

    files: source_url, content, content_type. index: source_url, current_sha256, current_path.
    """
    f = files.select(
        "source_url", F.length("content").cast("long").alias("content_length"), F.lower("content_type").alias("content_type"),
        sha256_hex(F.col("content")).alias("sha256"), looks_like_html(F.col("content").cast("string")).alias("is_html"), F.lit(True).alias("fetched"),
    )
    i = index.select("source_url", F.col("current_sha256").alias("cached_sha"), F.col("current_path").alias("cached_path"))
    d = manifest.join(i, "source_url", "left").join(f, "source_url", "left")
    cached = F.col("cached_sha").isNotNull() & F.col("cached_path").isNotNull()
    html = F.col("is_html") | F.col("content_type").contains("html")
    status = (
        F.when(cached, "cached_unchanged")
        .when(F.col("fetched").isNull(), "missing")
        .when(F.col("content_length") > max_bytes, "too_large")
        .when((F.col("doc_type") == "pdf") & html, "unexpected_html_for_pdf")
        .otherwise("ok")
    )
    d = d.withColumn("status", status).withColumn("skipped", ~F.col("status").isin("cached_unchanged", "ok"))
    d = d.withColumn("sha256", F.when(cached, F.col("cached_sha")).when(F.col("status") == "ok", F.col("sha256")))
    return d.drop("is_html", "fetched", "cached_sha", "cached_path")


def merge_index(index: DataFrame, downloads: DataFrame) -> DataFrame:
    """New download index: current sha and path per URL, and the history of all shas."""
    path = crawl_blob_path(F.col("agency"), F.col("external_id"), F.col("sha256"), F.col("content_type"), F.col("doc_type"))
    fresh = downloads.where(F.col("status") == "ok").select(
        "source_url", F.col("sha256").alias("new_sha"), path.alias("new_path"),
        F.create_map("sha256", path).alias("new_map"),
    )
    both = index.join(fresh, "source_url", "full_outer")
    empty = F.create_map().cast("map<string,string>")
    old = F.map_filter(F.coalesce("sha_to_path", empty), lambda k, _: ~k.eqNullSafe(F.col("new_sha")))
    return both.select(
        "source_url", F.coalesce("new_sha", "current_sha256").alias("current_sha256"),
        F.coalesce("new_path", "current_path").alias("current_path"),
        F.map_concat(old, F.coalesce("new_map", empty)).alias("sha_to_path"),
    )


def resume_state(downloads: DataFrame, state: DataFrame) -> DataFrame:
    """What is left to register: skipped, resumed-skip (registered or in conflict before), pending.

    state: state_key (external_id:sha256), prior_status, blob_path, policy_version_id.
    """
    d = downloads.withColumn("state_key", F.concat_ws(":", "external_id", "sha256")).join(state, "state_key", "left")
    done = F.coalesce(F.col("prior_status").isin("registered", "conflict"), F.lit(False))
    outcome = F.when(F.col("skipped"), "skipped").when(done, "resumed-skip").otherwise("pending")
    detail = F.when(F.col("skipped"), F.col("status")).when(done, F.concat(F.lit("prior_status="), "prior_status"))
    return d.withColumn("resume", outcome).withColumn("detail", detail)


def register_outcome(resumed: DataFrame, registered: DataFrame, rejects: DataFrame) -> DataFrame:
    """Final status per document after registration of the pending ones (keyed by external_id)."""
    won = registered.select("external_id", F.col("policy_version_id").alias("won_id"))
    lost = rejects.select("external_id", "reason")
    r = resumed.join(won, "external_id", "left").join(lost, "external_id", "left")
    conflict = F.col("reason").isin("duplicate", "label_conflict", "conflict")
    status = F.when(F.col("resume") != "pending", F.col("resume")).when(F.col("won_id").isNotNull(), "registered").when(conflict, "conflict")
    return r.withColumn("register_status", status.otherwise("failed"))


def first_per_slug(links: DataFrame, url: str = "url", order: str = "pos") -> DataFrame:
    """First URL per normalised tail of the URL."""
    s = links.where(~blank(F.col(url))).withColumn("slug", slug(last_segment(F.trim(url)))).where(F.col("slug") != "")
    first = F.min(F.struct(F.col(order).alias("pos"), F.trim(url).alias("url"))).alias("t")
    return s.groupBy("slug").agg(first).select("slug", "t.pos", "t.url")


# Slugs are tied to each other through their rarest three-letter pieces; shorter ones are few and
# are matched through all pieces of their own length.
GRAM = 3


def _grams(c: Column, n: int) -> Column:
    last = F.length(c) - n
    return F.array_distinct(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i + 1, n))).otherwise(F.array().cast("array<string>")))


def match_slugs(files: DataFrame, links: DataFrame, path: str = "path") -> DataFrame:
    """URL per file: same slug first, else the first link whose slug contains or is contained.

    Containment is found through shared pieces: the shorter slug looks up one of its own pieces of
    each length class (its rarest), so no file is paired with every link.
    """
    table = first_per_slug(links)
    base = slug(F.element_at(F.split(stem(F.col(path)), "__"), 1))
    f = files.withColumn("file_slug", base)
    exact = f.join(table.select(F.col("slug").alias("file_slug"), F.col("url").alias("exact_url")), "file_slug", "left")
    left = exact.where(F.col("exact_url").isNull()).select("file_slug").distinct()
    best = _containing(left, table)
    out = exact.join(best, "file_slug", "left").withColumn("source_url", F.coalesce("exact_url", "near_url"))
    return out.drop("exact_url", "near_url")


def _containing(names: DataFrame, table: DataFrame) -> DataFrame:
    """First link per name where one slug contains the other (both directions), by rarest piece."""
    t = table.select("slug", "pos", "url")
    n = names.select("file_slug")
    parts = []
    for short, long, a, b in ((n, t, "file_slug", "slug"), (t, n, "slug", "file_slug")):
        for size in range(1, GRAM + 1):
            exactly = F.length(a) == size if size < GRAM else F.length(a) >= size
            small = short.where(exactly)
            pieces = long.select("*", F.explode(_grams(F.col(b), size)).alias("gram"))
            weight = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
            own = small.select("*", F.explode(_grams(F.col(a), size)).alias("gram")).join(weight, "gram", "left")
            rarest = own.groupBy(*small.columns).agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("m"))
            rarest = rarest.select(*small.columns, F.col("m.gram").alias("gram"))
            parts.append(rarest.join(pieces, "gram").where(F.col(b).contains(F.col(a))).select("file_slug", "pos", "url"))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    # An empty slug is contained in every link: the first link of all is its match.
    first = table.agg(F.min(F.struct("pos", "url")).alias("t"))
    empty = n.where(F.col("file_slug") == "").withColumn("k", F.lit(1)).join(first.withColumn("k", F.lit(1)), "k").select("file_slug", "t.pos", "t.url")
    near = near.unionByName(empty)
    return near.groupBy("file_slug").agg(F.min_by("url", "pos").alias("near_url"))


def plan_files(files: DataFrame, root: str, source_system: str, agency: str, stamp: str, defaults: dict[str, str], blob_prefix: str = "", links: DataFrame | None = None) -> DataFrame:
    """Registration plan per scanned file (path, length, content; source_url where a sidecar gave one)."""
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    f = files.withColumn("source_file", rel)
    if links is not None:
        matched = match_slugs(f.drop("source_url"), links).select("path", F.col("source_url").alias("_link"))
        f = f.join(matched, "path", "left")
    sidecar = F.col("source_url") if "source_url" in files.columns else F.lit(None).cast("string")
    link = F.col("_link") if links is not None else F.lit(None).cast("string")
    sha = sha256_hex(F.col("content"))
    external = F.concat(F.lit(f"{source_system}-{agency.lower()}-"), F.substring(F.sha1(F.encode(F.regexp_replace("source_file", r"(?<=[^/])\.[^./]*$", ""), "UTF-8")), 1, 12))
    prefix = blob_prefix.strip() or f"external/{agency.lower()}/"
    prefix = prefix if prefix.endswith("/") else prefix + "/"
    meta = {"source_system": F.lit(source_system), "agency": F.lit(agency), "policy_source_type": F.lit("external"), **{k: F.lit(v) for k, v in defaults.items()}}
    p = f.select(
        "path", "source_file", external.alias("policy_external_id"), title_of_file(F.col("path")).alias("policy_name"),
        date_of_file(F.col("path")).alias("effective_date"), content_type_of_file(F.col("path")).alias("content_type"),
        sha.alias("file_sha256"), stamped_label(stamp, sha).alias("version_label"),
        F.coalesce(non_blank(sidecar), link).alias("source_url"),
    )
    p = p.withColumn("blob_path", F.concat(F.lit(prefix), "policy_external_id", F.lit(f"/{stamp}-"), last_segment(F.col("path"))))
    body = F.struct(*(v.alias(k) for k, v in meta.items()), "source_file", "file_sha256", "content_type", "source_url")
    return p.withColumn("metadata_json", F.to_json(body))


def with_default_keys(metadata: Column, defaults: dict[str, Column]) -> Column:
    """JSON object with missing keys filled in; present keys stay as they are."""
    given = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), v)))
    return F.to_json(F.map_concat(F.map_filter(extra, lambda k, _: ~F.map_contains_key(given, k)), given))


def missing_files(expected: DataFrame, files: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    return expected.join(files.select(*keys), list(keys), "left_anti")


