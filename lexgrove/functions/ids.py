"""Hashes, deterministic ids, labels and storage paths."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.functions.text import non_blank, strip

UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def section_key(path: Column) -> Column:
    return F.substring(sha256_hex(F.coalesce(path, F.lit(""))), 1, 16)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 name-based id, JVM-side."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID_PATTERN), F.lit(False))


def external_id(url: Column, title: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    prefix = F.when(slug == "", "document").otherwise(F.substring(slug, 1, 48))
    return F.concat(prefix, F.lit("-"), F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 12))


def _loaded(text):
    """(whether ``text`` is JSON, its value)."""
    if text is None:
        return True, {}
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, UTF-8; null counts as an empty object; null where the text is no JSON."""

    def one(text):
        good, value = _loaded(text)
        return None if not good else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return raw.map(one, na_action=None)


@F.pandas_udf(T.StringType())
def metadata_hash(raw: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form, with the first filled URL key copied to ``source_url``; null where there is no JSON object."""

    def one(text):
        _, value = _loaded(text)
        if not isinstance(value, dict):
            return None
        source = value.get("source_url") or value.get("public_url") or value.get("url")
        if source:
            value["source_url"] = str(source)
        canonical = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(canonical.encode("utf-8")).hexdigest()

    return raw.map(one, na_action=None)


def public_url(metadata: Column) -> Column:
    """First of the three URL keys that is present."""
    return F.coalesce(*(F.get_json_object(metadata, f"$.{k}") for k in ("source_url", "public_url", "url")))


def source_url(metadata: Column) -> Column:
    """As ``public_url``, but an empty value falls through to the next key."""
    return F.coalesce(*(F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in ("source_url", "public_url", "url")))


def dated_label(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit("v1"))


def stamped_label(stamp: str, sha: Column) -> Column:
    return F.concat(F.lit(f"v1-{stamp}-"), F.substring(sha, 1, 8))


def extracted_path(tenant: Column, policy: Column, version: Column) -> Column:
    return F.format_string("tenants/%s/policies/%s/versions/%s/extracted.json", tenant, policy, version)


def crawl_blob_path(agency: Column, external: Column, sha: Column, content_type: Column, doc_type: Column) -> Column:
    pdf = F.lower(content_type).contains("pdf") | (doc_type == "pdf")
    ext = F.when(pdf, ".pdf").otherwise(".html")
    return F.concat(F.lit("external/"), F.lower(agency), F.lit("/"), external, F.lit("/"), F.substring(sha, 1, 12), ext)


def upload_blob_path(tenant: Column, stamp: str, token: Column, name: Column) -> Column:
    clean = F.replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("uploaded.bin")), F.lit(" "), F.lit("-"))
    return F.concat(F.lit("uploads/"), tenant, F.lit(f"/{stamp}-"), F.substring(token, 1, 8), F.lit("-"), clean)


def crawled_blob_path(tenant: Column, stamp: str, token: Column, name: Column) -> Column:
    clean = F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "-")
    return F.concat(F.lit("crawled/"), tenant, F.lit(f"/{stamp}-"), F.substring(token, 1, 8), F.lit("-"), clean)


def relative_path(path: Column) -> Column:
    """Storage path without leading slashes; null when nothing is left."""
    return F.nullif(F.regexp_replace(strip(path), "^/+", ""), F.lit(""))


def blob_uri(base: str, container: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), container, relative_path(path))


def safe_filename(name: Column, size: int = 120) -> Column:
    return F.substring(F.regexp_replace(strip(name), "[^a-zA-Z0-9._-]+", "_"), 1, size)


def department(c: Column) -> Column:
    """Lower-case department, ``all`` when missing."""
    return F.coalesce(non_blank(F.lower(c)), F.lit("all"))
