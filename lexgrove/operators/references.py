"""Cross-references: extraction, resolution into edges, listings, backfill."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.operators.observed import Counts, rows
from lexgrove.scale import dimension_join, salted_lookup, top_per_group
from lexgrove.session import cut_lineage

EXTRACTOR = "regex-v1"
# Reference patterns as (type, pattern, group that is the match, confidence).
PATTERNS = [
    ("internal_section", r"§\s*(\d+(?:\.\d+)*)", 0, 1.0),
    ("internal_section", r"\b[Ss]ections?\s+(\d+(?:\.\d+)*)", 0, 1.0),
    ("internal_section", r"\b[Ss]ub[-\s]?sections?\s+(\d+(?:\.\d+)*)", 0, 1.0),
    (
        "cross_policy",
        r"\b(?i:per|pursuant to|under|in accordance with|see|refer to)\s+(?i:the\s+)?"
        r"([A-Z][A-Za-z0-9&\-]*(?:\s+[A-Z][A-Za-z0-9&\-]*)*\s+(?:Policy|SOP|Procedure|Guideline|Standard))",
        1,
        1.0,
    ),
    ("external_authority", r"https?://[^\s)\]\>]+", 0, 1.0),
    ("external_authority", r"\b\d+\s+CFR\s+§?\s*\d+(?:\.\d+)*\b", 0, 1.0),
    ("external_authority", r"\b\d+\s+U\.?S\.?C\.?\s+§?\s*\d+(?:\.\d+)*\b", 0, 1.0),
    ("external_authority", r"\b(HIPAA|GDPR|SOX|PCI[-\s]?DSS|HITECH|CCPA)\b", 0, 0.85),
]
# Words that do not count when policy names are compared.
NAME_STOP = ["the", "a", "an", "of", "and", "policy", "sop", "procedure", "guideline", "standard"]
NAME_THRESHOLD = 0.6

REFERENCE = T.ArrayType(
    T.StructType()
    .add("reference_type", T.StringType())
    .add("matched_text", T.StringType())
    .add("match_offset", T.IntegerType())
    .add("parsed_section_path", T.StringType())
    .add("external_uri", T.StringType())
    .add("external_label", T.StringType())
    .add("confidence", T.DoubleType())
)


@F.udf(REFERENCE, useArrow=False)
def find_references(text: str | None) -> list[tuple]:
    """All matches with their offsets; built-in functions give no offsets beyond the first match.

    Plain rows, of which a worker holds a hundred at a time: an Arrow batch holds thousands of whole texts and their matches.
    """
    found = {}
    for kind, pattern, group, conf in PATTERNS:
        for m in re.finditer(pattern, text or ""):  # compiled patterns are kept by ``re``
            matched, uri, label, path = m.group(group).strip() if group else m.group(0), None, None, None
            if kind == "internal_section":
                path = m.group(1)
            elif kind == "external_authority":
                if matched.startswith("http"):
                    matched = uri = matched.rstrip(".,;")
                label = matched
            found.setdefault((m.start(group), kind, matched), (kind, matched, m.start(group), path, uri, label, conf))
    return [found[key] for key in sorted(found, key=lambda k: k[:2])]


def extract_refs(sections: DataFrame) -> DataFrame:
    """One row per reference found in the section texts."""
    ids = [c for c in ("tenant_id", "policy_id", "policy_version_id", "section_id") if c in sections.columns]
    found = sections.select(*ids, F.explode(find_references("text")).alias("r"))
    return found.select(*ids, "r.*", F.lit(EXTRACTOR).alias("extractor_version"))


def section_keys(sections: DataFrame) -> DataFrame:
    """Ways to name a section inside its version: one best section per (version, key).

    Tier 1 is the exact path, tier 2 a dotted number that stands alone in the path. Both are keys
    here, so the match is an equi-join and never pairs all references with all sections.
    """
    numbers = F.regexp_extract_all("section_path", F.lit(r"(?:^|[\s-])(\d+(?:\.\d+)*)(?=$|[^\d.])"), F.lit(1))
    keys = F.concat(
        F.array(F.struct(F.lit(1).alias("tier"), F.col("section_path").alias("key"))),
        F.transform(F.array_distinct(numbers), lambda n: F.struct(F.lit(2).alias("tier"), n.alias("key"))),
    )
    flat = sections.where(F.col("section_path").isNotNull()).select(
        "policy_version_id", "section_id", "section_index", F.explode(keys).alias("k")
    )
    best = F.min(F.struct("k.tier", "section_index", "section_id")).alias("t")
    return flat.groupBy("policy_version_id", F.col("k.key").alias("key")).agg(best).select(
        "policy_version_id", "key", F.col("t.section_id").alias("by_path")
    )


def resolve_internal(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """Add ``target_section_id``: exact path, then number within a path, then section index."""
    by_index = sections.groupBy("policy_version_id", F.col("section_index").cast("long").alias("idx")).agg(
        F.min("section_id").alias("by_index")
    )
    path = F.col("parsed_section_path")
    r = refs.withColumn("key", path).withColumn("idx", F.when(path.rlike(r"^\d+$"), path.try_cast("long")))
    r = r.join(section_keys(sections), ["policy_version_id", "key"], "left")
    r = r.join(by_index, ["policy_version_id", "idx"], "left")
    return r.withColumn("target_section_id", F.coalesce("by_path", "by_index")).drop("key", "idx", "by_path", "by_index")


def name_tokens(name: Column) -> Column:
    words = F.transform(F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(NAME_STOP)))


def token_overlap(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def name_score(a: Column, b: Column) -> Column:
    """Shared words over the larger word set; zero when either side has none."""
    return token_overlap(name_tokens(a), name_tokens(b))


def match_names(names: DataFrame, policies: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Best policy per (tenant_id, matched_text) with score >= threshold; the first policy wins ties.

    Two word sets that reach the threshold share at least ceil(threshold * size) words, so they also
    share one of the (size - that + 1) rarest words of either set. Only those words are joined:
    words that most policy names contain never meet each other, and no match is lost.
    """
    order = "policy_order" if "policy_order" in policies.columns else "policy_id"
    p = policies.select("tenant_id", F.col("policy_id").alias("target_policy_id"), F.col(order).alias("ord"), name_tokens(F.col("name")).alias("p_words"))
    q = names.select("tenant_id", "matched_text").distinct().withColumn("q_words", name_tokens(F.col("matched_text")))
    seen = p.select("tenant_id", F.explode("p_words").alias("word")).groupBy("tenant_id", "word").agg(F.count(F.lit(1)).alias("df"))

    def rare(df: DataFrame, key: list[str], words: str) -> DataFrame:
        flat = df.select(*key, F.size(words).alias("n"), F.explode(words).alias("word"))
        flat = dimension_join(flat, seen, ["tenant_id", "word"], key[-1], "left")
        sets = flat.groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("s"))
        need = F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int")
        kept = F.slice("s", F.lit(1), F.greatest(F.lit(1), F.col("n") - need + 1))
        return sets.select(*key, F.explode(kept).alias("t")).select(*key, F.col("t.word").alias("word"))

    asked = rare(q, ["tenant_id", "matched_text"], "q_words")
    offered = rare(p, ["tenant_id", "target_policy_id"], "p_words")
    pairs = asked.join(offered, ["tenant_id", "word"]).select("tenant_id", "matched_text", "target_policy_id").distinct()
    scored = (
        pairs.join(q, ["tenant_id", "matched_text"])
        .join(p, ["tenant_id", "target_policy_id"])
        .withColumn("name_score", token_overlap(F.col("q_words"), F.col("p_words")))
        .where(F.col("name_score") >= threshold)
    )
    best = top_per_group(scored, ["tenant_id", "matched_text"], [F.col("name_score").desc(), F.col("ord"), F.col("target_policy_id")], 1)
    return best.select("tenant_id", "matched_text", "target_policy_id", "name_score")


def reference_edges(sections: DataFrame, policies: DataFrame, refs: DataFrame | None = None, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Extract and resolve all references; references to the own section or policy are dropped."""
    # Texts are searched once; the slim rows feed three ways of resolution.
    refs = cut_lineage(extract_refs(sections) if refs is None else refs)
    inner = resolve_internal(refs.where(F.col("reference_type") == "internal_section"), sections)
    inner = inner.where(~F.col("target_section_id").eqNullSafe(F.col("section_id"))).withColumn(
        "target_policy_id", F.when(F.col("target_section_id").isNotNull(), F.col("policy_id"))
    )
    named = refs.where(F.col("reference_type") == "cross_policy")
    # One name may be cited by a third of all references.
    matches = cut_lineage(match_names(named, policies, threshold))
    cross = dimension_join(named, matches, ["tenant_id", "matched_text"], "section_id", "left")
    cross = cross.where(~F.col("target_policy_id").eqNullSafe(F.col("policy_id")))
    outer = refs.where(F.col("reference_type") == "external_authority")
    none = F.lit(None).cast("string")
    parts = [
        inner.select(*_edge(F.col("target_section_id"), F.col("target_policy_id"), _resolved("target_section_id"), none, none)),
        cross.select(*_edge(none, F.col("target_policy_id"), _resolved("target_policy_id"), none, none)),
        outer.select(*_edge(none, none, F.lit("external"), F.col("external_uri"), F.coalesce("external_label", "matched_text"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _resolved(target: str) -> Column:
    return F.when(F.col(target).isNotNull(), "resolved").otherwise("unresolved")


def _edge(section: Column, policy: Column, status: Column, uri: Column, label: Column) -> list[Column]:
    return [
        F.col("tenant_id"), F.col("section_id").alias("source_section_id"),
        F.col("policy_version_id").alias("source_policy_version_id"), F.col("reference_type"),
        status.alias("resolution_status"), F.col("matched_text"), F.col("match_offset"), F.col("extractor_version"),
        F.col("confidence"), section.alias("target_section_id"), policy.alias("target_policy_id"),
        uri.alias("target_external_uri"), label.alias("target_external_label"),
    ]


def hydrate_targets(edges: DataFrame, sections: DataFrame, policies: DataFrame) -> DataFrame:
    """Edge rows with title and path of the target section, name of the target policy, and a text."""
    s = sections.select(
        F.col("section_id").alias("target_section_id"), F.col("title").alias("target_section_title"),
        F.col("section_path").alias("target_section_path"),
    )
    p = policies.select(F.col("policy_id").alias("target_policy_id"), F.col("name").alias("target_policy_name"))
    cited = edges.groupBy("target_section_id").agg(F.count(F.lit(1)).alias("n")).join(s, "target_section_id")
    out = salted_lookup(edges, cited, ["target_section_id"], "source_section_id", "n").drop("n")
    out = dimension_join(out, p, ["target_policy_id"], "source_section_id", "left")
    head = F.concat(F.coalesce(F.concat(F.nullif("target_policy_name", F.lit("")), F.lit(" · ")), F.lit("")), F.coalesce("target_section_title", "target_section_path"))
    return out.withColumn(
        "target_text",
        F.coalesce(head, F.nullif("target_policy_name", F.lit("")), F.nullif("target_external_label", F.lit("")), "matched_text"),
    )


def outbound(edges: DataFrame, tenant_id: str, section_id: str) -> DataFrame:
    mine = edges.where((F.col("tenant_id") == tenant_id) & (F.col("source_section_id") == section_id))
    return mine.orderBy(F.col("match_offset").asc_nulls_first())


def inbound(edges: DataFrame, tenant_id: str, section_id: str) -> DataFrame:
    mine = edges.where((F.col("tenant_id") == tenant_id) & (F.col("target_section_id") == section_id))
    return mine.orderBy("created_at" if "created_at" in edges.columns else "source_section_id", "match_offset")


def listing(edges: DataFrame, tenant_id: str, section_id: str, direction: str = "outbound") -> DataFrame:
    return (outbound if direction == "outbound" else inbound)(edges, tenant_id, section_id)


def for_version(edges: DataFrame, tenant_id: str, version_id: str, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    mine = edges.where((F.col("tenant_id") == tenant_id) & (F.col("source_policy_version_id") == version_id))
    order = ["created_at"] if "created_at" in edges.columns else ["source_section_id", "match_offset"]
    return mine.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def backfill_references(
    sections: DataFrame, policies: DataFrame, processed: DataFrame, counts: Counts | None = None
) -> tuple[DataFrame, DataFrame]:
    """Edges of ready versions not processed before, and the markers to append with them.

    The marker table, not the presence of edges, says what is done: a version without references
    is processed once. ``counts`` learns, while the two are written, how many versions were ``scanned``,
    and how many references ``inserted``, of them ``resolved`` to a section or policy.
    """
    todo = sections.where(F.col("parse_status") == "ready").join(processed.select("policy_version_id"), "policy_version_id", "left_anti")
    edges, markers = reference_edges(todo, policies), todo.select("policy_version_id").distinct()
    if counts:
        edges = counts.at(edges, inserted=rows(), resolved=F.count_if(F.col("resolution_status") == "resolved"))
        markers = counts.at(markers, scanned=rows())
    return edges, markers


def backfill_counts(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """One row: versions scanned, versions with references, references inserted."""
    found = edges.agg(F.count(F.lit(1)).alias("inserted"), F.countDistinct("source_policy_version_id").alias("with_references"))
    return markers.agg(F.count(F.lit(1)).alias("scanned")).withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one").drop("one")
