"""Nested control catalogs flattened to policies, sections and embedding rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.ids import sha256_hex, uuid5
from lexgrove.functions.text import blank, let, rstrip, strip
from lexgrove.scale import bucketed_scan
from lexgrove.session import cut_lineage

# Fixed value: name space of catalog ids.
CATALOG_SPACE = "11111111-2222-3333-4444-555555555555"
# Part names that are not rendered, the parameter placeholder, texts put in its place.
SKIPPED_PARTS = ["assessment-objective", "assessment-method", "objective"]
PLACEHOLDER = r"\{\{\s*insert:\s*param,\s*([^}\s]+)\s*\}\}"
UNKNOWN_PARAM = "[organization-defined parameter]"
UNNAMED_PARAM = "[Assignment: organization-defined parameter]"
FAMILY_SLICE = 10_000

NODE = (
    "struct<id:string,title:string,name:string,prose:string,props:array<struct<name:string,value:string,class:string>>,"
    "params:array<struct<id:string,label:string,values:array<string>,select:struct<`how-many`:string,choice:array<string>>>>,"
    "parts:array<variant>,controls:array<variant>>"
)
CATALOG = "struct<catalog:struct<groups:array<struct<id:string,title:string,controls:array<variant>>>>>"


def top_controls(catalog: DataFrame) -> DataFrame:
    """One row per group and top-level control: family, family_title, at, raw."""
    groups = catalog.select(F.explode(F.from_json("json", CATALOG)["catalog"]["groups"]).alias("g"))
    flat = groups.select(F.upper("g.id").alias("family"), F.col("g.title").alias("family_title"), F.posexplode("g.controls").alias("i", "c"))
    return flat.select("family", "family_title", F.array(F.col("i").cast("long")).alias("at"), F.to_json("c").alias("raw"))


def descend(top: DataFrame, children: str, at: str = "at", skip: list[str] | None = None) -> DataFrame:
    """All nodes of a tree level by level; ``at`` is the path of positions, so it sorts in tree order."""
    keys = [c for c in top.columns if c not in (at, "raw")]
    levels, level = [], top
    while True:
        level = level.withColumn("n", F.from_json("raw", NODE)).drop("raw")
        if skip:
            level = level.where(~F.coalesce(F.col("n.name").isin(skip), F.lit(False)))
        level = cut_lineage(level)
        if level.isEmpty():
            break
        levels.append(level)
        below = level.select(*keys, at, F.posexplode(f"n.{children}").alias("i", "c"))
        level = below.select(*keys, F.concat(at, F.array(F.col("i").cast("long"))).alias(at), F.to_json("c").alias("raw"))
    return reduce(DataFrame.unionByName, levels) if levels else level


def first_label(node: Column) -> Column:
    """Label property, rather not the zero-padded one; the upper-case id without any."""
    labels = F.filter(F.coalesce(node["props"], F.array().cast("array<struct<name:string,value:string,class:string>>")), lambda p: p["name"] == "label")
    plain = F.filter(labels, lambda p: ~p["class"].eqNullSafe(F.lit("zero-padded")))
    return F.coalesce(F.get(plain, F.lit(0))["value"], F.get(labels, F.lit(0))["value"], F.upper(node["id"]), F.lit(""))


def parameter_map(params: Column) -> Column:
    """Parameter id -> text put in its place."""

    def text(p: Column) -> Column:
        chosen = F.concat(
            F.lit("[Selection ("), F.coalesce(p["select"]["how-many"], F.lit("one")), F.lit("): "),
            F.array_join(F.coalesce(p["select"]["choice"], F.array().cast("array<string>")), "; "), F.lit("]"),
        )
        named = F.concat(F.lit("[Assignment: organization-defined "), p["label"], F.lit("]"))
        listed = F.array_join(p["values"], ", ")
        return (
            F.when(p["select"].isNotNull(), chosen).when(F.length(p["label"]) > 0, named)
            .when(F.size(p["values"]) > 0, listed).otherwise(UNNAMED_PARAM)
        )

    entries = F.transform(params, lambda p: F.named_struct(F.lit("k"), F.coalesce(p["id"], F.lit("")), F.lit("v"), text(p)))
    # The last of several parameters with one id counts.
    last = let(entries, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda o: o["k"] == e["k"])))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def fill_parameters(prose: Column, params: Column) -> Column:
    """Replace every placeholder once; inserted text is not searched again."""
    names = F.regexp_extract_all(prose, F.lit(PLACEHOLDER), F.lit(1))
    parts = F.split(prose, PLACEHOLDER)
    filled = lambda ps: F.transform(
        ps,
        lambda part, i: F.when(i == 0, part).otherwise(
            F.concat(F.coalesce(F.element_at(params, F.coalesce(F.get(names, i - 1), F.lit(""))), F.lit(UNKNOWN_PARAM)), part)
        ),
    )
    return let(parts, lambda ps: F.array_join(filled(ps), ""))


def part_lines(controls: DataFrame) -> DataFrame:
    """Rendered lines of the statement and guidance parts of every control, in tree order."""
    top = controls.select(
        "family", "control_at", parameter_map(F.col("n.params")).alias("params"), F.posexplode("n.parts").alias("i", "c")
    ).withColumn("raw", F.to_json("c"))
    kind = F.get_json_object("raw", "$.name")
    top = top.withColumn("kind", kind).where(F.col("kind").isin("statement", "guidance"))
    top = top.select("family", "control_at", "params", "kind", F.col("i").cast("long").alias("root"), F.array(F.col("i").cast("long")).alias("at"), "raw")
    nodes = descend(top, "parts", skip=SKIPPED_PARTS)
    labels = F.filter(F.coalesce("n.props", F.array().cast("array<struct<name:string,value:string,class:string>>")), lambda p: p["name"] == "label")
    label = F.coalesce(F.get(labels, F.lit(0))["value"], F.lit(""))
    prose = fill_parameters(F.coalesce("n.prose", F.lit("")), F.col("params"))
    head = F.concat(F.repeat(F.lit("  "), F.size("at") - 1), F.when(label != "", F.concat(label, F.lit(" "))).otherwise(""))
    lines = nodes.select("family", "control_at", "kind", "root", "at", label.alias("l"), prose.alias("p"), rstrip(F.concat(head, prose)).alias("line"))
    return lines.where((F.col("l") != "") | (F.col("p") != "")).drop("l", "p")


def control_texts(catalog_controls: DataFrame, max_text: int | None = None) -> DataFrame:
    """Live controls with label, title and text: title line, control statement, discussion."""
    nodes = descend(catalog_controls, "controls").withColumnRenamed("at", "control_at")
    status = F.filter(F.coalesce("n.props", F.array().cast("array<struct<name:string,value:string,class:string>>")), lambda p: (p["name"] == "status") & (p["value"] == "withdrawn"))
    live = nodes.where(F.size(status) == 0)
    by = ["family", "control_at"]
    lines = part_lines(live).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == "statement") & (strip(F.col("line")) != ""), F.struct("at", "line")))).alias("body"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "guidance", F.struct("at", "line")))).alias("talk"),
    )
    join = lambda rows: strip(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"))
    last = F.filter("talk", lambda r: F.element_at(r["at"], 1) == F.element_at(F.element_at("talk", -1)["at"], 1))
    joined = live.join(lines, by, "left")
    label = first_label(F.col("n"))
    title = F.coalesce("n.title", F.lit(""))
    body, talk = join(F.col("body")), F.when(F.size("talk") > 0, join(last))
    text = F.concat_ws(
        "\n\n", strip(F.concat(label, F.lit(" "), title)),
        F.when(body != "", F.concat(F.lit("Control:\n"), body)), F.when(talk != "", F.concat(F.lit("Discussion:\n"), talk)),
    )
    return joined.select(
        "family", "family_title", "control_at", F.col("n.id").alias("control_id"), label.alias("label"), title.alias("title"),
        (text if max_text is None else F.substring(text, 1, max_text)).alias("text"),
    )


def flatten_catalog(
    controls: DataFrame, tenant_id: str, name_prefix: str, profile: dict[str, str | int], url_prefix: str = "", max_text: int | None = None,
) -> dict[str, DataFrame]:
    """Three tables from one catalog: policies, sections, embedding rows (vectors still to fill).

    ``controls``: family, family_title, at, raw. Withdrawn controls are left out, their live
    children stay. ``profile``: category, authority_level, policy_type, effective_date, model. ``max_text`` cuts longer texts.
    """

    def make(kind: str, *more: str) -> Column:
        return uuid5(CATALOG_SPACE, F.concat_ws("/", F.lit(kind), *more))

    rows = bucketed_scan(
        control_texts(controls, max_text), ["family"], [F.col("control_at")],
        F.floor(F.element_at("control_at", 1) / FAMILY_SLICE), number="place",
    )
    name = F.concat(F.lit(f"{name_prefix} — "), "family_title", F.lit(" ("), "family", F.lit(")"))
    sections = rows.where(~blank(F.col("text"))).select(
        make("section", "family", "control_id").alias("section_id"), F.lit(tenant_id).alias("tenant_id"),
        make("version", "family").alias("policy_version_id"), make("policy", "family").alias("policy_id"),
        (F.col("place") - 1).alias("section_index"), F.col("label").alias("section_path"), "title", "text",
        F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), sha256_hex(F.col("text")).alias("content_sha256"),
        name.alias("policy_name"), make("embedding", "family", "control_id").alias("embedding_id"),
    )
    policies = controls.groupBy("family").agg(F.min("family_title").alias("family_title")).select(
        make("policy", "family").alias("policy_id"), F.lit(tenant_id).alias("tenant_id"), F.lower("family").alias("external_id"),
        name.alias("name"), F.lit("active").alias("status"), F.lit(profile["category"]).alias("category"),
        F.lit(profile["authority_level"]).alias("authority_level"), F.lit("all").alias("department_scope"),
        F.lit(profile["policy_type"]).alias("policy_type"), make("version", "family").alias("current_version_id"),
    )
    embeddings = sections.select(
        "embedding_id", "tenant_id", "policy_id", "policy_version_id", "section_id", F.lit(profile["model"]).alias("embedding_model"),
        "policy_name", F.col("title").alias("section_title"), "section_path", "section_index", "text",
        F.lit(profile["authority_level"]).alias("authority_level"), F.lit("all").alias("department_scope"),
        F.lit(profile["policy_type"]).alias("policy_type"), F.lit(True).alias("is_current"),
        F.lit(profile["effective_date"]).cast("date").alias("effective_date"),
        F.concat(F.lit(url_prefix), F.replace("section_path", F.lit(" "), F.lit(""))).alias("public_url"), "content_sha256",
    )
    return {"policies": policies, "sections": sections.drop("policy_name", "embedding_id"), "embeddings": embeddings}


def explode_versions(policies: DataFrame) -> DataFrame:
    """Versions of policies that carry them as a nested array."""
    head = policies.select(F.col("id").alias("policy_id"), "tenant_id", F.explode("versions").alias("v"))
    return head.select("policy_id", "tenant_id", F.col("v.id").alias("policy_version_id"), "v.*").drop("id")


def policy_of_version(policies: DataFrame, version_id: str) -> DataFrame:
    """The policy whose nested versions contain ``version_id``."""
    return policies.where(F.exists("versions", lambda v: v["id"] == version_id))
