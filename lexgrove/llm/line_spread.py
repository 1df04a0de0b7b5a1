"""Cross-site boilerplate lines: HyperLogLog sketches per line, exact counts near the threshold.

A line is a stretch between newlines, without the blanks around it; lines shorter than ``min_chars`` are never removed.
Lines are compared by two 64-bit hashes. The sketch of the distinct sites of each line is built before the shuffle and
merged by aggregation, so a line that a third of all documents carry costs one sketch per task. Where the estimate lies
within ``MARGIN`` of the threshold, the distinct sites are counted exactly; elsewhere the estimate decides.

Every line that at least ``min_sites`` sites carry is removed from all documents but the first (smallest doc_id) that
has it, there all its occurrences stay; so no content is lost. Nulls: a null text has no lines and stays null; a null site is one site of its own; a
null doc_id sorts first. Repeated rows are treated alike. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import id_key, stored
from lexgrove.scale import salted_lookup

MIN_SITES = 10
MIN_CHARS = 15
# 2^10 registers: a standard error of about 3 %; the margin is over four times that.
REGISTERS_LOG2 = 10
MARGIN = 0.15
HOT_ROWS = 100_000
BLANK = " \t\r\f\u000b"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    return F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(bare, F.lit(1)).alias("h2"))


def line_table(docs: DataFrame, site: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, id, site) for each line of each document that may be boilerplate; texts do not move."""
    lines = docs.select(id_key().alias("id"), F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"), F.explode(_lines(F.col("text"))).alias("line"))
    bare = F.btrim("line", F.lit(BLANK))
    return lines.where(F.length(bare) >= min_chars).select("id", "site", F.xxhash64(bare).alias("h1"), F.xxhash64(bare, F.lit(1)).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(h1, h2, first_id, n) of the lines that at least ``min_sites`` distinct sites carry; n is the number of occurrences."""
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS_LOG2))).alias("sites"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"),
    )
    spread = stored(spread.where((F.col("sites") >= low) & (F.col("n") >= min_sites)), "line-spread")
    sure = spread.where(F.col("sites") > high).select("h1", "h2", "first_id", "n")
    near = spread.where(F.col("sites") <= high).select("h1", "h2", "first_id", "n")
    counted = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    exact = counted.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(near.join(exact.select("h1", "h2"), ["h1", "h2"]))


def strip_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, margin: float = MARGIN) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the counts ``n_lines`` and ``n_removed``.

    Clashing columns of these names are replaced. All documents stay, also those left empty.
    """
    lines = stored(line_table(docs, site, min_chars), "lines")
    found = stored(boilerplate(lines, min_sites, margin), "boilerplate")
    hits = salted_lookup(lines.select("h1", "h2", "id"), found, ["h1", "h2"], "id", "n", hot_rows=HOT_ROWS, how="inner")
    gone = hits.where(F.col("id") > F.col("first_id")).groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    own = docs.drop("n_lines", "n_removed")
    keyed = own.select(F.struct(*own.columns).alias("whole"), id_key().alias("id"), F.col("text").alias("body"))
    short = lambda line: F.length(F.btrim(line, F.lit(BLANK))) < min_chars
    kept = F.when(F.col("gone").isNotNull(), F.filter(_lines(F.col("body")), lambda line: short(line) | ~F.array_contains(F.col("gone"), _line_key(line))))
    n_lines = F.size(_lines(F.col("body")))
    counted = keyed.join(gone, "id", "left").withColumn("kept", kept).withColumns({
        "all": F.when(F.col("body").isNull(), 0).otherwise(n_lines).cast("long"),
        "less": F.when(F.col("kept").isNull(), 0).otherwise(n_lines - F.size("kept")).cast("long"),
        "rest": F.when(F.col("kept").isNull(), F.col("body")).otherwise(F.array_join("kept", "\n")),
    })
    columns = [F.col("rest").alias("text") if c == "text" else F.col("whole").getField(c).alias(c) for c in own.columns]
    return counted.select(*columns, F.col("all").alias("n_lines"), F.col("less").alias("n_removed"))
