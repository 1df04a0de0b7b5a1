"""Full-text search over sections: posting table, AND match with OR fallback, rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import blank, let, tokens
from lexgrove.scale import fine_parts, fits, top_per_group
from lexgrove.session import cut_lineage

# English stop words of the Snowball project.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now
""".split()
# Fixed values of the rank: weight of an unlabelled word, and the limit of sum(1/j^2).
WEIGHT = 0.1
SQUARES = 1.64493406685
MIN_OR_LENGTH = 3
MAX_OR_TOKENS = 8
# Question terms are broadcast up to this many rows (a few dozen bytes each).
MAX_BROADCAST_TERMS = 500_000
TERM_SALTS = 16
# AND matches are sent to the text scan up to this many rows.
MAX_BROADCAST_PAIRS = 100_000
FOUND = ["question_id", "section_id", "policy_version_id", "policy_id"]
SCOPE = ["tenant_id", "policy_id", "policy_version_id", "is_current", "fts_policy_type"]


def stop_word(c: Column) -> Column:
    return c.isin(STOP_WORDS)


def question_terms(questions: DataFrame, stem: Callable[[Column], Column] | None = None, max_or: int = MAX_OR_TOKENS) -> DataFrame:
    """One row per question and term; ``in_or`` marks the terms of the OR query.

    AND uses every distinct word that is no stop word. OR uses words among the first ``max_or`` runs of
    at least three ASCII letters or digits, and only exists when there are two such runs.
    """
    stem = stem or (lambda c: c)
    runs = F.regexp_extract_all(F.col("question"), F.lit("[A-Za-z0-9]+"), F.lit(0))
    long_runs = F.slice(F.filter(runs, lambda t: F.length(t) >= MIN_OR_LENGTH), 1, max_or)
    q = questions.where(~blank(F.col("question"))).select(
        "question_id",
        *(c for c in ("tenant_id", "only_current", "policy_ids", "policy_types") if c in questions.columns),
        F.array_distinct(F.transform(F.filter(tokens(F.col("question")), lambda t: ~stop_word(t)), stem)).alias("and_terms"),
        F.transform(long_runs, F.lower).alias("long_runs"),
    )
    or_terms = F.array_distinct(F.transform(F.filter("long_runs", lambda t: ~stop_word(t)), stem))
    q = q.withColumn("or_terms", F.when(F.size("long_runs") >= 2, or_terms).otherwise(F.array().cast("array<string>")))
    return (
        q.withColumn("n_and", F.size("and_terms"))
        .withColumn("n_or", F.size("or_terms"))
        .withColumn("token", F.explode(F.array_union("and_terms", "or_terms")))
        .withColumn("in_and", F.array_contains("and_terms", F.col("token")))
        .withColumn("in_or", F.array_contains("or_terms", F.col("token")))
        .drop("and_terms", "or_terms", "long_runs")
    )


def section_words(sections: DataFrame, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """Section words without positions."""
    out = sections.select("section_id", *SCOPE, F.explode(tokens(F.col("text"))).alias("token")).where(~stop_word(F.col("token")))
    return out.withColumn("token", stem(F.col("token"))) if stem else out


def section_tokens(sections: DataFrame, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per section with its words and their positions (from 1) in ``words``; positions count stop words, which have no entry.

    Rows of one section are put together as texts, before there is a row or an entry for every word.
    """
    numbered = lambda text: F.transform(tokens(text), lambda t, i: F.struct(t.alias("token"), (i + 1).cast("int").alias("pos")))
    worded = lambda text: F.filter(numbered(text), lambda w: ~stop_word(w["token"]))
    words = F.flatten(F.transform("texts", worded))
    if stem:
        words = F.transform(words, lambda w: F.struct(stem(w["token"]).alias("token"), w["pos"].alias("pos")))
    texts = sections.groupBy("section_id", *SCOPE).agg(F.collect_list("text").alias("texts"))
    return texts.select("section_id", *SCOPE, words.alias("words"))


def build_postings(words: DataFrame) -> DataFrame:
    """Posting table: one row per section and word, with sorted positions (from 1).

    Words are grouped inside their section's row: a sort brings equal words together, and each run of them is one entry.
    """

    def runs(ws: Column) -> Column:
        begins = lambda i: (i == 0) | ~F.get(ws, i)["token"].eqNullSafe(F.get(ws, i - 1)["token"])
        end = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(ws))
        entry = lambda starts, i, j: F.struct(
            F.get(ws, i)["token"].alias("token"), F.transform(F.slice(ws, i + 1, end(starts, j) - i), lambda w: w["pos"]).alias("positions")
        )
        starts = F.filter(F.transform(ws, lambda _, i: i), begins)
        return let(starts, lambda at: F.transform(at, lambda i, j: entry(at, i, j)))

    found = words.select("section_id", *SCOPE, F.explode(let(F.sort_array("words"), runs)).alias("w"))
    return found.select("section_id", "w.token", *SCOPE, "w.positions")


def save_postings(postings: DataFrame, table: str, buckets: int = 1024) -> None:
    """Store postings bucketed by section: later question batches match them without a shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "section_id").sortBy("section_id", "token").saveAsTable(table)


def in_scope(questions: DataFrame, type_col: str) -> Column:
    """Tenant, current-only, policy and type scope of a question against a section row."""
    c = {name: F.col(name) for name in ("is_current", "policy_id", type_col)}
    ok = F.lit(True)
    if "q_tenant_id" in questions.columns:
        ok = ok & (F.col("tenant_id") == F.col("q_tenant_id"))
    if "only_current" in questions.columns:
        ok = ok & (~F.coalesce("only_current", F.lit(True)) | c["is_current"])
    else:
        ok = ok & c["is_current"]
    if "policy_ids" in questions.columns:
        free = F.col("policy_ids").isNull() | (F.size("policy_ids") == 0)
        ok = ok & (free | F.array_contains("policy_ids", c["policy_id"]))
    if "policy_types" in questions.columns:
        free = F.col("policy_types").isNull() | (F.size("policy_types") == 0)
        ok = ok & (free | F.coalesce(F.array_contains("policy_types", c[type_col]), F.lit(False)))
    return ok


def word_score(n: Column) -> Column:
    """Score of one word that occurs ``n`` times, before division by the query size."""
    squares = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, j: acc + F.lit(1.0) / (j * j))
    return F.lit(WEIGHT) * F.when(n == 1, F.lit(1.0)).otherwise(squares) / F.lit(SQUARES)


def pair_miss(left: Column, right: Column) -> Column:
    """Product of (1 - closeness) over all position pairs of two words."""

    def closeness(a: Column, b: Column) -> Column:
        gap = F.abs(a - b)
        near = F.lit(1.0) / (F.lit(1.005) + F.lit(0.05) * F.exp(gap / F.lit(1.5) - F.lit(2.0)))
        return F.sqrt(F.lit(WEIGHT * WEIGHT) * F.when(gap > 100, F.lit(1e-30)).otherwise(near))

    return F.aggregate(
        left,
        F.lit(1.0),
        lambda acc, a: F.aggregate(right, acc, lambda inner, b: F.when(a == b, inner).otherwise(inner * (F.lit(1.0) - closeness(a, b)))),
    )


def closeness_rank(words: Column) -> Column:
    """AND rank from the position arrays of all query words in one section."""
    miss = F.aggregate(
        F.sequence(F.lit(1), F.size(words) - 1),
        F.lit(1.0),
        lambda acc, i: F.aggregate(
            F.slice(words, 1, i), acc, lambda inner, other: inner * pair_miss(F.element_at(words, i + 1), other)
        ),
    )
    return F.lit(1.0) - miss


def pair_scores(terms: DataFrame, counted: DataFrame, small: bool) -> DataFrame:
    """Matched words and score sums per question and section that share a word in scope.

    ``counted``: one row per section and word with its score ``w``. Few terms are sent to every
    task; many are joined on (word, salt), since one word may occur in a third of all sections.
    """
    scope = in_scope(terms, "fts_policy_type")
    if small:
        hits = counted.join(F.broadcast(terms), "token").where(scope)
    else:
        salted = counted.withColumn("_salt", F.pmod(F.xxhash64("section_id"), F.lit(TERM_SALTS)).cast("int"))
        each = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
        hits = salted.join(each, ["token", "_salt"]).where(scope).drop("_salt")
    return hits.groupBy(*FOUND, "n_and", "n_or").agg(
        F.count_if("in_and").alias("matched"),
        F.count_if("in_or").alias("or_matched"),
        F.sum(F.when(F.col("in_or"), F.col("w")).otherwise(0.0)).alias("or_sum"),
        F.sum(F.when(F.col("in_and"), F.col("w")).otherwise(0.0)).alias("and_sum"),
    )


def word_positions(text: Column, words: Column, stem: Callable[[Column], Column] | None = None) -> Column:
    """Positions (from 1) of each of ``words`` in ``text``, as one array per word."""
    at = lambda ts, w: F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: F.element_at(ts, i) == w)
    found = F.transform(tokens(text), stem) if stem else tokens(text)
    return let(found, lambda ts: F.transform(words, lambda w: at(ts, w)))


def of_versions(sections: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """Sections of the versions in ``found``. A few versions are sent to the tasks, before texts are shuffled; else all sections."""
    if not few or "policy_version_id" not in sections.columns:
        return sections
    return sections.join(F.broadcast(found.select("policy_version_id").distinct()), "policy_version_id", "left_semi")


def fts_topk(
    questions: DataFrame,
    sections: DataFrame,
    k: int = 20,
    postings: DataFrame | None = None,
    stem: Callable[[Column], Column] | None = None,
    digits: int = 9,
    max_or: int = MAX_OR_TOKENS,
) -> DataFrame:
    """Best ``k`` sections per question: (question_id, section_id, policy_version_id, policy_id, score, rank).

    ``postings`` is a stored posting table; without it the words of ``sections`` are counted,
    keeping only words that some question asks for before anything is shuffled. One pass yields
    all AND matches and the best ``k`` OR matches per question; the texts of AND matches of several
    words are then read again for the word distances.
    """
    terms = question_terms(questions, stem, max_or)
    if "tenant_id" in terms.columns:
        terms = terms.withColumnRenamed("tenant_id", "q_tenant_id")
    small = fits(terms, MAX_BROADCAST_TERMS)
    if postings is None:
        # A task pairs its sections with all questions and holds the pairs, so it gets a bounded share of the sections.
        words = section_words(fine_parts(sections.select("section_id", *SCOPE, "text"), "policy_version_id"), stem)
        if small:
            words = words.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi")
        counted = words.groupBy("section_id", "token", *SCOPE).agg(F.count(F.lit(1)).cast("int").alias("n"))
    else:
        counted = postings.withColumn("n", F.size("positions"))
    pairs = pair_scores(terms, counted.withColumn("w", word_score(F.col("n"))), small)
    full = (F.col("n_and") > 0) & (F.col("matched") == F.col("n_and"))
    pairs = pairs.withColumn("is_full", full).where(F.col("is_full") | (F.col("or_matched") > 0))
    score = F.when(F.col("is_full"), F.col("and_sum")).otherwise(F.col("or_sum") / F.col("n_or"))
    pairs = pairs.withColumn("score", F.round(score, digits))
    # An AND match of several words is a group of its own and stays until its words' distances are known; matches
    # of one word and OR matches have their final score and are limited before the shuffle.
    pairs = pairs.withColumn("_own", F.when(F.col("is_full") & (F.col("n_and") > 1), F.col("section_id")))
    order = [F.col("score").desc(), F.col("section_id")]
    kept = cut_lineage(top_per_group(pairs, ["question_id", "is_full", "_own"], order, k).select(*FOUND, "n_and", "is_full", "score"))

    # One row per question says whether AND matched at all.
    answered = kept.groupBy("question_id").agg(F.max("is_full").alias("_and"))
    answered = F.broadcast(answered) if fits(answered, MAX_BROADCAST_PAIRS) else answered
    kept = kept.join(answered, "question_id").where(F.col("is_full") == F.col("_and")).drop("_and")
    several = kept.where(F.col("is_full") & (F.col("n_and") > 1)).select(*FOUND)
    ranked = kept.where(~(F.col("is_full") & (F.col("n_and") > 1))).select(*FOUND, "score")
    if not several.isEmpty():
        asked = terms.where("in_and").groupBy("question_id").agg(F.array_sort(F.collect_list("token")).alias("words"))
        wanted = several.join(asked, "question_id")
        few = fits(several, MAX_BROADCAST_PAIRS)
        wanted = F.broadcast(wanted) if few else wanted
        near = of_versions(sections, several, few).select("section_id", "text").join(wanted, "section_id")
        rank = let(word_positions(F.col("text"), F.col("words"), stem), closeness_rank)
        ranked = ranked.unionByName(near.select(*FOUND, F.round(rank, digits).alias("score")))
    return top_per_group(ranked, ["question_id"], order, k)

