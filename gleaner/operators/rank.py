"""Reranking by transparent features, as expressions over candidates joined with their query's plan.

Candidates: (query_id, chunk_id, article_path, section, subsection, text, score) and, where known,
reasons (why the article was discovered).  Plans: (query_id, intent, resolved_question, seed_queries,
entities, date_hints); there is one for each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.operators.sizes import bounded

#: Weights of the features.
WEIGHTS = {
    "semantic": 0.39, "lexical": 0.20, "title": 0.10, "section": 0.08, "entity": 0.10, "date": 0.04, "direct": 0.04, "completeness": 0.05,
    "low_value": -0.65, "topic_conflict": -0.35,
}
LOW_VALUE = r"(?i)^(?:references|external links|see also|bibliography|notes|sources)$"
REFERENCE_LIKE = r"(?i)references|bibliography|external links|literature about|gallery"
DIRECT_REASONS = ("direct title", "question search")
#: Parts of headings that suit an intent.
INTENT_TERMS = {
    "cause": ("cause", "origin", "background", "tension", "religious", "political", "trigger", "revolt"),
    "timeline": ("history", "timeline", "chronology", "phase", "battle", "campaign", "events"),
    "comparison": ("impact", "consequence", "political", "econom", "religio", "difference"),
    "lookup": ("introduction", "early life", "background", "history"),
}
AFTERMATH = ("cost", "casualt", "aftermath", "consequence")
AFTERMATH_WORDS = ("cost", "costs", "casualties", "deaths", "disease", "famine")
BEST_FUSED = 2 / 61


def minmax(value: str | Column, *by: str) -> Column:
    """A value between the least and greatest of its group; 0.5 where they hardly differ."""
    v = F.col(value) if isinstance(value, str) else value
    group = Window.partitionBy(*by)
    low, high = F.min(v).over(group), F.max(v).over(group)
    close = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    return F.when(close, 0.5).otherwise((v - low) / (high - low))


def date_score(text: Column, hints: Column) -> Column:
    """0.5 without hints, else whether one of them is in the text."""
    low = F.lower(text)
    hit = F.exists(hints, lambda h: F.contains(low, F.lower(h)))
    return F.when(F.size(hints) <= 0, 0.5).when(hints.isNull(), 0.5).otherwise(hit.cast("double"))


def headings(section: str = "section", subsection: str = "subsection") -> Column:
    return F.concat_ws(" ", F.when(F.col(section) != "", F.col(section)), F.when(F.col(subsection) != "", F.col(subsection)))


def with_plan(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    return candidates.join(bounded(plans), "query_id")


def with_features(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds the struct `features` to candidates; the plan's columns stay."""
    # Ranks need the rows of a question together: dealt out first, so that features are made after the shuffle and not carried through it.
    rows = with_plan(candidates, plans).repartition("query_id")
    if "reasons" not in rows.columns:
        rows = rows.withColumn("reasons", F.array().cast("array<string>"))
    title = F.translate("article_path", "_", " ")
    rows = rows.withColumns(
        {
            "_title": title,
            "_heading": headings(),
            "_query": t.words(F.array_join("seed_queries", " ")),
            "_body": t.words("text"),
            "_hay": t.haystack(F.concat_ws(" ", title, headings(), F.col("text"))),
        }
    )
    rows = rows.withColumns({"_titles": t.words("_title"), "_heads": t.words("_heading")})
    # Columns of their own: inside a function over entities they would be made again for each of them.
    rows = rows.withColumn("_everything", F.array_union(F.array_union("_body", "_titles"), "_heads"))
    everything = F.col("_everything")
    rows = rows.withColumn("_names", F.transform("entities", lambda e: F.struct(t.haystack(e["display_name"]).alias("hay"), t.words(e["display_name"]).alias("words"))))
    entity = lambda e: F.when(F.contains(F.col("_hay"), e["hay"]), F.lit(1.0)).otherwise(0.35 * t.overlap(e["words"], everything))
    entity_score = F.when(F.size("entities") > 0, F.array_max(F.transform("_names", entity))).otherwise(0.5)
    low_value = F.coalesce(F.trim("section").rlike(LOW_VALUE), F.lit(False)) | F.col("_title").rlike(r"(?i)\(disambiguation\)$")
    has = lambda array, word: F.array_contains(F.col(array), word)
    conflict = has("_query", "republic") & has("_titles", "empire") & ~has("_titles", "republic")
    dated = F.col("_title").rlike(r"\(.*\d{3,4}") & (F.size("date_hints") <= 0) & F.exists(
        "entities", lambda e: F.startswith(F.lower("_title"), F.concat(F.lower(e["display_name"]), F.lit(" (")))
    )
    values = {
        "semantic": minmax("score", "query_id"),
        "lexical": t.overlap("_query", everything),
        "title": t.overlap("_titles", "_query"),
        "section": t.overlap("_heads", "_query"),
        "entity": entity_score,
        "date": date_score(F.concat_ws(" ", "_heading", "text"), F.col("date_hints")),
        "direct": F.when(F.arrays_overlap("reasons", t.text_array(DIRECT_REASONS)), 1.0).otherwise(0.35),
        "completeness": t.density("text"),
        "low_value": low_value.cast("double"),
        "topic_conflict": (conflict | dated).cast("double"),
    }
    features = F.struct(*[v.alias(k) for k, v in values.items()]).alias("features")
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], features)


def total(features: str = "features") -> Column:
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.lit(weight) * F.col(f"{features}.{name}")
    return score


def rerank(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Candidates with features, original_score, score and rerank_score, and rerank_rank by (-score, article, chunk)."""
    scored = with_features(candidates, plans).withColumn("original_score", F.col("score")).withColumn("score", F.round(total(), 8))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "article_path", "chunk_id")
    return scored.withColumn("rerank_score", F.col("score")).withColumn("rerank_rank", F.row_number().over(order))


def section_affinity(intent: Column, query: Column) -> Column:
    """How well a chunk's headings suit an intent and the query's words."""
    heading = F.lower(headings())
    low = lambda words: sum((F.contains(heading, F.lit(w)).cast("int") for w in words), F.lit(0))
    hits = F.lit(0)
    for name, parts in INTENT_TERMS.items():
        hits = F.when(intent == name, low(parts)).otherwise(hits)
    asked, heads = t.words(query), t.words(heading)
    shared = F.size(F.array_intersect(asked, heads)) / F.greatest(F.lit(1), F.size(heads))
    off = (intent == "cause") & (low(AFTERMATH) > 0) & ~F.arrays_overlap(asked, t.text_array(AFTERMATH_WORDS))
    return F.least(F.lit(1.0), hits / 2) + 0.3 * shared - F.when(off, 1.0).otherwise(0.0)


def hybrid_rerank(fused: DataFrame, plans: DataFrame, limit: int = 80, backend: str = "deterministic") -> DataFrame:
    """Fused candidates (with fused_score, fused_rank and, where known, dense_pool_score and branches) in their final order.

    backend `rrf` keeps the order of fusion.  The semantic signal is the dense score where there is one.
    """
    rows = fused.filter(F.col("fused_rank") <= limit)
    share = F.col("fused_score") / BEST_FUSED
    if backend == "rrf":
        return rows.withColumns({"rerank_score": share, "score": share, "rerank_rank": F.col("fused_rank"), "rerank_method": F.lit("rrf")})
    dense = [F.col("dense_pool_score")] if "dense_pool_score" in rows.columns else []
    branch = [F.col("branches")["dense"]["score"]] if "branches" in rows.columns else []
    rows = rows.withColumn("score", F.coalesce(*dense, *branch, F.col("fused_score")))
    ranked = rerank(rows, plans).drop("rerank_rank")
    intent = F.when((F.col("intent") == "comparison") & F.col("resolved_question").rlike("(?i)caus"), "cause").otherwise(F.col("intent"))
    affinity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), section_affinity(intent, F.col("resolved_question"))))
    title = F.lower(F.translate("article_path", "_", " "))
    dated = title.rlike(r"\b\d{3,4}\b") & (F.size("date_hints") <= 0) & F.exists(
        "entities", lambda e: F.startswith(title, F.concat(e["normalized_name"], F.lit(" ")))
    )
    score = F.round(F.col("score") + 0.10 * share + 0.18 * affinity - 0.25 * dated.cast("double"), 8)
    score = score - F.when(F.col("section").rlike(REFERENCE_LIKE), 0.65).otherwise(0.0)
    tiebreak = "candidate_id" if "candidate_id" in rows.columns else "chunk_id"
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), tiebreak)
    out = ranked.withColumn("rerank_score", score).withColumn("score", F.col("rerank_score"))
    return out.withColumns({"rerank_rank": F.row_number().over(order), "rerank_method": F.lit("deterministic")})


def check_permutation(before: DataFrame, after: DataFrame, key: str = "chunk_id") -> None:
    """A reranking that loses, repeats or adds rows, or gives scores that are not finite, is an error."""
    a, b = before.select("query_id", key), after.select("query_id", key)
    broken = a.exceptAll(b).union(b.exceptAll(a)).limit(1).count()
    bad = after.filter(F.col("rerank_score").isNull() | F.isnan("rerank_score") | (F.abs("rerank_score") == float("inf"))).limit(1).count()
    if broken or bad:
        raise ValueError("reranking did not give back its candidates")
