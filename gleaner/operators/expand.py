"""From ranked chunks to articles, and from articles to their sections: capped per group by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.functions import text as t
from gleaner.operators.rank import section_affinity, with_plan

#: Marks of a concrete trigger in a text, with their weights.
TRIGGERS = ((r"(?i)defenestrat|assassinat|coup", 3), (r"(?i)revolt|rebellion|uprising", 1), (r"(?i)war began|outbreak|trigger", 1))


def first_seen(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    nth = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(nth)).filter("_nth = 1").drop("_nth")


def deduplicate_paragraphs(hits: DataFrame, limit: int, separator: str = "\n\n") -> DataFrame:
    """Hits (query_id, chunk_id, position, text, ...) with each paragraph kept at its first place only, up to limit hits.

    Paragraphs are compared squeezed and in lower case; hits without one left go; the rest are numbered anew.
    """
    hits = first_seen(hits, ["query_id", "chunk_id"], ["position"])
    parts = hits.select("query_id", "chunk_id", "position", F.posexplode(F.split("text", separator)).alias("nth", "paragraph"))
    parts = parts.withColumn("key", F.lower(t.squeeze("paragraph"))).filter("key != ''")
    kept = first_seen(parts, ["query_id", "key"], ["position", "nth"])
    joined = kept.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("nth", "paragraph"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["paragraph"]), separator)
    out = hits.drop("text").join(joined.select("query_id", "chunk_id", text.alias("text")), ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy("position")
    return out.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select(*hits.columns)


def article_shortlist(ranked: DataFrame, plans: DataFrame, config: Config) -> DataFrame:
    """(query_id, chunk_id, article_path, score) to the best articles: (query_id, article_path, article_score, occurrences, article_rank).

    The best chunks count with their maximum, mean and number; articles outside them whose title shares
    enough of the query's words enter with their best chunk.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    good = ranked.withColumn("_rank", F.row_number().over(order)).filter(F.col("score") >= config.similarity_threshold)
    good = with_plan(good, plans.select("query_id", "resolved_question"))
    titles = t.words(F.translate("article_path", "_", " "))
    good = good.withColumn("match", t.overlap(titles, t.words("resolved_question"))).withColumn("is_initial", F.col("_rank") <= config.initial_top_k)
    grouped = good.groupBy("query_id", "article_path").agg(
        F.max("score").alias("best"),
        F.avg(F.when(F.col("is_initial"), F.col("score"))).alias("mean"),
        F.count(F.when(F.col("is_initial"), 1)).alias("occurrences"),
        F.first("match").alias("match"),
    )
    grouped = grouped.filter("occurrences > 0 or match >= 0.3")
    initial = F.sum("occurrences").over(Window.partitionBy("query_id"))
    score = 0.65 * F.col("best") + 0.25 * F.coalesce("mean", "best") + 0.10 * F.col("occurrences") / F.greatest(F.lit(1), initial) + config.article_boost * F.col("match")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("article_score"), "article_path")
    scored = grouped.withColumn("article_score", score).withColumn("article_rank", F.row_number().over(by_score))
    return scored.filter(F.col("article_rank") <= config.article_top_k).select("query_id", "article_path", "article_score", "occurrences", "article_rank")


def expand_sections(ranked: DataFrame, plans: DataFrame, config: Config, articles: DataFrame | None = None) -> DataFrame:
    """The chunks of shortlisted articles with expansion_score, capped per section and per article.

    For cause questions the chunk with the strongest trigger of each article is reserved first.
    """
    articles = article_shortlist(ranked, plans, config) if articles is None else articles
    pool = ranked.filter(F.col("score") >= config.similarity_threshold).join(articles, ["query_id", "article_path"])
    pool = with_plan(pool, plans.select("query_id", "intent", "resolved_question"))
    pool = pool.withColumn("section_affinity", section_affinity(F.col("intent"), F.col("resolved_question")))
    pool = pool.withColumn(
        "expansion_score", F.col("score") + config.section_boost * F.col("section_affinity") + config.article_boost * F.col("article_score")
    )
    strength = sum((F.col("text").rlike(p).cast("int") * w for p, w in TRIGGERS), F.lit(0))
    pool = pool.withColumn("strength", F.when(F.col("intent") == "cause", strength).otherwise(0))
    by_strength = Window.partitionBy("query_id", "article_path").orderBy(
        F.desc(F.when(F.col("strength") > 0, F.col("strength") * 0.1 + F.col("expansion_score"))), F.desc("expansion_score"), "chunk_id"
    )
    pool = pool.withColumn("trigger_evidence", (F.row_number().over(by_strength) == 1) & (F.col("strength") > 0))
    # The reserved chunk takes a place in its section and in its article, before all others.
    order = [F.desc("trigger_evidence"), F.desc("expansion_score"), "chunk_id"]
    in_section = Window.partitionBy("query_id", "article_path", "section", "subsection").orderBy(*order)
    in_article = Window.partitionBy("query_id", "article_path").orderBy(*order)
    capped = pool.withColumn("in_section", F.row_number().over(in_section)).filter(F.col("in_section") <= config.chunks_per_section)
    capped = capped.withColumn("in_article", F.row_number().over(in_article)).filter(F.col("in_article") <= config.chunks_per_article)
    return capped.drop("strength", "in_section", "in_article")


def positioned(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def final_chunks(expanded: DataFrame, config: Config) -> DataFrame:
    """The evidence of each query: triggers forward for cause questions, each article's best first for comparisons."""
    best = Window.partitionBy("query_id").orderBy(F.desc("expansion_score"), "chunk_id")
    in_article = Window.partitionBy("query_id", "article_path").orderBy(F.desc("expansion_score"), "chunk_id")
    rows = expanded.withColumn("_best", F.row_number().over(best)).withColumn("_lead", F.row_number().over(in_article) == 1)
    articles = F.size(F.collect_set("article_path").over(Window.partitionBy("query_id")))
    rows = rows.withColumn("_articles", articles)
    asks = F.col("resolved_question").rlike("(?i)immediate|trigger")
    tier = (
        F.when((F.col("intent") == "cause") & asks & F.col("trigger_evidence"), 0)
        .when((F.col("intent") == "cause") & ~asks & (F.col("_best") == 1), 0)
        .when((F.col("intent") == "cause") & F.col("trigger_evidence"), 1)
        .when((F.col("intent") == "comparison") & (F.col("_articles") > 1) & F.col("_lead"), 0)
        .otherwise(2)
    )
    # Leaders stand in the order of their articles, all others by their own score.
    within = F.when((tier == 0) & (F.col("intent") == "comparison"), F.col("article_rank").cast("double")).otherwise(-F.col("expansion_score"))
    placed = positioned(rows.withColumns({"_tier": tier, "_within": within}), F.col("_tier"), F.col("_within"), F.col("chunk_id"))
    return deduplicate_paragraphs(placed.drop("_tier", "_within", "_best", "_lead", "_articles"), config.expanded_context_k)


def legacy_timeline_pool(expanded: DataFrame, config: Config) -> DataFrame:
    """The opening chunk of each section by score, then the rest, without repeated paragraphs."""
    opening = Window.partitionBy("query_id", "article_path", "section", "subsection").orderBy("chunk_id")
    rows = expanded.withColumn("_rest", F.row_number().over(opening) > 1)
    placed = positioned(rows, F.col("_rest"), F.desc("expansion_score"), F.col("chunk_id"))
    return deduplicate_paragraphs(placed.drop("_rest"), config.timeline_candidates)


def timeline_pool(ranked: DataFrame, config: Config) -> DataFrame:
    """Rows above the floor: up to 12 introductions, section openings by score, then the rest, each once."""
    rows = ranked.filter(F.col("rerank_score") >= config.rerank_relevance_floor)
    in_section = Window.partitionBy("query_id", "article_path", "section", "subsection").orderBy("chunk_id")
    rows = rows.withColumn("_opens", F.row_number().over(in_section) == 1)
    leads = F.col("section") == "Introduction"
    by_lead = Window.partitionBy("query_id", leads).orderBy(F.desc("rerank_score"), "chunk_id")
    rows = rows.withColumn("_tier", F.when(leads & (F.row_number().over(by_lead) <= 12), 0).when(F.col("_opens"), 1).otherwise(2))
    placed = positioned(rows, F.col("_tier"), F.desc("rerank_score"), F.col("chunk_id"))
    return placed.filter(F.col("position") <= config.timeline_candidates).drop("_opens", "_tier")


def cap_pool(chunks: DataFrame, total: int = 480) -> DataFrame:
    """Chunks of each query up to a total, in the order of articles' discovery and of chunks in them."""
    order = Window.partitionBy("query_id").orderBy("article_position", "chunk_no")
    return chunks.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= total).drop("_nth")


def sample_chunks(chunks: DataFrame, count: int, *by: str) -> DataFrame:
    """Chunks spread evenly over each article's: (chunk_no counts from 0)."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return chunks.withColumn("_size", size).filter(F.array_contains(t.even_positions(F.col("_size").cast("int"), count), F.col("chunk_no").cast("int"))).drop("_size")


def cap_articles(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` passages of each query (a user's own cap)."""
    order = Window.partitionBy("query_id").orderBy("position")
    return rows.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= limit).drop("_nth")
