"""The articles of each question, and the pool of chunks that its search is limited to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.operators import dense, discovery, expand, lexical
from gleaner.operators.sizes import bounded
from gleaner.plans import interpret
from gleaner.sources import archive as a
from gleaner.sources.lineage import cut


def full_text(questions: DataFrame, articles: DataFrame, limit: int) -> DataFrame:
    """(query_id, question) by (path, title, section, body) to (query_id, path, rank): BM25 over whole articles.

    Questions on battles search for careers too, whose first result goes before all others.
    """
    asked = questions.select("query_id", discovery.full_text_query("question").alias("query"))
    index = cut(lexical.postings(articles.withColumnRenamed("path", "chunk_id")))  # for both searches
    plain = lexical.bm25(asked, index, limit).select("query_id", F.col("chunk_id").alias("path"), "rank")
    battles = questions.filter(F.col("question").rlike(r"(?i)\bbattles?\b"))
    careers = battles.select("query_id", F.concat(discovery.full_text_query("question"), F.lit(" military career")).alias("query"))
    first = lexical.bm25(careers, index, 1).select("query_id", F.col("chunk_id").alias("path"), F.lit(0).alias("rank"))
    both = plain.unionByName(first)
    return both.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))


def discover_plan(plan_rows: DataFrame, articles: DataFrame, redirects: DataFrame, links: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """Plans to their articles with reasons: (query_id, article_path, position, reasons).

    articles: (path, title, section, body); redirects: (path, target); links: (article_path, href,
    anchor, context, position).  Seed queries find titles and full text; links of the best articles
    follow for broad questions; named subjects are looked up by title.
    """
    cfg = config or Config()
    plan_rows = cut(plan_rows)
    seeds = cut(interpret.seed_rows(plan_rows).withColumn("seed_id", F.concat_ws("#", "query_id", "seed_no")))
    asked = seeds.select(F.col("seed_id").alias("query_id"), F.col("query").alias("question"))
    texts = cut(full_text(asked, articles, 2 * cfg.articles_per_query))
    found = discovery.discover(asked, articles.select("path"), texts, redirects, cfg.articles_per_query).withColumnRenamed("query_id", "seed_id")
    found = cut(found.join(bounded(seeds.select("seed_id", "query_id", "seed_no")), "seed_id"))
    reason = F.when(F.col("is_title"), "direct title").when(F.col("seed_no") == 0, "question search").otherwise(F.concat(F.lit("seed query "), F.col("seed_no") + 1))
    rows = found.select("query_id", F.lit(0).alias("stage"), "seed_no", "position", "article_path", reason.alias("reason"))
    if links is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("is_title"), "seed_no", "position", "article_path")
        best = expand.first_seen(found, ["query_id", "article_path"], [F.desc("is_title"), "seed_no", "position"])
        best = best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= cfg.related_seed_articles)
        words = plan_rows.select("query_id", F.array_join("seed_queries", " ").alias("query"))
        related = discovery.related_articles(links, best.select("query_id", "article_path", "nth").join(bounded(words), "query_id"), cfg.related_articles_per_seed)
        related = related.join(bounded(best.select("query_id", "article_path", "nth")), ["query_id", "article_path"])
        target = related.join(redirects.select(F.col("path").alias("href"), "target"), "href", "left")
        rows = rows.unionByName(
            target.select(
                "query_id", F.lit(1).alias("stage"), F.col("nth").alias("seed_no"), F.col("rank").alias("position"), F.coalesce("target", "href").alias("article_path"),
                F.concat(F.lit("related from: "), "article_path").alias("reason"),
            )
        )
    named = plan_rows.select("query_id", F.posexplode("entities").alias("no", "e")).withColumn("name_id", F.concat_ws("#", "query_id", "no"))
    titles = a.search_titles(articles.select("path"), named.select(F.col("name_id").alias("query_id"), F.col("e.display_name").alias("query")), cfg.entity_title_candidates)
    titles = titles.withColumnRenamed("query_id", "name_id").join(bounded(named.select("name_id", "query_id", "no", F.col("e.display_name").alias("name"))), "name_id")
    titles = titles.join(redirects.select("path", "target"), "path", "left")
    rows = rows.unionByName(
        titles.select(
            "query_id", F.lit(2).alias("stage"), F.col("no").alias("seed_no"), F.col("rank").alias("position"), F.coalesce("target", "path").alias("article_path"),
            F.concat(F.lit("entity: "), "name").alias("reason"),
        )
    )
    return cut(discovery.merge_sources(cut(rows), plan_rows))


def with_fallback(primary: DataFrame, single: DataFrame) -> DataFrame:
    """Questions without any article from the plan take those of their single-query search, with the reason `fallback`."""
    missing = single.join(primary.select("query_id").distinct(), "query_id", "left_anti")
    shaped = missing.select("query_id", "article_path", "position", F.array(F.lit("fallback")).alias("reasons"))
    return primary.select("query_id", "article_path", "position", "reasons").unionByName(shaped)


def pool_chunks(chunks: DataFrame, pools: DataFrame, config: Config | None = None) -> DataFrame:
    """The chunks of each question's articles: long articles sampled evenly, all capped in the order of discovery.

    chunks: (article_path, chunk_no, chunk_id, section, subsection, text).
    """
    cfg = config or Config()
    wanted = chunks.join(bounded(pools.select("article_path").distinct()), "article_path", "left_semi")
    sampled = expand.sample_chunks(wanted, cfg.candidate_chunks_per_article, "article_path")
    named = pools.select("query_id", "article_path", F.col("position").alias("article_position"), "reasons")
    return cut(expand.cap_pool(sampled.join(bounded(named), "article_path"), cfg.candidate_chunks_total))


def pool_cosine(pool: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, k: int) -> DataFrame:
    """The best k chunks of each question's own pool: an equi-join, as a pool has a few hundred chunks."""
    pairs = pool.select("query_id", "chunk_id").join(chunk_vectors.withColumnRenamed("vector", "b"), "chunk_id").join(bounded(query_vectors.withColumnRenamed("vector", "a")), "query_id")
    scored = pairs.select("query_id", "chunk_id", F.round(dense.cosine(F.col("a"), F.col("b")), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
