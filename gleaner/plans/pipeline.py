"""From questions to answers: plan, retrieve, fuse, rerank, select, pack, generate, check — all questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.functions import text as t
from gleaner.operators import dense, expand, fusion, lexical, metrics, rank, select, timeline
from gleaner.operators.sizes import bounded
from gleaner.plans import generate as g
from gleaner.plans import interpret, pools
from gleaner.sources.lineage import cut

DIRECTIONS = {"bm25": "lower", "dense": "higher"}


def indexed(chunks: DataFrame) -> DataFrame:
    """Chunks (article_path, chunk_id, section, subsection, text) with the fields of the lexical index."""
    return chunks.withColumns({"title": F.translate("article_path", "_", " "), "body": F.col("text"), "heading": rank.headings()}).select(
        "chunk_id", "title", F.col("heading").alias("section"), "body"
    )


def branches(
    plans: DataFrame, chunks: DataFrame, query_vectors: DataFrame | None, chunk_vectors: DataFrame | None, config: Config, pool: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Rows (query_id, branch, candidate_id, score) of BM25 and, where there are vectors, of the dense branch.

    With a pool (chunks with the query_id whose search they are in) both branches stay in it, and BM25
    has its statistics from it.  index: the stored index of all chunks, if there is one.
    """
    asked = plans.select("query_id", F.col("resolved_question").alias("query"))
    if pool is not None:
        own = pool.select("query_id", "chunk_id", F.translate("article_path", "_", " ").alias("title"), rank.headings().alias("section"), F.col("text").alias("body"))
        found = lexical.bm25(asked, own, config.hybrid_branch_k, "pool")
    else:
        found = lexical.bm25(asked, indexed(chunks) if index is None else index, config.hybrid_branch_k)
    found = found.select("query_id", F.lit("bm25").alias("branch"), F.col("chunk_id").alias("candidate_id"), "score")
    if query_vectors is None or chunk_vectors is None:
        return found
    own = query_vectors.join(plans.select("query_id"), "query_id", "left_semi")
    if pool is not None:
        scored = pools.pool_cosine(pool, own, chunk_vectors, config.hybrid_branch_k)
    else:
        scored = dense.cosine_topk(own, chunk_vectors, config.hybrid_branch_k)
    return found.unionByName(scored.select("query_id", F.lit("dense").alias("branch"), F.col("chunk_id").alias("candidate_id"), "score"))


def retrieve(
    plans: DataFrame, chunks: DataFrame, query_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None, config: Config | None = None, pool: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Reranked candidates of each plan, with provenance.  Without vectors BM25 alone decides; a pool limits the search."""
    cfg = config or Config()
    rows = branches(plans, chunks, query_vectors, chunk_vectors, cfg, pool, index)
    directions = DIRECTIONS if query_vectors is not None and chunk_vectors is not None else {"bm25": "lower"}
    fused = fusion.rrf(rows, directions, cfg.rrf_k, cfg.hybrid_branch_k, cfg.hybrid_merge_k)
    # Texts join late: ranks were settled on ids and scores alone.
    texts = chunks.select("chunk_id", "article_path", "section", "subsection", "text")
    full = texts.join(bounded(fused.withColumnRenamed("candidate_id", "chunk_id")), "chunk_id")
    return rank.hybrid_rerank(full, plans, cfg.hybrid_rerank_k, cfg.rerank_backend)


def retrieve_legacy(plans: DataFrame, chunks: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, config: Config | None = None, intent_vectors: DataFrame | None = None) -> DataFrame:
    """The dense path: scores blended with the intent's, articles shortlisted, sections expanded, reranked."""
    cfg = config or Config()
    depth = cfg.candidate_chunks_total
    ranked = dense.cosine_topk(query_vectors, chunk_vectors, depth)
    if intent_vectors is not None:
        cause = plans.filter(F.col("intent") == "cause").select("query_id")
        blended = dense.blend(ranked, dense.cosine_topk(intent_vectors.join(cause, "query_id", "left_semi"), chunk_vectors, depth))
        ranked = ranked.select("query_id", "chunk_id", "score").join(cause, "query_id", "left_anti").unionByName(blended.select("query_id", "chunk_id", "score"))
    full = chunks.select("chunk_id", "article_path", "section", "subsection", "text").join(bounded(ranked.select("query_id", "chunk_id", "score")), "chunk_id")
    expanded = expand.expand_sections(full, plans, cfg)
    dropped = [c for c in ("intent", "resolved_question") if c in expanded.columns]
    return rank.rerank(expanded.drop(*dropped), plans)


def timeline_hits(ranked: DataFrame, plans: DataFrame, chunks: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of timeline questions within their periods, and the events as hits."""
    cfg = config or Config()
    asks = plans.filter(F.col("intent") == "timeline")
    pool = expand.timeline_pool(ranked.join(asks.select("query_id"), "query_id", "left_semi"), cfg)
    facts = asks if "anchor_year" in asks.columns else asks.withColumn("anchor_year", F.lit(None).cast("int"))
    periods = timeline.infer_period(facts.select("query_id", "question", "resolved_question", "anchor_year"), chunks, cfg.continuation_year_window)
    ends = timeline.endpoint_period(facts, chunks).select("query_id", F.col("low").alias("end_low"), F.col("high").alias("end_high"))
    bounds = periods.join(ends, "query_id", "left").select("query_id", F.coalesce("low", "end_low").alias("low"), F.coalesce("high", "end_high").alias("high"))
    names = ["query_id", "position", "article_path", "section", "subsection", "chunk_id", "text", "score"]
    events = timeline.extract_events(pool.select(*names).join(bounded(bounds), "query_id"), cfg.timeline_events, bounds=True)
    return events, timeline.event_hits(events)


def ask(
    questions: DataFrame, chunks: DataFrame, query_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None, config: Config | None = None,
    generator: g.Generator | None = None, output_tokens: int = 600, articles: DataFrame | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """(query_id, question) to an answer record each: answer, sources, citation check, counts.

    articles: (query_id, article_path, position, reasons) from pools.discover_plan; without them the
    search is over all chunks.
    """
    cfg = config or Config()
    plan_rows = cut(interpret.plans(questions, cfg))
    pool = None if articles is None else pools.pool_chunks(chunks, articles, cfg)
    if cfg.retrieval_mode == "legacy" and query_vectors is not None and chunk_vectors is not None:
        ranked = retrieve_legacy(plan_rows, chunks, query_vectors, chunk_vectors, cfg)
    else:
        ranked = retrieve(plan_rows, chunks, query_vectors, chunk_vectors, cfg, pool, index)
    ranked = cut(ranked)
    events, dated = timeline_hits(ranked, plan_rows, chunks, cfg)
    events, dated = cut(events), cut(dated)
    # Events replace the ranked passages of a question if there is at least one.
    shape = ["query_id", "chunk_id", "article_path", "section", "subsection", "text", "rerank_score"]
    plain = ranked.select(*shape).join(dated.select("query_id").distinct(), "query_id", "left_anti")
    hits = plain.unionByName(dated.withColumn("rerank_score", F.lit(None).cast("double")).select(*shape))
    fixed = F.lit(select.CHAT_OVERHEAD + select.tokens(g.SYSTEM) + 40) + t.estimate_tokens("question")
    subjects = F.transform(F.filter("entities", lambda e: e["reason"] == "comparison subject"), lambda e: e["normalized_name"])
    facts = plan_rows.select("query_id", fixed.cast("int").alias("fixed_tokens"), subjects.alias("subjects"))
    packed = cut(select.pack_evidence(hits.join(bounded(facts), "query_id"), cfg, output_tokens=output_tokens))
    chosen = packed.filter(F.col("label").isNotNull()).join(hits.select("query_id", "chunk_id", "section", "subsection").distinct(), ["query_id", "chunk_id"])
    source = F.struct(F.substring("label", 2, 4).cast("int").alias("no"), "label", "article_path", "section", "subsection", "supplied_text", "chunk_id")
    sources = chosen.groupBy("query_id").agg(F.sort_array(F.collect_list(source)).alias("sources"))
    answers = cut(g.generate(plan_rows.join(sources, "query_id", "left"), generator))
    labels = answers.select(F.col("query_id").alias("answer_id"), F.explode("sources.label").alias("label"))
    checked = metrics.citation_check(answers.select(F.col("query_id").alias("answer_id"), "answer"), labels)
    out = answers.join(checked.withColumnRenamed("answer_id", "query_id"), "query_id")
    counted = events.groupBy("query_id").agg(F.count(F.lit(1)).alias("events"))
    return out.join(counted, "query_id", "left").select(
        "query_id", "question", "intent", "breadth", "answer", "sources", "cited_labels", "unknown_labels", "has_citations", "skipped_generation", "model",
        F.coalesce("events", F.lit(0)).alias("events"),
    )


def evaluate(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Dense retrieval against labels: one row of metrics."""
    metrics.check_benchmark(queries, qrels, chunks)
    return metrics.ir_metrics(queries, qrels, dense.cosine_topk(query_vectors, chunk_vectors, k))
