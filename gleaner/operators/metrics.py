"""Quality of retrieval and of answers, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.operators.sizes import bounded

CITATION = r"\[(S\d+)\]"


def _first_ranks(hits: DataFrame) -> DataFrame:
    """Each chunk at its first rank: repeats do not count twice."""
    return hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))


def per_query(questions: DataFrame, qrels: DataFrame, hits: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(query_id), (query_id, chunk_id), (query_id, rank, chunk_id) to judged, hits, recalls and reciprocal rank of each question."""
    labels = qrels.select("query_id", "chunk_id").distinct()
    relevant = labels.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    ranks = hits.select("query_id", "chunk_id", "rank").join(labels, ["query_id", "chunk_id"])
    found = ranks.groupBy("query_id").agg(
        F.min("rank").alias("first"), *[F.countDistinct(F.when(F.col("rank") <= k, F.col("chunk_id"))).alias(f"found_{k}") for k in at]
    )
    rows = questions.select("query_id").join(relevant, "query_id", "left").join(found, "query_id", "left")
    judged = F.col("relevant").isNotNull()
    columns = {"judged": judged}
    for k in at:
        columns[f"hit_{k}"] = F.when(judged, (F.coalesce("first", F.lit(1 << 30)) <= k).cast("double"))
        columns[f"recall_{k}"] = F.when(judged, F.coalesce(f"found_{k}", F.lit(0)) / F.col("relevant"))
    last = max(at)
    columns[f"rr_{last}"] = F.when(judged, F.when(F.col("first") <= last, 1 / F.col("first")).otherwise(0.0))
    return rows.select("query_id", *[v.alias(k) for k, v in columns.items()])


def ir_metrics(questions: DataFrame, qrels: DataFrame, hits: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: hit rates, recalls, mean reciprocal rank over judged questions (null without any), and counts."""
    each = per_query(questions, qrels, hits, at)
    last = max(at)
    return each.agg(
        *[F.avg(f"hit_{k}").alias(f"hit_rate_{k}") for k in at], *[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in at], F.avg(f"rr_{last}").alias(f"mrr_{last}"),
        F.count_if("judged").alias("judged"), F.count_if(~F.col("judged")).alias("unjudged"),
    )


def check_benchmark(questions: DataFrame, qrels: DataFrame, chunks: DataFrame, expected: str | None = None, actual: str | None = None) -> None:
    """Repeated questions, labels outside the corpus, or a corpus with another digest are an error."""
    if expected != actual:
        raise ValueError("the labels belong to another corpus")
    if questions.groupBy("query_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a question's id stands twice")
    if qrels.join(chunks.select("chunk_id"), "chunk_id", "left_anti").limit(1).count():
        raise ValueError("a label names a chunk that is not in the corpus")


def facet_matches(rows: DataFrame, facets: DataFrame) -> DataFrame:
    """(query_id, rank, text) by (query_id, facet, span): which rows cover which facets (query_id, facet, rank)."""
    plain = rows.select("query_id", "rank", t.normalize_text("text").alias("plain"))
    spans = facets.select("query_id", "facet", t.normalize_text("span").alias("span")).filter("span != ''")
    # By question first: a question has few spans, so pairs stay in proportion to the rows.
    return plain.join(bounded(spans), "query_id").filter(F.contains("plain", "span")).select("query_id", "facet", "rank").distinct()


def facet_coverage(rows: DataFrame, facets: DataFrame, upto: int | None = None) -> DataFrame:
    """(query_id, facets, covered, coverage)."""
    hits = facet_matches(rows if upto is None else rows.filter(F.col("rank") <= upto), facets)
    covered = hits.groupBy("query_id").agg(F.countDistinct("facet").alias("covered"))
    total = facets.groupBy("query_id").agg(F.countDistinct("facet").alias("facets"))
    out = total.join(covered, "query_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("coverage", F.col("covered") / F.col("facets"))


def ndcg_partial(rows: DataFrame, facets: DataFrame, universe: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(query_id, dcg, ideal, ndcg, mrr) at `top`: a row that covers a facet gains 2, others are unjudged; the ideal is the pool's."""

    def gained(df: DataFrame) -> DataFrame:
        good = facet_matches(df, facets).select("query_id", "rank").distinct().withColumn("gain", F.lit(2))
        return df.select("query_id", "rank").join(good, ["query_id", "rank"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))

    worth = lambda gain, rank: (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1)
    own = gained(rows).filter(F.col("rank") <= top)
    first = F.min(F.when(F.col("gain") > 0, F.col("rank")))
    dcg = own.groupBy("query_id").agg(F.sum(worth(F.col("gain"), F.col("rank"))).alias("dcg"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"))
    pool = gained(rows if universe is None else universe)
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank")
    ideal = pool.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    ideal = ideal.groupBy("query_id").agg(F.sum(worth(F.col("gain"), F.col("place"))).alias("ideal"))
    out = dcg.join(ideal, "query_id")
    return out.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))


def summary(rows: DataFrame, values: list[str], *by: str) -> DataFrame:
    """Mean, median, least and greatest of values by group."""
    kinds = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
    return rows.groupBy(*by).agg(*[f(v).alias(f"{v}_{name}") for v in values for name, f in kinds.items()])


def lost_facets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, facet) covered before and not after."""
    return before.select("query_id", "facet").distinct().join(after.select("query_id", "facet").distinct(), ["query_id", "facet"], "left_anti")


def repeated_trigram_share(sources: DataFrame) -> DataFrame:
    """(query_id, source_no, text) to (query_id, grams, repeated, share): a gram repeats if an earlier source has it."""
    grams = t.let(t.all_words("text"), lambda found: F.when(F.size(found) >= 3, t.runs_of_three(found)))
    each = sources.select("query_id", "source_no", F.explode(grams).alias("gram"))
    counted = each.groupBy("query_id", "gram", "source_no").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("query_id", "gram").agg(F.sum("n").alias("n"), F.min(F.struct("source_no", "n")).alias("first"))
    out = first.groupBy("query_id").agg(F.sum("n").alias("grams"), F.sum(F.col("n") - F.col("first.n")).alias("repeated"))
    return out.withColumn("share", F.col("repeated") / F.col("grams"))


def lexical_only_support(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows (query_id, rank, origins) that only BM25 found and that cover a facet."""
    only = candidates.filter((F.size("origins") == 1) & (F.get("origins", 0) == "bm25"))
    return only.join(matches.select("query_id", "rank").distinct(), ["query_id", "rank"], "left_semi")


def citation_check(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, answer) by (answer_id, label) to cited_labels, unknown_labels, has_citations."""
    cited = F.sort_array(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1))))
    labels = known.groupBy("answer_id").agg(F.collect_set("label").alias("labels"))
    rows = answers.withColumn("cited_labels", F.coalesce(cited, F.array().cast("array<string>"))).join(labels, "answer_id", "left")
    unknown = F.array_except("cited_labels", F.coalesce("labels", F.array().cast("array<string>")))
    return rows.select("answer_id", "cited_labels", unknown.alias("unknown_labels"), (F.size("cited_labels") > 0).alias("has_citations"))


def _number(c: Column) -> Column:
    v = c.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")), v)


def usage(rows: DataFrame, prompt: str = "prompt_eval_count", output: str = "eval_count", nanoseconds: str = "eval_duration") -> DataFrame:
    """Adds prompt_tokens, output_tokens, total_tokens, tokens_per_second; counts that are no whole numbers from 0 on become null."""

    def count(name: str) -> Column:
        v = _number(F.col(name))
        return F.when(v == F.floor(v), v.cast("bigint"))

    rows = rows.withColumns({"prompt_tokens": count(prompt), "output_tokens": count(output)})
    seconds = F.nullif(_number(F.col(nanoseconds)), F.lit(0.0)) / 1e9
    return rows.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("output_tokens"), "tokens_per_second": F.col("output_tokens") / seconds})


def throughput(rows: DataFrame, *by: str) -> DataFrame:
    """Mean tokens per second and wall time by group, from counters in nanoseconds."""
    each = rows.withColumn("_rate", F.try_divide(F.col("eval_count"), F.col("eval_duration") / 1e9))
    return each.groupBy(*by).agg(F.avg("_rate").alias("tokens_per_second"), F.avg("wall_seconds").alias("wall_seconds"), F.count(F.lit(1)).alias("runs"))


def compare_models(evidence: DataFrame, models: DataFrame) -> DataFrame:
    """The same evidence for each model: a row for each pair; models are few."""
    return evidence.crossJoin(bounded(models))


def run_summary(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, article_path) pools to counts of rows and articles."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name), F.countDistinct("article_path").alias(f"{name}_articles"))
    return count(candidates, "candidates").join(count(selected, "selected"), "query_id", "left").na.fill(0)


def acceptance(metrics: DataFrame, baseline: DataFrame, events: DataFrame, least_gain: float = 0.05) -> DataFrame:
    """Per question: gain over the baseline, and whether events are in order and of a sensible number."""
    order = Window.partitionBy("query_id").orderBy("event_no")
    marked = events.withColumn("date", F.struct("year", "month", "day"))
    marked = marked.withColumn("sorted", F.coalesce(F.lag("date").over(order) <= F.col("date"), F.lit(True)))
    checks = marked.groupBy("query_id").agg(F.every("sorted").alias("events_sorted"), F.count(F.lit(1)).alias("events"))
    joined = metrics.select("query_id", "coverage").join(baseline.select("query_id", F.col("coverage").alias("before")), "query_id").join(checks, "query_id", "left")
    return joined.select(
        "query_id", (F.col("coverage") - F.col("before")).alias("gain"), (F.col("coverage") - F.col("before") >= least_gain).alias("enough_gain"), "events_sorted",
        F.col("events").between(2, 10).alias("sensible_events"),
    )


def source_audit(statuses: DataFrame) -> DataFrame:
    """(query_id, evidence_status, supplied_text) to counts of sources, of those that resolve and are found, and of exact duplicates."""
    return statuses.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("evidence_status") != "unavailable").alias("resolvable"),
        F.count_if(F.col("evidence_status") == "exact").alias("highlighted"), (F.count(F.lit(1)) - F.countDistinct("supplied_text")).alias("duplicates"),
    )


def inspect(fused: DataFrame, sources: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per candidate: where it came from, whether it was selected, why not, and a preview of 240 characters."""
    chosen = sources.select("query_id", "chunk_id", "label")
    reasons = rejected.select("query_id", "chunk_id", "reason")
    joined = fused.join(chosen, ["query_id", "chunk_id"], "left").join(reasons, ["query_id", "chunk_id"], "left")
    preview = F.substring(t.squeeze("text"), 1, 240).alias("preview")
    return joined.select("query_id", "chunk_id", "origins", "fused_rank", "fused_score", F.col("label").isNotNull().alias("selected"), "label", "reason", preview)
