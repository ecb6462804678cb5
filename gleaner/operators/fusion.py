"""Reciprocal rank fusion of any number of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
BRANCHES = {"bm25", "dense"}
DIRECTIONS = {"higher": -1, "lower": 1}


def positive(name: str, value: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer")


def branch_ranks(rows: DataFrame, directions: dict[str, str], branch_limit: int) -> DataFrame:
    """(query_id, branch, candidate_id, score) to each candidate's best score in each branch, with rank."""
    sign = F.create_map(*[F.lit(x) for name, d in directions.items() for x in (name, DIRECTIONS[d])])
    score = F.col("score").cast("double")
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    signed = rows.withColumn("signed", F.when(bad, F.raise_error(F.lit("branch scores must be finite")).cast("double")).otherwise(score * sign[F.col("branch")]))
    best = signed.groupBy("query_id", "branch", "candidate_id").agg(F.min("signed").alias("signed"))
    order = Window.partitionBy("query_id", "branch").orderBy("signed", "candidate_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branch_limit)
    # Back to the branch's own direction; 0.0 instead of a negative zero.
    return ranked.withColumn("score", F.col("signed") * sign[F.col("branch")] + F.lit(0.0)).drop("signed")


def rrf(rows: DataFrame, directions: dict[str, str], k: int = K, branch_limit: int = 40, output_limit: int = 80) -> DataFrame:
    """Fuse branches: (query_id, candidate_id, fused_score, fused_rank, best_rank, origins, branches).

    A candidate's score is the sum of 1 / (k + rank) over the branches that have it; ties go to the
    best rank in any branch, then to the smaller id.
    """
    for name, value in (("k", k), ("branch_limit", branch_limit), ("output_limit", output_limit)):
        positive(name, value)
    if set(directions) - BRANCHES or set(directions.values()) - set(DIRECTIONS):
        raise ValueError("directions map dense and bm25 to higher or lower")
    direction = F.create_map(*[F.lit(x) for pair in directions.items() for x in pair])
    ranked = branch_ranks(rows, directions, branch_limit)
    entry = F.struct("branch", F.struct("score", "rank", direction[F.col("branch")].alias("direction")).alias("value"))
    fused = ranked.groupBy("query_id", "candidate_id").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.min("rank").alias("best_rank")
    )
    # Summed in the order of the branches' names, so that every run gives the same double.
    total = F.aggregate("entries", F.lit(0.0), lambda acc, e: acc + F.lit(1.0) / (k + e["value"]["rank"]))
    fused = fused.withColumn("fused_score", total)
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "best_rank", "candidate_id")
    fused = fused.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= output_limit)
    return fused.select(
        "query_id", "candidate_id", "fused_score", "fused_rank", "best_rank", F.transform("entries", lambda e: e["branch"]).alias("origins"),
        F.map_from_entries("entries").alias("branches"),
    )


def with_pool_scores(fused: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds dense_pool_score, a row's dense score in the whole pool, where there is one; no dense rank is made up."""
    scores = pool.select("query_id", F.col("chunk_id").alias("candidate_id"), F.col("score").alias("dense_pool_score"))
    return fused.join(scores, ["query_id", "candidate_id"], "left")
