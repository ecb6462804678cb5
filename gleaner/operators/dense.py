"""Exact vector search: cosine top-k of many queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.best import Best

#: Query vectors that one pass over the corpus compares with; more are taken in further passes.
QUERY_BLOCK = 4096


def check_vectors(df: DataFrame, column: str = "vector") -> DataFrame:
    """df, where an empty, non-finite or zero vector is an error."""
    v = F.col(column)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit("vectors must be finite and not zero"))).otherwise(v))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: str | Column) -> Column:
    """The vector over its length, in double precision."""
    v = F.col(v) if isinstance(v, str) else v
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of equal length; other lengths are an error."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector lengths differ")).cast("double")).otherwise(dot(a, b) / (norm(a) * norm(b)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = len(flat) // max(1, len(vectors))
    if len(flat) != size * len(vectors):
        raise ValueError("vector lengths differ")
    matrix = flat.reshape(len(vectors), size)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    if not np.isfinite(matrix).all() or not lengths.all():
        raise ValueError("vectors must be finite and not zero")
    return matrix / lengths


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 40, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vector) by (chunk_id, vector) to the best k of each query: (query_id, chunk_id, score, rank).

    Ties go to the smaller chunk_id.  A block of queries, of bounded size, goes to all partitions; each
    gives back its own best k for every query, so k rows per query and partition are shuffled.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    found = None
    numbered = queries.select("query_id", "vector")
    passes = max(1, -(-numbered.count() // block))
    for turn in range(passes):
        part = numbered.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn) if passes > 1 else numbered
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        ids, matrix = rows.column(0).combine_chunks(), _matrix(rows.column(1).combine_chunks())
        best = _partial_topk(corpus.select("chunk_id", "vector"), ids, matrix, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}"
        found = queries.sparkSession.createDataFrame([], f"{kinds}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Scores that a worker holds at once (16 MB).
BLOCK_CELLS = 1 << 21


def _partial_topk(corpus: DataFrame, ids: pa.Array, matrix: np.ndarray, k: int) -> DataFrame:
    names = ["query_id", "chunk_id", "score"]
    query_kind = {pa.int32(): "int", pa.int64(): "bigint"}.get(ids.type, "string")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = None, max(1, BLOCK_CELLS // max(1, len(ids)))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                best = best or Best(len(ids), k, batch.column(0).type)
                best.add(-np.round(matrix @ _matrix(batch.column(1)).T, 12), batch.column(0))
        if best:
            yield best.rows(names, ids, -1.0)

    return corpus.mapInArrow(kernel, f"query_id {query_kind}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double")


def blend(base: DataFrame, intent: DataFrame, weight: float = 0.6) -> DataFrame:
    """Two score sets of the same rows in one: weight * base + (1 - weight) * intent."""
    other = intent.select("query_id", "chunk_id", F.col("score").alias("intent_score"))
    joined = base.select("query_id", "chunk_id", F.col("score").alias("base_score")).join(other, ["query_id", "chunk_id"])
    return joined.withColumn("score", weight * F.col("base_score") + (1 - weight) * F.col("intent_score"))


def consolidate(scored: DataFrame) -> DataFrame:
    """Scores of several sub-queries as one branch: the best of each row."""
    return scored.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def endpoint_sides(c: str | Column) -> Column:
    """The two ends of a question `from X to Y`; null if it is not one."""
    text = F.col(c) if isinstance(c, str) else c
    pattern = r"(?i)\bfrom\s+(.+?)\s+to\s+(.+?)[?.!]*$"
    sides = F.array(F.trim(F.regexp_extract(text, pattern, 1)), F.trim(F.regexp_extract(text, pattern, 2)))
    return F.when(text.rlike(pattern), sides)


def check_versions(queries: DataFrame, corpus: DataFrame, column: str = "embedding_version") -> None:
    """Queries and corpus embedded by different models are an error."""
    both = queries.select(column).unionByName(corpus.select(column)).distinct().limit(2).count()
    if both > 1:
        raise ValueError("queries and corpus were embedded by different models")


def uncached(chunks: DataFrame, cache: DataFrame, digest: str, text: str = "text") -> DataFrame:
    """Chunks whose vector is not in the cache (key, vector), with their key: digest of model and text."""
    keyed = chunks.withColumn("key", F.sha2(F.to_json(F.array(F.lit(digest), F.col(text))), 256))
    return keyed.join(cache.select("key"), "key", "left_anti")
