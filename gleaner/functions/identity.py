"""Identity and validity of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import estimate_tokens


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def candidate_id(df: DataFrame, corpus_version: str, chunker_version: str) -> Column:
    """A digest of versions, canonical article, headings, offsets and text: the same under an alias, new with a version."""
    article = F.coalesce(F.col("canonical_article_id"), F.col("article_path")) if "canonical_article_id" in df.columns else F.col("article_path")
    parts = [F.lit(corpus_version), F.lit(chunker_version), article]
    parts += [_optional(df, c).cast("string") for c in ("section", "subsection", "start_offset", "end_offset")]
    return F.sha2(F.to_json(F.array(*parts, F.col("text")), {"ignoreNullFields": "false"}), 256)


def adapt_hits(hits: DataFrame, corpus_version: str, chunker_version: str, blank: str = "error") -> DataFrame:
    """Hits as candidates with empty provenance; blank paths, ids or texts are an error.

    blank `keep`, for whole tables: their rows stay; what is null has no candidate_id, and a null text no estimate.
    """
    if not corpus_version or not chunker_version:
        raise ValueError("corpus and chunker versions are required")
    if blank not in ("error", "keep"):
        raise ValueError(f"no such policy: {blank}")
    required = ("article_path", "chunk_id", "text")
    if blank == "keep":
        whole = F.lit(True)
        for name in required:
            whole = whole & F.col(name).isNotNull()
        adapted = _adapted(hits, corpus_version, chunker_version)
        return adapted.withColumns({"candidate_id": F.when(whole, F.col("candidate_id")), "estimated_text_tokens": F.when(F.col("text").isNotNull(), F.col("estimated_text_tokens"))})
    checked = hits
    for name in required:
        empty = F.col(name).isNull() | (F.trim(F.col(name)) == "")
        checked = checked.withColumn(name, F.when(empty, F.raise_error(F.lit(f"evidence requires {name}"))).otherwise(F.col(name)))
    return _adapted(checked, corpus_version, chunker_version)


def _adapted(hits: DataFrame, corpus_version: str, chunker_version: str) -> DataFrame:
    article = F.coalesce("canonical_article_id", "article_path") if "canonical_article_id" in hits.columns else F.col("article_path")
    branch = "map<string,struct<score:double,rank:int,direction:string>>"
    return hits.withColumns(
        {
            "candidate_id": candidate_id(hits, corpus_version, chunker_version),
            "canonical_article": article,
            "corpus_version": F.lit(corpus_version),
            "chunker_version": F.lit(chunker_version),
            "origins": F.array().cast("array<string>"),
            "branches": F.create_map().cast(branch),
            "fused_score": F.lit(None).cast("double"),
            "fused_rank": F.lit(None).cast("int"),
            "estimated_text_tokens": estimate_tokens("text"),
        }
    )
