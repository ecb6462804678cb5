"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the partitions name the digests that may be frequent.  Their groups are
counted exactly and the winners, at most ``counters`` + 1 rows, are broadcast: rows of frequent
digests are settled without a shuffle.  All other digests are shuffled in the ordinary way, and no
group among them can be larger than 2 / ``counters`` of all rows.

Cases: a null text counts as an empty one; the row with the largest doc_id stays (null is smallest);
of repeated rows with that doc_id one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import column, fresh, materialize, small, tidy


def digest(text: str | Column) -> Column:
    """SHA-256 of the UTF-8 text, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(column(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256))


def merge_summaries(counts: dict[bytes, int], more: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Misra-Gries merge: add the counts, then take the (counters + 1)-th largest from each."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def summaries(keys: DataFrame, counters: int) -> DataFrame:
    """One Misra-Gries summary per partition of the single binary column of `keys`: rows (digest, n)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            more = dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True))
            counts = merge_summaries(counts, more, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"]
        )

    return keys.mapInArrow(tidy(kernel), "digest binary, n bigint")


def heavy_hitters(rows: DataFrame, total: int, counters: int) -> DataFrame:
    """Digests of (digest) rows whose summed counters allow more than total / (counters + 1) rows; at most counters + 1."""
    return (
        summaries(rows.select("digest"), counters)
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") * F.lit(counters + 1) >= F.lit(total))
        .filter(F.col("n") > 1)
        .select("digest")
    )


def settle(rows: DataFrame, counters: int | None = None) -> DataFrame:
    """For materialized rows (id, row_id, digest): adds keep (id, row_id) and group_size."""
    if counters is None:
        counters = max(1024, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    candidates = heavy_hitters(rows, rows.count(), counters)
    winners = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    marked = rows.join(F.broadcast(materialize(winners)), "digest", "left")
    heavy = marked.filter(F.col("group_size").isNotNull())
    group = Window.partitionBy("digest")
    rest = (
        marked.filter(F.col("group_size").isNull())
        .select(*rows.columns)
        .select(
            *rows.columns,
            F.max(F.struct("id", "row_id")).over(group).alias("keep"),
            F.count(F.lit(1)).over(group).alias("group_size"),
        )
    )
    return heavy.select(*rest.columns).unionByName(rest)


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialize(
        docs.select(column(id_col).alias("id"), digest(text_col).alias("digest")).withColumn(
            "row_id", F.monotonically_increasing_id()
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    found = settle(digest_rows(docs, id_col, text_col), counters)
    return found.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops, with their own columns, whatever their names."""
    rows = digest_rows(docs, id_col, text_col)
    found = settle(rows, counters)
    gone_id = fresh("gone", docs)
    gone = materialize(found.filter(F.col("row_id") != F.col("keep.row_id")).select(F.col("id").alias(gone_id)))
    dropped = gone.count()
    if rows.join(small(gone.distinct(), dropped), F.col("id").eqNullSafe(F.col(gone_id)), "left_semi").count() == dropped:
        # The ids of dropped rows, null among them, stand on no other row.
        return docs.join(small(gone, dropped), docs[f"`{id_col}`"].eqNullSafe(F.col(gone_id)), "left_anti")
    # Rows are told apart by id and digest, and equal ones thinned to one.
    own, stay_id, stay_digest = (fresh(x, docs) for x in ("own_digest", "stay_id", "stay_digest"))
    stay = found.filter(F.col("row_id") == F.col("keep.row_id")).select(F.col("id").alias(stay_id), F.col("digest").alias(stay_digest))
    named = docs.withColumn(own, digest(text_col))
    same = column(id_col).eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_digest))
    return named.join(stay, same, "left_semi").dropDuplicates([id_col, own]).select(*map(column, docs.columns))
