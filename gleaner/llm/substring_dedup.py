"""Substring deduplication by content-defined chunking.

A gear rolling hash over the UTF-8 bytes places the ends of chunks, so an insertion shifts no more
than the chunks around it.  Chunks are compared by digest over all documents; where a run of chunks,
each found in more than one document, is long enough, the run is a repeated passage.  The document
with the smallest id keeps a chunk, the others lose it.

Misra-Gries summaries name the digests that may be frequent.  What is to be known of these, at most a
few thousand rows, is broadcast, and their chunks are dealt out by document; all other chunks meet by
digest, and no digest among them has more than 2 / counters of all chunks.

Cases: null texts count as empty and have no chunks; a chunk repeated within one document only stays;
rows that share an id (or have none) are documents of their own, in table order; of equal texts the
first by id stays whole, and the others lose all of it; cuts never split a character; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, column, map_arrow, materialize, text_slices
from gleaner.llm.minhash import mix

#: Least and most bytes of a chunk (below 256), and how many high bits of the hash are zero at its end.
LEAST, MOST, BITS = 8, 96, 4
#: Bytes that a run of repeated chunks needs to be a passage.
MIN_RUN = 96
#: The hash has 16 bits, so it forgets a byte after as many steps: chunks agree soon after a passage begins.
REACH = 16
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """hash[i] = (hash[i - 1] << 1) + GEAR[data[i]] in REACH bits, for all i: windows are doubled up to REACH bytes."""
    h = GEAR[data]
    width = 1
    while width < REACH:
        h[width:] += h[:-width] << np.uint16(width)  # the right side is computed before it is added
        width *= 2
    return h


def chunk_ends(texts: list[bytes], least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[list[int]]:
    """Ends of the chunks of each text."""
    gap = bytes(REACH)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)  # each text begins after the same bytes
    cuts = np.flatnonzero(gear_hash(data) >> np.uint16(REACH - bits) == 0) + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = REACH + np.cumsum(sizes + REACH) - (sizes + REACH)
    first = np.searchsorted(cuts, begins, side="right")
    last = np.searchsorted(cuts, begins + sizes, side="left")
    out = []
    for begin, size, a, b in zip(begins.tolist(), sizes.tolist(), first.tolist(), last.tolist(), strict=True):
        ends, now = [], 0
        for cut in (cuts[a:b] - begin).tolist():
            while cut - now > most:
                now += most
                ends.append(now)
            if cut - now >= least:
                ends.append(cut)
                now = cut
        while size - now > most:
            now += most
            ends.append(now)
        if size > now:
            ends.append(size)
        out.append(ends)
    return out


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of the chunks of all texts: 64 bits of the digest, 24 more with the size below them, start; and how many each text has."""
    digest = xxhash.xxh3_128_digest
    found, starts, ends_of, counts = [], [], [], []
    for text, ends in zip(texts, chunk_ends(texts), strict=True):
        begins = [0, *ends[:-1]] if ends else []
        found += [digest(text[a:b]) for a, b in zip(begins, ends, strict=True)]
        starts += begins
        ends_of += ends
        counts.append(len(ends))
    halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    start = np.array(starts, np.int64)
    check = (halves[:, 1] & 0xFFFFFF) << 8 | (np.array(ends_of, np.int64) - start)
    return halves[:, 0], check.astype(np.uint32).view(np.int32), start.astype(np.int32), counts


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(id, text) to rows (h, check, id, start): the digest's parts, the second with the chunk's size in its last 8 bits."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                h, check, start, counts = digests(as_bytes(batch.column(1)))
                owner = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(check), owner, pa.array(start)], ["h", "check", "id", "start"])

    return map_arrow(docs, kernel, "h bigint, check int, id bigint, start int")


def merge_counts(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries merge of (key, count) pairs: add by key, then take the (counters + 1)-th largest from each."""
    keys, whose = np.unique(keys, return_inverse=True)
    counts = np.bincount(whose, counts, len(keys)).astype(np.int64)
    if len(keys) > counters:
        counts = counts - np.partition(counts, len(keys) - counters - 1)[len(keys) - counters - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def heavy_digests(docs: DataFrame, counters: int) -> DataFrame:
    """The h of (id, text) rows that may belong to more than one in counters + 1 of all chunks; at most counters + 1 rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for whole in batches:
            for batch in text_slices(whole, 1):
                h = digests(as_bytes(batch.column(1)))[0]
                total += len(h)
                keys, counts = merge_counts(np.r_[keys, h], np.r_[counts, np.ones(len(h), np.int64)], counters)
        names = pa.array([None, *keys.tolist()], pa.int64())  # null: all chunks
        yield pa.RecordBatch.from_arrays([names, pa.array(np.r_[total, counts].astype(np.int64))], ["h", "n"])

    summed = materialize(map_arrow(docs, kernel, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = (summed.filter("h is null").first() or {"n": 0})["n"]
    return summed.filter("h is not null and n > 1").filter(F.col("n") * F.lit(counters + 1) >= F.lit(total)).select("h")


def repeated_chunks(docs: DataFrame, counters: int | None = None) -> DataFrame:
    """(id, text) to rows (id, packed) of the chunks that several documents have: start, size and whether this one loses it."""
    if counters is None:
        counters = max(1024, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = chunk_rows(docs)
    ends = (F.min("id").alias("first"), F.max("id").alias("last"))
    winners = chunks.join(F.broadcast(heavy_digests(docs, counters)), "h", "left_semi").groupBy("h", "check").agg(*ends)
    marked = chunks.join(F.broadcast(materialize(winners)), ["h", "check"], "left")
    # Chunks of frequent digests need no others: the document's own hash deals them out evenly.
    salt = F.when(F.col("first").isNotNull(), F.xxhash64("id")).otherwise(F.lit(0))
    group = Window.partitionBy("h", "check", "salt")
    found = marked.withColumn("salt", salt).select(
        "id", "start", "check", F.coalesce("first", F.min("id").over(group)).alias("keeper"), F.coalesce("last", F.max("id").over(group)).alias("other")
    )
    size = F.col("check").bitwiseAND(F.lit(0xFF))
    gone = (F.col("id") != F.col("keeper")).cast("bigint")
    return found.filter("keeper < other").select("id", (F.col("start").cast("bigint") * 512 + size * 2 + gone).alias("packed"))


def runs(packed: list[int], min_run: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Runs of adjacent chunks of min_run bytes or more: start, end and the spans that go."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for x in sorted(packed):
        a = x >> 9
        b = a + (x >> 1 & 0xFF)
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, []))
        if x & 1:
            gone = out[-1][2]
            if gone and gone[-1][1] == a:
                gone[-1] = (gone[-1][0], b)
            else:
                gone.append((a, b))
    return [r for r in out if r[1] - r[0] >= min_run]


def whole_characters(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span that holds whole characters."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, counters: int | None = None
) -> DataFrame:
    """One row per document: id, n_bytes, n_chunks, has_repeats, repeat_bytes, removed_bytes, repeats, removed, clean_text.

    repeats: byte spans of passages that other documents have too; removed: what goes from them.
    """
    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("ids")).first()
    if found["n"] == found["ids"] and dict(rows.dtypes)["doc"] in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("id", F.col("doc").cast("bigint"))
    else:
        rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()))
    lists = repeated_chunks(rows.select("id", "text"), counters).groupBy("id").agg(F.collect_list("packed").alias("chunks"))
    joined = rows.join(lists, "id", "left").select("doc", "text", "chunks")
    kind = joined.schema["doc"].dataType.simpleString()
    span = "array<struct<start:bigint,end:bigint>>"
    schema = (
        f"doc {kind}, n_bytes bigint, n_chunks bigint, has_repeats boolean, repeat_bytes bigint, removed_bytes bigint, "
        f"repeats {span}, removed {span}, clean_text string"
    )
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), spans, spans, pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                texts = as_bytes(batch.column(1))
                many = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
                upto = np.cumsum(many).tolist()
                packed = batch.column(2).flatten().to_numpy()
                out = []
                for text, ends, n, to in zip(texts, chunk_ends(texts), many.tolist(), upto, strict=True):
                    passages = runs(packed[to - n : to].tolist(), min_run) if n else []
                    gone = [whole_characters(text, a, b) for _, _, spans in passages for a, b in spans]
                    gone = [x for x in gone if x[0] < x[1]]
                    clean, at = [], 0
                    for a, b in gone:
                        clean.append(text[at:a])
                        at = b
                    clean.append(text[at:])
                    repeats = [{"start": a, "end": b} for a, b, _ in passages]
                    removed = [{"start": a, "end": b} for a, b in gone]
                    out.append((len(text), len(ends), bool(repeats), sum(b - a for a, b, _ in passages), sum(b - a for a, b in gone), repeats, removed, b"".join(clean).decode()))
                columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return map_arrow(joined, kernel, schema).withColumnRenamed("doc", id_col)
