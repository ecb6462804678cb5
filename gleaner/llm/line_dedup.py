"""Line deduplication by content-defined chunks of lines.

Every line with a word begins a chunk that ends with the next such line, blank lines between them
included.  So chunks overlap, and what stands around a passage decides nothing: a run of repeated lines
of any length is covered by its own chunks, and none of them is missed.  Chunks whose digest stands more
than once in the corpus are candidates; their bytes are compared with those of the first occurrence, the
one of the smallest id and then the earliest, and the lines of those that are equal go.  The first place
of a line with words always stays, as no chunk that holds it has an earlier equal.

Chunks are counted by partial sums.  Digests with more than one in HOT of all chunks, at most HOT of them,
are salted: their chunks spread over many keys, and what they are compared with is repeated for each key.

Cases: null texts count as empty; a text with one line of words has no multi-line chunk and stays as it
is, and so does a line that is repeated without a neighbour; of equal lines side by side the first stays;
rows that share an id (or have none) are documents of their own, in table order; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, column, map_arrow, materialize, text_slices

#: Lines with words in a chunk.
MOST = 2
#: A digest is frequent with more than one in so many of all chunks; keys that it is spread over.
HOT, SALTS = 1024, 64


def line_chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """Chunks of lines, from and to; neighbours share a line."""
    worded = [k for k, x in enumerate(lines) if x.strip()]
    return [(a, b + 1) for a, b in zip(worded, worded[MOST - 1 :], strict=False)]


def candidates(lines: list[bytes]) -> list[tuple[int, int, bytes]]:
    """Chunks: from, to and bytes."""
    return [(a, b, b"\n".join(lines[a:b])) for a, b in line_chunks(lines)]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, n_lines, n_chunks, removed_chunks, removed_lines, removed, clean_text.

    removed: line spans of the chunks that go; neighbours share a line, and their union is what goes.
    """
    rows = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("ids")).first()
    if counted["n"] == counted["ids"] and dict(rows.dtypes)["doc"] in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("id", F.col("doc").cast("bigint"))
    else:
        rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                owner, begins, found = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    for a, _, chunk in candidates(text.split(b"\n")):
                        owner.append(doc)
                        begins.append(a)
                        found.append(xxhash.xxh3_128_digest(chunk))
                halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner, pa.int64()), pa.array(begins, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    ["id", "begin", "h", "check"],
                )

    chunks = materialize(map_arrow(rows.select("id", "text"), digests, "id bigint, begin int, h bigint, check bigint"))
    repeated = chunks.groupBy("h", "check").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "begin")).alias("first")).filter("n > 1")
    repeated = materialize(repeated.withColumn("hot", F.col("n") * hot > chunks.count()))
    frequent = repeated.filter("hot").select("h", "check", "hot")  # fewer than `hot` rows of fixed size
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    spread = chunks.join(F.broadcast(frequent), ["h", "check"], "left").withColumn("salt", salt).drop("hot")
    flagged = spread.join(repeated.select("h", "check", "first", "hot", salts), ["h", "check", "salt"]).select(
        "id", F.struct("begin", "h", "check", "salt", "hot", (F.struct("id", "begin") == F.col("first")).alias("is_first")).alias("chunk")
    )
    lists = materialize(flagged.groupBy("id").agg(F.collect_list("chunk").alias("chunks")))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "begin", "h", "check", "salt", "hot", "is_first", "chunk"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
        for whole in batches:
            for batch in text_slices(whole, 1):
                out = []
                for doc, text, wanted in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    at = {c["begin"]: c for c in wanted}
                    for a, _, chunk in candidates(text.split(b"\n")):
                        if c := at.get(a):
                            out.append((doc, *c.values(), chunk))
                columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "id bigint, begin int, h bigint, check bigint, salt int, hot boolean, is_first boolean, chunk binary"
    texts = materialize(map_arrow(rows.select("id", "text").join(lists, "id"), texts_of, schema))
    first = texts.filter("is_first").select("h", "check", F.col("chunk").alias("bytes"), salts)
    gone = texts.filter("not is_first").join(first, ["h", "check", "salt"]).filter("chunk = bytes")
    removals = gone.groupBy("id").agg(F.collect_list("begin").alias("begins"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = (
        f"doc {kind}, n_lines bigint, n_chunks bigint, removed_chunks bigint, removed_lines bigint, "
        "removed array<struct<start:bigint,end:bigint>>, clean_text string"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [*[pa.int64()] * 4, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                out = []
                for text, begins in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    chunks, drop = line_chunks(lines), set(begins or ())
                    removed = [(a, b) for a, b in chunks if a in drop]
                    gone = {k for a, b in removed for k in range(a, b)}
                    kept = [x for k, x in enumerate(lines) if k not in gone]
                    spans = [{"start": a, "end": b} for a, b in removed]
                    out.append((len(lines), len(chunks), len(removed), len(gone), spans, b"\n".join(kept).decode()))
                columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    joined = rows.join(removals, "id", "left").select("doc", "text", "begins")
    return map_arrow(joined, clean, schema).withColumnRenamed("doc", id_col)
