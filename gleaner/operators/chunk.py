"""Chunks of articles: paragraphs joined up to a size, with whole paragraphs carried over.

The fold is sequential in an article, so it runs on the array of its blocks, as a JVM aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n"


def _carry(paragraphs: Column, overlap: int) -> Column:
    """Whole paragraphs from the end: the last one always, earlier ones while all together stay within the overlap."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        stop = acc["done"] | ((F.size(acc["kept"]) > 0) & (acc["size"] + F.length(p) > overlap))
        size = F.when(stop, acc["size"]).otherwise(acc["size"] + F.length(p))
        return F.struct(
            F.when(stop, acc["kept"]).otherwise(F.concat(F.array(p), acc["kept"])).alias("kept"), size.alias("size"), (stop | (size >= overlap)).alias("done")
        )

    return F.aggregate(F.reverse(paragraphs), start, step, lambda acc: acc["kept"])


def chunk_array(blocks: Column, max_chars: int = 2000, overlap_chars: int = 300) -> Column:
    """Blocks array<struct<type,text>> in order to chunks array<struct<section,subsection,text>>.

    An h2 begins a section and clears the subsection, an h3 begins a subsection; neither carries over.
    A paragraph that would make the chunk too long begins the next one, after what is carried over.
    """
    chunk = "array<struct<section:string,subsection:string,text:string>>"
    start = F.struct(
        F.array().cast(chunk).alias("done"), F.lit("Introduction").alias("section"), F.lit(None).cast("string").alias("subsection"),
        F.array().cast("array<string>").alias("now"),
    )

    def flushed(acc: Column) -> Column:
        made = F.struct(acc["section"].alias("section"), acc["subsection"].alias("subsection"), F.trim(F.array_join(acc["now"], SEPARATOR)).alias("text"))
        return F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(made).cast(chunk))).otherwise(acc["done"])

    def step(acc: Column, block: Column) -> Column:
        empty = F.array().cast("array<string>")
        heading = block["type"].isin("h2", "h3")
        long = F.length(F.array_join(F.concat(acc["now"], F.array(block["text"])), SEPARATOR)) > max_chars
        flush = heading | (long & (F.size(acc["now"]) > 0))
        now = F.when(heading, empty).otherwise(
            F.concat(F.when(flush, _carry(acc["now"], overlap_chars)).otherwise(acc["now"]), F.array(block["text"]))
        )
        return F.struct(
            F.when(flush, flushed(acc)).otherwise(acc["done"]).alias("done"),
            F.when(block["type"] == "h2", block["text"]).otherwise(acc["section"]).alias("section"),
            F.when(block["type"] == "h2", None).when(block["type"] == "h3", block["text"]).otherwise(acc["subsection"]).alias("subsection"),
            now.alias("now"),
        )

    return F.aggregate(blocks, start, step, flushed)


def chunk_articles(articles: DataFrame, max_chars: int = 2000, overlap_chars: int = 300) -> DataFrame:
    """(article_path, blocks) to rows (article_path, chunk_no, chunk_id, section, subsection, text)."""
    found = articles.select("article_path", F.posexplode(chunk_array(F.col("blocks"), max_chars, overlap_chars)).alias("chunk_no", "c"))
    name = F.concat(F.col("article_path"), F.lit("_"), F.lpad(F.col("chunk_no").cast("string"), 3, "0"))
    # Numbers beyond 999 keep all their digits.
    name = F.when(F.col("chunk_no") < 1000, name).otherwise(F.concat(F.col("article_path"), F.lit("_"), F.col("chunk_no").cast("string")))
    return found.select("article_path", "chunk_no", name.alias("chunk_id"), "c.section", "c.subsection", "c.text")


def paragraphs(text: str | Column, separator: str = "\n") -> Column:
    """A plain text's paragraphs as blocks."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), separator), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.lit("p").alias("type"), p.alias("text")))
