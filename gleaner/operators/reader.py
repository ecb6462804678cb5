"""Where evidence stands in pages: heading links, the best block for a passage, and the state of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.sources import html as h

#: Least lengths for evidence and blocks, for a block inside evidence, for a sentence, for a window of words.
LEAST, LEAST_BLOCK, LEAST_SENTENCE, LEAST_WINDOW, WINDOW_WORDS = 20, 80, 40, 60, 18


def page_url(path: str | Column) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.concat(F.lit("/wiki/"), F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def _heading_key(c: Column) -> Column:
    return F.lower(t.squeeze(F.translate(F.coalesce(c, F.lit("")), "_", " ")))


def heading_links(sources: DataFrame, headings: DataFrame) -> DataFrame:
    """(source_id, path, section, subsection) by (path, text, parent, target) to sources with url.

    The subsection's heading, else the section's, if just one matches; one under the right section wins.
    """
    asked = sources.select(
        "source_id", "path", _heading_key(F.col("section")).alias("scope"),
        F.explode(F.array(F.struct(F.lit(0).alias("tier"), _heading_key(F.col("subsection")).alias("name")), F.struct(F.lit(1).alias("tier"), _heading_key(F.col("section")).alias("name")))).alias("a"),
    ).filter("a.name != ''")
    hits = asked.join(headings, "path").filter(F.col("text") == F.col("a.name")).withColumn("scoped", F.col("parent") == F.col("scope"))
    counts = hits.groupBy("source_id", "a.tier").agg(
        F.count(F.lit(1)).alias("all"), F.count_if("scoped").alias("scoped"), F.min("target").alias("any_target"), F.min(F.when(F.col("scoped"), F.col("target"))).alias("scoped_target")
    )
    target = F.when(F.col("scoped") == 1, F.col("scoped_target")).when((F.col("scoped") == 0) & (F.col("all") == 1), F.col("any_target"))
    best = counts.withColumn("target", target).filter("target is not null").groupBy("source_id").agg(F.min_by("target", "tier").alias("target"))
    out = sources.join(best, "source_id", "left")
    mark = F.when(F.col("target").isNotNull(), F.concat(F.lit("#"), F.replace(F.url_encode("target"), F.lit("+"), F.lit("%20")))).otherwise("")
    return out.withColumn("url", F.concat(page_url("path"), mark))


def locate_evidence(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_id, path, evidence) by (path, position, text) to the best block: (source_id, position, tier, matched).

    Tiers: 5 equal, 4 the block holds the evidence, 3 the evidence holds the block, 2 the block holds a
    sentence, 1 the block holds the evidence's first words.  Longer matches and then earlier blocks win.
    """
    wanted = evidence.withColumn("wanted", t.evidence_text("evidence")).filter(F.length("wanted") >= LEAST)
    wanted = wanted.withColumn("sentences", F.filter(F.transform(F.split("evidence", r"(?<=[.!?])\s+"), t.evidence_text), lambda s: F.length(s) >= LEAST_SENTENCE))
    wanted = wanted.withColumn("window", F.array_join(F.slice(F.split("wanted", " "), 1, WINDOW_WORDS), " "))
    plain = blocks.withColumn("block", t.evidence_text("text")).filter(F.length("block") >= LEAST).select("path", "position", "block")
    pairs = wanted.select("source_id", "path", "wanted", "sentences", "window").join(plain, "path")
    longest = F.array_max(F.transform(F.filter("sentences", lambda s: F.contains("block", s)), F.length))
    tier = (
        F.when(F.col("block") == F.col("wanted"), 5)
        .when(F.contains("block", "wanted"), 4)
        .when((F.length("block") >= LEAST_BLOCK) & F.contains("wanted", "block"), 3)
        .when(longest.isNotNull(), 2)
        .when((F.length("window") >= LEAST_WINDOW) & F.contains("block", "window"), 1)
    )
    matched = F.when(tier >= 4, F.length("wanted")).when(tier == 3, F.length("block")).when(tier == 2, longest).otherwise(F.length("window"))
    found = pairs.withColumn("tier", tier).filter("tier is not null").withColumn("matched", matched)
    best = Window.partitionBy("source_id").orderBy(F.desc("tier"), F.desc("matched"), "position")
    return found.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").select("source_id", "position", "tier", "matched")


def evidence_status(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_id, path, section, subsection, supplied_text) by (path, mimetype, html) to sources with url, evidence_status and preview.

    exact: the text is found in the page; section: its heading is; article: the page is; else unavailable.
    """
    known = pages.filter(F.col("mimetype") == "text/html")
    wanted = known.join(sources.select("path").distinct(), "path", "left_semi")
    heads = wanted.select("path", F.explode(h.headings("html")).alias("b")).select("path", "b.*")
    blocks = wanted.select("path", F.explode(h.readable("html")).alias("b")).select("path", "b.position", "b.text")
    linked = heading_links(sources, heads)
    found = locate_evidence(sources.select("source_id", "path", F.col("supplied_text").alias("evidence")), blocks).select("source_id", "tier")
    there = known.select("path", F.lit(True).alias("there"))
    out = linked.join(found, "source_id", "left").join(there, "path", "left")
    status = F.when(F.col("there").isNull(), "unavailable").when(F.col("tier").isNotNull(), "exact").when(F.col("target").isNotNull(), "section").otherwise("article")
    return out.withColumn("evidence_status", status).withColumn("preview", t.preview_excerpt("supplied_text")).drop("there", "tier", "target")
