"""Dated events from passages, and the periods that questions ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.functions.dates import MONTH, normalize_date

#: Classes of milestones.
MILESTONES = (
    r"defenestrat|assassinat|outbreak|revolt|rebellion",
    r"war began|war ended|ending the war|peace|treaty|signed",
    r"battle|siege|invad|landed|interven|surrender",
)
PERIOD = r"(?i)(?:between|from)\s+(\d{3,4})\s+(?:and|to|[–-])\s+(\d{3,4})"
#: Words of a question on endpoints that say nothing about its subject.
ENDPOINT_STOPS = ("outline", "sequence", "from", "major", "events", "connected", "outbreak", "beyond", "between")


def sentences(paragraph: Column) -> Column:
    return F.split(F.trim(paragraph), r"(?<=[.!?])\s+(?=[A-Z])")


def extract_events(hits: DataFrame, max_events: int = 24, bounds: bool = False) -> DataFrame:
    """Dated events of each query's hits, in order of time: at most max_events, kept by salience.

    hits: (query_id, position, article_path, section, subsection, chunk_id, text, score) and, with
    bounds, low and high years.  An event is a sentence with a date, and the next one if that has none;
    a bare year as heading dates the sentences below it.  Of equal events the first hit's stays.
    """
    heading = F.coalesce(F.when(F.col("subsection") != "", F.col("subsection")), F.col("section"), F.lit(""))
    year = F.when(F.trim(heading).rlike(r"^\d{3,4}$"), normalize_date(heading))
    rows = hits.withColumn("_heading_date", year)
    rows = rows.select("*", F.posexplode(F.split("text", "\n")).alias("_paragraph_no", "_paragraph"))
    rows = rows.withColumn("_all", sentences(F.col("_paragraph"))).withColumn(
        "_dates", F.transform("_all", lambda s: normalize_date(F.when(F.startswith(s, F.lit("Date:")), F.substring_index(s, ";", 1)).otherwise(s)))
    )
    # Only whether the next sentence has a date is asked for, so the first one's does not matter.
    rows = rows.withColumn("_plain_dates", F.transform("_all", lambda s, i: F.when(i > 0, normalize_date(s))))
    entries = F.transform(
        "_all",
        lambda s, i: F.struct(
            i.alias("no"),
            s.alias("sentence"),
            F.get("_dates", i).alias("date"),
            F.get("_all", i + 1).alias("next"),
            F.get("_plain_dates", i + 1).isNull().alias("next_undated"),
            F.get("_all", i - 1).alias("before"),
        ),
    )
    rows = rows.select(*hits.columns, "_heading_date", "_paragraph_no", F.explode(entries).alias("e"))
    partial = F.col("e.sentence").rlike(rf"(?i)^(?:On |By )?\d{{1,2}}\s+{MONTH},")
    rows = rows.filter((F.col("e.sentence") != "") & ~partial)
    rows = rows.withColumn("date", F.coalesce("e.date", "_heading_date")).filter(F.col("date").isNotNull())
    rows = rows.withColumn("heading_date", F.col("e.date").isNull())
    if bounds:
        rows = rows.filter(F.col("low").isNull() | F.col("date.year").between(F.col("low"), F.col("high")))
    event = F.concat_ws(" ", "e.sentence", F.when(F.col("e.next_undated"), F.col("e.next")))
    rows = rows.withColumn("event", event).withColumn("_key", F.lower(F.regexp_replace("event", r"\s+", " ")))
    first = Window.partitionBy("query_id", "_key").orderBy("position", "_paragraph_no", "e.no")
    rows = rows.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    salience = F.col("score") + 0.12 * sum((F.lower("event").rlike(p).cast("int") for p in MILESTONES), F.lit(0))
    rows = rows.withColumn("salience", salience)
    chrono = ["date.year", "date.month", "date.day", "article_path", "chunk_id", "_paragraph_no", "e.no"]
    by_year = Window.partitionBy("query_id", "date.year").orderBy(F.desc("salience"), *chrono)
    rows = rows.withColumn("_best_of_year", F.row_number().over(by_year) == 1)
    keep = Window.partitionBy("query_id").orderBy(F.desc("_best_of_year"), F.desc("salience"), *chrono)
    rows = rows.withColumn("_keep", F.row_number().over(keep)).filter(F.col("_keep") <= max_events)
    order = Window.partitionBy("query_id").orderBy(*chrono)
    return rows.select(
        "query_id", F.row_number().over(order).alias("event_no"), "date.*", "event", F.col("article_path").alias("source_article"), "section", "subsection",
        "chunk_id", "score", "heading_date", F.coalesce("e.before", F.lit("")).alias("supporting_context"),
    )


def event_hits(events: DataFrame) -> DataFrame:
    """Each event as a hit of its chunk, with its date."""
    lead = F.when(F.col("supporting_context") != "", F.concat(F.lit("Sentence before: "), "supporting_context", F.lit("\n"))).otherwise("")
    body = F.when(F.col("heading_date"), F.concat("date_text", F.lit(" — "), "event")).otherwise(F.concat(F.lit("With date: "), "event"))
    return events.select(
        "query_id", F.col("event_no").alias("position"), "chunk_id", F.col("source_article").alias("article_path"), "section", "subsection",
        F.concat(lead, body).alias("text"), "score", "date_text", F.col("precision").alias("date_precision"), "approximate",
        F.struct("year", "month", "day").alias("sortable_date"),
    )


def dated_records(hits: DataFrame, count: int = 10, otherwise: int = 8) -> DataFrame:
    """Dated records of the best section (`Date:` then `Battle:` or `Event:`), evenly sampled in source order; without any, the first hits."""
    dated = hits.withColumn("_dated", F.col("text").rlike(r"(?s)Date:.*(?:Battle|Event):"))
    group = Window.partitionBy("query_id", "article_path", "section", "subsection", "_dated")
    dated = dated.withColumn("_best", F.when(F.col("_dated"), F.max("score").over(group)))
    query = Window.partitionBy("query_id")
    top = F.max_by(F.struct("article_path", "section", "subsection"), F.struct("_best", -F.col("position"))).over(query)
    dated = dated.withColumn("_top", F.when(F.max("_dated").over(query), top))
    chosen = F.col("_dated") & F.struct("article_path", "section", "subsection").eqNullSafe(F.col("_top"))
    dated = dated.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    in_order = Window.partitionBy("query_id", "_chosen").orderBy("chunk_id")
    dated = dated.withColumn("_no", F.row_number().over(in_order) - 1).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("query_id", "_chosen")))
    sampled = F.col("_chosen") & F.array_contains(t.even_positions(F.col("_size").cast("int"), count), F.col("_no").cast("int"))
    plain = F.col("_top").isNull() & (F.col("position") <= otherwise)
    return dated.filter(sampled | plain).select(*hits.columns)


def infer_period(plans: DataFrame, chunks: DataFrame, window: int = 30) -> DataFrame:
    """(query_id, question, resolved_question, anchor_year) to (query_id, low, high), null without a period.

    The year that a follow-up is anchored to, else a span in the question, else the span that the
    introduction of an article states whose title's words all stand in the question.
    """
    asked = lambda n: F.regexp_extract("question", PERIOD, n)
    own = F.when(F.col("anchor_year").isNotNull(), F.struct(F.col("anchor_year").cast("int").alias("low"), (F.col("anchor_year") + window).cast("int").alias("high"))).when(
        asked(1) != "", F.struct(asked(1).cast("int").alias("low"), asked(2).cast("int").alias("high"))
    )
    lead = F.substring("text", 1, 1000)
    stated = chunks.filter((F.col("section") == "Introduction") & lead.rlike(PERIOD)).select(
        "article_path", "chunk_id", t.all_words(F.translate("article_path", "_", " ")).alias("title"),
        F.struct(F.regexp_extract(lead, PERIOD, 1).cast("int").alias("low"), F.regexp_extract(lead, PERIOD, 2).cast("int").alias("high")).alias("span"),
    )
    # Titles meet questions by the word that the fewest titles have, so a common word brings nobody together; then the whole title is checked.
    each = stated.select("article_path", "chunk_id", F.explode(F.array_distinct("title")).alias("word"))
    rare = each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("titles")), "word")
    rare = rare.groupBy("article_path", "chunk_id").agg(F.min_by("word", F.struct("titles", "word")).alias("word"))
    keyed = stated.join(rare, ["article_path", "chunk_id"])
    asks = plans.select("query_id", F.array_distinct(t.all_words("resolved_question")).alias("asked"))
    asks = asks.withColumn("word", F.explode("asked"))
    matched = asks.join(keyed, "word").filter(F.size(F.array_except("title", "asked")) == 0)
    first = matched.groupBy("query_id").agg(F.min_by("span", F.struct("article_path", "chunk_id")).alias("span"))
    found = plans.select("query_id", own.alias("own")).join(first, "query_id", "left").withColumn("period", F.coalesce("own", "span"))
    return found.select("query_id", "period.low", "period.high")


def endpoint_period(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, question) to (query_id, low, high) for questions on a sequence of events.

    From the first sentence of the introduction that shares most words, three at least, with the question:
    its least and greatest years.
    """
    asks = plans.filter(F.col("question").rlike(r"(?i)\b(?:sequence\s+from|events\s+connected)\b"))
    asks = asks.select("query_id", F.array_except(t.words("question"), t.text_array(ENDPOINT_STOPS)).alias("asked"))
    lead = F.get(F.split("text", r"(?<=[.!?])\s+"), 0)
    leads = chunks.filter((F.col("section") == "Introduction") & F.endswith("chunk_id", F.lit("_000"))).select("article_path", lead.alias("lead"))
    years = F.transform(F.regexp_extract_all("lead", F.lit(r"\b\d{4}\b"), F.lit(0)), lambda y: y.cast("int"))
    leads = leads.withColumn("years", years).filter(F.size("years") > 0).withColumn("words", t.words("lead"))
    pairs = asks.select("query_id", F.explode("asked").alias("word")).join(leads.select("article_path", "years", F.explode("words").alias("word")), "word")
    shared = pairs.groupBy("query_id", "article_path").agg(F.count(F.lit(1)).alias("shared"), F.first("years").alias("years")).filter("shared >= 3")
    best = shared.groupBy("query_id").agg(F.min_by("years", F.struct(-F.col("shared"), "article_path")).alias("years"))
    return best.select("query_id", F.array_min("years").alias("low"), F.array_max("years").alias("high"))


def focus_pool(pool: DataFrame, plans: DataFrame) -> DataFrame:
    """For anchored follow-ups the pool is the first matched article's; other pools stay."""
    facts = plans.select("query_id", F.when(F.col("anchor_year").isNotNull(), F.get("matched_articles", 0)).alias("_only"))
    return pool.join(facts, "query_id").filter(F.col("_only").isNull() | (F.col("article_path") == F.col("_only"))).drop("_only")


def valid_entries(entries: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """A model's timeline entries (query_id, entry_no, source_label, summary) that hold against their sources.

    The label is a known one, the summary's years all stand in the source, and of entries with one label
    the first stays; at most `limit`, in order of the sources' dates.
    """
    known = sources.select("query_id", F.col("label").alias("source_label"), "date_text", "sortable_date", "supplied_text")
    joined = entries.join(known, ["query_id", "source_label"])
    years = lambda c: F.regexp_extract_all(c, F.lit(r"\b\d{3,4}\b"), F.lit(0))
    grounded = F.size(F.array_except(years(F.col("summary")), years(F.concat_ws(" ", "date_text", "supplied_text")))) == 0
    joined = joined.filter((F.trim("summary") != "") & grounded)
    unseen = Window.partitionBy("query_id", "source_label").orderBy("entry_no")
    joined = joined.withColumn("_nth", F.row_number().over(unseen)).filter("_nth = 1")
    first = Window.partitionBy("query_id").orderBy("entry_no")
    joined = joined.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= limit)
    order = Window.partitionBy("query_id").orderBy("sortable_date", "entry_no")
    return joined.withColumn("line_no", F.row_number().over(order)).select("query_id", "line_no", "date_text", "summary", "source_label")
