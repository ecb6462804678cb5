"""Which articles a question is about: titles, full text, links and entities, merged with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.operators.sizes import bounded

#: Words that begin and end no phrase, and titles that name nothing.
STOPWORDS = tuple(
    "what why how when where who which did does do was were is are the a an of to in on for and or about tell me explain describe please give show create make "
    "provide construct build list timeline chronology chronological happen happened next most immediate those that these their they them he she his her it "
    "one latter former".split()
)
GENERIC_TITLES = (
    "cause", "causes", "caused", "effects", "impact", "begin", "start", "end", "ended", "role", "result", "results", "consequences", "war", "history",
    "battle", "battles", "events", "collapse", "collapsed", "spread", "comparison", "european", "year", "beyond", "revolution",
)
MEDIA = r"(?i)\((?:wargame|board.game|video.game|novel|film|album|song|disambiguation)\)"
ASKS_MEDIA = r"(?i)game|novel|film|album|song"
#: Words of links that lead on, and stop words of link scores.
CUES = (
    "crisis", "conflict", "reform", "revolution", "war", "treaty", "political", "military", "social", "economic", "collapse", "assassination", "aftermath",
    "consequence", "revolt",
)
LINK_STOPS = ("the", "a", "an", "of", "to", "in", "what", "why", "how", "did", "does", "cause", "caused", "causes", "after", "before", "and", "or")
LINK_WEIGHTS = {"overlap": 0.48, "anchor": 0.27, "cues": 0.15, "lead": 0.10}
MAX_PHRASES, MAX_WORDS = 48, 6


def _question_words(question: Column) -> Column:
    plain = F.regexp_replace(question, r"(?U)[’']s\b", "")
    return F.regexp_extract_all(plain, F.lit(r"(?U)[\w’']+"), F.lit(0))


def phrases(question: str | Column) -> Column:
    """Runs of up to six words, longest first, that neither begin nor end with a stop word: the first 48, distinct."""
    return t.let(_question_words(F.col(question) if isinstance(question, str) else question), _phrases)


def _phrases(words: Column) -> Column:
    n = F.size(words)
    stops = t.text_array(STOPWORDS)

    def runs(size: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(words, i, size))
        edge = lambda p, at: F.array_contains(stops, F.lower(F.element_at(p, at)))
        return F.transform(F.filter(parts, lambda p: ~edge(p, 1) & ~edge(p, -1)), lambda p: F.array_join(p, " "))

    return F.slice(F.array_distinct(F.concat(*[runs(k) for k in range(MAX_WORDS, 0, -1)])), 1, MAX_PHRASES)


def full_text_query(question: str | Column) -> Column:
    words = _question_words(F.col(question) if isinstance(question, str) else question)
    return F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*STOPWORDS)), " ")


def title_matches(questions: DataFrame, archive: DataFrame, limit: int = 2) -> DataFrame:
    """(query_id, question) to titles that equal a phrase: (query_id, path, position), at most `limit`.

    A phrase inside a title already found does not count, nor do titles that name nothing.
    """
    asked = questions.select("query_id", F.posexplode(phrases("question")).alias("phrase_no", "phrase"))
    asked = asked.withColumn("key", t.title_key("phrase")).filter((F.col("key") != "") & ~F.col("key").isin(*GENERIC_TITLES))
    titles = archive.select("path", t.title_key("path").alias("key"))
    found = titles.join(bounded(asked), "key")
    first = Window.partitionBy("query_id", "key").orderBy("phrase_no", "path")
    found = found.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    # At most 48 keys a question: fold them in order and leave out what an earlier one contains.
    per_query = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("phrase_no", "key", "path"))).alias("all"))
    kept = F.aggregate(
        "all",
        F.array().cast("array<struct<phrase_no:int,key:string,path:string>>"),
        lambda acc, x: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda a: F.contains(a["key"], x["key"])), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return per_query.select("query_id", F.posexplode(kept).alias("position", "x")).select("query_id", "position", "x.path")


def allowed(path: Column, question: Column) -> Column:
    """Whether an article may enter: its title is not generic, and no book or film unless asked for."""
    return ~F.contains(path, F.lit("%")) & ~t.title_key(path).isin(*GENERIC_TITLES) & (question.rlike(ASKS_MEDIA) | ~path.rlike(MEDIA))


def discover(questions: DataFrame, archive: DataFrame, full_text: DataFrame, redirects: DataFrame, limit: int = 3) -> DataFrame:
    """Titles, then full-text results, as canonical articles: (query_id, article_path, position, is_title).

    full_text: (query_id, path, rank), from BM25 over whole articles; redirects: (path, target).
    """
    titles = title_matches(questions, archive).select("query_id", "path", F.lit(0).alias("tier"), "position")
    texts = full_text.select("query_id", "path", F.lit(1).alias("tier"), F.col("rank").alias("position"))
    both = titles.unionByName(texts).join(redirects.select("path", "target"), "path", "left")
    both = both.withColumn("article_path", F.coalesce("target", "path")).join(questions.select("query_id", "question"), "query_id")
    both = both.filter(allowed(F.col("article_path"), F.col("question")))
    firsts = both.groupBy("query_id", "article_path").agg(F.min(F.struct("tier", "position")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "article_path")
    ranked = firsts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return ranked.select("query_id", "article_path", "position", (F.col("first.tier") == 0).alias("is_title"))


def link_scores(links: DataFrame, queries: DataFrame) -> DataFrame:
    """(article_path, href, anchor, context, position) by (query_id, article_path, query) to (query_id, article_path, href, score, position)."""
    joined = links.join(queries, "article_path")
    asked = F.array_except(F.array_distinct(t.all_words("query")), t.text_array(LINK_STOPS))
    anchor = F.array_distinct(t.all_words("anchor"))
    both = F.array_distinct(t.all_words(F.concat_ws(" ", "anchor", "context")))
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    cues = t.text_array(CUES)
    parts = {
        "overlap": shared(asked, both) / F.greatest(F.lit(1), F.size(asked)),
        "anchor": F.least(F.lit(1.0), (shared(asked, anchor) + shared(cues, anchor)) / 2),
        "cues": shared(cues, both) / len(CUES),
        "lead": F.greatest(F.lit(0.0), 1 - F.col("position") / 180),
    }
    score = sum((F.lit(LINK_WEIGHTS[k]) * v for k, v in parts.items()), F.lit(0.0))
    return joined.select("query_id", "article_path", "href", "position", score.alias("score"))


def related_articles(links: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    """The best links of each article for a query: (query_id, article_path, href, score, rank)."""
    scored = link_scores(links, queries)
    best = Window.partitionBy("query_id", "article_path", "href").orderBy(F.desc("score"), "position")
    scored = scored.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")
    order = Window.partitionBy("query_id", "article_path").orderBy(F.desc("score"), "position", "href")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def merge_sources(found: DataFrame, plans: DataFrame) -> DataFrame:
    """Seeds, related articles and entities in one pool per question, within its budget, with all reasons.

    found: (query_id, stage, seed_no, position, article_path, reason), stage 0 for seed queries, 1 for
    related articles, 2 for entities.  Broad questions keep places for the later stages: two for
    entities, and three for related articles if there are places enough.  No clock decides.
    """
    facts = plans.select("query_id", "breadth", "article_limit", F.size("entities").alias("named"), "date_hints", F.transform("entities", lambda e: t.title_key(e["normalized_name"])).alias("names"))
    rows = found.join(bounded(facts), "query_id")
    entity_places = F.least(F.lit(2), F.col("named"))
    related_places = F.when((F.col("breadth") == "broad") & (F.col("article_limit") >= 6), F.least(F.lit(3), F.greatest(F.lit(0), F.col("article_limit") - entity_places - 1))).otherwise(0)
    upto = F.when(F.col("stage") == 0, F.greatest(F.lit(1), F.col("article_limit") - entity_places - related_places)).when(
        F.col("stage") == 1, F.col("article_limit") - entity_places
    ).otherwise(F.col("article_limit"))
    key = t.title_key("article_path")
    dated_alias = (F.size("date_hints") <= 0) & F.col("article_path").rlike(r"\(.*\d{3,4}") & F.exists("names", lambda n: F.startswith(key, F.concat(n, F.lit(" "))))
    ok = ~F.contains("article_path", F.lit("%")) & ~F.regexp_replace(key, r"\s+\d+$", "").isin(*GENERIC_TITLES) & ~F.col("article_path").rlike(MEDIA) & ~dated_alias
    rows = rows.filter(ok).filter(~((F.col("stage") == 1) & (F.col("breadth") != "broad"))).withColumn("upto", upto)
    entry = F.struct("stage", "seed_no", "position").alias("at")
    firsts = rows.groupBy("query_id", "article_path").agg(
        F.min(F.struct(entry, "upto")).alias("first"), F.sort_array(F.collect_list(F.struct(entry, "reason"))).alias("why")
    )
    # Places by stage: an article has a place if those before it, in its own stage's order, leave one.
    stages = Window.partitionBy("query_id").orderBy("first.at", "article_path")
    ranked = firsts.withColumn("nth", F.row_number().over(stages)).withColumn("in_seed", F.sum((F.col("first.at.stage") == 0).cast("int")).over(stages))
    seeds = F.least("in_seed", F.min(F.when(F.col("first.at.stage") == 0, F.col("first.upto"))).over(Window.partitionBy("query_id")))
    ranked = ranked.withColumn("seeds", F.coalesce(seeds, F.lit(0)))
    in_related = F.sum((F.col("first.at.stage") == 1).cast("int")).over(stages)
    ranked = ranked.withColumn("in_related", in_related)
    related_limit = F.min(F.when(F.col("first.at.stage") == 1, F.col("first.upto"))).over(Window.partitionBy("query_id"))
    ranked = ranked.withColumn("upto_related", F.least(F.col("seeds") + F.col("in_related"), F.greatest(F.coalesce(related_limit, F.lit(0)), F.col("seeds"))))
    in_entity = F.sum((F.col("first.at.stage") == 2).cast("int")).over(stages)
    ranked = ranked.withColumn("in_entity", in_entity)
    place = F.when(F.col("first.at.stage") == 0, F.col("in_seed")).when(F.col("first.at.stage") == 1, F.col("seeds") + F.col("in_related")).otherwise(
        F.col("upto_related") + F.col("in_entity")
    )
    kept = ranked.withColumn("place", place).filter(F.col("place") <= F.col("first.upto"))
    order = Window.partitionBy("query_id").orderBy("first.at", "article_path")
    reasons = F.array_distinct(F.transform("why", lambda x: x["reason"]))
    return kept.select("query_id", "article_path", F.row_number().over(order).alias("position"), reasons.alias("reasons"))
