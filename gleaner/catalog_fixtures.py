"""Queries over small worlds made from the tables: pages with headings, dated questions, saved conversations.

The driver's pages have no headings or links and its texts no dates or named events, so what works on these
is shown on pages, questions and records composed of nations, orders and conversations.  SQL stands beside each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.functions import text as t
from gleaner.functions.dates import normalize_date
from gleaner.operators import dense, expand, metrics, reader, timeline
from gleaner.plans import interpret, pools
from gleaner.sources import archive, html, lineage, store
from gleaner.sources.archive import read_table as read
from gleaner.streaming import conversation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    """Register a query with its SQL."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def choose(key: Column, *values: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


# --- pages ---------------------------------------------------------------------------------------------


def region_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each region, with a section, headings and links for its nations and a table whose first cell spans all rows."""
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(
        F.lit('<h3 id="n'), "n_nationkey", F.lit('">'), "n_name", F.lit("</h3><p>The country "), "n_name", F.lit(" lies in the region "), "r_name", F.lit(', see <a href="'), "n_name", F.lit('">'), "n_name",
        F.lit("</a>.</p>"),
    )
    pages = rows.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", part.alias("part")))).alias("all"))
    first = F.concat(F.lit('<tr><td rowspan="'), F.size("all"), F.lit('">'), "r_name", F.lit("</td>"))
    lines = F.transform("all", lambda x, i: F.concat(F.when(i == 0, first).otherwise(F.lit("<tr>")), F.lit("<td>"), x["n_name"], F.lit("</td></tr>")))
    table = F.concat(F.lit("<table><tr><th>Region</th><th>Nation</th></tr>"), F.array_join(lines, ""), F.lit("</table>"))
    body = F.concat(F.lit('<article><h2 id="nations">Nations</h2>'), F.array_join(F.transform("all", lambda x: x["part"]), ""), table, F.lit("</article>"))
    return pages.select((-1 - F.col("r_regionkey")).cast("bigint").alias("page_id"), F.concat(F.lit("region_"), "r_regionkey").alias("path"), F.lit("text/html").alias("mimetype"), body.alias("html"))


_NATIONS = """nations AS (
            SELECT n_nationkey, n_name, r_regionkey, r_name, -1 - r_regionkey::BIGINT AS page_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS nth
            FROM nation JOIN region ON n_regionkey = r_regionkey
        )"""
_SENTENCE = "'The country ' || n_name || ' lies in the region ' || r_name || ', see ' || n_name || ' .'"


@query(f"""
    WITH {_NATIONS} SELECT page_id, nth::INT AS block_no, n_name AS href, n_name AS anchor, {_SENTENCE} AS context, nth::INT AS position FROM nations
""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links inside paragraphs of all pages."""
    pages = read(spark, sf, "pages").select("page_id", "html").unionByName(region_pages(spark, sf).select("page_id", "html"))
    return html.page_rows(pages, html.links("html"), "page_id")


@query(f"""
    WITH {_NATIONS} SELECT page_id, (nth + 1)::INT AS block_no, lower(replace(n_name, '_', ' ')) AS text, 'nations' AS parent, 'n' || n_nationkey AS target, (nth + 1)::INT AS position FROM nations
    UNION ALL SELECT DISTINCT page_id, 0, 'nations', 'nations', 'nations', 0 FROM nations
""")
def html_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings with a target of all pages."""
    pages = read(spark, sf, "pages").select("page_id", "html").unionByName(region_pages(spark, sf).select("page_id", "html"))
    return html.page_rows(pages, html.headings("html"), "page_id")


@query(f"WITH {_NATIONS} SELECT page_id, 0 AS table_no, 'Region: ' || r_name || '; Nation: ' || n_name AS row_text FROM nations")
def html_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Table rows of the regions' pages: a cell over all rows stands in each of them."""
    spark.udtf.register("html_table_rows", html.table_rows_udtf())
    region_pages(spark, sf).createOrReplaceTempView("region_pages")
    return spark.sql("SELECT page_id, t.* FROM region_pages, LATERAL html_table_rows(html) t")


@query(f"""
    WITH {_NATIONS} SELECT n_nationkey AS source_id, '/wiki/region_' || r_regionkey || CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE '#n' || n_nationkey END AS url FROM nations
""")
def heading_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's subsection as a link into its region's page; every third one's heading is not in the page."""
    nations = read(spark, sf, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 2, F.lit("elsewhere")).otherwise(F.col("n_name"))
    sources = nations.select(F.col("n_nationkey").alias("source_id"), F.concat(F.lit("region_"), "n_regionkey").alias("path"), F.lit("").alias("section"), name.alias("subsection"))
    heads = html.page_rows(region_pages(spark, sf), html.headings("html"), "path").select("path", "text", "parent", "target")
    return reader.heading_links(sources, heads).select("source_id", "url")


@query(f"""
    WITH {_NATIONS} SELECT n_nationkey AS source_id, CASE n_nationkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'section' WHEN 2 THEN 'article' ELSE 'unavailable' END AS evidence_status FROM nations
""")
def evidence_states(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose text is in the page, whose heading is, whose page is, and none of these."""
    key = F.col("n_nationkey")
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sources = rows.select(
        key.alias("source_id"), F.when(key % 4 == 3, F.lit("nowhere")).otherwise(F.concat(F.lit("region_"), "r_regionkey")).alias("path"), F.lit("Nations").alias("section"),
        F.when(key % 4 == 2, F.lit("")).otherwise(F.col("n_name")).alias("subsection"),
        F.when(key % 4 == 0, F.concat(F.lit("The country "), "n_name", F.lit(" lies in the region "), "r_name")).otherwise(F.lit("Nothing of this is in any page at all.")).alias("supplied_text"),
    )
    sources = sources.withColumn("section", F.when(F.col("source_id") % 4 == 2, F.lit("Other")).otherwise(F.col("section")))
    return reader.evidence_status(sources, region_pages(spark, sf)).select("source_id", "evidence_status")


@query("SELECT 'order_' || o_orderkey AS path, o_totalprice AS price FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def archive_entry(spark: SparkSession, sf: str) -> DataFrame:
    """The entry of one path, found by a filter."""
    orders = read(spark, sf, "orders")
    entries = orders.select(F.concat(F.lit("order_"), "o_orderkey").alias("path"), F.col("o_totalprice").alias("price"))
    return archive.entry(entries, f"order_{orders.agg(F.min('o_orderkey')).first()[0]}")


@query("SELECT n_nationkey, n_name FROM nation")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as JSON to the shared folder, twice over, and read again."""
    rows = read(spark, sf, "nation").select("n_nationkey", "n_name")
    path = f"{lineage.shared_dir(rows)}/gleaner-json-{spark.sparkContext.applicationId}"
    for part in (rows.limit(1), rows):
        archive.write_json(part, path)
    return archive.read_json(spark, path, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "))


@query("""SELECT n_nationkey, sha256('{"c0":' || n_nationkey || ',"c1":"' || n_name || '"}') AS fingerprint FROM nation""")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", t.stable_fingerprint("n_nationkey", "n_name").alias("fingerprint"))


# --- questions -------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """For users' turns a question each, every third one leaning back, and the question and answer before, if there are any."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf, "conversations").withColumns({"next": F.lead("text").over(order)}).filter("role = 'user'")
    rows = rows.withColumn("question", choose(F.floor(F.col("turn") / 2) + F.col("conv_id"), "What was the Great Treaty of Lund?", "What about it?", "Compare A and B."))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "question", F.lag("question").over(order).alias("before"), F.lag("next").over(order).alias("answer"))


_ASKED = """asked AS (
            SELECT conv_id * 1000 + turn AS query_id, question, lag(question) OVER w AS before, lag(next) OVER w AS answer FROM (
                SELECT conv_id, turn, role, ['What was the Great Treaty of Lund?', 'What about it?', 'Compare A and B.'][(turn // 2 + conv_id) % 3 + 1] AS question, next
                FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE role = 'user'
            ) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
        )"""
_KIND = """CASE WHEN {0} LIKE 'What was the Great%' THEN 'lookup' WHEN {0} LIKE 'Compare%' THEN 'comparison' ELSE 'general' END"""


@query(f"""
    WITH {_ASKED}, facts AS (SELECT *, question LIKE 'What about it%' AS follows, before IS NULL OR answer IS NULL OR before LIKE 'What about it%' AS alone FROM asked)
    SELECT query_id, CASE WHEN follows THEN 'followup' ELSE {_KIND.format('question')} END AS question_type,
        CASE WHEN follows AND NOT alone THEN {_KIND.format('before')} ELSE {_KIND.format('question')} END AS effective_type, follows AS is_followup, follows AND alone AS asks_back
    FROM facts
""")
def conversation_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's turn understood after the turn before it; turns with nothing to lean on ask back."""
    found = interpret.analyses(_turns(spark, sf))
    asks, goes_on = interpret.split_clarifications(found)
    both = asks.withColumn("asks_back", F.lit(True)).unionByName(goes_on.withColumn("asks_back", F.lit(False)))
    return both.select("query_id", "question_type", "effective_type", "is_followup", "asks_back")


_LEADS = ["Compare the French and Russian Revolutions", "What did King Otto / Otto II sign?", "Why did the Red Army & Navy of Lund fall?", "when did the July Crisis begin?"]
_NAMED = {
    0: [("the French and Russian Revolutions", "person_or_named_subject", 0.82, "question"), ("French Revolution", "event", 0.9, "comparison subject"), ("Russian Revolution", "event", 0.9, "comparison subject")],
    1: [("King Otto", "person_or_named_subject", 0.82, "question"), ("Otto II", "person_or_named_subject", 0.82, "question"), ("What did King Otto", "person_or_named_subject", 0.72, "question variant"), ("Otto II sign", "person_or_named_subject", 0.72, "question variant")],
    2: [("Red Army", "organization", 0.82, "question"), ("Navy of Lund", "person_or_named_subject", 0.82, "question")],
    3: [("July Crisis", "event", 0.82, "question")],
}
_NAMED_SQL = ", ".join(f"({k}, {i}, '{n}', '{kind}', {c}::DOUBLE, '{why}')" for k, found in _NAMED.items() for i, (n, kind, c, why) in enumerate(found))


@query(f"""
    SELECT n_nationkey AS query_id, no::INT AS no, name AS display_name, lower(name) AS normalized_name, kind AS entity_type, confidence, reason
    FROM nation JOIN (VALUES {_NAMED_SQL}) v(k, no, name, kind, confidence, reason) ON n_nationkey % 4 = k
""")
def question_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Named subjects of questions of four forms, with type, confidence and origin."""
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), choose(F.col("n_nationkey"), *_LEADS).alias("question"))
    found = interpret.plans(rows).select("query_id", F.posexplode("entities").alias("no", "e"))
    return found.select("query_id", "no", "e.display_name", "e.normalized_name", "e.entity_type", "e.confidence", "e.reason")


@query("""SELECT o_orderkey AS order_id, 'order ' || o_orderkey AS side_a, 'customer ' || o_custkey AS side_b FROM orders WHERE o_orderkey % 2 = 0""")
def endpoint_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Questions `from X to Y` split at both ends; others are none."""
    asked = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("What led from order "), "o_orderkey", F.lit(" to customer "), "o_custkey", F.lit("?"))).otherwise(F.lit("Who was it?"))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), dense.endpoint_sides(asked).alias("s"))
    return rows.filter("s is not null").select("order_id", F.get("s", 0).alias("side_a"), F.get("s", 1).alias("side_b"))


@query("SELECT count(*) AS rows, false AS refused FROM embeddings UNION ALL SELECT count(*), true FROM embeddings")
def embedding_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one model pass the guard, those of two are refused."""
    rows = read(spark, sf, "embeddings").select("vec_id", F.lit("m1").alias("embedding_version"))
    out = []
    for other in ("m1", "m2"):
        try:
            dense.check_versions(rows, rows.withColumn("embedding_version", F.lit(other)))
            refused = False
        except ValueError:
            refused = True
        out.append(rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused)))
    return out[0].unionByName(out[1])


@query("""
    SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 3 = 0 THEN 'plan_' || n_name ELSE 'single_' || n_name END AS article_path, CASE WHEN n_nationkey % 3 = 0 THEN 'seed' ELSE 'fallback' END AS reasons FROM nation
""")
def discovery_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Questions for which the plan found nothing take what their single search found."""
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), "n_name", F.lit(1).alias("position"))
    primary = rows.filter("query_id % 3 = 0").select("query_id", F.concat(F.lit("plan_"), "n_name").alias("article_path"), "position", F.array(F.lit("seed")).alias("reasons"))
    single = rows.select("query_id", F.concat(F.lit("single_"), "n_name").alias("article_path"), "position")
    return pools.with_fallback(primary, single).select("query_id", "article_path", F.array_join("reasons", ",").alias("reasons"))


@query("""
    WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS no FROM nation),
    answered AS (SELECT n_regionkey::BIGINT AS conv_id, (no * 10 + 1)::BIGINT AS turn, 'Tell me about ' || n_name AS question, least(4, CASE WHEN no < 3 THEN no ELSE no - 2 END)::INT AS turns, 'Tell me about ' || n_name AS focus FROM n)
    SELECT conv_id, turn, question, 'lookup' AS effective_type, turns, focus FROM answered
    UNION ALL SELECT conv_id, turn + 4, '/debug', 'lookup', turns, focus FROM answered WHERE turn = 41
""")
def stream_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a stream: the memory after each answer, cleared by `/new` before the third nation and shown by `/debug` after the fourth."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = read(spark, sf, "nation").select(F.col("n_regionkey").cast("bigint").alias("conv_id"), "n_name", F.row_number().over(order).cast("bigint").alias("no"))
    said = lambda turn, role, *text: rows.select("conv_id", (F.col("no") * 10 + turn).alias("turn"), F.lit(role).alias("role"), F.concat(*text).alias("text"))
    messages = said(0, "user", F.lit("Tell me about "), "n_name").unionByName(said(1, "assistant", "n_name", F.lit(" began in 1618 [S1].")))
    messages = messages.unionByName(said(5, "user", F.lit("/new")).filter("turn = 25")).unionByName(said(5, "user", F.lit("/debug")).filter("turn = 45"))
    path = lineage.write(messages)
    out = f"{path}-memory"
    stream = conversation.memory(spark.readStream.schema(messages.schema).parquet(path))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", "question", "effective_type", "turns", "focus")


# --- dates and periods -------------------------------------------------------------------------------------


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """An order's text with a date of one of seven forms."""
    year = 1500 + F.col("o_orderkey") % 400
    y = year.cast("string")
    forms = [
        F.concat(F.lit("It began in "), (100 + F.col("o_orderkey") % 800).cast("string"), F.lit(".")), F.concat((1 + F.col("o_orderkey") % 300).cast("string"), F.lit(" BC was its year.")),
        F.concat(F.lit("In the "), F.floor(year / 10).cast("string"), F.lit("0s it grew.")), F.concat(F.lit("War of "), y, F.lit("–"), (year + 30).cast("string"), F.lit(".")), F.concat(F.lit("Founded c. "), y, F.lit(".")),
        F.concat(F.lit("In May "), y, F.lit(" it fell.")), F.concat(F.lit("Siege of 3 May "), y, F.lit(" – 4 June "), y, F.lit(".")),
    ]
    text = F.coalesce(*(F.when(F.col("o_orderkey") % 7 == k, form) for k, form in enumerate(forms)))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), text.alias("text"))


@query("""
    WITH o AS (SELECT o_orderkey AS k, 1500 + o_orderkey % 400 AS y FROM orders)
    SELECT k AS order_id,
        CASE k % 7 WHEN 0 THEN (100 + k % 800)::VARCHAR WHEN 1 THEN (1 + k % 300) || ' BC' WHEN 2 THEN (y // 10) || '0s' WHEN 3 THEN y || '–' || (y + 30) WHEN 4 THEN 'c. ' || y WHEN 5 THEN 'May ' || y
            ELSE '3 May ' || y || ' – 4 June ' || y END AS date_text,
        CASE k % 7 WHEN 0 THEN 100 + k % 800 WHEN 1 THEN -(1 + k % 300) WHEN 2 THEN y // 10 * 10 ELSE y END::INT AS year, CASE WHEN k % 7 >= 5 THEN 5 ELSE 0 END AS month, CASE WHEN k % 7 = 6 THEN 3 ELSE 0 END AS day,
        CASE k % 7 WHEN 2 THEN 'decade' WHEN 3 THEN 'range' WHEN 5 THEN 'month' WHEN 6 THEN 'range' ELSE 'year' END AS precision, k % 7 = 4 AS approximate
    FROM o
""")
def date_precisions(spark: SparkSession, sf: str) -> DataFrame:
    """Years before and after the era's begin, decades, ranges, months and rough dates."""
    return _dated(spark, sf).select("order_id", normalize_date("text").alias("d")).select("order_id", "d.*")


def _introductions(spark: SparkSession, sf: str) -> DataFrame:
    """An article for each nation whose introduction states its period."""
    year = 1000 + F.col("n_nationkey") * 10
    text = F.concat(F.lit("The time of "), "n_name", F.lit(" lasted from "), year.cast("string"), F.lit(" to "), (year + 5).cast("string"), F.lit(". It ended well."))
    return read(spark, sf, "nation").select(F.col("n_name").alias("article_path"), F.concat("n_name", F.lit("_000")).alias("chunk_id"), F.lit("Introduction").alias("section"), text.alias("text"), "n_nationkey")


@query("""
    SELECT n_nationkey AS query_id, CASE n_nationkey % 4 WHEN 0 THEN 1700 + n_nationkey WHEN 1 THEN 1600 WHEN 2 THEN 1000 + n_nationkey * 10 END::INT AS low,
        CASE n_nationkey % 4 WHEN 0 THEN 1730 + n_nationkey WHEN 1 THEN 1650 WHEN 2 THEN 1005 + n_nationkey * 10 END::INT AS high
    FROM nation
""")
def period_inference(spark: SparkSession, sf: str) -> DataFrame:
    """The period of a question: from the year it is anchored to, from its own words, from an article that it names, or none."""
    key, intro = F.col("n_nationkey"), _introductions(spark, sf)
    question = F.when(key % 4 == 1, F.lit("What happened between 1600 and 1650?")).when(key % 4 == 2, F.concat(F.lit("A timeline of "), F.translate("article_path", "_", " "))).otherwise(F.lit("And then?"))
    plans = intro.select(key.alias("query_id"), question.alias("question"), question.alias("resolved_question"), F.when(key % 4 == 0, 1700 + key).cast("int").alias("anchor_year"))
    return timeline.infer_period(plans, intro).select("query_id", "low", "high")


@query("SELECT n_nationkey AS query_id, (1000 + n_nationkey * 10)::INT AS low, (1005 + n_nationkey * 10)::INT AS high FROM nation WHERE n_nationkey % 2 = 0")
def endpoint_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Questions on a sequence of events take the years of the introduction that shares most words."""
    intro = _introductions(spark, sf)
    question = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Outline the events connected with the time that lasted, of "), "article_path")).otherwise(F.lit("Who was it?"))
    plans = intro.select(F.col("n_nationkey").alias("query_id"), question.alias("question"))
    return timeline.endpoint_period(plans, intro)


@query("""
    WITH e AS (
        SELECT o_custkey AS query_id, o_orderdate, 'order_' || o_orderkey AS chunk_id, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY month(o_orderdate), day(o_orderdate), 'order_' || o_orderkey) = 1 AS first,
            strftime(o_orderdate, '%-d %B %Y') AS date_text, 'Date: ' || strftime(o_orderdate, '%-d %B %Y') || '; Event: order ' || o_orderkey || ' was signed.' AS event FROM orders
    ),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, year(o_orderdate), month(o_orderdate), day(o_orderdate), chunk_id) AS k FROM e) WHERE k <= 24)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY year(o_orderdate), month(o_orderdate), day(o_orderdate), chunk_id) AS position, chunk_id, 'With date: ' || event AS text, date_text FROM kept
""")
def event_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each customer's orders as passages with their dates."""
    order = Window.partitionBy("query_id").orderBy("order_id")
    date = F.date_format("o_orderdate", "d MMMM yyyy")
    rows = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("order_id"), F.concat(F.lit("Date: "), date, F.lit("; Event: order "), F.col("o_orderkey").cast("string"), F.lit(" was signed.")).alias("text")
    )
    hits = rows.select(
        "query_id", F.row_number().over(order).alias("position"), F.concat(F.lit("customer_"), "query_id").alias("article_path"), F.lit("Orders").alias("section"), F.lit(None).cast("string").alias("subsection"),
        F.concat(F.lit("order_"), "order_id").alias("chunk_id"), "text", F.lit(0.5).alias("score"),
    )
    return timeline.event_hits(timeline.extract_events(hits)).select("query_id", "position", "chunk_id", "text", "date_text")


@query("SELECT o_custkey AS query_id, 'order_' || o_orderkey AS chunk_id FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 5 = 1")
def focused_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of anchored questions keep their first matched article alone."""
    orders = read(spark, sf, "orders")
    pool = orders.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("part_"), F.col("o_orderkey") % 5).alias("article_path"), F.concat(F.lit("order_"), "o_orderkey").alias("chunk_id"))
    plans = orders.select(F.col("o_custkey").alias("query_id")).distinct().select(
        "query_id", F.when(F.col("query_id") % 2 == 1, 1700).alias("anchor_year"), F.array(F.lit("part_1"), F.lit("part_2")).alias("matched_articles")
    )
    return timeline.focus_pool(pool, plans).select("query_id", "chunk_id")


@query("""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS no FROM nation)
    SELECT n_regionkey AS query_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY 1600 + n_nationkey * 7 % 100, no)::INT AS line_no, 'S' || no AS source_label,
        'In ' || (1600 + n_nationkey * 7 % 100) || ' ' || n_name || ' began.' AS summary
    FROM n WHERE n_nationkey % 3 != 0
""")
def timeline_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A model's entries that hold against their sources: years that a source does not have, and repeated labels, go."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = read(spark, sf, "nation").withColumn("no", F.row_number().over(order)).withColumn("year", 1600 + F.col("n_nationkey") * 7 % 100)
    label, year = F.concat(F.lit("S"), "no"), F.col("year").cast("string")
    said = F.when(F.col("n_nationkey") % 3 == 0, F.lit("1999")).otherwise(year)
    entry = rows.select(F.col("n_regionkey").alias("query_id"), F.col("no").alias("entry_no"), label.alias("source_label"), F.concat(F.lit("In "), said, F.lit(" "), "n_name", F.lit(" began.")).alias("summary"))
    again = entry.withColumn("entry_no", F.col("entry_no") + 100).filter("entry_no % 2 = 0 and summary not like '%1999%'")
    sources = rows.select(F.col("n_regionkey").alias("query_id"), label.alias("label"), year.alias("date_text"), F.struct(F.col("year"), F.lit(0), F.lit(0)).alias("sortable_date"), F.col("n_name").alias("supplied_text"))
    return timeline.valid_entries(entry.unionByName(again), sources).select("query_id", "line_no", "source_label", "summary")


# --- pools and shortlists ------------------------------------------------------------------------------------


def _expanded(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as ranked chunks: articles by month, sections by status."""
    return read(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.concat(F.lit("order_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("chunk_id"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("article_path"),
        F.col("o_orderstatus").alias("section"), F.lit(None).cast("string").alias("subsection"), F.concat(F.lit("Text "), F.col("o_orderkey") % 50).alias("text"), (F.col("o_totalprice") / 1e6).alias("expansion_score"),
    )


@query("""
    WITH rows AS (
        SELECT o_custkey AS query_id, 'order_' || lpad(o_orderkey::VARCHAR, 9, '0') AS chunk_id, 'm' || month(o_orderdate) AS article, o_orderstatus AS section, o_orderkey % 50 AS text, o_totalprice / 1e6 AS score FROM orders
    ),
    opened AS (SELECT *, row_number() OVER (PARTITION BY query_id, article, section ORDER BY chunk_id) > 1 AS rest FROM rows),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rest, score DESC, chunk_id) AS place FROM opened),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY place) AS k FROM placed)
    SELECT query_id, position::INT AS position, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position FROM kept WHERE k = 1) WHERE position <= 32
""")
def legacy_timeline_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The opening chunk of each section, then the rest by score, without repeated paragraphs."""
    return expand.legacy_timeline_pool(_expanded(spark, sf), Config()).select("query_id", "position", "chunk_id")


@query("""
    SELECT query_id, chunk_id FROM (SELECT o_custkey AS query_id, 'order_' || o_orderkey AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3
""")
def user_cap(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own cap of three passages."""
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("order_"), "o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("position"))
    return expand.cap_articles(rows, 3).select("query_id", "chunk_id")


@query("""
    WITH rows AS (
        SELECT o_custkey AS query_id, 'order_' || lpad(o_orderkey::VARCHAR, 9, '0') AS chunk_id, 'm' || month(o_orderdate) AS article, o_totalprice / 1e6 AS score,
            CASE WHEN o_orderkey % 5 = 0 THEN 4 WHEN o_orderkey % 5 = 1 THEN 1 ELSE 0 END AS strength FROM orders
    ),
    marked AS (SELECT *, strength > 0 AND row_number() OVER (PARTITION BY query_id, article ORDER BY CASE WHEN strength > 0 THEN strength * 0.1 + score + 0.08 END DESC NULLS LAST, score DESC, chunk_id) = 1 AS reserved FROM rows),
    in_section AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY reserved DESC, score DESC, chunk_id) AS k FROM marked) WHERE k <= 3)
    SELECT query_id, chunk_id, reserved AS trigger_evidence FROM in_section
""")
def trigger_reservation(spark: SparkSession, sf: str) -> DataFrame:
    """For questions on causes, each article's chunk with the strongest trigger has a place before all others."""
    rows = _expanded(spark, sf).withColumnRenamed("expansion_score", "score").withColumn("section", F.lit("S"))
    key = F.substring("chunk_id", 7, 9).cast("int")
    rows = rows.withColumn("text", F.when(key % 5 == 0, F.lit("A revolt after the assassination.")).when(key % 5 == 1, F.lit("An uprising.")).otherwise(F.lit("Calm.")))
    plans = rows.select("query_id").distinct().select("query_id", F.lit("cause").alias("intent"), F.lit("x").alias("resolved_question"))
    articles = rows.select("query_id", "article_path").distinct().select("query_id", "article_path", F.lit(1.0).alias("article_score"), F.lit(1).alias("occurrences"), F.lit(1).alias("article_rank"))
    return expand.expand_sections(rows, plans, Config(similarity_threshold=0.0), articles).select("query_id", "chunk_id", "trigger_evidence")


# --- evaluation ------------------------------------------------------------------------------------------------


@query("""
    WITH m AS (SELECT n_nationkey AS query_id, (n_nationkey % 10) / 10.0 AS coverage, 0.3 AS before FROM nation)
    SELECT query_id, round((coverage - before)::DOUBLE, 8) AS gain, round((coverage - before)::DOUBLE, 8) >= 0.05 AS enough_gain, query_id % 2 = 0 AS events_sorted, query_id % 3 != 0 AS sensible_events FROM m
""")
def acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """Gain over a baseline, order of events, and their number."""
    key = F.col("query_id")
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"))
    own = rows.withColumn("coverage", key % 10 / 10)
    events = rows.withColumn("event_no", F.explode(F.sequence(F.lit(1), F.when(key % 3 == 0, 12).otherwise(4))))
    events = events.withColumns({"year": F.when(key % 2 == 0, F.col("event_no")).otherwise(-F.col("event_no")), "month": F.lit(0), "day": F.lit(0)})
    found = metrics.acceptance(own, rows.withColumn("coverage", F.lit(0.3)), events)
    return found.withColumn("gain", F.round("gain", 8)).withColumn("enough_gain", F.round("gain", 8) >= 0.05)


@query("""
    SELECT event_id % 3 AS model, round(avg((event_id % 50) / nullif((event_id % 5)::DOUBLE, 0)), 8) AS tokens_per_second, round(avg((event_id % 7)::DOUBLE), 8) AS wall_seconds, count(*) AS runs FROM events GROUP BY event_id % 3
""")
def model_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens a second and wall time by model."""
    rows = read(spark, sf, "events").select((F.col("event_id") % 3).alias("model"), (F.col("event_id") % 50).alias("eval_count"), ((F.col("event_id") % 5) * 1e9).alias("eval_duration"), (F.col("event_id") % 7).cast("double").alias("wall_seconds"))
    found = metrics.throughput(rows, "model")
    return found.withColumns({c: F.round(c, 8) for c in ("tokens_per_second", "wall_seconds")})


@query("SELECT n_nationkey AS query_id, m.model FROM nation CROSS JOIN (VALUES ('a'), ('b')) m(model)")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The same evidence for each of two models."""
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    return metrics.compare_models(read(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id")), models)


@query("""
    SELECT o_custkey AS query_id, count(*) AS sources, count(*) FILTER (o_orderkey % 4 != 3) AS resolvable, count(*) FILTER (o_orderkey % 4 = 0) AS highlighted, count(*) - count(DISTINCT o_orderkey % 6) AS duplicates
    FROM orders GROUP BY o_custkey
""")
def source_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of each question by state, and repeated texts."""
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), choose(F.col("o_orderkey"), "exact", "section", "article", "unavailable").alias("evidence_status"), (F.col("o_orderkey") % 6).cast("string").alias("supplied_text"))
    return metrics.source_audit(rows)


@query("SELECT DISTINCT o_custkey AS query_id, o_orderkey % 5 AS facet FROM orders WHERE (o_custkey, o_orderkey % 5) NOT IN (SELECT (o_custkey, o_orderkey % 5) FROM orders WHERE o_orderkey % 3 = 0)")
def lost_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Facets that all orders of a customer cover and those divisible by three do not."""
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 5).alias("facet"), "o_orderkey")
    return metrics.lost_facets(rows, rows.filter("o_orderkey % 3 = 0"))


# --- saved conversations -----------------------------------------------------------------------------------------


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "nation").select(
        F.concat(F.lit("c"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("double").alias("created"), F.col("n_nationkey").cast("double").alias("updated"),
        F.lit(0).alias("archived"), F.lit(1).alias("revision"), F.lit("{}").alias("state"), F.concat(F.lit('[{"question":"Who is '), "n_name", F.lit('?"}]')).alias("turns"),
    )
    path = lineage.write(rows)  # closed and opened again
    return store.open_store(spark, path)


@query("SELECT 'c' || n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'New name' ELSE n_name END AS title, CASE WHEN n_nationkey IN (3, 4) THEN 99.0 ELSE n_nationkey END::DOUBLE AS updated, CASE WHEN n_nationkey IN (3, 4) THEN 2 ELSE 1 END AS revision, (n_nationkey = 4)::INT AS archived FROM nation")
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One saved conversation renamed, another archived; both go up by a revision."""
    changed = store.archive(store.rename(_saved(spark, sf), "c3", "  New name ", 99.0), "c4", 99.0)
    return changed.select("id", "title", "updated", "revision", "archived")


@query("SELECT 'c' || n_nationkey AS id, n_name AS title, 'Who is ' || n_name || '?' AS question FROM nation WHERE n_nationkey = 5")
def store_load(spark: SparkSession, sf: str) -> DataFrame:
    """One conversation read back with its turns parsed."""
    return store.load(_saved(spark, sf), "c5").select("id", "title", F.col("turns")[0]["question"].alias("question"))
