import pytest

from gleaner.config import Config
from gleaner.operators import discovery
from pyspark.sql import functions as F

from gleaner.plans.interpret import State, analyze, detect_intent, entities, intent, is_follow_up, leans_back, plans


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("Give me a timeline of the war", "timeline"), ("What happened next?", "timeline"), ("Compare A and B", "comparison"), ("Why did it begin?", "cause"),
        ("Who was Wallenstein?", "lookup"), ("Tell me about Prague", "lookup"), ("Battles of 1618", "general"),
    ],
)
def test_intent(spark, question, kind):
    assert detect_intent(question) == kind
    assert spark.createDataFrame([(question,)], "q string").select(intent("q")).first()[0] == kind


@pytest.mark.parametrize(("question", "follows"), [("Why?", True), ("And then?", True), ("What about Sweden?", True), ("How did they win?", True), ("Who was Tilly?", False)])
def test_follow_up(spark, question, follows):
    assert leans_back(question) is follows
    assert spark.createDataFrame([(question,)], "q string").select(is_follow_up("q")).first()[0] is follows


def found_entities(spark, question, earlier=(), limit=8):
    rows = spark.createDataFrame([(question, list(earlier))], "question string, earlier array<string>")
    return rows.select(entities("question", F.col("earlier"), limit).alias("e")).first()["e"]


def test_entities(spark):
    found = found_entities(spark, "Compare the French and Russian Revolutions")
    assert [e["display_name"] for e in found if e["reason"] == "comparison subject"] == ["French Revolution", "Russian Revolution"]
    treaty = found_entities(spark, "What was the Treaty of Westphalia?")
    assert [e["normalized_name"] for e in treaty] == ["treaty of westphalia"] and treaty[0]["entity_type"] == "institution_or_settlement"
    assert [e["reason"] for e in found_entities(spark, "why did he leave?", ["Tilly", "Wallenstein"])] == ["bounded conversation"] * 2
    assert len(found_entities(spark, "Alpha, Beta, Gamma, Delta", limit=2)) == 2
    assert [(e["display_name"], e["aliases"]) for e in found_entities(spark, "Rome & Sons/rome & sons")][0] == ("Rome", [])
    assert found_entities(spark, None) == []


def test_plans(spark):
    def one(question):
        return plans(spark.createDataFrame([(1, question)], "query_id int, question string")).first()

    cause = one("What caused the Thirty Years War?")
    assert cause["intent"] == "cause" and cause["breadth"] == "broad" and len(cause["seed_queries"]) == 4 and cause["article_limit"] == 12
    assert cause["seed_queries"][1] == "the Thirty Years War political institutions causes"
    both = one("Compare Rome and Carthage")
    assert both["seed_queries"][1:] == ["Rome causes political social economic military", "Carthage causes political social economic military"]
    dated = one("Who was king in 1618?")
    assert dated["date_hints"] == ["1618"] and dated["article_limit"] == 2 and dated["breadth"] == "narrow"
    row = one("Why did Rome fall?")
    assert row["intent"] == "cause" and row["entities"][0]["display_name"] == "Rome"
    assert one(None)["seed_queries"] == []


def talked(**changes):
    state = State()
    state.remember(analyze("Tell me about the Thirty Years War", state), "It ran from 1618 to 1648 [S1].", ["Thirty_Years_War"], ["Thirty_Years_War"])
    state.__dict__.update(changes)
    return state


def test_analysis():
    assert analyze("Why?").clarification
    state = talked()
    assert state.focus == "Thirty Years War" and state.periods == ["1618", "1648"]
    why = analyze("Why?", state)
    assert why.is_followup and "Thirty Years War" in why.retrieval_query and "It ran from 1618 to 1648" in why.retrieval_query
    after = analyze("What happened next?", state)
    assert after.effective_type == "timeline" and after.anchor_year == 1618
    unclear = talked(ambiguous_topics=["Siege", "Peace"])
    asked = analyze("What happened after that?", unclear)
    assert "Siege or Peace" in asked.clarification
    chosen = analyze("the second", unclear)
    assert chosen.effective_type == "timeline" and unclear.focus == "Peace"
    assert not analyze("How did Wallenstein lose his army?", state, enhanced=True).is_followup


def test_state_is_bounded():
    state = State(max_turns=2, max_chars=500)
    for k in range(10):
        question = analyze(f"Tell me about topic {k}", state)
        state.remember(question, "word " * 400, [f"Topic_{k}"])
    assert len(state.turns) == 2 and len(state.context()) <= 500
    before = len(state.turns)
    state.remember(analyze("Tell me more of this"), "x", skipped=True)
    assert len(state.turns) == before
    state.clear()
    assert not state.turns and not state.focus


# --- discovery ---


def questions(spark, text):
    return spark.createDataFrame([(1, text)], "query_id int, question string")


def test_titles(spark):
    archive = spark.createDataFrame([("World_War_I",), ("War",), ("World",), ("July_Crisis",)], "path string")
    asked = questions(spark, "What caused World War I?")
    assert [r["path"] for r in discovery.title_matches(asked, archive).collect()] == ["World_War_I"]
    assert asked.select(discovery.full_text_query("question")).first()[0] == "caused World War I"
    phrases = asked.select(discovery.phrases("question")).first()[0]
    assert phrases[0] == "caused World War I" and "What" not in phrases


def test_discover(spark):
    archive = spark.createDataFrame([("World_War_I",)], "path string")
    found = [(1, "Causes", 1), (1, "Causes_of_World_War_I", 2), (1, "Crisis_(film)", 3), (1, "WWI", 4), (1, "July_Crisis", 5)]
    texts = spark.createDataFrame(found, "query_id int, path string, rank int")
    redirects = spark.createDataFrame([("WWI", "World_War_I")], "path string, target string")
    got = discovery.discover(questions(spark, "What caused World War I?"), archive, texts, redirects, 3).orderBy("position").collect()
    assert [r["article_path"] for r in got] == ["World_War_I", "Causes_of_World_War_I", "July_Crisis"]
    assert [r["is_title"] for r in got] == [True, False, False]


def test_related(spark):
    context = "The political crisis of the republic led to civil war."
    links = spark.createDataFrame(
        [("R", "Sulla", "Sulla", context, 0), ("R", "Julius_Caesar", "Julius Caesar", context, 1), ("R", "Olive", "olive", "Olives grow.", 2), ("R", "Sulla", "him", "x", 3)],
        "article_path string, href string, anchor string, context string, position int",
    )
    asked = spark.createDataFrame([(1, "R", "political crisis of the republic")], "query_id int, article_path string, query string")
    assert [r["href"] for r in discovery.related_articles(links, asked, 2).orderBy("rank").collect()] == ["Sulla", "Julius_Caesar"]


def test_merge_keeps_places(spark):
    plan_rows = plans(questions(spark, "What caused the Roman Crisis?"), Config(candidate_articles=6))
    found = [(1, 0, 0, k, f"Seed_{k}", "question search") for k in range(8)]
    found += [(1, 1, 0, k, f"Link_{k}", "related") for k in range(4)] + [(1, 1, 0, 9, "Seed_0", "related")]
    found += [(1, 2, 0, 0, "Roman_Crisis_Article", "entity"), (1, 2, 0, 1, "History", "entity")]
    rows = spark.createDataFrame(found, "query_id int, stage int, seed_no int, position int, article_path string, reason string")
    got = {r["article_path"]: r["reasons"] for r in discovery.merge_sources(rows, plan_rows).collect()}
    assert len(got) == 5 and "Roman_Crisis_Article" in got and "History" not in got
    assert sum(x.startswith("Seed") for x in got) == 1 and sum(x.startswith("Link") for x in got) == 3
    assert got["Seed_0"] == ["question search", "related"]


def test_discovery_and_pool(spark):
    from pyspark.sql import functions as F

    from gleaner.operators import chunk
    from gleaner.plans import pipeline, pools

    texts = {"Roman_Crisis": "The crisis of the republic began. " * 3, "Sulla": "Sulla was a general of the crisis. ", "Olive": "Olives grow. ", "Old_Name": ""}
    articles = spark.createDataFrame([(p, p.replace("_", " "), "", x) for p, x in texts.items()], "path string, title string, section string, body string")
    redirects = spark.createDataFrame([("Old_Name", "Roman_Crisis"), ("Sulla", "Sulla")], "path string, target string")
    links = spark.createDataFrame([("Roman_Crisis", "Sulla", "Sulla", "political crisis", 0)], "article_path string, href string, anchor string, context string, position int")
    plan_rows = plans(questions(spark, "What caused the Roman Crisis in the old republic?"))
    found = pools.discover_plan(plan_rows, articles, redirects, links)
    got = {r["article_path"]: r["reasons"] for r in found.collect()}
    assert "direct title" in got["Roman_Crisis"] and "Sulla" in got and "Olive" not in got
    single = spark.createDataFrame([(1, "X", 1), (9, "Y", 1)], "query_id int, article_path string, position int")
    assert {(r["query_id"], r["article_path"]) for r in pools.with_fallback(found, single).collect()} >= {(9, "Y")}
    blocks = articles.select(F.col("path").alias("article_path"), chunk.paragraphs("body").alias("blocks"))
    chunks = chunk.chunk_articles(blocks)
    pool = pools.pool_chunks(chunks, found)
    assert {r["article_path"] for r in pool.select("article_path").collect()} == {"Roman_Crisis", "Sulla"}
    ranked = pipeline.retrieve(plan_rows, chunks, pool=pool).orderBy("rerank_rank").collect()
    assert ranked[0]["article_path"] == "Roman_Crisis"
    answer = pipeline.ask(questions(spark, "What caused the Roman Crisis in the old republic?"), chunks, articles=found).first()
    assert answer["sources"][0]["article_path"] == "Roman_Crisis"
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.length("text").cast("double")).alias("vector"))
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<double>")
    assert pools.pool_cosine(pool, asked, vectors, 1).count() == 1
