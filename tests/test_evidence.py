import pytest
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.operators import chunk, expand, rank, select, timeline
from gleaner.plans import interpret

HIT = "query_id int, position int, chunk_id string, article_path string, section string, subsection string, text string, score double"


def hits(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows, 1)], HIT)


def plan(spark, question="What caused the Republic crisis?", **changes):
    made = interpret.plans(spark.createDataFrame([(1, question)], "query_id int, question string"))
    return made.withColumns({k: F.lit(v) for k, v in changes.items()})


# --- reranking ---


def test_minmax(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (2, 5.0)], "query_id int, score double")
    found = df.select(rank.minmax("score", "query_id").alias("x")).collect()
    assert sorted(r["x"] for r in found) == [0, 0.5, 0.5, 1]


def test_references_lose_to_content(spark):
    long = "The crisis of the republic was a political conflict. " * 6
    rows = hits(spark, ("a_000", "A", "References", None, long, 0.99), ("b_000", "B", "Background", None, long, 0.75))
    found = rank.rerank(rows, plan(spark)).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in found] == ["b_000", "a_000"]
    assert found[1]["features"]["low_value"] == 1
    rank.check_permutation(rows, rank.rerank(rows, plan(spark)))
    with pytest.raises(ValueError):
        rank.check_permutation(rows, rank.rerank(rows, plan(spark)).limit(1))


def test_rerank_weights(spark):
    rows = hits(spark, ("a_000", "Roman_Republic", "Crisis", None, "short text", 1.0), ("b_000", "Roman_Empire", "Other", None, "short text", 0.0))
    found = {r["chunk_id"]: r for r in rank.rerank(rows, plan(spark)).collect()}
    f = found["a_000"]["features"]
    assert f["semantic"] == 1 and f["completeness"] == pytest.approx(0.1) and f["direct"] == pytest.approx(0.35)
    assert found["a_000"]["rerank_score"] == pytest.approx(sum(w * f[k] for k, w in rank.WEIGHTS.items()), abs=1e-7)
    assert found["b_000"]["features"]["topic_conflict"] == 1


def test_affinity(spark):
    rows = hits(spark, ("a", "A", "Structural origins", None, "", 0.0), ("b", "A", "Human and financial cost", None, "", 0.0))
    found = rows.select("chunk_id", rank.section_affinity(F.lit("cause"), F.lit("why did it happen")).alias("x")).collect()
    score = {r["chunk_id"]: r["x"] for r in found}
    assert score["a"] == pytest.approx(0.5) and score["b"] == pytest.approx(-1)
    asked = rows.select(rank.section_affinity(F.lit("cause"), F.lit("why the cost")).alias("x")).collect()
    assert asked[1]["x"] > 0


def test_hybrid_rerank(spark):
    text = "The crisis was long and political. " * 8
    rows = hits(spark, ("a_000", "A", "Origins", None, text, 0.0), ("b_000", "B", "Gallery", None, text, 0.0))
    fused = rows.withColumns({"fused_score": F.lit(1 / 61), "fused_rank": F.col("position"), "dense_pool_score": F.lit(0.5)})
    found = rank.hybrid_rerank(fused, plan(spark)).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in found] == ["a_000", "b_000"]
    assert found[0]["rerank_score"] - found[1]["rerank_score"] > 0.6
    kept = rank.hybrid_rerank(fused, plan(spark), backend="rrf").orderBy("rerank_rank").collect()
    assert [r["rerank_score"] for r in kept] == [pytest.approx(0.5), pytest.approx(0.5)]


# --- expansion ---


def test_paragraphs_stay_once(spark):
    rows = hits(spark, ("a", "A", "s", None, "One.\n\nTwo.", 1.0), ("b", "A", "s", None, "TWO. \n\nThree.", 0.9), ("c", "A", "s", None, "one.", 0.8), ("a", "A", "s", None, "Other.", 0.7))
    found = expand.deduplicate_paragraphs(rows, 10).orderBy("position").collect()
    assert [(r["chunk_id"], r["text"]) for r in found] == [("a", "One.\n\nTwo."), ("b", "Three.")]
    assert expand.deduplicate_paragraphs(rows, 1).count() == 1


def test_expansion_reserves_a_trigger(spark):
    rows = hits(
        spark, ("A_001", "A", "Human and financial cost", None, "many died", 0.6), ("A_002", "A", "Structural origins", None, "long tension", 0.5),
        ("A_003", "A", "Background", None, "the defenestration of 1618", 0.3), ("A_004", "A", "Phase I", None, "battle", 0.01),
    )
    asks = plan(spark, "What caused the war?")
    found = expand.expand_sections(rows, asks, Config(chunks_per_article=2))
    ids = {r["chunk_id"]: r["trigger_evidence"] for r in found.collect()}
    assert ids.keys() == {"A_003", "A_002"} or ids.keys() == {"A_003", "A_001"}
    assert ids["A_003"]
    everything = expand.expand_sections(rows, asks, Config())
    assert "A_004" not in {r["chunk_id"] for r in everything.collect()}
    order = [r["chunk_id"] for r in expand.final_chunks(everything, Config()).orderBy("position").collect()]
    assert order.index("A_002") < order.index("A_001")


def test_section_cap(spark):
    rows = hits(spark, *[(f"A_{k:03}", "A", "One", None, f"text {k}", 0.9 - k / 100) for k in range(6)], ("A_100", "A", "Two", None, "x", 0.2))
    found = expand.expand_sections(rows, plan(spark, "Tell me about A"), Config())
    assert {r["chunk_id"] for r in found.collect()} == {"A_000", "A_001", "A_002", "A_100"}


def test_timeline_pools(spark):
    rows = hits(spark, ("A_009", "A", "History", None, "later", 0.9), ("A_001", "A", "History", None, "opening", 0.5), ("A_000", "A", "Introduction", None, "lead", 0.4))
    ranked = rows.withColumn("rerank_score", F.col("score"))
    order = [r["chunk_id"] for r in expand.timeline_pool(ranked, Config()).orderBy("position").collect()]
    assert order == ["A_000", "A_001", "A_009"]
    legacy = expand.legacy_timeline_pool(rows.withColumn("expansion_score", F.col("score")), Config())
    assert [r["chunk_id"] for r in legacy.orderBy("position").collect()] == ["A_001", "A_000", "A_009"]


def test_samples_and_caps(spark):
    rows = spark.range(15).select(F.lit("A").alias("article_path"), F.col("id").cast("int").alias("chunk_no"))
    kept = sorted(r["chunk_no"] for r in expand.sample_chunks(rows, 10, "article_path").collect())
    assert len(kept) == 10 and kept[0] == 0 and kept[-1] == 14
    pool = rows.withColumns({"query_id": F.lit(1), "article_position": F.lit(1)})
    assert expand.cap_pool(pool, 4).count() == 4


# --- selection ---


def test_selection_bounds(spark):
    text = "The same long text about a war and its causes. " * 8
    rows = spark.createDataFrame(
        [(1, "a1", "a", text, 0.9), (1, "a2", "a", text, 0.89), (1, "b1", "b", "Other words on the treaty of peace. " * 8, 0.8), (1, "c1", "c", "Third topic of kings and queens. " * 8, 0.1)],
        "query_id int, chunk_id string, article_path string, text string, rerank_score double",
    )
    cfg = Config(context_token_budget=900, selected_chunks_per_article=1, duplicate_overlap_threshold=0.5)
    found = {r["chunk_id"]: r for r in select.select_diverse(rows, cfg).collect()}
    assert found["a1"]["position"] == 1 and found["b1"]["position"] == 2
    assert found["a2"]["reason"] in ("redundant", "article cap") and found["a2"]["position"] is None
    assert found["c1"]["reason"] == "below relevance floor"
    assert sum(r["token_estimate"] for r in found.values() if r["position"]) <= 900
    again = select.select_diverse(rows.repartition(3), cfg).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found.values()))


PACK = "query_id int, chunk_id string, article_path string, section string, text string, rerank_score double"


def test_packing(spark):
    long = "Distinct first fact. " * 1000
    rows = [(1, "a", "A", "s", long, 0.9), (1, "b", "B", "s", "A short useful text that stands by itself and says enough to count as a source of its own.", 0.8)]
    rows += [(1, "c", "C", "s", rows[1][4], 0.7), (1, "d", "D", "s", "x" * 20000, 0.6), (1, "e", "E", "s", "weak", 0.1)]
    found = {r["chunk_id"]: r for r in select.pack_evidence(spark.createDataFrame(rows, PACK), Config(context_token_budget=120, context_chars=1000)).collect()}
    for key, text in (("a", long), ("b", rows[1][4])):
        if found[key]["label"]:
            assert found[key]["supplied_text"] in text
    assert found["c"]["label"] is None or found["b"]["label"] is None
    assert found["d"]["reason"] == "token budget"
    assert found["e"]["reason"] == "lower relevance"
    labels = sorted(r["label"] for r in found.values() if r["label"])
    assert labels == [f"S{k + 1}" for k in range(len(labels))]


def test_packing_covers_both_sides(spark):
    rows = [(1, f"f{k}", "French_Revolution", "s", f"French evidence number {k} is about kings, estates and bread prices in the city. " * 2, 0.9) for k in range(2)]
    rows.append((1, "r", "Russian_Revolution", "s", "Russian evidence is about soviets, soldiers, land and peace in the capital city. " * 2, 0.3))
    df = spark.createDataFrame(rows, PACK).withColumn("subjects", F.array(F.lit("french revolution"), F.lit("russian revolution")))
    found = select.pack_evidence(df, Config(hybrid_pack_k=2)).filter("label is not null").collect()
    assert {r["article_path"] for r in found} == {"French_Revolution", "Russian_Revolution"}


def test_packing_without_a_budget(spark):
    df = spark.createDataFrame([(1, "a", "A", "s", "text", 0.9)], PACK)
    assert select.pack_evidence(df, fixed_tokens=9000).first()["reason"] == "no budget"
    df = df.withColumn("rerank_score", F.lit(None).cast("double"))
    assert select.pack_evidence(df).first()["label"] == "S1"


def test_novel_part():
    known = select.plain("This is a long sentence which another source has already supplied in full to the reader.")
    text = "This is a long sentence which another source has already supplied in full to the reader. A fresh one."
    assert select.novel_part(text, [known]) == "A fresh one."
    assert select.novel_part(text, []) == text


def test_contexts(spark):
    rows = hits(spark, *[(f"c{k}", "A", "s", None, "é" * 2000, 1.0) for k in range(5)])
    found = select.contexts(rows, max_chars=6000, token_budget=1000).first()
    assert found["tokens"] <= 1000 and found["sources"] == 1


# --- chunks ---


def fold(blocks, max_chars, overlap):
    """The chunker as a plain loop."""
    out, section, sub, now = [], "Introduction", None, []

    def flush():
        if now:
            out.append((section, sub, "\n\n".join(now).strip()))

    for kind, text in blocks:
        if kind in ("h2", "h3"):
            flush()
            section, sub, now = (text, None, []) if kind == "h2" else (section, text, [])
            continue
        if now and len("\n\n".join([*now, text])) > max_chars:
            flush()
            kept, size = [], 0
            for p in reversed(now):
                if kept and size + len(p) > overlap:
                    break
                kept.insert(0, p)
                size += len(p)
                if size >= overlap:
                    break
            now = kept
        now.append(text)
    flush()
    return out


@pytest.mark.parametrize("seed", range(6))
def test_chunks_equal_a_loop(spark, seed):
    import random

    rng = random.Random(seed)
    blocks = [(rng.choice(["h2", "h3"] + ["p"] * 6), f"{k} " + "w" * rng.randint(1, 60)) for k in range(40)]
    df = spark.createDataFrame([("A", [{"type": t, "text": x} for t, x in blocks])], "article_path string, blocks array<struct<type:string,text:string>>")
    found = chunk.chunk_articles(df, 100, 30).orderBy("chunk_no").collect()
    assert [(r["section"], r["subsection"], r["text"]) for r in found] == fold(blocks, 100, 30)
    assert [r["chunk_id"] for r in found] == [f"A_{k:03}" for k in range(len(found))]


# --- events ---


def test_events(spark):
    rows = hits(
        spark, ("c3", "W", "End", None, "Peace was signed in 1648.", 0.5), ("c1", "W", "1618", None, "The governors were thrown out. They lived.", 0.6),
        ("c2", "W", "Course", None, "On 8 November 1620 the battle was fought. It was short.\nOn 19 August, he rescinded the 1617 election. There were 109 delegations.", 0.4),
    )
    found = timeline.extract_events(rows).orderBy("event_no").collect()
    assert [r["chunk_id"] for r in found] == ["c1", "c1", "c2", "c3"]
    assert [(r["year"], r["month"], r["day"]) for r in found] == [(1618, 0, 0), (1618, 0, 0), (1620, 11, 8), (1648, 0, 0)]
    assert found[0]["heading_date"] and not found[2]["heading_date"]
    assert found[2]["event"].endswith("It was short.")
    texts = [r["text"] for r in timeline.event_hits(timeline.extract_events(rows)).orderBy("position").collect()]
    assert texts[0].startswith("1618 — ") and texts[2].startswith("With date: ")


def test_event_bounds_and_sampling(spark):
    rows = hits(spark, *[(f"c{k:02}", "W", "S", None, f"A thing happened in {1600 + k}.", 0.1) for k in range(30)], ("d", "W", "S", None, "A battle took place in 1605 there.", 0.1))
    bounded = rows.withColumns({"low": F.lit(1610), "high": F.lit(1612)})
    assert [r["year"] for r in timeline.extract_events(bounded, bounds=True).orderBy("event_no").collect()] == [1610, 1611, 1612]
    found = timeline.extract_events(rows, max_events=5).collect()
    assert len(found) == 5 and "d" in {r["chunk_id"] for r in found}


def test_dated_records(spark):
    rows = hits(spark, *[(f"c{k:02}", "W", "S", None, f"Date: 1800; Battle: Example {k}", 0.5) for k in range(15)])
    ids = [r["chunk_id"] for r in timeline.dated_records(rows).collect()]
    assert len(ids) == 10 and {"c00", "c14"} <= set(ids)
    prose = hits(spark, *[(f"c{k:02}", "W", "S", None, "prose", 0.5) for k in range(12)])
    assert sorted(r["position"] for r in timeline.dated_records(prose).collect()) == list(range(1, 9))


def test_periods(spark):
    asks = spark.createDataFrame(
        [(1, "What happened between 1618 and 1648?", "x", None), (2, "next", "next", 1700), (3, "Tell me of the Long War", "tell me of the long war", None), (4, "none", "none", None)],
        "query_id int, question string, resolved_question string, anchor_year int",
    )
    chunks = spark.createDataFrame([("Long_War", "Long_War_000", "Introduction", "It lasted from 1593 to 1606 in all.")], "article_path string, chunk_id string, section string, text string")
    found = {r["query_id"]: (r["low"], r["high"]) for r in timeline.infer_period(asks, chunks).collect()}
    assert found == {1: (1618, 1648), 2: (1700, 1730), 3: (1593, 1606), 4: (None, None)}
    ends = spark.createDataFrame([(1, "Outline the sequence from reform congress crisis to collapse")], "query_id int, question string")
    lead = spark.createDataFrame([("A", "A_000", "Introduction", "The reform congress met the crisis from 1800 to 1810. In 1900 more.")], "article_path string, chunk_id string, section string, text string")
    assert [(r["low"], r["high"]) for r in timeline.endpoint_period(ends, lead).collect()] == [(1800, 1810)]


def test_model_entries(spark):
    sources = spark.createDataFrame(
        [(1, "S1", "1620", (1620, 0, 0), "In 1620 a battle."), (1, "S2", "1618", (1618, 0, 0), "In 1618 a fall.")],
        "query_id int, label string, date_text string, sortable_date struct<year:int,month:int,day:int>, supplied_text string",
    )
    entries = spark.createDataFrame(
        [(1, 1, "S1", "Battle of 1620"), (1, 2, "S1", "again"), (1, 3, "S2", "Fall"), (1, 4, "S9", "unknown"), (1, 5, "S2", "In 1999")], "query_id int, entry_no int, source_label string, summary string"
    )
    found = timeline.valid_entries(entries, sources).orderBy("line_no").collect()
    assert [(r["source_label"], r["summary"]) for r in found] == [("S2", "Fall"), ("S1", "Battle of 1620")]


def test_focus_pool(spark):
    pool = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B")], "query_id int, article_path string")
    plans = spark.createDataFrame([(1, 1800, ["A"]), (2, None, ["A"])], "query_id int, anchor_year int, matched_articles array<string>")
    assert sorted(map(tuple, timeline.focus_pool(pool, plans).select("query_id", "article_path").collect())) == [(1, "A"), (2, "B")]
