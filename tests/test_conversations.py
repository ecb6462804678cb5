import json

import pytest

from gleaner.operators import conversation
from gleaner.plans import generate, output, pipeline
from gleaner.sources import store
from gleaner.streaming import conversation as stream

MESSAGES = [
    (1, 0, "system", "rules"), (1, 1, "user", "Tell me about the war of 1618"), (1, 2, "assistant", "It began in 1618 [S1]."), (1, 3, "user", "Why?"),
    (1, 4, "assistant", "Because."), (1, 5, "user", "/new"), (1, 6, "user", "Who was Tilly?"), (1, 7, "assistant", "A general."), (2, 0, "user", "no answer"),
]


def messages(spark):
    return spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")


def test_turns_and_state(spark):
    turns = conversation.turn_pairs(messages(spark))
    found = [(r["session"], r["turn_no"], r["question"]) for r in turns.orderBy("session", "turn_no").collect()]
    assert found == [(0, 1, "Tell me about the war of 1618"), (0, 2, "Why?"), (1, 1, "Who was Tilly?")]
    state = {(r["session"], r["turn_no"]): r for r in conversation.window_state(turns).collect()}
    assert state[0, 1]["periods"] == ["1618"] and len(state[0, 2]["turns"]) == 2 and len(state[1, 1]["turns"]) == 1
    assert state[0, 1]["turns"][0]["answer_summary"] == "It began in 1618 ."
    context = conversation.context(conversation.window_state(turns), 60).collect()
    assert all(len(r["context"]) <= 60 for r in context)


def test_stream_equals_one_by_one(spark, tmp_path):
    """Two micro-batches: the state carries a waiting question over, and late repeats are skipped."""
    df = messages(spark)
    parts = [df.filter("turn <= 3"), df.filter("turn >= 3")]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    done = stream.memory(source, max_turns=2).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, part in enumerate(parts):
            part.coalesce(1).write.parquet(str(tmp_path / "in" / f"x{k}"))
            for f in (tmp_path / "in" / f"x{k}").glob("*.parquet"):
                f.rename(tmp_path / "in" / f"{k}.parquet")
            done.processAllAvailable()
    finally:
        done.stop()
    rows = spark.table("turns").orderBy("turn").collect()
    assert [(r["turn"], r["question"], r["is_followup"], r["turns"]) for r in rows] == [(2, "Tell me about the war of 1618", False, 1), (4, "Why?", True, 2), (7, "Who was Tilly?", False, 1)]
    assert "Tell me about the war of 1618" in rows[1]["retrieval_query"]


SAVED = "id string, title string, updated double, state string, turns string"


def saved(spark):
    turns = json.dumps([{"question": "Q?", "result": {"answer": "A [S1].", "sources": [{"label": "S1", "article_path": "Some_Page", "section": "Intro", "subsection": None}]}}])
    return spark.createDataFrame([("a", "Causes", 123.0, "{}", turns), ("b", "The Consequences", 200.0, "{}", turns), ("c", "Empty", 300.0, "{}", "[]")], SAVED)


def test_store(spark):
    table = store.migrate(saved(spark))
    row = table.filter("id = 'a'").first()
    assert (row["created"], row["archived"], row["revision"]) == (123.0, 0, 1)
    assert [r["id"] for r in store.list_saved(table).collect()] == ["b", "a"]
    assert [r["id"] for r in store.list_saved(table, "CONSEQuences").collect()] == ["b"]
    renamed = store.rename(table, "a", "  New  ", 400.0)
    assert store.list_saved(renamed).first()["title"] == "New"
    assert renamed.filter("id = 'a'").first()["revision"] == 2
    gone = store.archive(table, "a", 400.0)
    assert [r["id"] for r in store.list_saved(gone).collect()] == ["b"]
    for bad in (lambda: store.rename(gone, "a", "x", 1.0), lambda: store.rename(table, "a", " ", 1.0), lambda: store.rename(table, "a", "x" * 121, 1.0), lambda: store.list_saved(table, "x" * 201)):
        with pytest.raises(ValueError):
            bad()


def test_upsert(spark):
    table = store.migrate(saved(spark))
    changes = spark.createDataFrame([("a", "Again", "{}", "[]"), ("n", "New", "{}", "[]")], "id string, title string, state string, turns string")
    found = {r["id"]: r for r in store.upsert(table, changes, 500.0).collect()}
    assert (found["a"]["revision"], found["a"]["created"], found["a"]["updated"]) == (2, 123.0, 500.0)
    assert (found["n"]["revision"], found["n"]["created"]) == (1, 500.0)
    assert found["b"]["revision"] == 1


def test_export_and_load(spark, tmp_path):
    table = store.migrate(saved(spark))
    text = {r["id"]: r["markdown"] for r in store.export_markdown(table).collect()}
    assert text["a"] == "# Causes\n\n_Created 1970-01-01 00:02 UTC_\n\n## Question\n\nQ?\n\n## Answer\n\nA [S1].\n\n### Sources\n\n- [S1] Some Page — Intro (`Some_Page`)\n"
    assert store.load(table, "a").first()["turns"][0]["question"] == "Q?"
    damaged = spark.createDataFrame([("a", "t", 1.0, "nonsense", "[]")], SAVED)
    with pytest.raises(Exception, match="damaged|MALFORMED"):
        store.load(store.migrate(damaged), "a").collect()
    assert store.open_store(spark).count() == 0
    table.write.parquet(str(tmp_path / "s"))
    assert store.open_store(spark, str(tmp_path / "s")).count() == 3


# --- whole answers ---


def corpus(spark):
    texts = {
        "Bohemian_Revolt": "The defenestration of Prague in 1618 began the Bohemian revolt. Protestant nobles resisted the crown and its religious policy for years.",
        "Peace_of_Westphalia": "The peace of Westphalia was signed in 1648. It ended the long war between many states and settled the religious quarrel at last.",
        "Olive": "Olives grow near the sea. They are pressed for oil in the autumn, and the oil is kept in large jars all the year round.",
    }
    return spark.createDataFrame([(k, f"{k}_000", "Introduction", None, v * 2) for k, v in texts.items()], "article_path string, chunk_id string, section string, subsection string, text string")


def test_ask(spark):
    questions = spark.createDataFrame([(1, "What caused the Bohemian revolt?"), (2, "zzz qqq"), (3, "Give a timeline of the revolt and the peace")], "query_id int, question string")
    found = {r["query_id"]: r for r in pipeline.ask(questions, corpus(spark)).collect()}
    assert found[1]["sources"][0]["article_path"] == "Bohemian_Revolt" and found[1]["unknown_labels"] == []
    assert found[1]["answer"].startswith("The defenestration of Prague in 1618")
    assert found[2]["answer"] == generate.ABSTENTION and found[2]["skipped_generation"]
    assert found[3]["events"] >= 2
    assert "[S1]" in output.answer_text(found[1].asDict(recursive=True))
    assert output.usage_text({"skipped": True}) and "prompt 3" in output.usage_text({"model": "m", "prompt_tokens": 3})


def test_retrieve_with_and_without_vectors(spark):
    from gleaner.plans import interpret

    plans = interpret.plans(spark.createDataFrame([(1, "peace treaty quarrel")], "query_id int, question string"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    v = spark.createDataFrame([("Olive_000", [1.0, 0.0]), ("Bohemian_Revolt_000", [0.0, 1.0])], "chunk_id string, vector array<double>")
    alone = {r["chunk_id"]: r["origins"] for r in pipeline.retrieve(plans, corpus(spark)).collect()}
    assert set(map(tuple, alone.values())) == {("bm25",)}
    both = {r["chunk_id"]: r["origins"] for r in pipeline.retrieve(plans, corpus(spark), q, v).collect()}
    assert both["Olive_000"] == ["dense"] and both["Peace_of_Westphalia_000"] == ["bm25"]
    legacy = pipeline.retrieve_legacy(plans, corpus(spark), q, v).collect()
    assert [r["chunk_id"] for r in legacy] == ["Olive_000"]
    row = pipeline.evaluate(plans.select("query_id"), q, corpus(spark), v, spark.createDataFrame([(1, "Olive_000")], "query_id int, chunk_id string")).first()
    assert row["hit_rate_1"] == 1


def test_benchmark_of_models(spark):
    from gleaner.__main__ import benchmark, generator
    from gleaner.config import Config
    from gleaner.plans.generate import Extractive

    assert generator("Extractive") == generator("gleaner.plans.generate:Extractive") == Extractive()
    questions = spark.createDataFrame([(1, "What was the Peace of Westphalia?")], "query_id int, question string")
    rows = benchmark(spark, questions, corpus(spark), [Extractive("one", 1), Extractive("two", 2)], Config()).collect()
    assert {r["model"] for r in rows} == {"one", "two"} and all(r["runs"] == 1 and r["tokens_per_second"] > 0 for r in rows)
