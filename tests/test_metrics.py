import pytest

from gleaner.operators import metrics


def test_ir_metrics(spark):
    questions = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    qrels = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "z")], "query_id string, chunk_id string")
    hits = spark.createDataFrame([("q1", 1, "x"), ("q1", 2, "a"), ("q1", 3, "b"), ("q2", 1, "x")], "query_id string, rank int, chunk_id string")
    row = metrics.ir_metrics(questions, qrels, hits).first()
    assert (row["hit_rate_1"], row["hit_rate_3"], row["recall_3"], row["mrr_5"]) == (0, 0.5, 0.5, 0.25)
    assert (row["judged"], row["unjudged"]) == (2, 1)
    twice = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "a")], "query_id string, rank int, chunk_id string")
    assert metrics.ir_metrics(questions.filter("query_id = 'q1'"), qrels, twice).first()["recall_3"] == 0.5
    none = metrics.ir_metrics(questions, qrels.limit(0), hits).first()
    assert none["recall_1"] is None and none["unjudged"] == 3


def test_benchmark_is_checked(spark):
    questions = spark.createDataFrame([(1,), (2,)], "query_id int")
    chunks = spark.createDataFrame([("a",)], "chunk_id string")
    good = spark.createDataFrame([(1, "a")], "query_id int, chunk_id string")
    metrics.check_benchmark(questions, good, chunks)
    for q, r, digest in ((questions.union(questions), good, None), (questions, spark.createDataFrame([(1, "b")], "query_id int, chunk_id string"), None), (questions, good, "other")):
        with pytest.raises(ValueError):
            metrics.check_benchmark(q, r, chunks, digest)


def test_facets(spark):
    rows = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "The Edict, of Restitution!")], "query_id int, rank int, text string")
    facets = spark.createDataFrame([(1, "edict", "edict of restitution"), (1, "peace", "peace of prague")], "query_id int, facet string, span string")
    row = metrics.facet_coverage(rows, facets).first()
    assert (row["covered"], row["coverage"]) == (1, 0.5)
    n = metrics.ndcg_partial(rows, facets).first()
    assert n["mrr"] == 0.5 and n["ndcg"] == pytest.approx(0.6309, abs=1e-4)
    before = metrics.facet_matches(rows, facets)
    assert metrics.lost_facets(before, before.limit(0)).count() == 1
    found = spark.createDataFrame([(1, 2, ["bm25"]), (1, 1, ["bm25", "dense"])], "query_id int, rank int, origins array<string>")
    assert metrics.lexical_only_support(found, before).count() == 1


def test_repeats_count_across_sources_only(spark):
    rows = spark.createDataFrame([(1, 1, "a b c a b c"), (1, 2, "a b c d")], "query_id int, source_no int, text string")
    row = metrics.repeated_trigram_share(rows).first()
    assert (row["grams"], row["repeated"]) == (6, 1)


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [S2] y [S1] [S2] [S9]"), (2, "none")], "answer_id int, answer string")
    known = spark.createDataFrame([(1, "S1"), (1, "S2")], "answer_id int, label string")
    found = {r["answer_id"]: r for r in metrics.citation_check(answers, known).collect()}
    assert found[1]["cited_labels"] == ["S1", "S2", "S9"] and found[1]["unknown_labels"] == ["S9"]
    assert found[2]["cited_labels"] == [] and not found[2]["has_citations"]


def test_usage(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10.0, 2.0, 1e9), (None, 1.0, 0.0), (-1.0, 0.0, 1e9), (nan, inf, 1.0), (1.2, 3.0, 1e9)]
    df = spark.createDataFrame(rows, "prompt_eval_count double, eval_count double, eval_duration double")
    found = [(r["prompt_tokens"], r["output_tokens"], r["total_tokens"], r["tokens_per_second"]) for r in metrics.usage(df).collect()]
    assert found == [(10, 2, 12, 2), (None, 1, None, None), (None, 0, None, 0), (None, None, None, None), (None, 3, None, 3)]


def test_summaries(spark):
    rows = spark.createDataFrame([("m", 10, 1e9, 1.0), ("m", 30, 1e9, 3.0)], "model string, eval_count int, eval_duration double, wall_seconds double")
    row = metrics.throughput(rows, "model").first()
    assert (row["tokens_per_second"], row["wall_seconds"]) == (20, 2)
    stats = metrics.summary(rows, ["wall_seconds"]).first()
    assert (stats["wall_seconds_mean"], stats["wall_seconds_median"], stats["wall_seconds_min"], stats["wall_seconds_max"]) == (2, 2, 1, 3)
    assert metrics.compare_models(rows, rows.select("wall_seconds").distinct()).count() == 4
    audit = spark.createDataFrame([(1, "exact", "a"), (1, "unavailable", "a"), (1, "section", "b")], "query_id int, evidence_status string, supplied_text string")
    a = metrics.source_audit(audit).first()
    assert (a["sources"], a["resolvable"], a["highlighted"], a["duplicates"]) == (3, 2, 1, 1)


def test_acceptance(spark):
    after = spark.createDataFrame([(1, 0.7)], "query_id int, coverage double")
    before = spark.createDataFrame([(1, 0.5)], "query_id int, coverage double")
    events = spark.createDataFrame([(1, 1, 1618, 0, 0), (1, 2, 1648, 0, 0)], "query_id int, event_no int, year int, month int, day int")
    row = metrics.acceptance(after, before, events).first()
    assert row["enough_gain"] and row["events_sorted"] and row["sensible_events"]
