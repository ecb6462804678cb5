import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import mixing
from gleaner.llm.common import WORD


def water_filling(sizes, weights=mixing.WEIGHTS, percent=mixing.PERCENT, most=mixing.MOST):
    """Targets by sharing again and again; sizes: source to words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: dict = {}
    total = sum(sizes.values()) * percent / 100
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1e-300, sum(weight[s] for s in free))
        over = {s: most * sizes[s] for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= over


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["copies"] * r["size"] + r["part"] and 0 <= r["part"] < max(1, r["size"])
    expected = water_filling(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
    for s, words in taken.items():
        assert abs(words - expected[s]) <= 1
    return expected


@pytest.mark.parametrize("parts", [1, 9])
def test_mix(spark, docs, texts, parts):
    rows = mixing.mix(docs.repartition(parts)).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(re.findall(WORD, t)) for i, t in texts.items()}
    check(rows)
    # At most one cut copy for each source, and the rest whole.
    cut = [r["source"] for r in rows if r["part"]]
    assert len(cut) == len(set(cut))


def test_reruns_agree(docs):
    one = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert one == {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect()}


def test_rates_solve_the_dual(spark):
    """Rates are min(2, exp(tilt * size / mean)) and meet the targets."""
    sizes = [(s, n) for s, top in (("a", 400), ("b", 30), ("c", 5000)) for n in range(1, top, max(1, top // 60))]
    counts = spark.createDataFrame(sizes, "source string, size long").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    for share in (0.01, 0.5, 1.0, 1.5, 1.99):
        solved = mixing.solve(counts, totals.withColumn("target", F.col("source_size") * share)).collect()
        for r in solved:
            import math

            words = sum(n * min(2, math.exp(r["tilt"] * n / r["mean"])) for s, n in sizes if s == r["source"])
            assert words == pytest.approx(r["target"], rel=1e-6)


def test_mix_odd(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and {r["taken"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    check(rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    alone = spark.createDataFrame([(1, "one two", "x")], "doc_id long, text string, source string")
    assert mixing.mix(alone).first()["taken"] == 3
    assert mixing.mixed_documents(odd).columns == odd.columns


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_documents_follow_the_mix(request, name):
    """Documents stand as often as the mix takes them; the last copy of a source is whole or not there."""
    df = request.getfixturevalue(name)
    expected = defaultdict(int)
    for r in mixing.mix(df).collect():
        expected[r["doc_id"], r["source"], r["size"]] += r["copies"] + (2 * r["part"] >= max(1, r["size"]))
    made = mixing.mixed_documents(df)
    assert made.columns == df.columns
    found = made.groupBy("doc_id", "source", mixing.word_count("text")).count().collect()
    assert {tuple(r[:3]): r[3] for r in found} == {k: n for k, n in expected.items() if n}
    assert made.filter("text is not null").select("text").exceptAll(df.crossJoin(df.sparkSession.range(2)).select("text")).count() == 0


def test_one_cell_holds_the_order(spark, monkeypatch):
    """Few cells leave long lists to be put in order, many none: the mix is the same."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 37)) AS text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'c')) AS source")
    found = []
    for cells in (1, 5, 4096):
        monkeypatch.setattr(mixing, "CELLS", cells)
        found.append(sorted((r["doc_id"], r["taken"]) for r in mixing.mix(rows).collect()))
    assert found[0] == found[1] == found[2]


def test_rates_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 3)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.0)
    rows = spark.createDataFrame([(k, "w " * (k + 1), "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    with pytest.raises(ArithmeticError):
        mixing.mix(rows).collect()


def test_pipeline(spark, sf, docs, texts):
    """run() is its stages in order, and each decision is the operator's own as tested against brute force."""
    from tests.llm.test_dedup import components
    from tests.llm.test_texts import encoded

    kept, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
        stages[name] = kept.collect()
        if name != "packing":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(stages[name], docs.schema)
    assert list(stages) == ["language_id", "exact_dedup", "minhash", "mixing", "packing"]
    known = {r["doc_id"] for r in stages["language_id"]}
    assert {i for i, t in texts.items() if not any(map(str.isalpha, t))}.isdisjoint(known) and len(known) >= 0.99 * len(texts)
    last = {texts[i]: i for i in sorted(known)}
    assert {r["doc_id"] for r in stages["exact_dedup"]} == set(last.values())
    near = components([(i, texts[i]) for i in last.values()])
    assert {r["doc_id"] for r in stages["minhash"]} == {i for i, x in near.items() if x[2]}
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in stages["minhash"]:
        n = len(re.findall(WORD, r["text"]))
        sizes[r["source"]] += n
        longest[r["source"]] = max(n, longest[r["source"]])
    mixed = defaultdict(int)
    for r in stages["mixing"]:
        mixed[r["source"]] += len(re.findall(WORD, r["text"]))
    for s, target in water_filling(sizes).items():
        assert abs(mixed[s] - target) <= 1 + longest[s] / 2  # one whole copy more or less
    assert {r["text"] for r in stages["mixing"]} <= {r["text"] for r in stages["minhash"]}
    tokens = sum(len(x) + 1 for x in encoded([r["text"] for r in stages["mixing"]]))
    assert sum(r["length"] for r in stages["packing"]) == tokens
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == tokens


def test_pipeline_odd(spark, odd, empty):
    """Nulls, repeated rows, ties and clashing columns pass through all stages; an empty table gives an empty result."""
    kept = odd
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, None)
        if name != "packing":
            assert kept.columns == odd.columns
            rows = kept.collect()
            assert rows
            kept = spark.createDataFrame(rows, odd.schema)
    assert kept.count() > 0
    kept = empty
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, None)
    assert kept.count() == 0


def test_release(spark):
    """What was written goes, what the result reads stays."""
    from gleaner.llm import common

    earlier = common.materialize(spark.range(2))
    begin = common.written()
    gone, stays = (common.materialize(spark.range(n)) for n in (3, 4))
    common.release(spark, stays, begin)
    assert stays.count() == 4 and earlier.count() == 2 and common.written() == begin + 1
    common.release(spark, since=begin)
    assert common.written() == begin and earlier.count() == 2
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        gone.collect()
