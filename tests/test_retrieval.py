import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from gleaner.config import Config, load
from gleaner.functions import identity
from gleaner.operators import dense, fusion, lexical


def fts5(rows, match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE e USING fts5(title, section, body, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO e(rowid, title, section, body) VALUES (?,?,?,?)", rows)
    return dict(con.execute("SELECT rowid, bm25(e, 2.0, 1.5, 1.0) FROM e WHERE e MATCH ?", (match,)).fetchall())


def test_bm25_equals_fts5(spark):
    rng = random.Random(3)
    vocabulary = ["lützen", "war", "peace", "battle", "treaty", "naïve", "x1", "king", "queen", "river"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=2)), rng.choice(vocabulary), " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, section string, body string")
    queries = spark.createDataFrame([(1, "Lutzen battle"), (2, "NAIVE king? x1"), (3, "***"), (4, "Lutzen Lützen")], "query_id int, query string")
    found = {}
    for r in lexical.bm25_scores(queries, chunks).collect():
        found.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    for q, match in ((1, '"lutzen" OR "battle"'), (2, '"naive" OR "king" OR "x1"'), (4, '"lutzen" OR "lützen"')):
        expected = fts5(rows, match)
        assert found[q].keys() == expected.keys()
        assert all(found[q][k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())
    assert 3 not in found


def test_bm25_pool_has_its_own_statistics(spark):
    rows = [(1, 1, "", "", "a b"), (1, 2, "", "", "b c"), (2, 1, "", "", "a b"), (2, 3, "", "", "a a"), (2, 4, "", "", "d")]
    pool = spark.createDataFrame(rows, "query_id int, chunk_id int, title string, section string, body string")
    queries = spark.createDataFrame([(1, "a"), (2, "a")], "query_id int, query string")
    found = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.bm25_scores(queries, pool, "pool").collect()}
    assert set(found) == {(1, 1), (2, 1), (2, 3)}
    for q in (1, 2):
        expected = fts5([r[1:] for r in rows if r[0] == q], '"a"')
        assert all(found[q, k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())
    with pytest.raises(ValueError):
        lexical.check_pool(pool, 2)


def test_empty_pool(spark):
    empty = spark.createDataFrame([], "chunk_id int, title string, section string, body string")
    assert lexical.bm25(spark.createDataFrame([(1, "a")], "query_id int, query string"), empty).count() == 0


def test_manifest_ignores_order(spark):
    rows = spark.createDataFrame([("a_000", "A", "i1"), ("b_000", "B", "i2")], "chunk_id string, article_path string, candidate_id string")
    one = lexical.manifest(rows, "c1", "k1")
    lexical.validate_manifest(one, lexical.manifest(rows.repartition(3), "c1", "k1"))
    with pytest.raises(ValueError):
        lexical.validate_manifest(one, lexical.manifest(rows, "c2", "k1"))


def test_cosine_topk(spark):
    corpus = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0]), ("c", [2.0, 0.0])], "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    found = dense.cosine_topk(queries, corpus, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in found] == ["a", "c"]
    assert found[0]["score"] == 1
    assert dense.cosine_topk(queries, corpus, 2, block=1).count() == 2
    with pytest.raises(ValueError):
        dense.cosine_topk(queries, corpus, 0)


@pytest.mark.parametrize("vector", [[0.0, 0.0], [float("nan"), 1.0], []])
def test_bad_vectors(spark, vector):
    df = spark.createDataFrame([(1, vector)], "id int, vector array<double>")
    with pytest.raises(Exception, match="finite"):
        dense.check_vectors(df).collect()


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(dense.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1)
    assert df.select(dense.dot(dense.normalize("a"), dense.normalize("b"))).first()[0] == pytest.approx(1)


def test_blend_consolidate_and_cache(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 0.5)], "query_id int, chunk_id string, score double")
    b = spark.createDataFrame([(1, "x", 0.0), (1, "y", 1.0)], "query_id int, chunk_id string, score double")
    assert {r["chunk_id"]: round(r["score"], 6) for r in dense.blend(a, b).collect()} == {"x": 0.6, "y": 0.7}
    assert {r["chunk_id"]: r["score"] for r in dense.consolidate(a.union(b)).collect()} == {"x": 1.0, "y": 1.0}
    chunks = spark.createDataFrame([("t1",), ("t2",)], "text string")
    cache = dense.uncached(chunks.limit(1), spark.createDataFrame([], "key string"), "m").select("key")
    assert dense.uncached(chunks, cache, "m").count() == 1
    assert dense.uncached(chunks, cache, "other").count() == 2
    sides = spark.createDataFrame([("events from the crown to the fall?",), ("plain",)], "q string").select(dense.endpoint_sides("q")).collect()
    assert [r[0] for r in sides] == [["the crown", "the fall"], None]


SCHEMA = "query_id int, branch string, candidate_id string, score double"
DIRECTIONS = {"dense": "higher", "bm25": "lower"}


def test_rrf_by_hand(spark):
    rows = [(1, "dense", "A", 0.9), (1, "dense", "A", 0.1), (1, "dense", "B", 0.8), (1, "bm25", "B", -5.0), (1, "bm25", "C", -2.0)]
    found = fusion.rrf(spark.createDataFrame(rows, SCHEMA), DIRECTIONS).orderBy("fused_rank").collect()
    assert [r["candidate_id"] for r in found] == ["B", "A", "C"]
    assert found[0]["fused_score"] == pytest.approx(1 / 62 + 1 / 61)
    assert found[1]["fused_score"] == pytest.approx(1 / 61)
    assert found[0]["origins"] == ["bm25", "dense"]
    assert "bm25" not in found[1]["branches"]
    assert found[0]["branches"]["bm25"]["score"] == -5


def test_rrf_ties_and_bounds(spark):
    rows = [(1, "dense", "A", 1.0), (1, "dense", "B", 1.0)]
    one = fusion.rrf(spark.createDataFrame(rows, SCHEMA), {"dense": "higher"}).collect()
    assert one == fusion.rrf(spark.createDataFrame(rows[::-1], SCHEMA), {"dense": "higher"}).collect()
    df = spark.createDataFrame(rows, SCHEMA)
    assert fusion.rrf(df, {"dense": "higher"}, branch_limit=1, output_limit=1).count() == 1
    assert fusion.rrf(spark.createDataFrame([], SCHEMA), DIRECTIONS).count() == 0
    for bad in ({"k": 0}, {"output_limit": True}, {"branch_limit": 1.5}):
        with pytest.raises(ValueError):
            fusion.rrf(df, {"dense": "higher"}, **bad)
    with pytest.raises(ValueError):
        fusion.rrf(df, {"other": "higher"})
    with pytest.raises(Exception, match="finite"):
        fusion.rrf(spark.createDataFrame([(1, "dense", "A", float("nan"))], SCHEMA), {"dense": "higher"}).collect()


def test_identity(spark):
    rows = [("A", "A", "i", "t"), ("Alias", "A", "i", "t"), ("B", None, "i", "t")]
    df = spark.createDataFrame(rows, "article_path string, canonical_article_id string, section string, text string")
    a, alias, b = [r[0] for r in df.select(identity.candidate_id(df, "c1", "k1")).collect()]
    assert a == alias != b
    assert a != df.select(identity.candidate_id(df, "c2", "k1")).first()[0]
    hits = spark.createDataFrame([("A", "A_000", " ")], "article_path string, chunk_id string, text string")
    with pytest.raises(Exception, match="requires text"):
        identity.adapt_hits(hits, "c", "k").collect()


def test_config(tmp_path):
    assert load(rrf_k=10).rrf_k == 10
    (tmp_path / "c.json").write_text('{"retrieval_mode": "legacy"}')
    assert load(str(tmp_path / "c.json")).retrieval_mode == "legacy"
    for bad in ({"nope": 1}, {"candidate_chunks_total": 481}, {"hybrid_branch_k": 41}, {"similarity_threshold": 1.5}, {"max_chars": 0}, {"rerank_backend": "x"}, {"history_chars": 3001}):
        with pytest.raises(ValueError):
            load(**bad)
    assert Config().context_token_budget == 4800
