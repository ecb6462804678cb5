"""Work that must not grow as the product of two tables."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from gleaner import catalog
from gleaner.operators import lexical
from gleaner.operators.best import Best
from gleaner.sources import archive


def most_rows(df: DataFrame) -> int:
    """The most rows that any node of a collected plan gave."""

    def under(node) -> int:  # noqa: ANN001
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return under(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return under(node.plan())
        counted = node.metrics().get("numOutputRows")
        own = int(counted.get().value()) if counted.isDefined() else 0
        below = node.children()
        return max([own, *(under(below.apply(i)) for i in range(below.size()))])

    df.collect()
    return under(df._jdf.queryExecution().executedPlan())


def plain_search(titles: list[str], asked: list[tuple[int, str]], limit: int) -> set[tuple]:
    found = set()
    for query_id, wanted in asked:
        rows = []
        for path in titles:
            shared = len(set(path.split(" ")) & set(wanted.split(" ")))
            if shared:
                rows.append((0 if path == wanted else 1 if path.startswith(wanted) else 2, -shared, len(path), path))
        found |= {(query_id, path, tier, -shared, n) for n, (tier, shared, _, path) in enumerate(sorted(rows)[:limit], 1)}
    return found


def test_search_does_not_pair_titles_and_queries(spark):
    rng = random.Random(5)
    words = ["red", "reds", "old", "ring", "bolt", "gear"]
    titles = sorted({f"{rng.choice(words)} {rng.choice(words)} {i}" for i in range(1500)} | {"red", "red ring", "rings", "old gear bolt"})
    asked = [(i, " ".join(rng.choices([*words, "none"], k=rng.randint(1, 3)))) for i in range(400)] + [(1000, "re"), (1001, "red ri"), (1002, "none")]
    frames = spark.createDataFrame([(x,) for x in titles], "path string"), spark.createDataFrame(asked, "query_id int, query string")
    found = archive.search_titles(*frames, 4)
    assert {tuple(r) for r in found.collect()} == plain_search(titles, asked, 4)
    assert most_rows(found) < 60_000  # pairs that share a word: over 200,000


def texts(rng: random.Random, n: int) -> list[tuple]:
    words = ["lützen", "lutzen", "war", "peace", "battle", "treaty", "naïve", "x1", "king", *map(str, range(60))]
    return [(f"c{i}", rng.choice("ab"), " ".join(rng.choices(words, k=2)), rng.choice(words), " ".join(rng.choices(words, k=rng.choice([0, 3, 30])))) for i in range(n)]


@pytest.mark.parametrize("share", [0.0, 1 / 128, 2.0])
def test_scan_equals_bm25(spark, monkeypatch, share):
    monkeypatch.setattr(lexical, "DENSE_SHARE", share)
    rows = texts(random.Random(7), 120)
    rows += [(f"d{i}", *rows[3][1:]) for i in range(9)] + [("e", "a", None, None, None), ("f", None, "war", "war", "war")]  # ties, no text, no pool
    chunks = spark.createDataFrame(rows, "chunk_id string, lang string, title string, section string, body string").repartition(3)
    asked = [(i, r[1], r[4]) for i, r in enumerate(rows[:20])] + [(50, "a", "Lützen lutzen war"), (51, "b", "***"), (52, "c", "war"), (53, None, "war")]
    queries = spark.createDataFrame(asked, "query_id long, lang string, query string")
    plain = queries.select("query_id", "query")
    assert sorted(lexical.scan(plain, chunks, 5, block=7).collect()) == sorted(lexical.bm25(plain, chunks, 5).collect())
    pool = chunks.join(queries.select("query_id", "lang"), "lang").drop("lang")
    expected = sorted(lexical.bm25(plain, pool, 5, "pool").collect())
    assert expected and sorted(lexical.scan(queries, chunks, 5, pool="lang").collect()) == expected
    assert lexical.scan(plain.limit(0), chunks).count() == lexical.scan(plain, chunks.limit(0)).count() == 0


def test_pools_read_each_document_once(spark, sf, monkeypatch):
    seen = []
    for name in ("postings", "_weights"):
        of = getattr(lexical, name, None)
        monkeypatch.setattr(lexical, name, lambda rows, *more, of=of: (seen.append(rows.count()), of(rows, *more))[1], raising=False)
    assert catalog.bm25_pool(spark, sf).count()
    assert sum(seen) <= spark.read.parquet(f"{sf}/documents.parquet").count()


def test_best_keeps_ties_in_order():
    kept = Best(2, 3, pa.string())
    for ids in (["d", "b", "f"], ["a", "c"], ["e", "g"]):
        kept.add(np.array([[1.0] * len(ids), [np.inf] * len(ids)]), pa.array(ids))
        assert len(kept.query) <= 3
    kept.add(np.array([[0.5, 1.0], [2.0, np.inf]]), pa.array(["z", "0"]))
    assert kept.rows(["q", "id", "s"], pa.array([7, 8])).to_pylist() == [{"q": 7, "id": x, "s": s} for x, s in (("z", 0.5), ("0", 1.0), ("a", 1.0))] + [{"q": 8, "id": "z", "s": 2.0}]


def test_fusion_does_not_pair_queries_and_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "EVERY", 2)
    rows = most_rows(catalog.rrf_hybrid(spark, sf))
    assert rows < 40_000  # terms by documents that hold them


def test_backfill_searches_once(spark, sf):
    assert "MapInArrow" not in catalog.dense_backfill(spark, sf)._jdf.queryExecution().toString()


def test_identity_of_blank_texts(spark, tmp_path):
    texts = ["war", None, "", " ", "".join(map(chr, range(1, 40))), "\x7f \u2028 \\ / é 😀"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "lost")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.candidate_identity(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES['candidate_identity']})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
