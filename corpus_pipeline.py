"""A corpus from documents to packed sequences, in five stages.

Each stage works on all rows that the one before kept, and is written and read again before the next.

Cases: null and empty texts and texts without letters go with the first stage; repeated rows, ties, null ids and
extra columns of any name pass as each operator states; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import exact_dedup, language_id, minhash, mixing, packing
from gleaner.llm.common import materialize, read, release, written
from gleaner.llm.queries import tokenizer


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: no letters, or no learned language explains them better than chance."""
    return language_id.keep_identified(docs, language_id.train(docs.filter(~language_id.held_out())))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays."""
    return minhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("exact_dedup", without_copies),
    ("minhash", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express language ID, min-max hashing, entropy balancing or tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs, begin = read(spark, sf_dir, "documents"), written()
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, docs, begin)  # what the stage wrote on its way
    return docs
