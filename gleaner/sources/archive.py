"""The archive as a table (path, redirect_to, mimetype, html), and stores of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import title_key
from gleaner.operators.sizes import bounded

MAX_HOPS = 32


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def entry(archive: DataFrame, path: str) -> DataFrame:
    """The entry of a path, by a filter that reaches the scan."""
    return archive.filter(F.col("path") == path)


def resolve_redirects(archive: DataFrame, hops: int = MAX_HOPS, on_loop: str = "error") -> DataFrame:
    """(path, redirect_to) to (path, target, hops): the end of each chain of redirects, without its fragment.

    Chains are halved in each round, so their number is the logarithm of the longest one.  Loops,
    longer chains and missing ends: an error, a null target (`null`), or the last entry reached (`stop`).
    """
    if on_loop not in ("error", "null", "stop"):
        raise ValueError(f"no such policy: {on_loop}")
    edges = archive.select("path", F.substring_index("redirect_to", "#", 1).alias("next"))
    state = edges.select("path", F.col("next").alias("target"), F.when(F.col("next").isNotNull(), 1).otherwise(0).alias("hops"))
    jump = edges.filter(F.col("next").isNotNull()).select(F.col("path").alias("at"), F.col("next").alias("to"), F.lit(1).alias("more"))
    for _ in range(max(1, (hops - 1).bit_length())):
        joined = state.join(jump, F.col("target") == F.col("at"), "left")
        state = joined.select("path", F.coalesce("to", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        twice = jump.alias("a").join(jump.select(F.col("at").alias("b_at"), F.col("to").alias("b_to"), F.col("more").alias("b_more")), F.col("to") == F.col("b_at"), "left")
        jump = twice.select("at", F.coalesce("b_to", "to").alias("to"), (F.col("more") + F.coalesce("b_more", F.lit(0))).alias("more"))
    ends = edges.select(F.col("path").alias("end"), F.col("next").isNotNull().alias("goes_on"))
    state = state.withColumn("target", F.coalesce("target", "path")).join(ends, F.col("target") == F.col("end"), "left")
    bad = F.col("end").isNull() | F.col("goes_on") | (F.col("hops") >= hops)
    if on_loop == "error":
        target = F.when(bad, F.raise_error(F.concat(F.lit("redirect loop or missing entry: "), "path"))).otherwise(F.col("target"))
    else:
        target = F.when(bad & F.lit(on_loop == "null"), None).otherwise(F.col("target"))
    return state.select("path", target.alias("target"), "hops")


def search_titles(archive: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, query) to the best titles: exact, then beginning, then by shared words; ties by path.

    Each wording is searched once, however many queries have it.  Titles that hold the same asked words share as many
    with any wording, so of each such group only its first ones meet the wordings; titles that begin with a wording are
    found by their beginnings.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    titles = archive.select("path", title_key("path").alias("key")).filter("key != ''")
    asked = queries.select("query_id", title_key("query").alias("wanted")).filter("wanted != ''")
    wanted = asked.select("wanted").distinct()
    terms = wanted.select("wanted", F.explode(words(F.col("wanted"))).alias("word"))
    by_word = titles.select("path", "key", F.explode(words(F.col("key"))).alias("word"))
    known = by_word.join(bounded(terms.select("word").distinct()), "word", "left_semi")
    titles = known.groupBy("path").agg(F.first("key").alias("key"), F.sort_array(F.collect_list("word")).alias("held"))

    nearest = Window.partitionBy("held").orderBy(F.length("key"), "path")
    first = titles.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= limit).drop("nth")
    groups = first.select("held").distinct().select("held", F.explode(F.array_distinct("held")).alias("word"))
    sharing = first.join(groups.join(bounded(terms), "word").select("held", "wanted").distinct(), "held").filter(~F.startswith("key", "wanted"))

    lengths = wanted.agg(F.collect_set(F.length("wanted")).alias("lengths"))
    heads = F.transform(F.filter("lengths", lambda n: n <= F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    begun = titles.crossJoin(F.broadcast(lengths)).select("path", "key", "held", F.explode(heads).alias("wanted"))
    begun = begun.join(bounded(wanted), "wanted", "left_semi")

    found = sharing.unionByName(begun).withColumn("parts", words(F.col("wanted")))
    found = found.withColumn("shared", F.size(F.filter("held", lambda w: F.array_contains("parts", w))).cast("long")).filter("shared > 0")
    tier = F.when(F.col("key") == F.col("wanted"), 0).when(F.startswith("key", "wanted"), 1).otherwise(2)
    order = Window.partitionBy("wanted").orderBy("tier", F.desc("shared"), F.length("key"), "path")
    ranked = found.withColumn("tier", tier).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return asked.join(ranked, "wanted").select("query_id", "path", "tier", "shared", "rank")


def write_json(df: DataFrame, path: str) -> None:
    """Replace what is at path; Spark's committer lets readers see all of it or nothing."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
