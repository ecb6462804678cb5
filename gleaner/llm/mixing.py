"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document of size x in source s gets the rate min(2, exp(lambda_s * x / mean size of s)): among all
rates that give each source its target of words, these stay closest to 1 in relative entropy.  The
lambdas solve the convex dual: Newton steps on the logarithm of each source's words, kept inside
brackets that close in on the root, over the counts of documents by source and size.

Rates are rounded into copies.  Each document takes the whole copies of its rate; the fractions decide
by sequential Poisson sampling (a hash of id and text against the fraction) who takes one more, in
order until the source's target is met.  The last such copy of a source is counted by the part that meets
it exactly; where documents are written out, that copy is a whole one or none, whichever is nearer.

Cases: null and empty texts have size 0 and are never taken; a null source is a source, last in
order; null ids hash as empty; repeated rows are documents of their own, and rows that the hash
cannot tell apart are taken in any order, as they are alike; extra columns may have any name; an empty
table gives an empty result.  Should Newton's steps not end within STEPS, that is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, column, fresh, materialize, small

WEIGHTS = (5, 2, 1)
#: The mix's words in percent of all words, and the most copies of a document.
PERCENT, MOST = 150, 2
#: Newton steps, how many of them one job takes, and the relative error at which they end.
STEPS, STEPS_A_JOB, TOLERANCE = 60, 3, 1e-9
#: Cells of the order of extra copies: sums by cell find the one where a source meets its target, and so on within that
#: cell, LEVELS times; only what lies in the last one, one in CELLS ** LEVELS or so, is put in order.
CELLS, LEVELS = 256, 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size) to the same with target: shares by weight, capped, the excess shared again by weight.

    Sources in order of size per weight meet their caps one after the other: a source is capped if the
    level of the rest, after all before it are capped, is above its cap.  One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sources.withColumn("nth", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        (F.sum("source_size").over(everything) * F.lit(percent / 100)).alias("all"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    level = (F.col("all") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    levels = levels.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # From the first open source on, levels only fall: its own level is the one at which all open sources stand.
    open_level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return levels.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", open_level * F.col("weight"))).alias("target")
    )


def rate(size: Column, tilt: Column, mean: Column, most: int) -> Column:
    """The exponentially tilted rate, at most `most`."""
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * size / mean, F.lit(700.0))))


def newton(counts: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One safeguarded Newton step for every source that is still open.

    counts: (source, size, n); state: (source, target, mean, tilt, low, high, error).
    """
    r = rate(F.col("size"), F.col("tilt"), F.col("mean"), most)
    joined = counts.join(state, counts["source"].eqNullSafe(state["source"])).select(
        state["source"], "target", "mean", "tilt", "low", "high", (F.col("n") * F.col("size") * r).alias("words"),
        F.when(r < most, F.col("n") * F.col("size") * r * F.col("size") / F.col("mean")).otherwise(0.0).alias("slope"),
    )
    summed = joined.groupBy("source").agg(
        *(F.first(c).alias(c) for c in ("target", "mean", "tilt", "low", "high")), F.sum("words").alias("words"), F.sum("slope").alias("slope")
    )
    low = F.when(F.col("words") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
    high = F.when(F.col("words") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
    stepped = summed.withColumns({"low": low, "high": high}).withColumn(
        "next", F.col("tilt") + F.when(F.col("slope") > 0, F.log(F.col("target") / F.col("words")) * F.col("words") / F.col("slope"))
    )
    middle = (F.col("low") + F.col("high")) / 2
    inside = F.col("next").isNotNull() & (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
    error = F.abs(F.col("words") / F.col("target") - 1)
    return stepped.select(
        "source", "target", "mean",
        F.when(error < TOLERANCE, F.col("tilt")).when(inside, F.col("next")).otherwise(middle).alias("tilt"),
        "low", "high", error.alias("error"),
    )


def solve(counts: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target) to rows (source, source_size, target, mean, tilt); tilt is null at the cap or without words."""
    known = sources.withColumn("mean", F.col("source_size") / F.col("docs"))
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12))
    # Within these brackets the words run from next to nothing to next to the cap, whatever the sizes:
    # a document of one word has size / mean of 1 / mean.
    state = known.filter(free).select(
        "source", "target", "mean",
        (F.log(F.col("target") / F.col("source_size"))).alias("tilt"),
        (-40.0 * F.greatest("mean", F.lit(1.0))).alias("low"), (40.0 * F.greatest("mean", F.lit(1.0))).alias("high"),
        F.lit(1.0).alias("error"),
    )
    state = materialize(state)
    rows = state.count()
    for _ in range(0, STEPS, STEPS_A_JOB):
        if not rows:
            break
        for _ in range(STEPS_A_JOB):
            state = newton(counts, small(state, rows), most)
        state = materialize(state)
        error = state.agg(F.max("error")).first()[0]
        if error < TOLERANCE:
            break
    else:
        raise ArithmeticError(f"the rates miss a target by {error:g} of it after {STEPS} steps")
    solved = state.select(F.col("source").alias("s"), "tilt")
    return known.join(small(solved, rows), known["source"].eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "mean", "tilt")


def meeting(sums: DataFrame) -> DataFrame:
    """Rows (source, cell, extra, rest) to (s, edge, room): the first cell up to which extra exceeds rest, and what fits in it."""
    upto = F.sum("extra").over(Window.partitionBy("source").orderBy("cell"))
    found = sums.withColumn("upto", upto).filter("upto > rest and upto - extra <= rest")
    room = F.min_by(F.col("rest") - (F.col("upto") - F.col("extra")), "cell")
    return materialize(found.groupBy(F.col("source").alias("s")).agg(F.min("cell").alias("edge"), room.alias("room")))


def mix_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """Rows (source, size, u in (0, 1], ...) with source_size, target, copies (whole ones) and part (words of a cut copy) added."""
    counts = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    totals = materialize(totals)
    aims = targets(totals.select("source", "source_size"), weights, percent, most).withColumnRenamed("source", "s")
    aims = totals.join(aims.drop("source_size"), totals["source"].eqNullSafe(F.col("s"))).drop("s")
    solved = materialize(solve(counts, materialize(aims), most))
    many = solved.count()

    r = F.when(F.col("size") == 0, 0.0).when(F.col("target") >= F.col("source_size") * most * (1 - 1e-12), F.lit(float(most))).when(
        F.col("tilt").isNotNull(), rate(F.col("size"), F.col("tilt"), F.col("mean"), most)
    ).otherwise(0.0)
    facts = small(solved.withColumnRenamed("source", "s"), many)
    rated = rows.join(facts, rows["source"].eqNullSafe(F.col("s"))).drop("s")
    rated = rated.withColumn("rate", r).withColumn("copies", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("copies"))
    place = F.when(F.col("fraction") > 0, F.col("u") / F.col("fraction"))
    order = F.col("place") / (1 + F.col("place"))
    marked = rated.withColumn("place", place).withColumn("inside", F.col("place").isNotNull()).withColumn("fits", F.lit(False))

    # What the whole copies leave of each target, and the cell in which the extra copies meet it; then within that cell.
    rest = F.round(F.first("target")).cast("bigint") - F.sum(F.col("copies") * F.col("size"))
    room = materialize(rated.groupBy(F.col("source").alias("s")).agg(rest.alias("room")))
    for level in range(1, LEVELS + 1):
        marked = marked.withColumn("cell", F.floor(order * CELLS**level) - CELLS * F.floor(order * CELLS ** (level - 1)))
        sums = marked.filter("inside").groupBy("source", "cell").agg(F.sum("size").alias("extra"))
        room = meeting(sums.join(small(room, many), sums["source"].eqNullSafe(F.col("s"))).select("source", "cell", "extra", F.col("room").alias("rest")))
        marked = marked.join(small(room.drop("room"), many), marked["source"].eqNullSafe(F.col("s")), "left").drop("s")
        fits = F.col("fits") | (F.col("inside") & (F.col("edge").isNull() | (F.col("cell") < F.col("edge"))))
        inside = F.col("inside") & F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))
        marked = marked.withColumns({"fits": fits, "inside": inside}).drop("cell", "edge")
    sure = marked.filter("not inside").withColumn("part", F.when(F.col("fits"), F.col("size")).otherwise(F.lit(0).cast("bigint")))
    in_edge = Window.partitionBy("source").orderBy("place", "h", "id").rowsBetween(Window.unboundedPreceding, 0)
    close = marked.filter("inside").join(small(room, many), marked["source"].eqNullSafe(F.col("s"))).withColumn("sum", F.sum("size").over(in_edge))
    close = close.withColumn("part", F.greatest(F.lit(0).cast("bigint"), F.least("size", F.col("room") - (F.col("sum") - F.col("size"))))).drop("sum", "s", "room", "edge")
    both = sure.unionByName(close)
    full = F.col("part") == F.col("size")
    return both.withColumn("copies", F.col("copies") + F.when(full & (F.col("size") > 0), 1).otherwise(0)).withColumn(
        "part", F.when(full, F.lit(0).cast("bigint")).otherwise(F.col("part"))
    ).select(*rows.columns, "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def hash_of(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(20), F.coalesce(column(id_col).cast("string"), F.lit("")), column(text_col))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows (id, source, size, h, u): h is a hash of id and text, u the same in (0, 1]."""
    return docs.select(
        column(id_col).alias("id"), column(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), hash_of(id_col, text_col).alias("h")
    ).withColumn("u", (F.pmod("h", F.lit(1 << 52)) + 1) / F.lit(float(1 << 52)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = PERCENT,
    most: int = MOST,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, copies, part."""
    rows = materialize(sized(docs, id_col, text_col, source_col))
    found = mix_rows(rows, weights, percent, most)
    return found.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "copies", "part")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: int | tuple[int, ...]
) -> DataFrame:
    """docs as often as the mix takes them, whole and with their own columns, whatever their names.

    Rows meet their copies by id and hash of id and text; rows that share both are alike, and share
    the copies of their group as each of them counts.
    """
    rows = materialize(sized(docs, id_col, text_col, source_col))
    key, source_key, hash_key, copies, nth, own_hash, own_nth = (
        fresh(x, docs) for x in ("key", "source_key", "hash_key", "copies", "nth", "own_hash", "own_nth")
    )
    whole = (F.col("copies") + F.when(2 * F.col("part") >= F.greatest("size", F.lit(1)), 1).otherwise(0)).cast("int")
    found = mix_rows(rows, **options).select(
        F.col("id").alias(key), F.col("source").alias(source_key), F.col("h").alias(hash_key), whole.alias(copies)
    )
    alike = Window.partitionBy(key, source_key, hash_key).orderBy(copies)
    found = found.filter(F.col(copies) > 0).withColumn(nth, F.row_number().over(alike))
    keyed = docs.withColumn(own_hash, hash_of(id_col, text_col))
    if rows.count() != rows.select("id", "source", "h").distinct().count():
        order = [column(c) for c, kind in docs.dtypes if kind in ("bigint", "string", "int")]
        keyed = keyed.withColumn(own_nth, F.row_number().over(Window.partitionBy(column(id_col), column(source_col), own_hash).orderBy(*order)))
    else:
        keyed = keyed.withColumn(own_nth, F.lit(1))
    same = column(id_col).eqNullSafe(F.col(key)) & column(source_col).cast("string").eqNullSafe(F.col(source_key))
    joined = keyed.join(found, same & (F.col(own_hash) == F.col(hash_key)) & (F.col(own_nth) == F.col(nth)))
    again = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return joined.withColumn(nth, again).select(*map(column, docs.columns))
