"""Saved conversations as a table: every change gives a new DataFrame, which the caller writes.

Columns: id, title, created, updated (seconds since 1970), archived, revision, state, turns (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import single_line

SCHEMA = "id string, title string, created double, updated double, archived int, revision int, state string, turns string"
MAX_TITLE, MAX_SEARCH = 120, 200
SOURCE = "struct<label:string,article_path:string,section:string,subsection:string>"
TURNS = f"array<struct<question:string,result:struct<answer:string,sources:array<{SOURCE}>>>>"
STATE = (
    "max_turns int, max_chars int, turns array<struct<question:string,answer_summary:string>>, focus string, entities array<string>, periods array<string>, "
    "events array<string>, articles array<string>, ambiguous_topics array<string>, effective_type string, clarification_options array<string>"
)


def open_store(spark: SparkSession, path: str | None = None) -> DataFrame:
    """What is saved at path, in the present form; without a path an empty store in memory."""
    return spark.createDataFrame([], SCHEMA) if path is None else migrate(spark.read.parquet(path))


def migrate(saved: DataFrame) -> DataFrame:
    """Older tables in the present form: created is updated where it was not kept; not archived; first revision."""
    have = set(saved.columns)
    defaults = {"created": F.col("updated"), "archived": F.lit(0), "revision": F.lit(1)}
    for name, value in defaults.items():
        saved = saved.withColumn(name, F.coalesce(F.col(name), value) if name in have else value)
    return saved.select(*[F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in SCHEMA.split(", ")])


def upsert(saved: DataFrame, changes: DataFrame, now: float | Column) -> DataFrame:
    """Changes (id, title, state, turns, created) by id: new rows begin at revision 1, others go up by one.

    Of changes to one id the last by `change_no`, if there is one, counts; each counts as a revision.
    """
    when = now if isinstance(now, Column) else F.lit(float(now))
    if "change_no" in changes.columns:
        per_id = changes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.max_by(c, "change_no").alias(c) for c in changes.columns if c not in ("id", "change_no")])
    else:
        per_id = changes.withColumn("n", F.lit(1))
    created = F.col("n.created") if "created" in changes.columns else F.lit(None).cast("double")
    joined = saved.alias("s").join(per_id.alias("n"), "id", "full_outer")
    new = F.col("n.n").isNotNull()
    return joined.select(
        "id", F.when(new, F.col("n.title")).otherwise(F.col("s.title")).alias("title"), F.coalesce("s.created", created, when).alias("created"),
        F.when(new, when).otherwise(F.col("s.updated")).alias("updated"), F.coalesce("s.archived", F.lit(0)).alias("archived"),
        (F.coalesce("s.revision", F.lit(0)) + F.coalesce("n.n", F.lit(0))).cast("int").alias("revision"),
        F.when(new, F.col("n.state")).otherwise(F.col("s.state")).alias("state"), F.when(new, F.col("n.turns")).otherwise(F.col("s.turns")).alias("turns"),
    )


def list_saved(saved: DataFrame, search: str = "") -> DataFrame:
    """What is neither archived nor empty, by a part of the title in any case, the latest first."""
    if not isinstance(search, str) or len(search) > MAX_SEARCH:
        raise ValueError(f"search takes at most {MAX_SEARCH} characters")
    rows = saved.filter((F.col("archived") == 0) & (F.col("turns") != "[]"))
    if search.strip():
        rows = rows.filter(F.contains(F.lower("title"), F.lower(F.lit(search.strip()))))
    return rows.select("id", "title", "created", "updated", "revision").orderBy(F.desc("updated"), "id")


def _active(saved: DataFrame, identifier: str) -> None:
    if not saved.filter((F.col("id") == identifier) & (F.col("archived") == 0)).limit(1).count():
        raise ValueError("no such saved conversation")


def _change(saved: DataFrame, identifier: str, now: float, **values: Column) -> DataFrame:
    _active(saved, identifier)
    hit = (F.col("id") == identifier) & (F.col("archived") == 0)
    changed = {"updated": F.lit(float(now)), "revision": F.col("revision") + 1} | values
    return saved.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changed.items()})


def rename(saved: DataFrame, identifier: str, title: str, now: float) -> DataFrame:
    if not isinstance(title, str) or not 1 <= len(title.strip()) <= MAX_TITLE:
        raise ValueError(f"a title has 1 to {MAX_TITLE} characters")
    return _change(saved, identifier, now, title=F.lit(title.strip()))


def archive(saved: DataFrame, identifier: str, now: float) -> DataFrame:
    return _change(saved, identifier, now, archived=F.lit(1))


def load(saved: DataFrame, identifier: str) -> DataFrame:
    """One active conversation with state and turns parsed; JSON of another shape is an error."""
    _active(saved, identifier)
    rows = saved.filter((F.col("id") == identifier) & (F.col("archived") == 0))
    state = F.from_json("state", STATE, {"mode": "FAILFAST"})
    turns = F.from_json("turns", TURNS, {"mode": "FAILFAST"})
    bad = ~F.trim("turns").rlike(r"^\[") | ~F.trim("state").rlike(r"^\{")
    return rows.withColumns({"state": F.when(bad, F.raise_error(F.lit("saved conversation is damaged"))).otherwise(state), "turns": turns})


def export_markdown(saved: DataFrame) -> DataFrame:
    """(id, markdown) of each conversation: title, date, questions, answers and sources."""
    turns = F.from_json("turns", TURNS)
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))

    def source(s: Column) -> Column:
        detail = F.concat_ws(" / ", *[F.when(single_line(s[k]) != "", single_line(s[k])) for k in ("section", "subsection")])
        path = single_line(s["article_path"])
        return F.concat(
            F.lit("- ["), single_line(F.coalesce(s["label"], F.lit("?"))), F.lit("] "), F.translate(path, "_", " "),
            F.when(detail != "", F.concat(F.lit(" — "), detail)).otherwise(""), F.lit(" (`"), path, F.lit("`)"),
        )

    def turn(x: Column) -> Column:
        listed = F.array_join(F.transform(x["result"]["sources"], source), "\n")
        sources = F.when(F.size(x["result"]["sources"]) > 0, F.concat(F.lit("### Sources\n\n"), listed, F.lit("\n\n"))).otherwise("")
        return F.concat(F.lit("## Question\n\n"), blank(x["question"]), F.lit("\n\n## Answer\n\n"), blank(x["result"]["answer"]), F.lit("\n\n"), sources)

    date = F.date_format(F.timestamp_seconds(F.floor("created")), "yyyy-MM-dd HH:mm 'UTC'")
    text = F.concat(F.lit("# "), single_line("title"), F.lit("\n\n_Created "), date, F.lit("_\n\n"), F.array_join(F.transform(turns, turn), ""))
    return saved.select("id", F.concat(F.rtrim(F.regexp_replace(text, r"\s+$", "")), F.lit("\n")).alias("markdown"))


def latest(versions: DataFrame) -> DataFrame:
    """Of several versions of a conversation the one of the highest revision."""
    newest = Window.partitionBy("id").orderBy(F.desc("revision"), F.desc("updated"))
    return versions.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")
