"""Bounded memory of conversations, for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to questions with the answer that follows: (conv_id, turn_no, question, answer).

    A `/new` message begins the memory anew; other commands and blank messages are no turns.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.filter(F.col("role").isin("user", "assistant"))
    rows = rows.withColumns({"_next_role": F.lead("role").over(order), "_next": F.lead("text").over(order)})
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = rows.filter(F.col("role") == "user").withColumn("_session", F.sum((text == "/new").cast("int")).over(order))
    rows = rows.filter((text != "") & ~text.rlike(r"^/|^(?i:exit|quit)$") & (F.col("_next_role") == "assistant"))
    number = Window.partitionBy("conv_id", "_session").orderBy("turn")
    return rows.select(
        "conv_id", F.col("_session").alias("session"), F.row_number().over(number).alias("turn_no"), F.col("text").alias("question"), F.col("_next").alias("answer")
    )


def summary(answer: str | Column) -> Column:
    """An answer without its citation marks, at most 600 characters."""
    c = F.col(answer) if isinstance(answer, str) else answer
    return F.substring(F.regexp_replace(c, r"\[S\d+\]", ""), 1, 600)


def periods(text: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b\d{3,4}\b"), F.lit(0))), 1, 10)


def window_state(turns: DataFrame, max_turns: int = 4) -> DataFrame:
    """The memory after each turn: the last turns, the periods of the last one, and the focus.

    The focus is the last question that is no follow-up (is_followup, where known).
    """
    rows = turns if "is_followup" in turns.columns else turns.withColumn("is_followup", F.lit(False))
    keys = ["conv_id", "session"] if "session" in rows.columns else ["conv_id"]
    last = Window.partitionBy(*keys).orderBy("turn_no").rowsBetween(1 - max_turns, 0)
    before = Window.partitionBy(*keys).orderBy("turn_no").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.struct(F.substring("question", 1, 300).alias("question"), summary("answer").alias("answer_summary"))
    return rows.select(
        *keys, "turn_no", F.collect_list(entry).over(last).alias("turns"), periods(F.concat_ws(" ", "question", "answer")).alias("periods"),
        F.last(F.when(~F.col("is_followup"), F.substring("question", 1, 220)), ignorenulls=True).over(before).alias("focus"),
    )


def context(state: DataFrame, max_chars: int = 1800) -> DataFrame:
    """Adds the context that a memory gives to the next question: its topic and last two turns, cut from the front."""
    head = F.substring(F.concat(F.lit("Subject: "), F.coalesce("focus", F.lit(""))), 1, min(250, max_chars))
    lines = F.transform(F.slice("turns", F.greatest(F.lit(-2), -F.size("turns")), 2), lambda x: F.concat(F.lit("Asked: "), x["question"], F.lit("\nAnswered (not checked): "), x["answer_summary"]))
    rest = F.array_join(lines, "\n")
    room = max_chars - F.length(head) - 1
    tail = F.when(F.length(rest) <= room, rest).otherwise(F.substring(rest, F.length(rest) - room + 1, room))
    return state.withColumn("context", F.concat(head, F.when(room > 0, F.concat(F.lit("\n"), tail)).otherwise("")))
