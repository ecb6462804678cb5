"""Conversation memory over a stream of messages: bounded state per conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.plans.interpret import State, analyze

OUTPUT = (
    "conv_id bigint, turn bigint, question string, retrieval_query string, effective_type string, is_followup boolean, clarification string, "
    "focus string, periods array<string>, turns int, context string"
)
STATE = (
    "turn bigint, pending string, turns array<struct<question:string,answer_summary:string>>, focus string, entities array<string>, periods array<string>, "
    "events array<string>, articles array<string>, ambiguous_topics array<string>, effective_type string, clarification_options array<string>"
)
_LISTS = ("entities", "periods", "events", "articles", "ambiguous_topics")


def memory(messages: DataFrame, max_turns: int = 4, max_chars: int = 1800) -> DataFrame:
    """(conv_id, turn, role, text), in the order of turn, to a row for each answered question, with the memory after it.

    `/new` clears the memory, `/debug` gives a row with the memory as it is.  The state holds at most max_turns turns and a question that waits for its
    answer, whatever the length of the conversation.  Messages that come again (turn not above the last) are skipped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, last, waiting = State(max_turns, max_chars), -1, None
        if group.exists:
            last, waiting, turns, state.focus, *lists, state.effective_type, options = group.get
            state.turns = [{"question": x[0], "answer_summary": x[1]} for x in turns or []]
            for name, value in zip(_LISTS, lists, strict=True):
                setattr(state, name, list(value or []))
            state.clarification_options = list(options or [])
        out = []
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
            if turn <= last or not isinstance(text, str) or not text.strip():
                continue
            last = int(turn)
            if role == "user" and text.strip() == "/new":
                state.clear()
                waiting = None
            elif role == "user" and text.strip() == "/debug":
                out.append((key[0], last, "/debug", "", state.effective_type, False, "", state.focus, state.periods, len(state.turns), state.context()))
            elif role == "user" and not text.startswith("/"):
                waiting = text
            elif role == "assistant" and waiting is not None:
                found = analyze(waiting, state)
                state.remember(found, text)
                out.append(
                    (key[0], last, waiting, found.retrieval_query, found.effective_type, found.is_followup, found.clarification, state.focus, state.periods, len(state.turns), state.context())
                )
                waiting = None
        turns = [(x["question"], x["answer_summary"]) for x in state.turns]
        group.update((last, waiting, turns, state.focus, *(getattr(state, n) for n in _LISTS), state.effective_type, state.clarification_options))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return messages.groupBy("conv_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
