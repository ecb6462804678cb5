"""The boundary to a text generator: any callable object that answers a prompt from labelled sources."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABSTENTION = "The selected sources hold no evidence for this question."
SYSTEM = "Answer from the numbered sources only. Cite each statement with its source's label in brackets. Say so when the sources do not answer the question."
#: Options that make a model's answers repeatable.
OPTIONS = {"temperature": 0, "seed": 42, "num_ctx": 8192, "num_predict": 600}
TIMELINE_SCHEMA = "struct<entries:array<struct<source_label:string,summary:string>>>"


class Generator(Protocol):
    """What stands behind the boundary; it is pickled to the executors."""

    name: str

    def answer(self, question: str, kind: str, sources: list[dict], context: str) -> str: ...


@dataclass(frozen=True)
class Extractive:
    """The default: the first sentence of each of the leading sources, cited.  No model, the same answer every time."""

    name: str = "extractive"
    sentences: int = 3

    def answer(self, question: str, kind: str, sources: list[dict], context: str) -> str:
        lines = []
        for s in sources[: self.sentences if kind != "timeline" else 10]:
            first = re.split(r"(?<=[.!?])\s+", s["supplied_text"].strip(), maxsplit=1)[0]
            lines.append(f"{first} [{s['label']}]")
        return ("\n- " if kind == "timeline" else " ").join(lines)


def messages(question: str, context: str, kind: str, memory: str = "") -> list[dict]:
    """The system's and the user's message."""
    said = [("earlier turns, for what words refer to and nothing else", memory)] if memory else []
    parts = [("sources", context), *said, ("kind of answer", kind), ("question", question)]
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": "\n\n".join(f"<{name}>\n{text}" for name, text in parts)}]


def prompt_tokens(question: str, context: str, kind: str, memory: str = "") -> int:
    from gleaner.operators.select import CHAT_OVERHEAD, tokens

    return sum(tokens(m["content"]) for m in messages(question, context, kind, memory)) + CHAT_OVERHEAD


def generate(prompts: DataFrame, generator: Generator | None = None) -> DataFrame:
    """(query_id, question, intent, sources array<struct<label,article_path,section,subsection,supplied_text>>) to answers.

    Questions without evidence are answered by an abstention, and the generator is not called.
    """
    model = generator or Extractive()

    @F.pandas_udf("string")
    def answered(question: pd.Series, kind: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for q, k, rows in zip(question, kind, sources, strict=True):
            given = [dict(r) for r in (rows if rows is not None else [])]
            context = "\n\n".join(f"[{s['label']}] {s['article_path']} | {s['section']} | {s['subsection'] or '-'}\n{s['supplied_text']}" for s in given)
            out.append(model.answer(q or "", k, given, context) if given else ABSTENTION)
        return pd.Series(out)

    skipped = F.coalesce(F.size("sources"), F.lit(0)) <= 0
    return prompts.withColumns({"answer": answered("question", "intent", "sources"), "skipped_generation": skipped, "model": F.lit(model.name)})
