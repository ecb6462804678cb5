"""Answers and their accounts as text for a terminal."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame


def usage_text(usage: dict) -> str:
    if usage.get("skipped"):
        return "No model was called."
    shown = {k: "unknown" if usage.get(k) is None else usage[k] for k in ("model", "context_window", "prompt_tokens", "output_tokens", "total_tokens")}
    return (
        f"Model {shown['model']}, window of {shown['context_window']} tokens; prompt {shown['prompt_tokens']}, output {shown['output_tokens']}, "
        f"total {shown['total_tokens']}"
    )


def answer_text(record: dict, width: int = 100) -> str:
    """An answer with its sources below."""
    lines = [textwrap.fill(p, width) for p in record["answer"].split("\n")]
    if record.get("sources"):
        lines += ["", "Sources"]
        for s in record["sources"]:
            where = " / ".join(x for x in (s["section"], s["subsection"]) if x)
            lines.append(f"[{s['label']}] {s['article_path'].replace('_', ' ')}" + (f" — {where}" if where else ""))
    return "\n".join(lines)


def show_answers(records: DataFrame, limit: int = 20) -> None:
    for row in records.orderBy("query_id").limit(limit).toLocalIterator():
        print(answer_text(row.asDict(recursive=True)), end="\n\n")
