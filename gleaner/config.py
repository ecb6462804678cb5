"""Settings, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

#: Upper bounds of pools, choices, and below the settings with their defaults.
CEILINGS = {
    "candidate_chunks_total": 480, "hybrid_branch_k": 40, "hybrid_merge_k": 80, "hybrid_rerank_k": 80, "hybrid_pack_k": 12, "context_token_budget": 5600,
    "history_chars": 3000,
}
CHOICES = {"retrieval_mode": ("hybrid", "legacy"), "rerank_backend": ("deterministic", "rrf")}


@dataclass(frozen=True)
class Config:
    """All settings of retrieval; names and defaults are fixed values."""

    retrieval_mode: str = "hybrid"
    rerank_backend: str = "deterministic"
    candidate_articles: int = 12
    narrow_candidate_articles: int = 2
    max_seed_queries: int = 4
    max_entities: int = 8
    max_date_hints: int = 8
    articles_per_query: int = 4
    entity_title_candidates: int = 2
    related_seed_articles: int = 2
    related_articles_per_seed: int = 4
    candidate_chunks_per_article: int = 64
    candidate_chunks_total: int = 480
    max_chars: int = 2000
    overlap_chars: int = 300
    hybrid_branch_k: int = 40
    hybrid_merge_k: int = 80
    hybrid_rerank_k: int = 80
    hybrid_pack_k: int = 12
    rrf_k: int = 60
    initial_top_k: int = 24
    article_top_k: int = 6
    chunks_per_article: int = 6
    chunks_per_section: int = 3
    expanded_context_k: int = 10
    similarity_threshold: float = 0.15
    section_boost: float = 0.18
    article_boost: float = 0.08
    selected_chunks_per_article: int = 3
    source_metadata_tokens: int = 40
    rerank_relevance_floor: float = 0.25
    redundancy_penalty: float = 0.32
    article_repeat_penalty: float = 0.055
    duplicate_overlap_threshold: float = 0.72
    context_token_budget: int = 4800
    context_chars: int = 15000
    history_turns: int = 4
    history_chars: int = 1800
    timeline_events: int = 24
    timeline_candidates: int = 32
    continuation_year_window: int = 30

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in CHOICES:
                if value not in CHOICES[f.name]:
                    raise ValueError(f"{f.name} must be one of {CHOICES[f.name]}")
            elif isinstance(f.default, float):
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
                    raise ValueError(f"{f.name} must lie between 0 and 1")
            elif isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= CEILINGS.get(f.name, value):
                raise ValueError(f"{f.name} must be an integer from 1 to {CEILINGS.get(f.name, 'any bound')}")


def load(path: str | None = None, **changes: object) -> Config:
    """Settings from a JSON file and changes to them; unknown names are an error."""
    values: dict[str, object] = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    values |= changes
    if unknown := set(values) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Config(**values)
