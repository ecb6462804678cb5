"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are held as one ragged pair of numpy arrays: symbol ids, and the sequence
that each belongs to.  In each round every sequence finds the lowest-rank pair among its neighbours
and merges all its occurrences, all sequences at once; sequences without a mergeable pair leave.
The symbols that survive are the tokens.  A pair's rank is above the ranks of the merges that made
its two symbols, so merging all occurrences at once gives what one merge at a time gives.

Repeated pieces of text are merged once per worker: counts are kept by piece in tables of bounded
size.  Cases: null counts as empty (0 tokens); a special string inside a text is one token, as in the
library; texts are never cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import column, keep, kept, map_arrow, text_slices

#: Fixed values of byte-level vocabularies: the split pattern, white space by its Unicode property.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Two white-space characters in a row, or one at the end: such texts are split by the pattern as a whole.
_UNEVEN = regex.compile(r"\p{White_Space}\p{White_Space}|\p{White_Space}\Z")
#: Pieces and pre-tokens kept per worker.
KEPT_PIECES = 400_000
_NEVER = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts the tokens of pre-tokens with the merges of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.start = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.pieces: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.pretokens: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of neighbour pairs, and where the pairs stand in the sorted merges."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER), at

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.minimum(sizes, 1)
        symbols = self.start[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        keep = (sizes > 1)[owner]
        symbols, owner = symbols[keep], owner[keep]
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[begins, len(owner)])
            rank, at = self.ranks(symbols[:-1], symbols[1:])
            rank[begins[1:] - 1] = _NEVER  # the last of a sequence has no right neighbour in it
            rank, at = np.r_[rank, _NEVER], np.r_[at, 0]
            lowest = np.minimum.reduceat(rank, begins)
            counts[owner[begins]] = lengths
            low = np.repeat(lowest, lengths)
            hit = (rank == low) & (low != _NEVER)
            # In a run of hits (a pair of equal symbols) every other one merges, from the left.
            where = np.flatnonzero(hit)
            opens = np.r_[True, np.diff(where) != 1] if len(where) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(opens, np.arange(len(where)), 0)) if len(where) else where
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.made[at[where]]
            stay = low != _NEVER
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return counts

    def count_pretokens(self, split: list[list[str]]) -> list[int]:
        """Tokens of texts that are given as lists of pre-tokens."""
        new = list(dict.fromkeys(t for tokens in split for t in tokens if t not in self.pretokens))
        known = self.pretokens
        if new:
            known.update(zip(new, self.merge([t.encode() for t in new]).tolist(), strict=True))
        counts = [sum(map(known.__getitem__, tokens)) for tokens in split]
        if len(known) > KEPT_PIECES:
            known.clear()
        return counts

    def _learn(self, known: dict[str, int], pieces: set[str], before: str) -> None:
        new = [p for p in pieces if p not in known]
        heads = [p if p[:1] == "\n" else before + p for p in new]
        known.update(zip(new, self.count_pretokens([PATTERN.findall(h) for h in heads]), strict=True))

    def count_even(self, texts: list[str]) -> list[int]:
        """Texts whose white space stands singly: each space begins a piece, each line feed too."""
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        rest, first = set(), set()
        for pieces in split:
            first.add(pieces[0])
            rest.update(pieces[1:])
        self._learn(self.pieces, rest, " ")
        self._learn(self.firsts, first, "")
        known, begin = self.pieces, self.firsts
        counts = [begin[p[0]] + sum(map(known.__getitem__, p[1:])) for p in split]
        for table in (known, begin):
            if len(table) > KEPT_PIECES:
                table.clear()
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        total = [0] * len(texts)
        even: list[tuple[int, str]] = []
        uneven: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                if s in text:
                    parts = [p for part in parts for p in part.split(s)]
                    total[i] = len(parts) - 1
            for part in parts:
                if part:
                    (uneven if _UNEVEN.search(part) else even).append((i, part))
        for group, f in ((even, self.count_even), (uneven, lambda x: self.count_pretokens([PATTERN.findall(t) for t in x]))):
            for (i, _), n in zip(group, f([t for _, t in group]), strict=True):
                total[i] += n
        return total


def merger(path: str) -> RankMerger:
    """One per worker."""
    return kept(f"ranks {path}") or keep(f"ranks {path}", RankMerger(path))


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit.  path: the tokenizer's file, the same on all executors."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for whole in batches:
            for batch in text_slices(whole, 1, 4 << 20, 4096):  # larger slices have fewer distinct words a text
                texts = [x or "" for x in batch.column(1).to_pylist()]
                sizes = [len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(own.count(texts), pa.int64())],
                    ["id", "n_bytes", "n_tokens"],
                )

    counted = map_arrow(rows, kernel, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint", f"ranks {path}")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
