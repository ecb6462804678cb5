"""The best rows of each query inside a Python kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Best:
    """Of all scores that were added, the k lowest of each query; ties go to the smaller id.  Holds at most k rows a query between two additions."""

    def __init__(self, queries: int, k: int, kind: pa.DataType) -> None:
        self.k, self.worst = k, np.full(queries, np.inf)
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores by query and row; infinite where there is none."""
        close = (scores <= self.worst[:, None]) & (scores < np.inf)
        many = np.flatnonzero(close.sum(axis=1) > self.k)
        if len(many):
            kth = np.partition(scores[many], self.k - 1, axis=1)[:, self.k - 1]
            close[many] &= scores[many] <= kth[:, None]
        query, row = np.nonzero(close)
        if not len(query):
            return
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, scores[query, row]])
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(row))])
        by_id = np.empty(len(self.ids), np.int64)
        by_id[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        order = np.lexsort((by_id, self.score, self.query))
        sizes = np.bincount(self.query, minlength=len(self.worst))
        place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[place < self.k]
        self.query, self.score, self.ids = self.query[order], self.score[order], self.ids.take(pa.array(order))
        full = np.flatnonzero(sizes >= self.k)
        last = np.cumsum(np.minimum(sizes, self.k)) - 1
        self.worst[full] = self.score[last[full]]

    def rows(self, names: list[str], query_ids: pa.Array, sign: float = 1.0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.query)), self.ids, pa.array(self.score * sign)], names)
