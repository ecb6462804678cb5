"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  The pieces of a document go to the open window
where they fit best; when a piece fits none, the fullest window is topped up with the head of the
piece, if head and rest stay useful, and emitted.  The windows still open at the end of a partition
are leftovers: they are merged over groups of partitions, then over groups of groups, each group of
bounded size, until one is left.

Cases: a null text counts as an empty one and packs as its end id alone; an empty table gives an
empty result; long documents are cut into whole windows first; ids repeat only if documents do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, column, keep, kept, map_arrow, materialize, text_slices

WINDOW = 2048
OPEN_WINDOWS = 32
#: A piece is cut to top up a window only if both parts keep so many ids.
LEAST_CUT = 16
#: Partitions, or groups of them, whose leftovers meet in one task: at most GROUP * OPEN_WINDOWS * WINDOW ids.
GROUP = 4
#: Fixed value of the vocabulary: how a token that ends a word is written.
WORD_END = "</w>"
#: New words that are encoded in one call.
JOINED = 256
#: Words, and cores of words with their ids, that are kept per worker.
KEPT_WORDS, KEPT_CORES = 200_000, 500_000

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Numbered(dict):
    """Numbers what is looked up, in order of first sight."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class Ragged:
    """Id lists that are appended in bulk and gathered by number."""

    def __init__(self) -> None:
        self.starts, self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def extend(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        sizes = sizes.astype(np.int32)
        self.starts = np.r_[self.starts, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, flat.astype(np.int32)]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists numbered `at` in a row, and the end of each."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)], ends


class WordIds:
    """Ids of texts for a tokenizer that lower-cases and drops white space: each distinct word is encoded once.

    Words are runs between ASCII white space, over which neither the normaliser nor the split of such
    a tokenizer reaches.  Nor do they reach over the end of a run of letters before closing marks, so
    words that differ in case or closing marks only share the ids of their lower-case core.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.cores = Numbered(), Numbered()
        self.word_cores, self.core_ids = Ragged(), Ragged()

    def _learn(self) -> None:
        """Number the cores of the words that are new, and encode the cores that are new."""
        new = list(islice(reversed(self.words), len(self.words) - len(self.word_cores.sizes)))[::-1]
        parts: list[int] = []
        sizes = np.ones(len(new), np.int64)
        for k, word in enumerate(map(bytes.decode, new)):
            core = word.rstrip(".,")
            low = core if "Σ" in core else core.lower()  # str.lower() looks at what stands around that letter
            if core.isalpha() and low.isalpha():
                parts.append(self.cores[low])
                if len(core) < len(word):
                    parts.append(self.cores[word[len(core) :]])
                    sizes[k] = 2
            else:
                parts.append(self.cores[word])
        self.word_cores.extend(sizes, np.array(parts, np.int64))
        fresh = list(islice(reversed(self.cores), len(self.cores) - len(self.core_ids.sizes)))[::-1]
        plain = np.fromiter(map(str.isalpha, fresh), bool, len(fresh))
        order = np.argsort(~plain, kind="stable")
        now, n = Ragged(), int(plain.sum())
        coded = [self._encode([fresh[i] for i in order[k : min(k + JOINED, n)]]) for k in range(0, n, JOINED)]
        coded.append(self._encode_each([fresh[i] for i in order[n:]]))
        now.extend(np.concatenate([sizes for sizes, _ in coded]), np.concatenate([ids for _, ids in coded]))
        back = np.empty(len(fresh), np.int64)
        back[order] = np.arange(len(fresh))
        self.core_ids.extend(now.sizes[back], now.take(back)[0])

    def _encode(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of runs of letters, encoded as one text; singly if its ids don't show one word for each."""
        ids = np.array(self.tokenizer.encode(" ".join(cores), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(cores) and ends[-1] == len(ids):
            return np.diff(np.r_[0, ends]), ids
        return self._encode_each(cores)

    def _encode_each(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(cores, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many of them each text has."""
        if len(self.cores) > KEPT_CORES:
            self.forget()
        elif len(self.words) > KEPT_WORDS:
            self.words, self.word_cores = Numbered(), Ragged()
        number, found, counts = self.words.__getitem__, [], []
        for t in texts:
            words = t.split()
            counts.append(len(words))
            found += map(number, words)
        if len(self.words) > len(self.word_cores.sizes):
            self._learn()
        cores, core_ends = self.word_cores.take(np.array(found, np.int64))
        ids, ends = self.core_ids.take(cores)
        upto = np.r_[0, ends][np.r_[0, core_ends][np.cumsum(counts, dtype=np.int64)]]
        return ids, np.diff(np.r_[0, upto])


def word_ids(path: str) -> WordIds:
    """One per worker."""
    return kept(f"ids {path}") or keep(f"ids {path}", WordIds(path))


class OpenWindows:
    """The open windows of one task; `place` gives back the windows that it closes."""

    def __init__(self, size: int, most: int, least_cut: int = LEAST_CUT) -> None:
        self.size, self.most, self.least_cut = size, most, least_cut
        self.free: list[int] = []
        self.windows: list[list[tuple]] = []

    def place(self, doc: object, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[list[tuple]]:
        """Place the ids that stand from `start` on in a document, at most a window's size."""
        n = len(ids)
        fits = [f for f in self.free if f >= n]
        if fits:
            k = self.free.index(min(fits))
        elif len(self.windows) < self.most:
            self.free.append(self.size)
            self.windows.append([])
            k = len(self.windows) - 1
        else:
            k = self.free.index(min(self.free))
            head = min(self.free[k], n - self.least_cut)
            if head >= self.least_cut:
                self.windows[k].append((doc, start, ids[:head], doc_tokens))
                start, ids, n = start + head, ids[head:], n - head
            yield self.windows.pop(k)
            self.free.pop(k)
            yield from self.place(doc, start, ids, doc_tokens)
            return
        self.windows[k].append((doc, start, ids, doc_tokens))
        self.free[k] -= n
        if not self.free[k]:
            self.free.pop(k)
            yield self.windows.pop(k)


def window_rows(window: list[tuple], sequence: int) -> list[tuple]:
    """Rows (id, *PIECE) of a closed window."""
    rows, offset = [], 0
    for doc, start, ids, doc_tokens in window:
        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, offset))
        offset += len(ids)
    return rows


def pack_partitions(
    docs: DataFrame, path: str, end_id: int, window: int, open_windows: int, id_col: str, text_col: str
) -> DataFrame:
    """Rows (id, *PIECE, part, ids): ids are null in closed windows; part is the partition."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {PIECE}, part bigint, ids array<int>"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, sequence = word_ids(path), TaskContext.get().partitionId(), 0
        open_now = OpenWindows(window, open_windows)
        out: list[tuple] = []
        kind = None

        def close(closed: list[tuple]) -> None:
            nonlocal sequence
            out.extend((*row, part, None) for row in window_rows(closed, part << 30 | sequence))
            sequence += 1

        def flush() -> pa.RecordBatch:
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
            kinds = [kind, *[pa.int64()] * 7, pa.list_(pa.int32())]
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return batch

        for whole in batches:
            kind = whole.column(0).type
            for batch in text_slices(whole, 1, 2 << 20, 2048):  # larger slices have fewer distinct words a text
                ids, sizes = coder.encode(as_bytes(batch.column(1)))
                at = 0
                for doc, n in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                    own = np.append(ids[at : at + n], end_id)
                    at += n
                    cut = (n + 1) // window * window
                    for start in range(0, cut, window):
                        close([(doc, start, own[start : start + window], n + 1)])
                    if cut <= n:
                        for closed in open_now.place(doc, cut, own[cut:], n + 1):
                            close(closed)
                if out:
                    yield flush()
        for left in open_now.windows:
            for (doc, start, own, n), row in zip(left, window_rows(left, part << 30 | sequence), strict=True):
                out.append((*row, part, own.tolist()))
            sequence += 1
        if out:
            yield flush()

    return map_arrow(rows, kernel, schema, f"ids {path}")


def merge_leftovers(left: DataFrame, window: int, level: int) -> DataFrame:
    """Merge the leftover windows of up to GROUP parts: rows as before, ids only in the last window of a group.

    Windows are joined from the fullest on; what exceeds a window is cut off and goes on into the next.
    """

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        windows = [list(g) for _, g in groupby(rows, key=lambda r: r["sequence_id"])]
        windows.sort(key=lambda w: -sum(r["length"] for r in w))
        now, filled, out, sequence = [], 0, [], 0
        name = level << 56 | part << 30
        for r in (r for w in windows for r in w):
            start, ids = r["start"], np.array(r["ids"], np.int64)
            while len(ids):
                head = ids[: window - filled]
                now.append((r["id"], start, head, r["doc_tokens"]))
                start, ids, filled = start + len(head), ids[len(head) :], filled + len(head)
                if filled == window:
                    out += [(*row, part, None) for row in window_rows(now, name | sequence)]
                    now, filled, sequence = [], 0, sequence + 1
        for (_, _, own, _), row in zip(now, window_rows(now, name | sequence), strict=True):
            out.append((*row, part, own.tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), table.schema, strict=True)], table.schema.names)

    grouped = left.withColumn("part", F.floor(F.col("part") / GROUP))
    return grouped.groupBy("part").applyInArrow(kernel, left.schema)


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    now = materialize(pack_partitions(docs, path, end_id, window, open_windows, id_col, text_col))
    closed = now.filter(F.col("ids").isNull())
    left = now.filter(F.col("ids").isNotNull())
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        parts = -(-parts // GROUP)
        now = materialize(merge_leftovers(left, window, level))
        closed = closed.unionByName(now.filter(F.col("ids").isNull()))
        left = now.filter(F.col("ids").isNotNull())
        if parts == 1:
            break
    return closed.unionByName(left).select(F.col("id").alias(id_col), *names)
