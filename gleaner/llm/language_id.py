"""Language identification: script ranges narrow the candidates, a Viterbi pass labels spans.

Training counts hashed character n-grams of labelled texts by language, on a bounded sample of rows,
in a distributed aggregation; the model is a table of fixed size for each language.  A word's score
for a language is the log-probability of its n-grams.  Languages whose training text hardly uses the
word's script are no candidates for it.  Over the words of a text, the Viterbi path pays a penalty
for each change of language, so spans of mixed texts get their own labels and single odd words don't.
The text's language is the one whose spans hold most letters; its score is their share.

Cases: `und` with score 0 for null texts, texts without a letter, and when nothing was learned; ties
go to the language that comes first by code point; texts are labelled whole, whatever their length; null
and repeated ids are rows like others; extra columns may have any name.  `keep_identified` rejects what is
`und` and what no learned language explains better than chance; mixed texts stay, and so does everything
when nothing was learned.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, column, keep, kept, map_arrow, text_slices

UNDETERMINED = "und"
#: First code points of blocks, and the script that letters from there on belong to (fixed values of Unicode).
SCRIPT_RANGES = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x1380, "Other"),
    (0x1780, "Khmer"),
    (0x1800, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x2C60, "Latin"),
    (0x2C80, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB10, "Other"),
    (0x20000, "Han"),
)
_STARTS = [x[0] for x in SCRIPT_RANGES]
SCRIPTS = sorted({x[1] for x in SCRIPT_RANGES})

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
#: Labelled rows that training reads for each language, about.
TRAIN_ROWS = 1500
#: What a change of language costs, in nats.
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script that has this share of its letters in training.
SCRIPT_SHARE = 0.001
SMOOTHING = 0.5
#: The log-probability of an n-gram if all buckets were alike.
CHANCE = -float(np.log(BUCKETS))
#: Words whose scores are kept per worker.
KEPT_WORDS = 150_000
#: Bytes of text and rows that are labelled at once: a step of the paths serves all texts of a slice.
LABELLED_BYTES, LABELLED_ROWS = 2 << 20, 1024
#: Cells (words times texts) of one padded Viterbi block.
BLOCK = 1 << 18


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPT_RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1]


def letters(word: str) -> str:
    """A word's letters in lower case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of all words, with ends marked, and the number of the word of each."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    found, whose = [], []
    gram = np.zeros(len(text), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(text) < n:
            break
        gram = gram[: len(text) - n + 1] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(n)
        same = owner[: len(gram)] == owner[n - 1 :]
        mixed = gram * np.uint64(0x9E3779B97F4A7C15)
        found.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[same])
        whose.append(owner[: len(gram)][same])
    return np.concatenate(found), np.concatenate(whose)


@dataclass
class Model:
    """languages in order; logp (BUCKETS, languages); allowed: script to the languages that may use it."""

    languages: list[str]
    logp: np.ndarray
    allowed: dict[str, np.ndarray]
    penalty: float = SWITCH_PENALTY
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    words: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None

    @property
    def label_kind(self) -> type:
        """The smallest type that numbers all languages."""
        return np.min_scalar_type(-max(1, len(self.languages)))

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("languages", "logp", "allowed", "penalty", "key")}

    def __setstate__(self, state: dict) -> None:
        """In a worker: take over the words that earlier tasks scored with the same model."""
        self.__dict__.update(state)
        self.words, self.scores, self.letters = kept(self.key) or ({}, None, None)

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the words of each text, for `scores` and `letters`."""
        if self.scores is None or len(self.words) > KEPT_WORDS:
            self.words, self.scores, self.letters = {}, np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int32)
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self.words]
        if new:
            own = [letters(w) for w in new]
            scores = np.zeros((len(new), len(self.languages)), np.float32)
            with_letters = [i for i, w in enumerate(own) if w]
            if with_letters:
                chosen = [own[i] for i in with_letters]
                buckets, whose = ngram_buckets(chosen)
                order = np.argsort(whose, kind="stable")
                begins = np.searchsorted(whose[order], np.arange(len(chosen)))
                scores[with_letters] = np.add.reduceat(self.logp[buckets[order]], begins, axis=0)
                barred = {script: ~may for script, may in self.allowed.items() if not may.all()}
                for k, w in zip(with_letters, chosen, strict=True) if barred else ():
                    if (no := barred.get(script_of(w))) is not None:
                        scores[k, no] = -1e4
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, scores])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, own), np.int32, len(own))])
            keep(self.key, (self.words, self.scores, self.letters))
        return [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in texts]

    def paths(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The Viterbi path of each text; texts of like length run together, a step for each word."""
        out: list[np.ndarray] = [np.zeros(0, self.label_kind)] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
        while order:
            steps = len(texts[order[0]])
            block, order = order[: max(1, BLOCK // steps)], order[max(1, BLOCK // steps) :]
            sizes = np.array([len(texts[i]) for i in block])
            numbers = np.zeros((steps, len(block)), np.int64)
            for k, i in enumerate(block):
                numbers[: sizes[k], k] = texts[i]
            rows = np.arange(len(block))
            best = np.zeros((steps, len(block)), self.label_kind)
            stays = np.zeros((steps, len(block), len(self.languages)), bool)
            value = self.scores[numbers[0]].astype(np.float64)
            live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than t words
            for t in range(1, steps):
                n = live[t]
                now = value[:n]
                top = now.argmax(axis=1)
                other = now[rows[:n], top][:, None] - self.penalty
                keep = now >= other
                best[t, :n], stays[t, :n] = top, keep
                value[:n] = np.where(keep, now, other) + self.scores[numbers[t, :n]]
            path = np.zeros((steps, len(block)), self.label_kind)
            state = value.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                n = live[t]
                path[t, :n] = state[:n]
                if t:
                    state[:n] = np.where(stays[t, rows[:n], state[:n]], state[:n], best[t, :n])
            for k, i in enumerate(block):
                out[i] = path[: sizes[k], k]
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, list[dict], float]]:
        """Language, score, spans (start and end by word, lang) and fit of each text.

        The fit is the mean log-probability of an n-gram along the path.
        """
        if not self.languages:
            return [(UNDETERMINED, 0.0, [], 0.0)] * len(texts)
        numbers = self.look_up([t.decode().split() for t in texts])
        out = []
        for own, path in zip(numbers, self.paths(numbers), strict=True):
            sizes = self.letters[own]
            total = int(sizes.sum())
            if not total:
                out.append((UNDETERMINED, 0.0, [], 0.0))
                continue
            held = np.bincount(path, weights=sizes, minlength=len(self.languages))
            winner = int(held.argmax())
            edges = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)].tolist()
            spans = [
                {"start": a, "end": b, "lang": self.languages[path[a]]} for a, b in zip(edges[:-1], edges[1:], strict=True)
            ]
            worded = sizes > 0  # a word of n letters and its two ends have 4 n + 2 n-grams
            fit = float(self.scores[own[worded], path[worded]].sum(dtype=np.float64)) / (4 * total + 2 * int(worded.sum()))
            out.append((self.languages[winner], float(held[winner]) / total, spans, fit))
        return out


def id_remainder(id_col: str | Column, parts: int = 4) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = TRAIN_ROWS
) -> Model:
    """Learn from labelled rows: about rows_per_lang of each language, chosen by a hash of the id and the text."""
    rows = labelled.filter(column(lang_col).isNotNull()).select(
        column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).cast("string").alias("lang")
    )
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(there, key=lambda x: [ord(c) for c in x])
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), {})
    # A hash of 62 bits against as fine a bound: of the largest languages, too, about as many rows as asked for are read.
    bounds = {lang: int(min(1.0, rows_per_lang / n) * (1 << 62)) for lang, n in there.items()}
    bound = F.element_at(F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)), F.col("lang"))
    chosen = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 62) - 1)) < bound.cast("bigint")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(languages)}
        counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)), np.int64)
        for whole in batches:
            for batch in text_slices(whole, 0, LABELLED_BYTES, LABELLED_ROWS):
                for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    words = [x for x in map(letters, text.decode().split()) if x]
                    if words:
                        own = counts[number[lang]]
                        own[:BUCKETS] += np.bincount(ngram_buckets(words)[0], minlength=BUCKETS)
                        for w in words:
                            own[BUCKETS + SCRIPTS.index(script_of(w))] += len(w)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang, bucket], pa.int64())],
            ["lang", "bucket", "n"],
        )

    partial = map_arrow(rows.filter(chosen).select("text", "lang"), kernel, "lang int, bucket int, n bigint")
    # At most BUCKETS and the scripts for each language.
    summed = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    counts[summed["lang"], summed["bucket"]] = summed["n"]
    grams, by_script = counts[:, :BUCKETS] + SMOOTHING, counts[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    share = by_script / np.maximum(1, by_script.sum(axis=1, keepdims=True))
    allowed = {s: share[:, k] >= SCRIPT_SHARE for k, s in enumerate(SCRIPTS)}
    return Model(languages, np.ascontiguousarray(logp), {s: may for s, may in allowed.items() if may.any()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, spans."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1, LABELLED_BYTES, LABELLED_ROWS):
                found = model.predict(as_bytes(batch.column(1)))
                columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], spans)],
                    ["id", "lang_pred", "score", "spans"],
                )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
    return map_arrow(rows, kernel, schema, model.key).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least_fit: float = CHANCE, text_col: str = "text") -> DataFrame:
    """docs with a language that explains the text better than chance, with their own columns; all if nothing was learned."""
    if not model.languages:
        return docs
    names = docs.columns
    text = names.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # the kernel's interface takes no names that need quotes

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text, LABELLED_BYTES, LABELLED_ROWS):
                found = model.predict(as_bytes(batch.column(text)))
                yield batch.filter(pa.array([lang != UNDETERMINED and fit >= least_fit for lang, _, _, fit in found], pa.bool_()))

    return map_arrow(plain, kernel, plain.schema, model.key).toDF(*names)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training must not see."""
    return id_remainder(id_col) == 2


def python_remainder(doc_id: object) -> int:
    """id_remainder in Python, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4
