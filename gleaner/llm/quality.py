"""Line-first quality rules.

Each line of a text is judged on its own by punctuation, navigation and boilerplate rules.  Lines
that fail are removed, and a document that loses too large a share of its words is rejected, as is
one that is too short or repeats itself too much as a whole.

Cases: null and empty texts have no words and are rejected as too short; very long texts are worked
on whole; lines without a word are neither judged nor counted as repeats.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import map_arrow, text_slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Characters that may end a sentence, of several scripts, and any opening or closing quotation mark (either closes in some language).
TERMINAL = ".!?…:;\"')։؟۔।॥።។။。！．？"
QUOTES = ("Pi", "Pf")
#: Phrases of page furniture in lower case, by language; they count in lines of at most FURNITURE_WORDS words, not in prose.
BOILERPLATE = {
    "en": (
        "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "read more", "sign in", "skip to content",
        "subscribe to our newsletter", "terms of service", "terms of use",
    ),
    "de": ("alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "jetzt anmelden", "newsletter abonnieren", "nutzungsbedingungen", "weiterlesen", "zum inhalt springen"),
    "fr": ("accepter les cookies", "aller au contenu", "conditions d'utilisation", "lire la suite", "politique de confidentialité", "se connecter", "tous droits réservés"),
    "es": ("aceptar cookies", "iniciar sesión", "leer más", "política de privacidad", "saltar al contenido", "términos de uso", "todos los derechos reservados"),
    "it": ("accetta i cookie", "leggi tutto", "informativa sulla privacy", "tutti i diritti riservati"),
    "pt": ("aceitar cookies", "leia mais", "política de privacidade", "todos os direitos reservados"),
}
FURNITURE_WORDS = 12
_BOILERPLATE = re.compile("|".join(re.escape(x) for found in BOILERPLATE.values() for x in found))

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is a menu if it has so many separators and one for every SEPARATED words at least.
MIN_SEPARATORS, SEPARATED = 2, 5
#: A line fails for symbols if it has more than one for so many words.
WORDS_PER_SYMBOL = 4
#: A line without any lower-case letter fails from so many words on.
SHOUTED_WORDS = 3
#: A line that ends without a terminal mark passes if it has so many words and a sentence inside.
LONG_LINE = 12
#: The largest share of words that removed lines may hold, in percent.
MAX_LOST_PERCENT = 50

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, "
    "failed_punctuation bigint, failed_navigation bigint, failed_boilerplate bigint, lost_words bigint, clean_text string"
)


def line_rule(line: str, n_words: int) -> int:
    """0: the line passes; 1: punctuation, 2: navigation, 3: boilerplate rule fails."""
    bars = line.count("|") + line.count("»") + line.count(">")
    if bars >= MIN_SEPARATORS and bars * SEPARATED >= n_words:
        return 2
    if n_words <= FURNITURE_WORDS and _BOILERPLATE.search(line.lower()):
        return 3
    symbols = sum(map(line.count, SYMBOLS))
    if symbols * WORDS_PER_SYMBOL > n_words:
        return 1
    if n_words >= SHOUTED_WORDS and line == line.upper() and line != line.lower():
        return 1
    end = line.rstrip(SPACES)[-1:]
    if end not in TERMINAL and unicodedata.category(end) not in QUOTES and not (n_words >= LONG_LINE and ". " in line):
        return 1
    return 0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1_000_000:  # keeps the keys of windows within 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[where] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= hit
    return int(inside.sum())


def measure(text: str | None) -> tuple:
    """The values of SCHEMA for one text."""
    text = text or ""
    words = text.encode().split()
    lost, failed, kept, seen, dup = 0, [0, 0, 0, 0], [], set(), 0
    lines = text.split("\n")
    n_lines = 0
    for line in lines:
        n = len(line.encode().split())
        if n:
            n_lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
            rule = line_rule(line, n)
            failed[rule] += 1
            if rule:
                lost += n
                continue
        kept.append(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        n_lines,
        *failed[1:],
        lost,
        "\n".join(kept),
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_lost_percent: int = MAX_LOST_PERCENT,
    with_text: bool = True,
) -> DataFrame:
    """One row per document: id, the measures, base_failed, kept and, if asked for, the cleaned text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id"] + [x.split()[0] for x in SCHEMA.split(", ")]
    if not with_text:
        names.remove("clean_text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA if with_text else SCHEMA.rpartition(',')[0]}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                found = [measure(x) for x in batch.column(1).to_pylist()]
                columns = list(map(list, zip(*found, strict=True))) if found else [[] for _ in SCHEMA.split(",")]
                kinds = [pa.int64()] * (len(columns) - 1) + [pa.string()]
                arrays = [batch.column(0)] + [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    measured = map_arrow(rows, kernel, schema)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured.select(
        F.col("id").alias(id_col),
        *names[1:],
        base.alias("base_failed"),
        (~base & (100 * F.col("lost_words") <= max_lost_percent * F.col("n_words"))).alias("kept"),
    )
