"""Text expressions: every function takes and gives Columns and stays inside the JVM, unless it says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that `words` leaves out.
WORD_STOPS = ("the", "of", "a", "and", "to", "in", "what", "why")
#: Bounds of the text functions.
MAX_TERMS = 96
PREVIEW_CHARS = 280
EXPORT_NAME_CHARS = 80

_WORD = r"(?U)\w+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row, however often and wherever it stands in what is used."""
    return F.get(F.transform(F.array(value), use), 0)


def text_array(values: tuple[str, ...] | list[str]) -> Column:
    """A literal array of strings, empty ones included."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def all_words(c: str | Column) -> Column:
    """Runs of word characters in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(_WORD), F.lit(0))


def words(c: str | Column) -> Column:
    """Distinct words without stop words."""
    return F.array_except(F.array_distinct(all_words(c)), text_array(WORD_STOPS))


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters under the marks."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalpha():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accents()


def without_accents(c: str | Column) -> Column:
    return F.translate(_col(c), _MARKED, _PLAIN)


def index_tokens(c: str | Column) -> Column:
    """Tokens of the lexical index: letters and digits in lower case, without diacritics, with repeats."""
    return F.regexp_extract_all(F.lower(without_accents(F.coalesce(_col(c), F.lit("")))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def nfkc_casefold(c: str | Column) -> Column:
    """Compatibility normal form, case folded.  Spark has no function for either, so this one runs in Arrow batches."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return fold(_col(c))


def terms(c: str | Column, folded: bool = False) -> Column:
    """Query terms: ordered, distinct, at most MAX_TERMS.  folded: c went through nfkc_casefold already."""
    source = F.coalesce(_col(c), F.lit(""))
    found = F.regexp_extract_all(source if folded else F.lower(source), F.lit(r"(?U)[^\W_]+"), F.lit(0))
    return F.slice(F.array_distinct(found), 1, MAX_TERMS)


def normalize_text(c: str | Column) -> Column:
    return F.array_join(all_words(c), " ")


def title_key(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(_col(c), "_", " ")), r"(?U)[^\w ]", ""))


def normalize_entity(c: str | Column) -> Column:
    """Without a closing parenthesis of up to 60 characters and odd marks, squeezed, in lower case."""
    out = F.translate(_col(c), "_’", " '")
    out = F.regexp_replace(out, r"(?U)\s*\([^)]{1,60}\)\s*$", "")
    out = F.regexp_replace(out, r"(?U)[^\w\-' ]+", " ")
    return F.lower(squeeze(out))


def squeeze(c: str | Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def trigram_set(c: str | Column) -> Column:
    """Distinct runs of three words; of texts with fewer than three words, the distinct words."""
    return F.array_distinct(let(all_words(c), lambda found: F.when(F.size(found) >= 3, runs_of_three(found)).otherwise(found)))


def runs_of_three(found: Column) -> Column:
    """Of an array with three words or more, bound by `let`, all runs of three."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.get(found, i - 1), F.get(found, i), F.get(found, i + 1)))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two sets: the shared part of all, 0 if both are empty."""
    return let(
        F.struct(_col(a).alias("a"), _col(b).alias("b")),
        lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.lit(1), F.size(F.array_union(s["a"], s["b"]))),
    )


def redundancy(left: str | Column, right: str | Column) -> Column:
    return jaccard(trigram_set(left), trigram_set(right))


def overlap(left: str | Column, right: str | Column) -> Column:
    """The part of the left set that the right set holds."""
    return F.size(F.array_intersect(_col(left), _col(right))) / F.greatest(F.lit(1), F.size(_col(left)))


def estimate_tokens(c: str | Column) -> Column:
    """A third of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(_col(c), F.lit(""))) / 3)


def density(c: str | Column) -> Column:
    """How complete a passage reads: 0.1 below 18 words, else by sentences and words, at most 1."""
    n = F.size(all_words(c))
    sentences = F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(r"[.!?](?:\s|$)"))
    return F.when(n < 18, F.lit(0.1)).otherwise(F.least(F.lit(1.0), 0.35 + sentences * 0.12 + F.least(n, F.lit(160)) / 400))


def haystack(c: str | Column) -> Column:
    """Lower case, with everything but word characters and spaces turned into spaces."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"(?U)[^\w ]+", " ")


def embedding_text(variant: str, article: str = "article_path", section: str = "section", subsection: str = "subsection", text: str = "text") -> Column:
    """What is embedded for a chunk: its text alone, or below its headings, or below title and headings."""
    heading = F.concat_ws(" > ", F.col(section), F.col(subsection))
    title = F.translate(F.col(article), "_", " ")
    parts = {"text": [F.col(text)], "section": [heading, F.col(text)], "title": [F.concat_ws(" > ", title, heading), F.col(text)]}
    if variant not in parts:
        raise ValueError(f"no such variant: {variant}")
    return F.concat_ws("\n\n", *parts[variant])


def sentence_ends(c: str | Column) -> Column:
    """Where sentences or paragraphs end, in characters from the text's begin, in order."""
    # Pieces up to each end; their lengths add up to the ends.
    pieces = F.regexp_extract_all(_col(c), F.lit(r"(?s).*?(?:[.!?](?=\s|$)|\n\n)"), F.lit(0))
    return F.aggregate(
        pieces, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p)))
    )


def trim_sentence(c: str | Column, max_tokens: int | Column, max_chars: int | Column) -> Column:
    """The longest prefix that ends a sentence or paragraph within both limits; empty if there is none."""
    text = _col(c)
    tokens = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    chars = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    # Ends beyond the limit do not count, so the text is read to the limit and the character that shows an end there.
    fits = F.filter(sentence_ends(F.substring(text, F.lit(1), chars + 2)), lambda n: (n <= chars) & (estimate_tokens(F.substring(text, F.lit(1), n)) <= tokens))
    cut = F.rtrim(F.substring(text, F.lit(1), F.array_max(fits)))
    return F.when((estimate_tokens(text) <= tokens) & (F.length(text) <= chars), text).otherwise(F.coalesce(cut, F.lit("")))


def preview_excerpt(c: str | Column, limit: int = PREVIEW_CHARS) -> Column:
    """At most limit characters: up to a sentence's end, else a word's, else cut; null for blank texts."""
    text = squeeze(c)
    clipped = F.substring(text, 1, limit + 1)
    back = F.reverse(clipped)
    last = lambda mark: F.when(F.instr(back, mark) > 0, F.length(clipped) - F.instr(back, mark) - len(mark) + 1).otherwise(-1)
    sentence = F.greatest(*(last(f" {m}") for m in ".?!"))
    word = last(" ")
    cut = F.when(sentence >= max(80, limit // 2), F.substring(clipped, F.lit(1), sentence + 1)).otherwise(
        F.rtrim(F.substring(clipped, F.lit(1), F.when(word >= 80, word).otherwise(limit)))
    )
    return F.when(text == "", None).when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def evidence_text(c: str | Column) -> Column:
    """For finding evidence in a page: plain quotes and dashes, no [n] marks, squeezed, in lower case."""
    plain = F.translate(F.coalesce(_col(c), F.lit("")), "’‘“”–—", "''\"\"--")
    return F.lower(squeeze(F.regexp_replace(plain, r"\[\d+\]", " ")))


def stable_fingerprint(*columns: str | Column) -> Column:
    """A SHA-256 over the JSON of the values."""
    return F.sha2(F.to_json(F.struct(*[_col(c).alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def export_name(c: str | Column) -> Column:
    """A file name: other marks than space, dash and underscore become dashes."""
    name = F.substring(F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^\p{L}\p{N} _-]", "-")), 1, EXPORT_NAME_CHARS)
    return F.concat(F.when(F.trim(name) == "", "conversation").otherwise(F.trim(name)), F.lit(".md"))


def single_line(c: str | Column) -> Column:
    return F.trim(F.translate(F.coalesce(_col(c), F.lit("")), "\n\r", " "))


def even_positions(length: Column, count: int) -> Column:
    """Positions of count items spread evenly over length ones, first and last included; half rounds to even."""
    if count == 1:
        return F.array(F.lit(0))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda n: F.bround(n * (length - 1) / (count - 1)).cast("int")))
    return F.when(length <= count, F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)))).otherwise(spread)
