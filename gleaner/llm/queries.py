"""The corpus operators as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, language_id, line_dedup, minhash, mixing, packing, quality, secrets, substring_dedup, token_counts
from gleaner.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train_forest(secrets.labelled_findings(spark))
    return secrets.scan(read(spark, sf_dir, "documents"), model)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return line_dedup.line_dedup(read(spark, sf_dir, "documents")).withColumn("removed", spans)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_substring_dedup, op3_minhash, op4_secret_scan, op5_packing, op6_line_dedup, op7_token_counts, op8_language_id,
        op9_exact_dedup, op10_mixing,
    )
}

_TERMS = "|".join(x.replace("'", "''") for found in quality.BOILERPLATE.values() for x in found)
_ENDS = quality.TERMINAL.replace("'", "''").replace(")", "\\)") + "".join(rf"\p{{{x}}}" for x in quality.QUOTES)
ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
        windows AS (
            SELECT doc_id, unnest(range(1, len(w) - 1)) AS pos, w FROM words
        ),
        triples AS (
            SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos], w[pos + 1], w[pos + 2]) AS n FROM windows
        ),
        repeated AS (
            SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM triples, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
        ),
        lines AS (
            SELECT doc_id, nth, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
                length(regexp_replace(line, '[^|»>]', '', 'g')) AS bars,
                length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
                regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS trimmed
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM docs)
        ),
        judged AS (
            SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY nth) > 1 AS again,
                (bars >= {quality.MIN_SEPARATORS} AND bars * {quality.SEPARATED} >= n)
                OR (n <= {quality.FURNITURE_WORDS} AND regexp_matches(lower(line), '{_TERMS}'))
                OR symbols * {quality.WORDS_PER_SYMBOL} > n
                OR (n >= {quality.SHOUTED_WORDS} AND line = upper(line) AND line != lower(line))
                OR (NOT regexp_matches(trimmed, '[{_ENDS}]$') AND NOT (n >= {quality.LONG_LINE} AND contains(line, '. '))) AS fails
            FROM lines WHERE n > 0
        ),
        by_doc AS (
            SELECT doc_id, coalesce(sum(n) FILTER (fails), 0) AS lost_words, count(*) FILTER (again) AS n_dup_lines FROM judged GROUP BY doc_id
        ),
        measured AS (
            SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
                length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                coalesce(b.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
                coalesce(b.lost_words, 0)::BIGINT AS lost_words
            FROM docs d JOIN words w USING (doc_id) LEFT JOIN by_doc b USING (doc_id) LEFT JOIN repeated r USING (doc_id)
        )
        SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
            NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
            AND 100 * lost_words <= {quality.MAX_LOST_PERCENT} * n_words AS kept
        FROM measured
    """,
    "op3_minhash": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        each_word AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
        windows AS (
            SELECT doc_id, n, pos, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle FROM each_word WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
        ),
        sets AS (SELECT DISTINCT doc_id, md5(shingle) AS shingle FROM windows WHERE pos <= greatest(1, n - {minhash.SHINGLE - 1})),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= {minhash.PERCENT} * (x.n + y.n - c.n)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
        roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT r.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, component_id, r.doc_id = component_id AS kept FROM roots r LEFT JOIN sizes s USING (doc_id)
    """,
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents
        ),
        worded AS (
            SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ),
        chunks AS (
            SELECT w.doc_id, w.pos, w.upto + 1 AS stop, string_agg(l.line, chr(10) ORDER BY l.pos) AS chunk FROM worded w JOIN lines l ON l.doc_id = w.doc_id AND l.pos BETWEEN w.pos AND w.upto
            WHERE w.upto IS NOT NULL GROUP BY w.doc_id, w.pos, w.upto
        ),
        marked AS (SELECT doc_id, pos, stop, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) > 1 AS gone FROM chunks),
        spans AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed_chunks, string_agg(pos || '-' || stop, ',' ORDER BY pos) FILTER (gone) AS removed FROM marked GROUP BY doc_id),
        dropped AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN marked m ON m.doc_id = l.doc_id AND m.gone AND l.pos >= m.pos AND l.pos < m.stop),
        kept AS (
            SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS removed_lines, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '') AS clean_text
            FROM lines l LEFT JOIN dropped d ON d.doc_id = l.doc_id AND d.pos = l.pos GROUP BY l.doc_id
        )
        SELECT k.doc_id, n_lines, coalesce(n, 0) AS n_chunks, coalesce(removed_chunks, 0) AS removed_chunks, removed_lines, coalesce(removed, '') AS removed, clean_text FROM kept k LEFT JOIN spans USING (doc_id)
    """,
    "op9_exact_dedup": """
        WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM hashed WINDOW g AS (PARTITION BY text_sha256)
    """,
}
