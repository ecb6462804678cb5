import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, with and without underscores, and one that needs quotes.
CLASHING = (
    "id row_id digest part size key chunks h gone row nth stays stay_id stay_digest own_digest copies source_key nth_own own_hash root node u doc "
    "_gone _row _digest _nth _stay _id _d _copies _part _h _h2 _nth2 _text _source a.b"
).split()
LONG = "word and other words of a very long text, again. " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "A plain line of text with enough words in it.\nAnd one more line.", "en", "a", 1, "x", 7),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 7),
        (4, LONG, "en", "b", 1, "x", 7),
        (5, "A plain line of text with enough words in it.\nAnd one more line.", "en", "a", 1, "x", 7),
        (5, "A plain line of text with enough words in it.\nAnd one more line.", "en", "a", 1, "x", 7),
        (6, " \t\n\x0b\x0c\r ", "fr", "b", 1, "x", 7),
        (7, "1234 !! ??", "de", None, 1, "x", 7),
        (8, "ünïcödé \U0001f642 日本語 текст é \x1c   end", None, "b", 1, "x", 7),
        (None, "without an id", "en", "a", 1, "x", 7),
    ]
    values = [(*r, *["x"] * (len(CLASHING) - 2)) for r in rows]
    return spark.createDataFrame(values, ", ".join([COLUMNS, "id string, row_id long", *[f"`{c}` string" for c in CLASHING[2:]]]))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
