import unicodedata

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as t
from gleaner.functions.dates import normalize_date


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def test_words(spark):
    assert sorted(one(spark, t.words("s"), s="The War of Lützen, the war")) == ["lützen", "war"]
    assert one(spark, t.words(F.lit(None).cast("string"))) == []


def test_terms_are_ordered_distinct_and_bounded(spark):
    assert one(spark, t.terms("s"), s="Jean-Paul's reign_x Jean") == ["jean", "paul", "s", "reign", "x"]
    assert len(one(spark, t.terms("s"), s=" ".join(map(str, range(200))))) == 96
    folded = spark.createDataFrame([("ﬁne STRASSE ß",)], "s string").select(t.terms(t.nfkc_casefold("s"), folded=True)).first()[0]
    assert folded == ["fine", "strasse", "ss"]


def test_accents(spark):
    marked = "Lützen Évora ñandú"
    plain = "".join(c for c in unicodedata.normalize("NFD", marked) if not unicodedata.combining(c))
    assert one(spark, t.without_accents("s"), s=marked) == plain


def test_trigrams_of_short_texts(spark):
    assert sorted(one(spark, t.trigram_set("s"), s="a b")) == ["a", "b"]
    assert one(spark, t.trigram_set("s"), s="a b c") == ["a b c"]
    assert one(spark, t.redundancy("a", "b"), a="x y z w", b="x y z v") == pytest.approx(1 / 3)
    assert one(spark, t.redundancy("a", "b"), a="", b="") == 0


def test_estimates(spark):
    assert one(spark, t.estimate_tokens("s"), s="éé") == 2
    assert one(spark, t.density("s"), s="too short.") == pytest.approx(0.1)
    assert one(spark, t.density("s"), s="word " * 39 + "end.") == pytest.approx(0.35 + 0.12 + 0.1)


def test_trim_ends_at_a_sentence(spark):
    text = "First one. Second two. Third"
    assert one(spark, t.trim_sentence("s", 100, 100), s=text) == text
    assert one(spark, t.trim_sentence("s", 100, 24), s=text) == "First one. Second two."
    assert one(spark, t.trim_sentence("s", 100, 5), s=text) == ""


def test_preview(spark):
    assert one(spark, t.preview_excerpt("s"), s=" a \n b ") == "a b"
    assert one(spark, t.preview_excerpt("s"), s="  ") is None
    sentence = "x" * 150 + ". " + "y" * 200
    assert one(spark, t.preview_excerpt("s"), s=sentence) == "x" * 150 + ".…"
    assert one(spark, t.preview_excerpt("s"), s="z" * 400) == "z" * 280 + "…"
    words = "ab " * 200
    assert one(spark, t.preview_excerpt("s"), s=words) == ("ab " * 93).rstrip() + "…"


def test_keys(spark):
    assert one(spark, t.title_key("s"), s="World_War_I!") == "world war i"
    assert one(spark, t.normalize_entity("s"), s="Roman_Empire (27 BC)  ") == "roman empire"
    assert one(spark, t.export_name("s"), s="a/b: c") == "a-b- c.md"
    assert one(spark, t.export_name("s"), s="") == "conversation.md"
    assert one(spark, t.single_line("s"), s=" a\nb ") == "a b"
    assert one(spark, t.evidence_text("s"), s="“It’s”\n – fine [3]") == "\"it's\" - fine"


def test_even_positions(spark):
    assert one(spark, t.even_positions(F.lit(15), 10)) == [0, 2, 3, 5, 6, 8, 9, 11, 12, 14]
    assert one(spark, t.even_positions(F.lit(15), 1)) == [0]
    assert one(spark, t.even_positions(F.lit(3), 10)) == [0, 1, 2]


@pytest.mark.parametrize(
    ("text", "date", "precision", "approximate"),
    [
        ("23 May 1618", (1618, 5, 23), "day", False),
        ("May 23rd, 1618", (1618, 5, 23), "day", False),
        ("circa 1619", (1619, 0, 0), "year", True),
        ("the war of 1618–1648", (1618, 0, 0), "range", False),
        ("500 BCE", (-500, 0, 0), "year", False),
        ("15 March 44 BCE", (-44, 3, 15), "day", False),
        ("in the 1620s", (1620, 0, 0), "decade", False),
        ("June 1789", (1789, 6, 0), "month", False),
        ("August 29, 1793 – December 19, 1793", (1793, 8, 29), "range", False),
        ("29 February 1600", (1600, 2, 29), "day", False),
    ],
)
def test_dates(spark, text, date, precision, approximate):
    found = one(spark, normalize_date("s"), s=text)
    assert (found["year"], found["month"], found["day"]) == date
    assert (found["precision"], found["approximate"]) == (precision, approximate)


@pytest.mark.parametrize("text", ["31 February 1618", "109 delegations", "no date", "12,345 men", ""])
def test_no_dates(spark, text):
    assert one(spark, normalize_date("s"), s=text) is None
