import pytest
from pyspark.sql import functions as F

from gleaner.operators import reader
from gleaner.sources import archive, html

PAGE = """<html><body><div id="mw-content-text"><nav><ul><li>Menu</li></ul></nav><div class="navbox"><ul><li>Box</li></ul></div>
<p>Lead <b>text</b><sup>[1]</sup> here.<p>Second paragraph.
<h2 id="Campaigns">Campaigns</h2><h3><span id="y1805">1805</span></h3><ul><li>Ulm</li><li>Austerlitz</ul>
<table class="wikitable"><tr><th>Date</th><th>Battle</th></tr><tr><td rowspan=2>1815</td><td>Ligny</td></tr><tr><td>Waterloo<table><tr><td>inner</td></tr></table></td></tr></table>
<table><tr><td>layout</td></tr></table><h2>References</h2><ul><li>A book</li></ul></div></body></html>"""


def test_structured():
    found = [(b["type"], b["text"]) for b in html.structured_blocks(PAGE)]
    assert found[:2] == [("p", "Lead text here."), ("p", "Second paragraph.")]
    assert found[2:4] == [("h2", "Campaigns"), ("h3", "1805")]
    assert ("p", "Ulm") in found and ("p", "Austerlitz") in found
    assert ("p", "Date: 1815; Battle: Ligny") in found
    assert any(t.startswith("Date: 1815; Battle: Waterloo") for _, t in found)
    text = " ".join(t for _, t in found)
    for gone in ("Menu", "Box", "layout", "A book", "[1]"):
        assert gone not in text


def test_prose():
    assert [b["type"] for b in html.prose_blocks(PAGE)] == ["p", "p", "h2", "h3", "h2"]


@pytest.mark.parametrize("page", [None, "", "plain", "<p>unclosed", "<table><tr><td colspan='x'>a", "<div><div></p></div>"])
def test_broken_pages(page):
    for f in (html.structured_blocks, html.prose_blocks, html.local_links, html.heading_targets, html.text_blocks):
        f(page)
    html.clean_copy(page, "a")


def test_spans():
    table = html.parse("<table><tr><th>a<th colspan=2>b<tr><td rowspan=3>1<td>2<td>3<tr><td>4<td>5<tr><td>6</table>")
    node = next(n for n in table.walk() if n.tag == "table")
    assert list(html.table_lines(node)) == ["a: 1; b: 2; b: 3", "a: 1; b: 4; b: 5", "a: 1; b: 6"]


def test_links_and_headings():
    page = '<article><p><a href="Sulla">Sulla</a> and <a href="Julius_Caesar#x">Caesar</a> <a href="https://x.org">far</a> <a href="#top">up</a> <a href="N1">[1]</a></p><a href="Out">no paragraph</a></article>'
    assert [x["href"] for x in html.local_links(page)] == ["Sulla", "Julius_Caesar"]
    assert [(h["text"], h["parent"], h["target"]) for h in html.heading_targets(PAGE)] == [("campaigns", "campaigns", "Campaigns"), ("1805", "campaigns", "y1805")]


def test_clean_copy():
    page = '<p onclick="x()">a<script>bad()</script><img src="//x"><a href="https://x.org">far</a><a href="../secret">up</a><a href="Other page#s">ok</a></p>'
    out = html.clean_copy(page, "dir/page")
    assert "script" not in out and "onclick" not in out and "x.org" not in out and "img" not in out
    assert 'href="/wiki/dir/Other page#s"' in out


@pytest.mark.parametrize(("path", "valid"), [("A/b", True), ("", False), ("/a", False), ("a\\b", False), ("a/../b", False), ("a\nb", False), ("..a", True)])
def test_paths(spark, path, valid):
    assert html.valid_path(path) is valid
    assert spark.createDataFrame([(path,)], "p string").select(html.valid_path_column("p")).first()[0] is valid


def test_blocks_as_rows(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")
    rows = html.page_rows(pages, html.blocks("html"), "page_id").orderBy("block_no").collect()
    assert rows[0]["text"] == "Lead text here." and {r["page_id"] for r in rows} == {1}


ENTRIES = [("Alias", "Mid"), ("Mid", "Café / War#part"), ("Café / War", None), ("Loop", "Loop"), ("Lost", "Nowhere")]


def test_redirects(spark):
    entries = spark.createDataFrame(ENTRIES, "path string, redirect_to string")
    found = {r["path"]: r["target"] for r in archive.resolve_redirects(entries, on_loop="null").collect()}
    assert found == {"Alias": "Café / War", "Mid": "Café / War", "Café / War": "Café / War", "Loop": None, "Lost": None}
    stopped = {r["path"]: r["target"] for r in archive.resolve_redirects(entries, on_loop="stop").collect()}
    assert stopped["Loop"] == "Loop"
    with pytest.raises(Exception, match="redirect loop"):
        archive.resolve_redirects(entries).collect()


def test_search(spark):
    titles = spark.createDataFrame([("World_War_I",), ("World_War_II",), ("War",), ("Peace",)], "path string")
    asked = spark.createDataFrame([(1, "World War I")], "query_id int, query string")
    found = archive.search_titles(titles, asked, 3).orderBy("rank").collect()
    assert [r["path"] for r in found] == ["World_War_I", "World_War_II", "War"]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    for _ in range(2):
        archive.write_json(df, str(tmp_path / "t"))
    assert archive.read_json(spark, str(tmp_path / "t"), "id int, x string").collect() == df.collect()


# --- evidence in pages ---


def test_heading_links(spark):
    heads = spark.createDataFrame(
        [("P", "origins", "origins", "Origins"), ("P", "battle", "origins", "b1"), ("P", "battle", "end", "b2"), ("P", "twice", "x", "t1"), ("P", "twice", "y", "t2")],
        "path string, text string, parent string, target string",
    )
    sources = spark.createDataFrame(
        [(1, "P", "Origins", "Battle"), (2, "P", "Origins", "Missing"), (3, "P", "Twice", None), (4, "P q", None, None)], "source_id int, path string, section string, subsection string"
    )
    urls = {r["source_id"]: r["url"] for r in reader.heading_links(sources, heads).collect()}
    assert urls == {1: "/wiki/P#b1", 2: "/wiki/P#Origins", 3: "/wiki/P", 4: "/wiki/P%20q"}


def test_location(spark):
    blocks = spark.createDataFrame(
        [("P", 0, "A short lead that is here."), ("P", 1, "It’s the “great” battle – fought [1] at dawn in the fields."), ("P", 2, "Before. It's the \"great\" battle - fought at dawn in the fields. After that.")],
        "path string, position int, text string",
    )
    evidence = spark.createDataFrame(
        [(1, "P", "It's the \"great\" battle - fought at dawn\nin the fields."), (2, "P", "An unrelated sentence of enough length."), (3, "P", "short")], "source_id int, path string, evidence string"
    )
    found = {r["source_id"]: (r["position"], r["tier"]) for r in reader.locate_evidence(evidence, blocks).collect()}
    assert found == {1: (1, 5)}


def test_status(spark):
    pages = spark.createDataFrame([("P", "text/html", PAGE), ("B", "image/png", None)], "path string, mimetype string, html string")
    sources = spark.createDataFrame(
        [(1, "P", "Campaigns", None, "Second paragraph. And more than that."), (2, "P", "Campaigns", None, "x" * 50), (3, "P", "None", None, "y" * 50), (4, "B", "s", None, "z" * 50)],
        "source_id int, path string, section string, subsection string, supplied_text string",
    )
    pages = pages.withColumn("html", F.when(F.col("path") == "P", F.regexp_replace("html", "Second paragraph.", "Second paragraph. And more than that.")).otherwise(F.col("html")))
    found = {r["source_id"]: r["evidence_status"] for r in reader.evidence_status(sources, pages).collect()}
    assert found == {1: "exact", 2: "section", 3: "article", 4: "unavailable"}
