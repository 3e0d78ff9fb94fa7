import random
import re

from pyspark.sql import functions as F

from regionscore.functions import text as TX
from regionscore.operators import evidence as E


def _names(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return set(df.select(TX.place_names(F.col("t"))).first()[0])


def test_names_single_multiple_complex_none(spark):
    assert _names(spark, "Loudoun County approved a new data center ordinance.") == {"Loudoun County"}
    assert _names(spark, "Data center rules in Loudoun County and Prince William County according to officials") == \
        {"Loudoun County", "Prince William County"}
    got = _names(spark, "Los Angeles County, San Bernardino County and St. Louis County all voted.")
    assert {"Los Angeles County", "San Bernardino County", "St. Louis County"} <= got
    assert "Louis County" not in got
    assert _names(spark, "The county-level policy discussion is ongoing.") == set()


def test_names_of_odd_texts_equal_python_re(spark):
    """Both forms of the pattern give the same names, with suffixes that are words of a name and others."""
    parts = ["New", "North", "St.", "San", "La", "Ada", "County", "Bar", "city", "of", "O'", "x", "A", ".", "É", "é", "_", "7"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", "-", "'", "\n", ""]) for _ in range(rng.randint(1, 14)))
             for _ in range(4000)]
    texts += ["New  County", "Ada New  Bar County", "New  New  Ada County x", "Ada County Bar Ada", "St.Ada County",
              "Ada city Bar city", "Ada County Board Bar County Boards", "Ada-County Bar 'County"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for suffix in ["County", "[A-Z][a-z]+", "(?:County|city)", "County Bar", r"\s*Bar"]:
        pattern = re.compile(TX.place_name_pattern(suffix))
        got = {r.i: r.n for r in df.select("i", TX.place_names("t", suffix).alias("n")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == list(dict.fromkeys(m.group(1).strip(" ") for m in pattern.finditer(t))), (suffix, t)


def test_names_of_long_runs(spark):
    """A run of any length takes no stack and linear time: without a name, with one at its start, with one at its end."""
    run = "Alpha " * 200_000
    texts = [run, "Ada County " + run, run + "County", "New  " + run, "Ada  New  " * 50_000, "Alpha-Beta'" * 100_000, "A" + "a" * 1_000_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", TX.place_names("t").alias("n")).collect()}
    assert got == {0: [], 1: ["Ada County"], 2: [run + "County"], 3: [], 4: [], 5: [], 6: []}
    words = df.where("i < 2").select("i", TX.place_names("t", "[A-Z][a-z]+").alias("n")).collect()
    assert {r.i: r.n for r in words} == {0: [run.strip()], 1: ["Ada County " + run.strip()]}
    verdicts = E.rule_verdicts(df, "t", ["i"], ["County"], ["Ada"], ["Alpha"]).collect()
    assert {r.i: r.mentioned_county for r in verdicts if r.mentioned_county} == {1: "Ada County", 2: run + "County"}


def test_evidence_rows_and_counts(spark):
    items = spark.createDataFrame([
        ("q1", "Prince William County news", "Prince William County votes", "u1"),
        ("q1", "Fairfax County update", "zoning", "u2")], "query string, title string, snippet string, url string")
    rows = E.evidence_rows(items, F.concat_ws(" ", "title", "snippet"), ["query", "title", "snippet", "url"])
    assert rows.count() == 2
    counts = {r["county"]: r["count"] for r in E.name_counts(rows).collect()}
    assert counts == {"Prince William County": 1, "Fairfax County": 1}


def test_distinct_nonblank_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(
        ["page1", "page2", "", "  page3  ", "page1", None, "page4"])], "pos int, url string")
    out = {r["value"] for r in E.distinct_nonblank(df, "url", "pos").collect()}
    assert out == {"page1", "page2", "page3", "page4"}


def _html(spark, h):
    return spark.createDataFrame([(h,)], "h string").select(TX.html_to_text(F.col("h"))).first()[0]


def test_html_to_text_cases(spark):
    assert _html(spark, "<html><body>Test HTML content</body></html>") == "Test HTML content"
    out = _html(spark, "<html><head><script>var x=1;</script><style>p{}</style></head><body>"
                       "<noscript>enable js</noscript><p>Visible</p></body></html>")
    assert out == "Visible"
    out = _html(spark, "<p>a</p>\n\n\n\n\n<p>b    c</p>  ")
    assert "\n\n\n" not in out and "    " not in out and out == out.strip()
    assert _html(spark, "<p>Fish &amp; Chips</p><!-- c --><p>x</p>") == "Fish & Chips\nx"
