"""Text and elements of pages against Python's own HTML parser."""

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from conftest import SF_ORACLE
from regionscore.functions import text as TX
from regionscore.operators import evidence as E

VOID = set(TX.VOID_ELEMENTS)


class Tree(HTMLParser):
    """Elements by nesting: an end tag closes the last open element of its name and all that are open in it."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.nodes, self.found, self.gap = [], [], [], True
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.gap = True
        element = {"tag": tag, "attrs": dict(attrs), "texts": []}
        self.found.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.gap = True

    def handle_endtag(self, tag):
        self.gap = True
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if any(e["tag"] in TX.HIDDEN_ELEMENTS for e in self.open):
            return
        for e in [*self.open, {"texts": self.nodes}]:
            if self.gap or not e["texts"]:
                e["texts"].append(data)
            else:
                e["texts"][-1] += data
        self.gap = False

    def handle_comment(self, data):
        self.gap = True

    handle_decl = handle_pi = unknown_decl = handle_comment


def plain(nodes):
    text = "\n".join(nodes)
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


HARD = ["1 < 2", "a<b>c</b>d", "<p title=\"a > b\">x</p>", "<a href='x' title='>'>y</a>", "3 <4> 5", "<p>a</p ><br/>b", "<p><p><b>c",
        "x <!-- <b> --> y", "<script>a<b</script>z", "<style>p>a{}</style>z", "<SCRIPT>'<!--'</SCRIPT>t<!-- c -->u", "a < b > c", "<",
        "a <", "<div class='</div>'>q</div>", "<p\nid=1\n>l</p>", "&lt;b&gt;", "<!DOCTYPE html><p>d", "<noscript><p>n</p></noscript>m", "<?pi x?>y", "", "é<é>"]


def test_texts_equal_the_parser(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF_ORACLE}/pages.parquet").select("html").collect()]
    rows = list(enumerate([*pages, *HARD]))
    got = spark.createDataFrame(rows, "i int, html string").select("i", TX.html_to_text("html").alias("t")).collect()
    for r in got:
        assert r.t.split() == plain(Tree(rows[r.i][1]).nodes).split(), rows[r.i][1][:300]
    joined = spark.createDataFrame(rows, "i int, html string").select(F.array_join(TX.markup_tokens("html"), "").alias("t"), "html")
    assert joined.filter("t != html").count() == 0


NESTED = ["<div class='x a'>1<div>2</div>3</div>4", "<div><p class=a>1<p>2</p>3</p>4</div>", "<a class=a>1<a>2</a>3</a>4", "<b class=a>1<br>2", "<i class='b a c'/>1",
          "<div class=ab>0</div><DIV CLASS=\"a\">1<div class='</div>'>2</DIV>3</div>4", "<div data-class='a'>0</div><p class=a>1</p>", "no",
          "<div title='class=\"a\"'>0<span class='a'>1<!-- </span> -->2<span/></span>3</div>", "<ul><li class=a>1<ul><li>2</li></ul>3</li><li>4</li></ul>",
          "<div class=a>" + "<div>x" * 50 + "</div>" * 50 + "y</div>z", "<input class=a>0<p class=a>1</p>"]


def test_elements_equal_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(NESTED)), "i int, h string")
    got = {r.i: r.e for r in TX.with_element_of_class(df, "h", "a", "e").select("i", F.array_join(TX.text_nodes("e"), "|").alias("e")).collect()}
    for i, html in enumerate(NESTED):
        first = next((e for e in Tree(html).found if "a" in (e["attrs"].get("class") or "").split() and e["tag"] not in VOID), None)
        assert (got[i] or "") == ("|".join(t.strip() for t in first["texts"] if t.strip()) if first else ""), html


def test_links_with_quoted_brackets(spark):
    html = "<a title='x > y' href=\"/1\">a</a><a href = '/2?a>b'>b</a><a data-href='/no'>c</a><A CLASS=x HREF=/3>d</A><abbr href='/no'>"
    assert spark.createDataFrame([(html,)], "h string").select(TX.hrefs("h")).first()[0] == ["/1", "/2?a>b", "/3"]


def test_cards_of_nested_descriptions(spark):
    card = ("<a class='ui card' href='/usa/va/m/1'><div class='header'>Name</div><div class='description'><div>Co</div><div><div>1 St</div>"
            "<div>20147-1</div><div>20147</div>Suite 1<br>Town</div></div></a>")
    df = spark.createDataFrame([(1, card * 2), (2, card.replace("</div></a>", "</a>")), (3, card[:-4])], "id int, h string")
    got = E.extract_cards(df, "h", ["id"], ["usa", "va", "m"]).collect()
    assert sorted(tuple(r) for r in got) == [(i, "/usa/va/m/1", "Name", "Co", "1 St", "20147", "Town") for i in (1, 2, 3)]
