from pyspark.sql import functions as F

from regionscore.functions import text as TX
from regionscore.operators import evidence as E
from regionscore.operators import explain as XP
from regionscore.operators.neighbours import knn


def test_knn_excludes_self_by_key_under_ties(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [5.0, 5.0])],
                               "id long, v array<float>")
    out = [(r["neighbor_id"], r["nn_rank"]) for r in knn(df, "id", "v", [1], k=2).orderBy("nn_rank").collect()]
    assert out == [(2, 1), (3, 2)]  # the identical vector 2 is a neighbour, self (1) is not


def test_parse_verdicts_success_and_failure(spark):
    ok = '{"mentioned_state": "VA", "mentioned_county": "loudoun", "is_data_center_policy": true, ' \
         '"support_data_center_siting": "neutral", "policy_type": "zoning", "summary": "s", "llm_confidence": 0.8}'
    df = spark.createDataFrame([(1, ok), (2, "not json"), (3, None)], "id int, reply string")
    rows = {r["id"]: r for r in E.parse_verdicts(df, "reply", ["id"]).collect()}
    assert rows[1]["is_data_center_policy"] is True and rows[1]["error"] is None and rows[1]["llm_confidence"] == 0.8
    for k in (2, 3):
        assert rows[k]["is_data_center_policy"] is False and rows[k]["llm_confidence"] == 0.0
        assert rows[k]["summary"] == "" and rows[k]["error"] == "unparsable reply"
    sig = E.entity_signal(E.parse_verdicts(df, "reply", ["id"])).collect()
    assert [(r["mentioned_state"], r["mentioned_county"], r["policy_direction_score"]) for r in sig] == \
        [("Virginia", "Loudoun County", 0.0)]


def test_cards_of_listing_pages(spark):
    card = ('<a class="ui card" href="/usa/va/ashburn/{0}"><div class="header">DC One</div><div class="description">Acme<br>'
            '12345 Main St<br>Suite 200<br>{1}<br>Suite 9<br>Ashburn</div></a>')
    html = (card.format("a", "20147-1234") + card.format("b", "VA 20147") + card.format("a", "99999")
            + '<a class="card" href="/usa/va/other/c"><p class="header">X</p><p class="description">a<br>b</p></a>'
            + '<a class="card" href="/usa/va/ashburn/d"><p class="header">X</p><p class="description">a</p></a>')
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    cards = {r["href"][-1]: r for r in E.extract_cards(df, "html", ["page_id"], ["usa", "va", "ashburn"]).collect()}
    assert set(cards) == {"a", "b"}  # equal names are two sites; a repeated href is one
    assert (cards["a"]["facility"], cards["a"]["company"], cards["a"]["street"]) == ("DC One", "Acme", "12345 Main St")
    assert (cards["a"]["zip"], cards["a"]["city"]) == ("20147", "Ashburn") and cards["b"]["zip"] is None
    limited = df.select(E.rate_limited(df, "html", F.lit(0), marker="DC One").alias("x")).first()["x"]
    assert limited is True


def test_verdicts_keep_the_fields_of_valid_replies(spark):
    df = spark.createDataFrame([(1, '{"mentioned_state": "Ohio", "is_data_center_policy": true, "summary": null}'),
                                (2, '{"mentioned_state": "Ohio", "is_data_center'), (3, '{"support_data_center_siting": false}')],
                               "id int, reply string")
    rows = {r["id"]: r for r in E.parse_verdicts(df, "reply", ["id"]).collect()}
    assert rows[1]["mentioned_state"] == "Ohio" and rows[1]["is_data_center_policy"] and rows[1]["error"] is None
    assert rows[1]["summary"] == "" and rows[2]["error"] == "unparsable reply" and rows[2]["mentioned_state"] is None
    assert rows[3]["support_data_center_siting"] == "false" and rows[3]["error"] is None


def test_entities_and_links(spark):
    page = "<p>a&#8217;b &eacute; &#x27;x&#X41; &amp;lt; &unknown; &#0; &nbsp</p><A HREF='/one'>1</A><a class=x href=/two>2</a><a  href=\"/three\">3</a>"
    df = spark.createDataFrame([(page,)], "html string")
    row = df.select(TX.html_to_text("html").alias("t"), TX.hrefs("html").alias("h")).first()
    assert row["t"].split("\n")[0] == "a\u2019b é 'xA &lt; &unknown; &#0; &nbsp" and row["h"] == ["/one", "/two", "/three"]


def test_rank_shift_direction(spark):
    imp = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s1", "c", 3), ("s2", "a", 3), ("s2", "b", 2),
                                 ("s2", "c", 1)], "stage string, feature string, rank int")
    out = {r["feature"]: (r["shift"], r["direction"]) for r in XP.rank_shift(imp, "s1", "s2", threshold=1).collect()}
    assert out == {"a": (-2, "falls"), "b": (0, "stable"), "c": (2, "rises")}
