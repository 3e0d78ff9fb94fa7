"""Text-evidence, HTML, URL, JSON and scalar-feature queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionscore.functions import keys as K
from regionscore.functions import scalar as X
from regionscore.functions import text as TX
from regionscore.operators import evidence as E
from regionscore.plans.catalog import _r, query, sql_state_full, sql_title
from regionscore.sources.tables import Tables

LICENSE_SUFFIX = "License"
RUN_SUFFIX = "[A-Z][a-z]+"
POLICY_TERMS = ["License", "Licensed"]
SUPPORT_TERMS = ["MIT", "Apache"]
OPPOSE_TERMS = ["GNU", "General Public"]


#: The character references that the pages hold, for the oracle.
PAGE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
                 ("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"),
                 ("&amp;", "&")]


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _sql_names(text: str, suffix: str) -> str:
    return f"regexp_extract_all({text}, '{_sq(TX.place_name_pattern(suffix))}', 1)"


@query("place_names", f"""
SELECT DISTINCT doc_id, trim(n) AS county FROM (SELECT doc_id, unnest({_sql_names('text', LICENSE_SUFFIX)}) AS n FROM documents)""")
def place_names(spark, d):
    docs = Tables(spark, d).documents
    return E.evidence_rows(docs, F.col("text"), ["doc_id"], LICENSE_SUFFIX).select("doc_id", "county")


@query("evidence_rows")
def evidence_rows(spark, d):
    """Capitalised word runs. No SQL oracle: RE2's ``\\b`` is ASCII-only while Java's
    (like Python's) is Unicode-aware; tests compare against Python ``re`` instead."""
    docs = Tables(spark, d).documents
    text = F.concat_ws(" ", "source", "text")
    return E.evidence_rows(docs, text, ["doc_id", "source", "lang"], RUN_SUFFIX).select("doc_id", "source", "lang", "county")


@query("name_counts", f"""
SELECT county, count(*) AS count FROM (
  SELECT DISTINCT doc_id, trim(n) AS county FROM (SELECT doc_id, unnest({_sql_names('text', LICENSE_SUFFIX)}) AS n FROM documents))
GROUP BY county""")
def name_counts(spark, d):
    rows = E.evidence_rows(Tables(spark, d).documents, F.col("text"), ["doc_id"], LICENSE_SUFFIX)
    return E.name_counts(rows, "county")


def _sql_html_to_text(h: str) -> str:
    s = f"coalesce({h}, '')"
    s = f"regexp_replace({s}, '(?is)<!--.*?-->', '<!>', 'g')"
    s = f"regexp_replace({s}, '(?is)<!DOCTYPE[^>]*>', '', 'g')"
    for tag in TX.HIDDEN_ELEMENTS:
        s = f"regexp_replace({s}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '<{tag}>', 'g')"
    s = f"regexp_replace({s}, '(?s)(?:<[^>]*>)+', chr(10), 'g')"
    for ent, ch in PAGE_ENTITIES:
        s = f"replace({s}, '{_sq(ent)}', '{_sq(ch)}')"
    s = f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    s = f"regexp_replace({s}, '[ \\t]{{2,}}', ' ', 'g')"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    return s


@query("html_text", f"SELECT page_id, {_sql_html_to_text('html')} AS text FROM pages")
def html_text(spark, d):
    return E.html_pages_to_text(Tables(spark, d).pages, "html", ["page_id"])


@query("html_text_cut", f"SELECT page_id, substr({_sql_html_to_text('html')}, 1, {TX.DEFAULT_MAX_CHARS // 40}) AS text FROM pages")
def html_text_cut(spark, d):
    return E.html_pages_to_text(Tables(spark, d).pages, "html", ["page_id"], TX.DEFAULT_MAX_CHARS // 40)


_SQL_PATH = "regexp_extract(href, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"


@query("page_links", f"""
SELECT page_id, href, {_SQL_PATH} AS path,
       CAST(len(list_filter(string_split({_SQL_PATH}, '/'), lambda s: s <> '')) AS INTEGER) AS depth
FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '{_sq(TX.HREF)}', 1), lambda x: regexp_replace(x, '{_sq(TX.QUOTES)}', '', 'g'))) AS href FROM pages)""")
def page_links(spark, d):
    return E.page_links(Tables(spark, d).pages, "html", ["page_id"]).select("page_id", "href", "path", "depth")


@query("link_pairs", """
SELECT DISTINCT regexp_extract(url, '://([^/:?#]*)', 1) AS host, href
FROM (SELECT url, unnest(regexp_extract_all(html, '<a\\b[^>]*href="([^"]*)"', 1)) AS href FROM pages)""")
def link_pairs(spark, d):
    links = E.page_links(Tables(spark, d).pages.withColumn("host", X.url_host(F.col("url"))), "html", ["host"])
    return links.select("host", "href").distinct().orderBy("host", "href")


_SQL_LANG = "nullif(list_filter(string_split(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/'), lambda s: s <> '')[1], '')"


@query("url_dedup", f"""
SELECT page_id, url, lang FROM (
  SELECT page_id, url, {_SQL_LANG} AS lang,
         row_number() OVER (PARTITION BY {_SQL_LANG} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1 AND lang IS NOT NULL""")
def url_dedup(spark, d):
    p = Tables(spark, d).pages.withColumn("lang", F.get(X.url_segments(F.col("url")), 0))
    return E.first_by_key(p, "lang", "page_id", ["page_id", "url", "lang"])


@query("url_distinct", """
SELECT trim(regexp_extract(url, '://([^/:?#]*)', 1)) AS value, min(page_id) AS first_pos FROM pages
WHERE trim(regexp_extract(url, '://([^/:?#]*)', 1)) <> '' GROUP BY 1""")
def url_distinct(spark, d):
    p = Tables(spark, d).pages.withColumn("host", X.url_host(F.col("url")))
    return E.distinct_nonblank(p, "host", "page_id")


@query("json_flatten", """
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_flatten(spark, d):
    return E.flatten_json_object(Tables(spark, d).events, "props", "k int", ["event_id", "user_id"])


@query("search_flatten", """
SELECT page_id, coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title,
       coalesce(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '') AS snippet, url FROM pages""")
def search_flatten(spark, d):
    """Search replies as JSON derived from the pages, then flattened (E-1)."""
    p = Tables(spark, d).pages
    item = F.struct(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
                    F.regexp_extract("html", r'(?s)<div class="ad">(.*?)</div>', 1).alias("snippet"),
                    F.col("url").alias("link"))
    replies = p.select("page_id", F.to_json(F.struct(F.array(item).alias("organic_results"))).alias("reply"))
    return E.flatten_search_results(replies, "reply", ["page_id"])


@query("search_flatten_multi", """
SELECT page_id, title, snippet, url FROM (
  SELECT page_id, CAST(page_id AS VARCHAR) AS title, 'first' AS snippet, url FROM pages WHERE page_id % 3 < 2
  UNION ALL SELECT page_id, '', '', url || '#2' FROM pages WHERE page_id % 3 = 0)""")
def search_flatten_multi(spark, d):
    """Replies of two results, the second without title and snippet; of one; of none; and broken ones."""
    p = Tables(spark, d).pages
    first = F.struct(F.col("page_id").cast("string").alias("title"), F.lit("first").alias("snippet"), F.col("url").alias("link"))
    second = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("snippet"),
                      F.concat("url", F.lit("#2")).alias("link"))
    k = F.col("page_id") % 3
    reply = (F.when(k == 0, F.to_json(F.struct(F.array(first, second).alias("organic_results"))))
             .when(k == 1, F.to_json(F.struct(F.array(first).alias("organic_results"))))
             .when(F.col("page_id") % 2 == 0, F.lit('{"organic_results": []}')).otherwise(F.lit('{"organic')))
    return E.flatten_search_results(p.select("page_id", reply.alias("reply")), "reply", ["page_id"])


def _verdicts(spark, d):
    docs = Tables(spark, d).documents
    return E.rule_verdicts(docs, "text", ["doc_id", "lang", "source"], POLICY_TERMS, SUPPORT_TERMS, OPPOSE_TERMS,
                           place_suffix=LICENSE_SUFFIX)


def _terms(ts):
    return "\\b(" + "|".join(ts) + ")\\b"


_STATES_RE = "\\b(" + "|".join(sorted(set(K.STATE_ABBR_TO_FULL.values()), key=len, reverse=True)).replace(".", "\\.") + ")\\b"

_VERDICT_SQL = f"""v AS (SELECT doc_id, lang, source,
  nullif(regexp_extract(t, '{_sq(_STATES_RE)}', 1), '') AS mentioned_state,
  trim({_sql_names('t', LICENSE_SUFFIX)}[1]) AS mentioned_county,
  regexp_matches(t, '{_terms(POLICY_TERMS)}') AS is_data_center_policy,
  CASE WHEN len(regexp_extract_all(t, '{_terms(SUPPORT_TERMS)}', 1)) > len(regexp_extract_all(t, '{_terms(OPPOSE_TERMS)}', 1)) THEN 'true'
       WHEN len(regexp_extract_all(t, '{_terms(SUPPORT_TERMS)}', 1)) < len(regexp_extract_all(t, '{_terms(OPPOSE_TERMS)}', 1)) THEN 'false'
       ELSE 'neutral' END AS support_data_center_siting,
  nullif(regexp_extract(t, '{_terms(POLICY_TERMS)}', 1), '') AS policy_type,
  coalesce(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_terms(POLICY_TERMS)}'))[1], '') AS summary,
  least(len(regexp_extract_all(t, '{_terms(POLICY_TERMS)}', 1)) / 10.0, 1.0) AS llm_confidence,
  CAST(NULL AS VARCHAR) AS error
  FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents))"""


@query("verdict_rule", f"""WITH {_VERDICT_SQL}
SELECT doc_id, lang, source, mentioned_state, mentioned_county, is_data_center_policy, support_data_center_siting,
       policy_type, summary, round(llm_confidence, 6) AS llm_confidence, error FROM v""")
def verdict_rule(spark, d):
    v = _verdicts(spark, d)
    return v.withColumn("llm_confidence", _r("llm_confidence"))


@query("entity_signal", f"""WITH {_VERDICT_SQL},
w AS (SELECT {sql_state_full('upper(lang)')} AS mentioned_state,
             {sql_title("trim(source)")} || CASE WHEN {sql_title("trim(source)")} LIKE '% County' THEN '' ELSE ' County' END AS mentioned_county,
             CASE WHEN lower(trim(support_data_center_siting)) IN ('true','1','yes') THEN 1
                  WHEN lower(trim(support_data_center_siting)) IN ('false','0','no') THEN -1 ELSE 0 END AS dir
      FROM v WHERE is_data_center_policy AND trim(lang) <> '' AND trim(source) <> '')
SELECT mentioned_state, mentioned_county, 1 AS has_policy_signal, round(avg(dir), 6) AS policy_direction_score
FROM w GROUP BY ALL""")
def entity_signal(spark, d):
    v = _verdicts(spark, d).withColumn("mentioned_state", F.upper("lang")).withColumn("mentioned_county", F.col("source"))
    out = E.entity_signal(v)
    return out.withColumn("policy_direction_score", _r("policy_direction_score"))


@query("verdict_parse", """
SELECT event_id, CASE WHEN k IN (0, 1) THEN 'Ohio' END AS mentioned_state, CASE WHEN k IN (0, 1, 2) THEN event_type END AS mentioned_county,
       k IN (0, 1) AS is_data_center_policy,
       CASE k WHEN 0 THEN 'true' WHEN 1 THEN 'neutral' WHEN 3 THEN 'false' WHEN 4 THEN 'false' END AS support_data_center_siting,
       CASE WHEN k IN (0, 1) THEN 'zoning' END AS policy_type, CASE WHEN k = 0 THEN 'said ' || event_type ELSE '' END AS summary,
       CAST(CASE k WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 END AS DOUBLE) AS llm_confidence,
       CASE WHEN k IN (3, 4) THEN 'unparsable reply' END AS error
FROM (SELECT event_id, event_type, event_id % 6 AS k FROM events)""")
def verdict_parse(spark, d):
    """Replies made of the events: a full one, one with null summary and neutral siting, one of few keys, a broken one,
    none, and an object with other keys."""
    e = Tables(spark, d).events
    full = F.to_json(F.struct(F.lit("Ohio").alias("mentioned_state"), F.col("event_type").alias("mentioned_county"),
                              F.lit(True).alias("is_data_center_policy"), F.lit(True).alias("support_data_center_siting"),
                              F.lit("zoning").alias("policy_type"), F.concat(F.lit("said "), "event_type").alias("summary"),
                              F.lit(0.75).alias("llm_confidence")))
    null_summary = F.concat(F.lit('{"mentioned_state": "Ohio", "is_data_center_policy": "yes", "summary": null, "policy_type": "zoning", '
                                  '"support_data_center_siting": "Neutral", "llm_confidence": "0.5", "mentioned_county": "'),
                            "event_type", F.lit('"}'))
    few = F.to_json(F.struct(F.col("event_type").alias("mentioned_county"), F.lit(False).alias("is_data_center_policy")))
    k = F.col("event_id") % 6
    reply = (F.when(k == 0, full).when(k == 1, null_summary).when(k == 2, few).when(k == 3, F.substring(full, 1, 20))
             .when(k == 5, F.col("props")))
    return E.classify(e, lambda _: reply, ["event_id"])


@query("collect_resume", """
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)""")
def collect_resume(spark, d):
    T = Tables(spark, d)
    return E.pending_units(T.orders, T.events.select(F.col("user_id").alias("o_custkey")), "o_custkey")


@query("cards", """
SELECT s_suppkey, '/usa/n' || s_nationkey || '/m/' || s_suppkey AS href, s_name AS facility, 'Co & Sons ' || s_suppkey AS company,
       CAST(10000 + s_suppkey AS VARCHAR) || ' Main St' AS street,
       CASE WHEN s_suppkey % 3 < 2 THEN lpad(CAST(s_suppkey * 37 % 90000 AS VARCHAR), 5, '0') END AS zip,
       CASE WHEN s_suppkey % 3 < 2 THEN n_name END AS city
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT s_suppkey, '/usa/n' || s_nationkey || '/m/other', s_name, 'Other', '2 Side St', NULL, NULL FROM supplier""")
def cards(spark, d):
    """Listing pages made of the suppliers: both quote styles, equal names, 5-digit street numbers, suite lines, entities,
    repeated cards, cards of other paths, cards without a header."""
    T = Tables(spark, d)
    s = T.supplier.join(F.broadcast(T.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    href = F.concat(F.lit("/usa/n"), "s_nationkey", F.lit("/m/"), "s_suppkey")
    code = F.lpad((F.col("s_suppkey") * 37 % 90000).cast("string"), 5, "0")
    kind = F.col("s_suppkey") % 3
    place = (F.when(kind == 0, F.concat(F.lit("Suite 12345<br>"), code, F.lit("<br>SUITE 9<br>fl 2<br>"), "n_name"))
             .when(kind == 1, F.concat(F.lit("<span>"), code, F.lit("-1234</span><p>"), "n_name", F.lit("</p>")))
             .otherwise(F.concat(F.lit("zip "), code)))
    body = F.concat(F.lit("<div class='ui header'> "), "s_name", F.lit('</div><DIV CLASS="description">Co &amp; Sons '), "s_suppkey",
                    F.lit("<br/>"), (F.col("s_suppkey") + 10000).cast("string"), F.lit(" Main St<br>"), place, F.lit("</DIV></A>"))
    card = F.when(kind == 0, F.concat(F.lit('<a class="ui card" href="'), href, F.lit('">'), body)) \
        .otherwise(F.concat(F.lit("<A href='"), href, F.lit("' class='card'>"), body))
    other = F.concat(F.lit("<a href=/usa/n"), "s_nationkey", F.lit("/m/other class=card><b class=header>"), "s_name",
                     F.lit("</b><p class=description>Other<br>2 Side St</p></a>"))
    wrong = F.lit("<a class='card' href='/usa/x/m/1'><b class=header>No</b><p class=description>a<br>b</p></a>"
                  "<a class='discard' href='/usa/n1/m/2'><b class=header>No</b><p class=description>a<br>b</p></a>"
                  "<a class='card' href='/usa/n1/m/2/3'><b class=header>No</b></a>")
    pages = s.select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("state"), F.concat(wrong, card, other, card).alias("html"))
    return E.extract_cards(pages, "html", ["s_suppkey", "state"], ["usa", F.col("state"), "m"]).drop("state")


@query("cards_nested", """
SELECT s_suppkey, '/usa/n' || s_nationkey || '/m/' || s_suppkey AS href, s_name || '<' || n_name AS facility,
       'Co > ' || s_suppkey AS company, CAST(s_suppkey AS VARCHAR) || ' < Main St' AS street,
       lpad(CAST(s_suppkey * 37 % 90000 AS VARCHAR), 5, '0') AS zip, n_name AS city
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def cards_nested(spark, d):
    """Cards whose descriptions hold elements of their own name, anchors in anchors, markup in quoted values and comments,
    a bare ``<``, elements without content and unclosed ones."""
    T = Tables(spark, d)
    s = T.supplier.join(F.broadcast(T.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    key, code = F.col("s_suppkey").cast("string"), F.lpad((F.col("s_suppkey") * 37 % 90000).cast("string"), 5, "0")
    html = F.concat(
        F.lit("<!-- <a class='ui card' href='/usa/n1/m/0'> --><a title=\"a > b <a class='card'>\" class='ui card' href='/usa/n"), "s_nationkey", F.lit("/m/"), key,
        F.lit("'><img alt='</a>' class=header-like><div class=header><div title='>'>"), "s_name", F.lit("</div><b>&lt;"), "n_name",
        F.lit("</b></div><a href='/x'>inner</a><div class=\"x description\"><div><div>Co > "), key, F.lit("</div></div><div/><br><script>'</div>'</script><div>"),
        key, F.lit(" < Main St</div><p><i>"), code, F.lit("<hr><div class='</div>'>"), "n_name", F.lit("</div><b>unclosed</div>after</a> outside"))
    pages = s.select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("state"), html.alias("html"))
    return E.extract_cards(pages, "html", ["s_suppkey", "state"], ["usa", F.col("state"), "m"]).drop("state")


@query("html_markup", """
SELECT c_custkey, c_name || ' < ' || c_mktsegment || chr(10) || '1 <2 & <3' || chr(10) || c_mktsegment AS text FROM customer""")
def html_markup(spark, d):
    """Text of pages made of the customers, with a bare ``<``, quoted ``>``, markup in values, scripts and comments."""
    page = F.concat(F.lit("<!DOCTYPE html><style>p > a {}</style><p title='a > b'>"), "c_name", F.lit(" < "), "c_mktsegment",
                    F.lit("</p><!-- > <b>no</b> --><img alt=\"<p>no</p>\" src=x><script>if (a <b && c> d) '<!--'</script>1 <2 &amp; <3<br data-x='>' />"), "c_mktsegment",
                    F.lit("<noscript><p>no</p></noscript><?php no ?></ no>"))
    return E.html_pages_to_text(Tables(spark, d).customer.select("c_custkey", page.alias("html")), "html", ["c_custkey"])


@query("market_links", """
SELECT r_name AS state, lower(n_name) AS name, 'https://example.org/usa/' || r_name || '/' || lower(n_name) || '/' AS url
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def market_links(spark, d):
    """Links of index pages made of the regions' nations: absolute and relative, both quotes, repeated, too short, too deep, bad."""
    T = Tables(spark, d)
    j = T.nation.join(F.broadcast(T.region), F.col("n_regionkey") == F.col("r_regionkey"))
    at = F.concat(F.lit("/usa/"), "r_name", F.lit("/"), F.lower("n_name"))
    html = F.concat(F.lit("<A HREF='"), at, F.lit("/'>x</A><a class=b href=\"https://example.org"), at, F.lit("?q=1\">y</a><a href="), at,
                    F.lit("/deep>z</a><a href='/usa/"), "r_name", F.lit("/privacy'>p</a><a href='/usa/"), "r_name", F.lit("/'>s</a>"))
    pages = j.select(F.col("r_name").alias("state"), html.alias("html"))
    return E.path_links(pages, "html", ["state"], "https://example.org", ["usa", F.col("state")], 3,
                        ("quote", "contact", "about", "privacy", "terms"))


@query("rate_limit", f"""
SELECT page_id, CAST(len(regexp_extract_all(html, '{_sq(TX.HREF)}', 1)) AS INTEGER) AS n_links,
       contains(html, 'Page View Limit') AND len(regexp_extract_all(html, '{_sq(TX.HREF)}', 1)) = 0 AS rate_limited
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Page View Limit' WHEN 1 THEN 'Page View Limit ' || html ELSE html END AS html FROM pages)""")
def rate_limit(spark, d):
    """Pages, of which some show the marker in place of their links, and some besides them."""
    marker, k = F.lit("Page View Limit"), F.col("page_id") % 5
    p = Tables(spark, d).pages.withColumn("html", F.when(k == 0, marker).when(k == 1, F.concat_ws(" ", marker, "html")).otherwise(F.col("html")))
    n = F.size(TX.hrefs(F.col("html")))
    return p.select("page_id", n.alias("n_links"), E.rate_limited(p, "html", n).alias("rate_limited"))


# ---------------------------------------------------------------------------------------
# Scalar features (X-1…X-7, X-11, X-12, X-16)

@query("special_values", """
SELECT event_id, coalesce(TRY_CAST(replace(CASE WHEN trim(CAST(user_id AS VARCHAR)) = '7' THEN '5'
                                           WHEN trim(CAST(user_id AS VARCHAR)) = '8' THEN '1,234' ELSE trim(CAST(user_id AS VARCHAR)) END, ',', '') AS DOUBLE), 0) AS user_num
FROM events""")
def special_values(spark, d):
    e = Tables(spark, d).events
    v = X.special_values(F.col("user_id"), {"7": "5", "8": "1,234"})
    return e.select("event_id", X.number_or_zero(v).alias("user_num"))


_XFEAT = {"primary_large_airport_count": "l_quantity", "primary_medium_airport_count": "l_tax",
          "primary_small_airport_count": "l_discount"}


@query("row_sum", """
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) + coalesce(CASE WHEN l_discount <> 0 THEN l_discount END, 0) + coalesce(l_tax, 0), 6) AS total
FROM lineitem""")
def row_sum(spark, d):
    li = Tables(spark, d).lineitem
    disc = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", _r(X.row_sum(["l_quantity", disc, "l_tax"])).alias("total"))


@query("weighted_log", """
SELECT l_orderkey, l_linenumber,
       round(ln(1 + (5.0 * coalesce(l_quantity, 0) + 4.0 * coalesce(l_tax, 0) + 3.0 * coalesce(CASE WHEN l_discount <> 0 THEN l_discount END, 0))), 6) AS air_connectivity
FROM lineitem""")
def weighted_log(spark, d):
    li = Tables(spark, d).lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("primary_large_airport_count"),
        F.col("l_tax").alias("primary_medium_airport_count"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("primary_small_airport_count"))
    return li.select("l_orderkey", "l_linenumber", _r(X.weighted_log(list(_XFEAT))).alias("air_connectivity"))


@query("condition_index", """
SELECT o_custkey, round(CASE WHEN g + f + p > 0 THEN (g + 0.5 * f) / (g + f + p) END, 6) AS infrastructure_quality,
       CAST(p > 0 AS INTEGER) AS dock_presence, round(ln(1 + coalesce(f, 0)), 6) AS rail_intensity
FROM (SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS g,
             CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS f,
             CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS p FROM orders GROUP BY 1)""")
def condition_index(spark, d):
    o = Tables(spark, d).orders
    g = o.groupBy("o_custkey").agg(*[F.count(F.when(F.col("o_orderstatus") == s, 1)).cast("double").alias(n)
                                     for s, n in (("F", "g"), ("O", "f"), ("P", "p"))])
    return g.select("o_custkey", _r(X.condition_index("g", "f", "p")).alias("infrastructure_quality"),
                    X.presence_flag("p").alias("dock_presence"), _r(X.log1p_zero("f")).alias("rail_intensity"))


@query("presence_flag", """
SELECT event_id, CAST(coalesce(value, 0) > 0 AS INTEGER) AS has_value,
       CAST(coalesce(value > 20.0, false) AS INTEGER) AS value_above_floor,
       CASE WHEN lower(trim(event_type)) IN ('true','1','yes','purchase') THEN 1
            WHEN lower(trim(event_type)) IN ('false','0','no','error') THEN -1 ELSE 0 END AS direction
FROM events""")
def presence_flag(spark, d):
    e = Tables(spark, d).events
    et = F.when(F.col("event_type") == "purchase", F.lit("yes")).when(F.col("event_type") == "error", F.lit("no")) \
        .otherwise(F.col("event_type"))
    return e.select("event_id", X.presence_flag("value").alias("has_value"),
                    X.above_floor(F.col("value"), 20.0).alias("value_above_floor"),
                    X.tri_state(et).alias("direction"))


@query("zip_extract", """
SELECT page_id, nullif(regexp_extract(trim(lpad(CAST(page_id * 37 AS VARCHAR), 5, '9')), '^(\\d{5})(?:-\\d{4})?$', 1), '') AS zip
FROM pages""")
def zip_extract(spark, d):
    p = Tables(spark, d).pages
    code = F.lpad((F.col("page_id") * 37).cast("string"), 5, "9")
    return p.select("page_id", X.zip5(code).alias("zip"))
