"""Text-evidence operators (E-1…E-11, U-2…U-4, A-26, K-2).

Network fetching and the chat-model call of the source pipeline are not
built; their inputs enter as tables (search results as JSON, pages as HTML)
and their contract — one verdict row per document, a default row on failure —
is kept.  Everything below is column expressions plus ``explode`` /
``groupBy``; hot keys are pre-aggregated map-side (``min`` of a struct for
first-wins dedup, ``count`` for frequencies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.functions import keys as K
from regionscore.functions import scalar as X
from regionscore.functions import text as TX

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
VERDICT_KEYS = ["mentioned_state", "mentioned_county", "is_data_center_policy", "support_data_center_siting",
                "policy_type", "summary", "llm_confidence"]
RATE_LIMIT_MARKER = "Page View Limit"
# ---------------------------------------------------------------------------

VERDICT_SCHEMA = T.StructType([
    T.StructField("mentioned_state", T.StringType()),
    T.StructField("mentioned_county", T.StringType()),
    T.StructField("is_data_center_policy", T.BooleanType()),
    T.StructField("support_data_center_siting", T.StringType()),
    T.StructField("policy_type", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("llm_confidence", T.DoubleType()),
])

SEARCH_SCHEMA = T.StructType([T.StructField("organic_results", T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()), T.StructField("snippet", T.StringType()),
    T.StructField("link", T.StringType())])))])


def flatten_search_results(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """JSON search reply -> one row per organic result (title, snippet, url); missing -> ''."""
    keep = keep or []
    parsed = df.select(*keep, F.from_json(json_col, SEARCH_SCHEMA).alias("_r"))
    ex = parsed.select(*keep, F.explode_outer("_r.organic_results").alias("_o")).where(F.col("_o").isNotNull())
    return ex.select(*keep, F.coalesce("_o.title", F.lit("")).alias("title"),
                     F.coalesce("_o.snippet", F.lit("")).alias("snippet"),
                     F.coalesce("_o.link", F.lit("")).alias("url"))


def flatten_json_object(df: DataFrame, json_col: str, schema: T.StructType | str, keep: list[str]) -> DataFrame:
    """JSON object column -> its fields as columns (PERMISSIVE: bad JSON gives nulls)."""
    return df.select(*keep, F.from_json(json_col, schema, {"mode": "PERMISSIVE"}).alias("_j")).select(*keep, "_j.*")


def evidence_rows(df: DataFrame, text: Column, keep: list[str], suffix: str = TX.DEFAULT_SUFFIX,
                  name_col: str = "county") -> DataFrame:
    """One row per distinct place name found in ``text`` (title + ' ' + snippet)."""
    return df.select(F.explode(TX.place_names(text, suffix)).alias(name_col), *keep)


def name_counts(rows: DataFrame, name_col: str = "county") -> DataFrame:
    """Frequency of each name, most common first (ties by name)."""
    return rows.groupBy(name_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name_col)


def distinct_nonblank(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Trimmed, non-blank distinct values with the position of their first occurrence."""
    v = F.trim(F.col(col).cast("string"))
    return (df.select(v.alias("value"), F.col(order_col).alias("_pos")).where(F.col("value") != "")
            .groupBy("value").agg(F.min("_pos").alias("first_pos")))


def first_by_key(df: DataFrame, key: Column | str, order_col: str, cols: list[str]) -> DataFrame:
    """First-wins dedup: per key the row with the smallest ``order_col``.

    ``min(struct(order, ...))`` is a partial aggregate, so a key with a third of
    all rows is reduced inside every task before the shuffle (a window would
    sort that key's rows in one task).
    """
    k = F.col(key) if isinstance(key, str) else key
    packed = F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in cols if c != order_col])
    out = df.where(k.isNotNull()).groupBy(k.alias("_key")).agg(F.min(packed).alias("_first"))
    return out.select(F.col("_first._o").alias(order_col), *[F.col(f"_first.{c}") for c in cols if c != order_col])


def html_pages_to_text(df: DataFrame, html: str, keep: list[str], max_chars: int | None = None) -> DataFrame:
    return df.select(*keep, TX.html_to_text(F.col(html), max_chars).alias("text"))


def page_links(df: DataFrame, html: str, keep: list[str], prefix: str | None = None) -> DataFrame:
    """(keep..., href, path, depth) for every anchor; optional path-prefix check."""
    ex = df.select(*keep, F.explode(TX.hrefs(F.col(html))).alias("href"))
    ex = ex.withColumn("path", X.url_path(F.col("href"))).withColumn("depth", F.size(X.url_segments(F.col("href"))))
    if prefix is not None:
        ex = ex.where(F.col("path").startswith(prefix))
    return ex


def path_links(df: DataFrame, html: str, keep: list[str], base: str, segments: list, depth: int,
               bad: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (keep..., name, url) of the links one level below ``segments``, sorted: the path of a relative or
    absolute href has ``depth`` segments, begins with ``segments`` (strings or columns), and its last segment, the
    name, is not in ``bad``; the url is absolute."""
    parts = X.url_segments(F.col("href"))
    ok = F.size(parts) == depth
    for i, s in enumerate(segments):
        ok = ok & (F.get(parts, F.lit(i)) == (F.lit(s) if isinstance(s, str) else s))
    name = F.get(parts, F.lit(depth - 1))
    links = df.withColumn("href", F.explode(TX.hrefs(F.col(html)))).withColumn("href", F.trim("href"))
    out = links.where(ok & ~name.isin(list(bad)) if bad else ok)
    url = F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(parts, "/"), F.lit("/"))
    return out.select(*keep, name.alias("name"), url.alias("url")).distinct().orderBy(*keep, "name")


def extract_cards(df: DataFrame, html: str, keep: list[str], segments: list) -> DataFrame:
    """Cards of listing pages: anchors of class ``card`` whose href has one segment below ``segments``.

    An element ends at its own end tag, with elements of its name nested in it, or with the card. A card counts once per (keep..., href), at its first place, if it has a header and a description of two lines
    or more: facility is the header, company and street the first two lines, zip the first later line that is a
    5-digit or ZIP+4 code as a whole, city the first line after it that is no suite or floor.
    """
    pages = df.select(*keep, TX.markup_tokens(html).alias("_tokens"), F.array(*[F.lit(s) if isinstance(s, str) else s for s in segments]).alias("_segments"))
    pages = pages.withColumn("_events", TX.tag_events("_tokens"))
    anchors = F.filter(F.sequence(F.lit(0), F.size("_tokens") - 1),
                       lambda i: (F.get("_events", i) == "a") & TX.has_class(F.get("_tokens", i), "card"))
    cards = pages.where(F.size("_tokens") > 0).withColumn("_at", F.explode(anchors))
    cards = cards.withColumn("href", F.trim(TX.attribute(F.get("_tokens", F.col("_at")), "href")))
    parts = F.filter(F.split("href", "/"), lambda s: s != "")
    cards = cards.where((F.size(parts) == F.size("_segments") + 1)
                        & (F.slice(parts, F.lit(1), F.size("_segments")) == F.col("_segments")))
    cards = cards.withColumn("_card", TX.inner_html(F.col("_tokens"), F.col("_events"), F.col("_at"))).drop("_tokens", "_events")
    cards = TX.with_element_of_class(TX.with_element_of_class(cards, "_card", "header", "_header"), "_card", "description", "_description")
    cards = (cards.withColumn("facility", F.array_join(TX.text_nodes("_header"), "")).withColumn("_l", TX.text_nodes("_description"))
             .withColumn("_zip", F.array_position(F.transform("_l", lambda s, i: (i >= 2) & s.rlike(r"^\d{5}(?:-\d{4})?$")), True)))
    later = F.filter(F.slice("_l", F.col("_zip").cast("int") + 1, F.size("_l")), lambda s: ~s.rlike(r"(?i)^(suite|ste|unit|floor|fl)\b"))
    found = F.col("_zip") > 0
    values = F.struct("_at", "facility", F.get("_l", F.lit(0)).alias("company"), F.get("_l", F.lit(1)).alias("street"),
                      F.when(found, F.substring(F.get("_l", F.col("_zip").cast("int") - 1), 1, 5)).alias("zip"),
                      F.when(found, F.get(later, F.lit(0))).alias("city"), F.size("_l").alias("_n"))
    first = cards.withColumn("_v", values).groupBy(*keep, "href").agg(F.min("_v").alias("_v"))
    return first.where("_v.facility <> '' AND _v._n >= 2").select(
        *keep, "href", *[f"_v.{c}" for c in ("facility", "company", "street", "zip", "city")])


def rate_limited(df: DataFrame, html: str, n_found: Column, marker: str = RATE_LIMIT_MARKER) -> Column:
    """True when the page shows the rate-limit marker and nothing was extracted."""
    return F.coalesce(F.col(html).contains(marker), F.lit(False)) & (n_found == 0)


def _terms_re(terms: list[str], ignore_case: bool) -> str:
    return ("(?i)" if ignore_case else "") + "\\b(" + "|".join(terms) + ")\\b"


def rule_verdicts(df: DataFrame, text: str, keep: list[str], policy_terms: list[str], support_terms: list[str],
                  oppose_terms: list[str], place_suffix: str = TX.DEFAULT_SUFFIX, ignore_case: bool = False) -> DataFrame:
    """Deterministic verdict scorer with the 7-key contract (+ ``error`` null).

    is_data_center_policy: any policy term; support: 'true' / 'false' /
    'neutral' by comparing support and oppose term counts; mentioned county:
    first place name; mentioned state: first full state name in the text;
    summary: the line that holds the first policy term, uncut ('' without one);
    confidence: matched policy terms / 10, capped at 1.
    """
    kinds = {"p": policy_terms, "s": support_terms, "o": oppose_terms}
    # one pass over the text finds all terms; the rest works on the few that it found
    every = sorted({t for ts in kinds.values() for t in ts}, key=len, reverse=True)
    terms = "|".join(every)
    hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_terms_re([terms], ignore_case)), 1)
    d = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_hits", hits)
    norm = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    of = lambda k: F.filter("_hits", lambda x: norm(x).isin([t.lower() if ignore_case else t for t in kinds[k]]))
    d = d.withColumn("_p", of("p")).withColumn("_s", F.size(of("s"))).withColumn("_o", F.size(of("o")))
    states = "|".join(sorted(set(K.STATE_ABBR_TO_FULL.values()), key=len, reverse=True))
    state = F.regexp_extract("_t", "\\b(?=[A-Z])(" + states.replace(".", "\\.") + ")\\b", 1)
    policy = F.size("_p") > 0
    line = F.get(F.filter(F.split("_t", "\n"), lambda x: x.rlike(_terms_re(policy_terms, ignore_case))), F.lit(0))
    return d.select(
        *keep,
        F.nullif(state, F.lit("")).alias("mentioned_state"),
        F.get(TX.place_names(F.col("_t"), place_suffix), 0).alias("mentioned_county"),
        policy.alias("is_data_center_policy"),
        F.when(F.col("_s") > F.col("_o"), F.lit("true")).when(F.col("_s") < F.col("_o"), F.lit("false"))
        .otherwise(F.lit("neutral")).alias("support_data_center_siting"),
        F.get("_p", F.lit(0)).alias("policy_type"),
        F.when(policy, F.coalesce(line, F.lit(""))).otherwise(F.lit("")).alias("summary"),
        F.least(F.size("_p") / F.lit(10.0), F.lit(1.0)).alias("llm_confidence"),
        F.lit(None).cast("string").alias("error"))


def classify(df: DataFrame, scorer, keep: list[str]) -> DataFrame:
    """Verdicts of any scorer: ``scorer(df)`` gives a JSON reply column, whose contract ``parse_verdicts`` holds.

    ``scorer`` is a function from a DataFrame to a Column (a model behind a Pandas UDF, a rule, a stored reply).
    """
    return parse_verdicts(df.withColumn("_reply", scorer(df)), "_reply", keep)


def parse_verdicts(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """Model replies as JSON -> verdict columns.

    A reply that parses as a JSON object keeps every field it has: absent or null ones stay null, but for
    is_data_center_policy (false) and summary (''). Only a null reply or one that does not parse becomes the
    default row (not policy, siting false, confidence 0) with an error.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in VERDICT_SCHEMA] + [T.StructField("_bad", T.StringType())])
    p = df.select(*keep, F.col(json_col).alias("_raw"),
                  F.from_json(F.col(json_col), text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_v"))
    ok = F.coalesce(F.trim("_raw").startswith("{") & F.col("_v").isNotNull() & F.col("_v._bad").isNull(), F.lit(False))
    p = p.withColumn("_ok", ok)
    plain = lambda c: F.when(F.col("_ok"), F.col(f"_v.{c}"))
    return p.select(
        *keep, plain("mentioned_state").alias("mentioned_state"), plain("mentioned_county").alias("mentioned_county"),
        F.when(F.col("_ok"), F.coalesce(X.is_truthy(F.col("_v.is_data_center_policy")), F.lit(False))).otherwise(F.lit(False))
        .alias("is_data_center_policy"),
        F.when(F.col("_ok"), F.lower("_v.support_data_center_siting")).otherwise(F.lit("false")).alias("support_data_center_siting"),
        plain("policy_type").alias("policy_type"),
        F.when(F.col("_ok"), F.coalesce("_v.summary", F.lit(""))).otherwise(F.lit("")).alias("summary"),
        F.when(F.col("_ok"), F.col("_v.llm_confidence").try_cast("double")).otherwise(F.lit(0.0)).alias("llm_confidence"),
        F.when(~F.col("_ok"), F.lit("unparsable reply")).alias("error"))


def entity_signal(verdicts: DataFrame, state: str = "mentioned_state", county: str = "mentioned_county",
                  policy: str = "is_data_center_policy", support: str = "support_data_center_siting") -> DataFrame:
    """Verdicts -> (state, county, has_policy_signal=1, policy_direction_score=mean of −1/0/1).

    Blank state/county dropped; state to full name; county to 'Name County';
    only truthy policy rows kept.
    """
    v = verdicts.where(~K.is_blank_key(state) & ~K.is_blank_key(county))
    v = v.where(X.is_truthy(policy))
    v = v.select(K.state_full_name(state).alias(state), K.county_form(county).alias(county),
                 X.tri_state(support).alias("_dir"))
    return (v.groupBy(state, county).agg(F.avg("_dir").alias("policy_direction_score"))
            .withColumn("has_policy_signal", F.lit(1))
            .select(state, county, "has_policy_signal", "policy_direction_score"))


def pending_units(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resumable collection: units whose key is not yet in the done set (anti join)."""
    return units.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key), key, "left_anti")


def write_done(df: DataFrame, path: str, unit: str, fmt: str = "parquet") -> None:
    """Persist a finished unit of work in a folder of its own, so that a rerun skips it and a retry replaces it."""
    df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/unit={unit}")


def search_queries(spark, path: str) -> DataFrame:
    """Query list file: one query per line, trimmed, blank lines skipped (S-8)."""
    return (spark.read.text(path).select(F.trim("value").alias("query"), F.monotonically_increasing_id().alias("seq"))
            .where(F.col("query") != ""))
