"""Filters, look-ups and sinks over the driver tables, with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regionscore.operators import evidence as E
from regionscore.operators import filters as FL
from regionscore.plans.catalog import _r, query
from regionscore.plans.catalog_rank import _FIXED_SQL, _fixed_scores
from regionscore.session import checkpoint_dir
from regionscore.sources import readers as RD
from regionscore.sources.tables import Tables


def _path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("result_filters", f"""WITH {_FIXED_SQL}
SELECT c_custkey, c_nationkey, y, round(p_presence, 6) AS p_presence FROM fx
WHERE y > 0 AND p_presence >= 0.5 AND c_nationkey IN (1, 2, 3, 5, 8)
UNION ALL SELECT c_custkey, c_nationkey, y, round(p_presence, 6) FROM fx WHERE y = 0 AND p_presence >= 0.9""")
def result_filters(spark, d):
    """The dashboard's filters: active rows of some nations, and inactive rows of high probability (F-9)."""
    s = _fixed_scores(spark, d).select("c_custkey", "c_nationkey", "y", "p_presence")
    active = FL.result_filter(s, "y", "positive", "p_presence", 0.5, ("c_nationkey", [1, 2, 3, 5, 8]))
    idle = FL.result_filter(s, "y", "zero", "p_presence", 0.9)
    return active.unionByName(idle).withColumn("p_presence", _r("p_presence"))


@query("point_lookup", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    """One row by its key (F-10); the predicate reaches the scan."""
    return FL.point_lookup(Tables(spark, d).customer, {"c_custkey": 7}).select("c_custkey", "c_name", "c_nationkey")


@query("drop_names", "SELECT * EXCLUDE (o_orderpriority, o_totalprice) FROM orders")
def drop_names(spark, d):
    """Columns dropped by a set of names, of which some are absent (P-8)."""
    return FL.drop_names(Tables(spark, d).orders, {"o_orderpriority", "o_totalprice", "no_such_column"})


@query("invalid_codes", """
SELECT event_id, code, CASE WHEN code IS NULL OR trim(code) = '' OR contains(lower(code), 'nan') THEN 1 ELSE 0 END AS is_invalid
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '00NaN' ELSE CAST(user_id AS VARCHAR) END AS code FROM events)""")
def invalid_codes(spark, d):
    """Blank codes and codes made of a missing number (F-5)."""
    k = F.col("event_id") % 5
    e = Tables(spark, d).events.select("event_id", F.when(k == 0, None).when(k == 1, "  ").when(k == 2, "00NaN")
                                       .otherwise(F.col("user_id").cast("string")).alias("code"))
    return e.withColumn("is_invalid", FL.invalid_code("code").cast("int"))


@query("truthy_rows", """
SELECT event_id, mark FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' TRUE ' WHEN 1 THEN '1' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' WHEN 4 THEN 'maybe' END AS mark FROM events)
WHERE lower(trim(mark)) IN ('true', '1', 'yes')""")
def truthy_rows(spark, d):
    """Rows kept by a mark that says yes in any of its spellings (F-7)."""
    k = F.col("event_id") % 6
    mark = F.when(k == 0, " TRUE ").when(k == 1, "1").when(k == 2, "yes").when(k == 3, "no").when(k == 4, "maybe")
    return FL.keep_truthy(Tables(spark, d).events.select("event_id", mark.alias("mark")), "mark")


@query("frequency_export", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def frequency_export(spark, d):
    """A frequency table written as CSV, most common first, and read again (K-2)."""
    path = _path(spark, "counts")
    RD.write_counts(Tables(spark, d).orders, "o_orderpriority", path)
    return RD.read_csv(spark, path, columns=["o_orderpriority", "count"]).withColumn("count", F.col("count").cast("long"))


@query("json_export", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_export(spark, d):
    """Records written as JSON lines and as a Parquet stage, each read again; both must agree (K-1, K-3)."""
    n = Tables(spark, d).nation.select("n_nationkey", "n_name", "n_regionkey")
    path, stage = _path(spark, "json"), _path(spark, "stage")
    RD.export_json(n, path)
    RD.write_stage(n, stage)
    return spark.read.schema(n.schema).json(path).intersect(spark.read.parquet(stage))


@query("collect_units", """
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 2""")
def collect_units(spark, d):
    """Units of work done in two parts, one of them twice: a retry replaces its part, and what is left is pending (E-10)."""
    o = Tables(spark, d).orders.select("o_custkey")
    path = _path(spark, "done")
    for unit in (0, 1, 1):
        E.write_done(o.where(F.col("o_custkey") % 3 == unit).distinct(), path, str(unit))
    return E.pending_units(o, spark.read.parquet(path), "o_custkey")


@query("query_list", "SELECT DISTINCT n_name || ' policy' AS query FROM nation")
def query_list(spark, d):
    """A list of queries, one a line with blanks between, read from a text file (S-8)."""
    path = _path(spark, "queries")
    n = Tables(spark, d).nation
    lines = n.select(F.concat(F.lit("  "), "n_name", F.lit(" policy ")).alias("value")).union(n.select(F.lit("   ")))
    lines.write.text(path)
    return E.search_queries(spark, path).select("query")
