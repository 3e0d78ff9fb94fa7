"""Registered queries over the driver's tables, each with a DuckDB oracle.

Mapping (grain analogy): part = fine grain (ZIP), nation = coarse grain
(county), the share of a part's quantity supplied from a nation = crosswalk
ratio.  Every query reads whole tables; doubles are rounded the same way on
both sides so the value hashes can match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.functions import keys as K
from regionscore.functions import scalar as X
from regionscore.operators import aggregate as A
from regionscore.operators import assemble as J
from regionscore.operators import crosswalk as C
from regionscore.operators import filters as FL
from regionscore.operators.quantile import exact_median
from regionscore.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _r(c, d: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


# SQL helpers mirroring the column expressions -------------------------------------------

def sql_pad(expr: str, n: int) -> str:
    s = f"trim(CAST({expr} AS VARCHAR))"
    return (f"(CASE WHEN length({s}) >= {n} THEN {s} "
            f"WHEN {s} LIKE '-%' THEN '-' || lpad(substr({s}, 2), {n - 1}, '0') "
            f"ELSE lpad({s}, {n}, '0') END)")


def sql_title(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda x: upper(x[1]) || x[2:]), '')")


def sql_state_map() -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in K.STATE_ABBR_TO_FULL.items())
    return "MAP {" + pairs + "}"


def sql_state_full(expr: str) -> str:
    s = f"trim({expr})"
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN '' "
            f"WHEN length({s}) = 2 THEN coalesce({sql_state_map()}[upper({s})], {sql_title(s)}) "
            f"ELSE {sql_title(s)} END)")


# ---------------------------------------------------------------------------------------
# Crosswalk allocation (J-5, A-4, A-5, A-6)

def _xwalk(T: Tables) -> DataFrame:
    li = T.lineitem.select("l_partkey", "l_suppkey", "l_quantity")
    sup = T.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation_key"))
    j = li.join(sup, on="l_suppkey").select(F.col("l_partkey").alias("part_key"), "nation_key", "l_quantity")
    return C.crosswalk_ratio(j, "part_key", "nation_key", "l_quantity")


_XWALK_SQL = """
pairs AS (SELECT l_partkey AS part_key, s_nationkey AS nation_key, sum(l_quantity) AS w
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
x AS (SELECT part_key, nation_key, w / sum(w) OVER (PARTITION BY part_key) AS ratio FROM pairs)"""


@query("xwalk_ratio", f"WITH {_XWALK_SQL} SELECT part_key, nation_key, round(ratio, 8) AS ratio FROM x")
def xwalk_ratio(spark, d):
    return _xwalk(Tables(spark, d)).withColumn("ratio", _r("ratio", 8))


def _part_measures(T: Tables) -> DataFrame:
    lines = A.count_by_key(T.lineitem.select(F.col("l_partkey").alias("part_key")), ["part_key"], "n_lines")
    part = T.part.select(F.col("p_partkey").alias("part_key"), "p_retailprice",
                         F.when(F.col("p_type") != "PROMO", F.col("p_size")).alias("p_size"))
    return part.join(lines, on="part_key", how="full_outer")


_MEASURES_SQL = """
lines AS (SELECT l_partkey AS part_key, count(*) AS n_lines FROM lineitem GROUP BY 1),
m AS (SELECT * FROM (SELECT p_partkey AS part_key, p_retailprice,
                            CASE WHEN p_type <> 'PROMO' THEN p_size END AS p_size FROM part)
      FULL OUTER JOIN lines USING (part_key))"""


@query("alloc_additive", f"""
WITH {_XWALK_SQL}, {_MEASURES_SQL}
SELECT nation_key, round(sum(coalesce(n_lines, 0) * coalesce(ratio, 0)), 6) AS n_lines
FROM x LEFT JOIN m USING (part_key) GROUP BY nation_key""")
def alloc_additive(spark, d):
    T = Tables(spark, d)
    out, _ = C.crosswalk_allocate(_part_measures(T), _xwalk(T), "part_key", "nation_key", "ratio",
                                  additive=["n_lines"])
    return out.select("nation_key", _r("n_lines").alias("n_lines"))


def _weighted_sql(mode: str) -> str:
    if mode == "any":
        w_price = w_size = "CASE WHEN p_retailprice IS NOT NULL OR p_size IS NOT NULL THEN coalesce(ratio, 0) ELSE 0 END"
    else:
        w_price = "CASE WHEN p_retailprice IS NOT NULL THEN coalesce(ratio, 0) ELSE 0 END"
        w_size = "CASE WHEN p_size IS NOT NULL THEN coalesce(ratio, 0) ELSE 0 END"
    return f"""
WITH {_XWALK_SQL}, {_MEASURES_SQL}
SELECT nation_key,
  round(sum(coalesce(p_retailprice, 0) * coalesce(ratio, 0)) / nullif(sum({w_price}), 0), 6) AS p_retailprice,
  round(sum(coalesce(p_size, 0) * coalesce(ratio, 0)) / nullif(sum({w_size}), 0), 6) AS p_size,
  round(sum(coalesce(n_lines, 0) * coalesce(ratio, 0)), 6) AS n_lines
FROM x LEFT JOIN m USING (part_key) GROUP BY nation_key"""


def _alloc_weighted(spark, d, mode):
    T = Tables(spark, d)
    out, _ = C.crosswalk_allocate(_part_measures(T), _xwalk(T), "part_key", "nation_key", "ratio",
                                  additive=["n_lines"], weighted=["p_retailprice", "p_size"], weight_mode=mode)
    return out.select("nation_key", *[_r(c).alias(c) for c in ("p_retailprice", "p_size", "n_lines")])


@query("alloc_weighted_any", _weighted_sql("any"))
def alloc_weighted_any(spark, d):
    return _alloc_weighted(spark, d, "any")


@query("alloc_weighted_percol", _weighted_sql("per_column"))
def alloc_weighted_percol(spark, d):
    return _alloc_weighted(spark, d, "per_column")


@query("alloc_unallocated", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def alloc_unallocated(spark, d):
    """Source rows with no crosswalk row: orders of customers outside the crosswalk."""
    T = Tables(spark, d)
    xw = T.customer.where(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation_key"), F.lit(1.0).alias("ratio"))
    _, unalloc = C.crosswalk_allocate(T.orders.select("o_orderkey", "o_custkey"), xw, "o_custkey",
                                      "nation_key", "ratio", additive=[])
    return unalloc.select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------------------------------
# Keys and names (P-4…P-7, P-10, P-13, J-7, X-8…X-10, N1, N7)

@query("key_normalise", f"""
SELECT c_custkey,
  {sql_pad('c_custkey', 5)} AS cust_code,
  {sql_pad("regexp_replace(trim(CAST(c_nationkey AS VARCHAR) || '.0'), '\\.0+$', '')", 3)} AS nation_code,
  {sql_pad('CAST(trunc(c_acctbal) AS BIGINT)', 6)} AS acct_code
FROM customer""")
def key_normalise(spark, d):
    c = Tables(spark, d).customer
    return c.select("c_custkey",
                    K.normalise_code("c_custkey", 5).alias("cust_code"),
                    K.normalise_code(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")), 3).alias("nation_code"),
                    K.pad_code(F.col("c_acctbal").cast("bigint"), 6).alias("acct_code"))


@query("combine_codes", f"""
SELECT n_nationkey,
  {sql_pad('n_regionkey', 2)} || {sql_pad('n_nationkey', 3)} AS place_code,
  concat_ws(' ', trim(r_name), trim(n_name)) AS place_label,
  n_name || '||' || r_name AS place_key,
  concat_ws(', ', n_name, r_name) AS display
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def combine_codes(spark, d):
    T = Tables(spark, d)
    j = T.nation.join(T.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey",
                    K.combine_codes(["n_regionkey", "n_nationkey"], [2, 3]).alias("place_code"),
                    K.combine_text(["r_name", "n_name"]).alias("place_label"),
                    K.composite_key("n_name", "r_name").alias("place_key"),
                    K.display_label("n_name", "r_name").alias("display"))


@query("state_lookup", f"""
SELECT n_nationkey,
  {sql_state_full('substr(r_name, 1, 2)')} AS region_state,
  {sql_state_full('n_name')} AS nation_state,
  {sql_title("regexp_replace(trim(r_name || ' Area, ' || n_name), ',\\s*[^,]+$', '')")} || ' County' AS county
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def state_lookup(spark, d):
    T = Tables(spark, d)
    j = T.nation.join(T.region, F.col("n_regionkey") == F.col("r_regionkey"))
    place = K.strip_place_suffix(F.concat("r_name", F.lit(" Area, "), "n_name"))
    return j.select("n_nationkey",
                    K.state_full_name(F.substring("r_name", 1, 2)).alias("region_state"),
                    K.state_full_name("n_name").alias("nation_state"),
                    K.county_form(place).alias("county"))


# ---------------------------------------------------------------------------------------
# Assembly (J-1…J-4, F-4)

def _nation_tables(T: Tables) -> dict[str, DataFrame]:
    mean_and_n = [F.avg("acctbal").alias("acctbal"), F.count(F.lit(1)).alias("n")]
    cust = (T.customer.select(F.col("c_nationkey").alias("nation_key"), F.col("c_acctbal").alias("acctbal"))
            .groupBy("nation_key").agg(*mean_and_n))
    # supplier codes are shifted by five, so that either side has keys the other lacks, and one code is blank
    sup = (T.supplier.select(F.when(F.col("s_nationkey") != 7, F.col("s_nationkey") + 5).alias("nation_key"),
                             F.col("s_acctbal").alias("acctbal"))
           .groupBy("nation_key").agg(*mean_and_n))
    urgent = (T.orders.where(F.col("o_orderpriority") == "1-URGENT")
              .join(T.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
              .where(F.col("o_totalprice") > 300000))
    ords = urgent.groupBy(F.col("c_nationkey").alias("nation_key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return {"customer": cust, "supplier": sup, "orders": ords}


_NATION_SQL = """
cust AS (SELECT c_nationkey AS nation_key, avg(c_acctbal) AS acctbal, count(*) AS n FROM customer GROUP BY 1),
sup AS (SELECT s_nationkey + 5 AS nation_key, avg(s_acctbal) AS acctbal_supplier, count(*) AS n_supplier FROM supplier
        WHERE s_nationkey <> 7 GROUP BY 1),
ords AS (SELECT c_nationkey AS nation_key, count(*) AS n_orders, sum(o_totalprice) AS total
         FROM orders JOIN customer ON o_custkey = c_custkey
         WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 GROUP BY 1)"""


@query("assemble_outer", f"""
WITH {_NATION_SQL}
SELECT nation_key, round(acctbal, 6) AS acctbal, n, round(acctbal_supplier, 6) AS acctbal_supplier,
       n_supplier, n_orders, round(total, 6) AS total
FROM cust FULL OUTER JOIN sup USING (nation_key) FULL OUTER JOIN ords USING (nation_key)""")
def assemble_outer(spark, d):
    tabs = _nation_tables(Tables(spark, d))
    kept = {k: J.drop_blank_keys(v, ["nation_key"])[0] for k, v in tabs.items()}
    out = J.outer_assemble(kept, "nation_key")
    return out.select("nation_key", _r("acctbal").alias("acctbal"), "n",
                      _r("acctbal_supplier").alias("acctbal_supplier"), "n_supplier",
                      F.col("n_orders"), _r("total").alias("total"))


@query("assemble_composite", """
WITH a AS (SELECT n_regionkey AS region_key, c_nationkey AS nation_key, count(*) AS n_cust
           FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
b AS (SELECT n_regionkey AS region_key, s_nationkey AS nation_key, count(*) AS n_sup
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
c AS (SELECT c_nationkey AS nation_key, count(*) AS n_ord
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT region_key, nation_key, n_cust, n_sup, n_ord
FROM a FULL OUTER JOIN b USING (region_key, nation_key) FULL OUTER JOIN c USING (nation_key)""")
def assemble_composite(spark, d):
    T = Tables(spark, d)
    nat = T.nation.select("n_nationkey", "n_regionkey")
    a = (T.customer.join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
         .groupBy(F.col("n_regionkey").alias("region_key"), F.col("c_nationkey").alias("nation_key"))
         .agg(F.count(F.lit(1)).alias("n_cust")))
    b = (T.supplier.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
         .groupBy(F.col("n_regionkey").alias("s_region"), F.col("s_nationkey").alias("s_nation"))
         .agg(F.count(F.lit(1)).alias("n_sup"))
         .withColumnsRenamed({"s_region": "region_key", "s_nation": "nation_key"}))
    c = (T.orders.where(F.col("o_orderstatus") == "P")
         .join(T.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
         .groupBy(F.col("c_nationkey").alias("nation_key")).agg(F.count(F.lit(1)).alias("n_ord")))
    return J.outer_assemble({"a": a, "b": b, "c": c}, ["region_key", "nation_key"])


# ---------------------------------------------------------------------------------------
# Union and grouped aggregates (U-1, A-1…A-3)

def _parties(T: Tables) -> DataFrame:
    c = T.customer.select(F.col("c_custkey").alias("party_key"), F.col("c_nationkey").alias("nation_key"),
                          F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = T.supplier.select(F.col("s_suppkey").alias("party_key"), F.col("s_nationkey").alias("nation_key"),
                          F.col("s_acctbal").alias("acctbal"))
    return A.union_sources([c, s], "source", ["customer", "supplier"])


_PARTIES_SQL = """
parties AS (SELECT c_custkey AS party_key, c_nationkey AS nation_key, c_acctbal AS acctbal,
                   c_mktsegment AS segment, 'customer' AS source FROM customer
            UNION ALL BY NAME
            SELECT s_suppkey AS party_key, s_nationkey AS nation_key, s_acctbal AS acctbal,
                   'supplier' AS source FROM supplier)"""


@query("union_sources", f"WITH {_PARTIES_SQL} SELECT party_key, nation_key, acctbal, segment, source FROM parties")
def union_sources(spark, d):
    return _parties(Tables(spark, d)).select("party_key", "nation_key", "acctbal", "segment", "source")


@query("mean_by_key", f"""WITH {_PARTIES_SQL}
SELECT nation_key, source, round(avg(acctbal), 6) AS acctbal FROM parties GROUP BY ALL""")
def mean_by_key(spark, d):
    out = A.mean_by_key(_parties(Tables(spark, d)), ["nation_key", "source"], ["acctbal"])
    return out.select("nation_key", "source", _r("acctbal").alias("acctbal"))


@query("count_by_key", f"""WITH {_PARTIES_SQL}
SELECT nation_key, source, count(*) AS n FROM parties GROUP BY ALL""")
def count_by_key(spark, d):
    return A.count_by_key(_parties(Tables(spark, d)), ["nation_key", "source"], "n")


@query("agg_median", f"""WITH {_PARTIES_SQL}
SELECT nation_key, round(median(acctbal), 6) AS acctbal FROM parties GROUP BY ALL""")
def agg_median(spark, d):
    out = exact_median(_parties(Tables(spark, d)), ["nation_key"], "acctbal")
    return out.select("nation_key", _r("acctbal").alias("acctbal"))


@query("agg_median_global", """
SELECT round(median(l_extendedprice), 6) AS median_price, round(quantile_cont(l_quantity, 0.9), 6) AS q90_qty
FROM lineitem""")
def agg_median_global(spark, d):
    from regionscore.operators.quantile import exact_quantiles
    li = Tables(spark, d).lineitem
    a = exact_quantiles(li, [], "l_extendedprice", {"median_price": 0.5})
    b = exact_quantiles(li, [], "l_quantity", {"q90_qty": 0.9})
    return a.crossJoin(F.broadcast(b)).select(_r("median_price").alias("median_price"), _r("q90_qty").alias("q90_qty"))


# ---------------------------------------------------------------------------------------
# Pivots (A-8, A-9)

@query("pivot_single", """
SELECT l_orderkey,
  min(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a,
  min(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n,
  min(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r
FROM lineitem GROUP BY l_orderkey""")
def pivot_single(spark, d):
    li = Tables(spark, d).lineitem
    return A.pivot_first(li, ["l_orderkey"], "l_returnflag", ["A", "N", "R"], "l_quantity",
                         names={"A": "qty_a", "N": "qty_n", "R": "qty_r"})


@query("pivot_multi", """
SELECT l_partkey,
  min(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS l_discount_O,
  min(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS l_tax_O,
  min(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS l_discount_F,
  min(CASE WHEN l_linestatus = 'F' THEN l_tax END) AS l_tax_F
FROM lineitem GROUP BY l_partkey""")
def pivot_multi(spark, d):
    li = Tables(spark, d).lineitem
    return A.pivot_first(li, ["l_partkey"], "l_linestatus", ["O", "F"], ["l_discount", "l_tax"])


# ---------------------------------------------------------------------------------------
# Filters (F-1…F-3, F-5, F-6)

@query("spec_filter", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '2-HIGH'""")
def spec_filter(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return FL.spec_filter(o, {"o_orderstatus": ["F", "P"], " o_orderpriority ": "2-HIGH", "absent_col": 1}, strict=False)


@query("post_filter", f"""
SELECT n_nationkey, n_name FROM nation
WHERE {sql_pad('n_regionkey', 3)} = '002' AND NOT ((CAST(n_nationkey AS VARCHAR) || '0') LIKE '%20')""")
def post_filter(spark, d):
    n = Tables(spark, d).nation
    n = FL.padded_equals(n, {"n_regionkey": ("2", 3)})
    n = n.withColumn("_code", F.concat(F.col("n_nationkey").cast("string"), F.lit("0")))
    return FL.not_ending_with(n, "_code", "20").select("n_nationkey", "n_name")


@query("anti_list", """
SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE trim(r_name) NOT IN ('ASIA', 'MIDDLE EAST')""")
def anti_list(spark, d):
    T = Tables(spark, d)
    j = T.nation.join(T.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return FL.exclude_values(j, "r_name", ["ASIA", "MIDDLE EAST"]).select("n_nationkey", "n_name", "r_name")
