"""Spec-compiler and source/sink queries: raw-looking tables derived from the
driver's tables (messy headers, thousands commas, suppressed tokens) go through
``compile_spec`` or a CSV round trip through the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from regionscore.plans.catalog import _r, query, sql_pad
from regionscore.plans.spec import TableSpec, compile_spec
from regionscore.session import checkpoint_dir
from regionscore.sources import readers as RD
from regionscore.sources.tables import Tables

LINE_SPEC = TableSpec(
    keys={"order_key": "Order Key"},
    value_columns={"qty": "Quantity", "price": "Extended Price", "disc": "Discount"},
    filters={"Line Status": "F"},
    special_values={"Quantity": {"50.0": "49.5"}},
    dtypes={"order_key": "string", "qty": "float64", "price": "float64", "disc": "float64"},
    pad={"order_key": 8},
    aggregation={"by": ["order_key"], "method": "mean"},
    proxies={"gross": {"kind": "row_sum", "columns": ["qty", "price"]},
             "has_disc": {"kind": "presence", "columns": ["disc"]}},
    drop_inputs="used",
)


def raw_lines(spark, d):
    """lineitem as a raw export: spaced / broken headers, prices with thousands commas."""
    li = Tables(spark, d).lineitem
    return li.select(F.col("l_orderkey").cast("string").alias("Order\nKey"),
                     F.col("l_linestatus").alias("Line  Status"),
                     F.col("l_quantity").cast("string").alias("Quantity"),
                     F.format_number("l_extendedprice", 2).alias("Extended Price"),
                     F.col("l_discount").cast("string").alias(" Discount "))


@query("spec_compile", f"""
SELECT order_key, round(coalesce(qty, 0) + coalesce(price, 0), 6) AS gross,
       CAST(coalesce(disc, 0) > 0 AS INTEGER) AS has_disc FROM (
  SELECT {sql_pad('l_orderkey', 8)} AS order_key, avg(CASE WHEN l_quantity = 50 THEN 49.5 ELSE l_quantity END) AS qty,
         avg(round(l_extendedprice, 2)) AS price, avg(l_discount) AS disc
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)""")
def spec_compile(spark, d):
    out = compile_spec(LINE_SPEC)(raw_lines(spark, d))
    return out.select("order_key", _r("gross").alias("gross"), "has_disc")


NATION_SPEC = TableSpec(
    keys={"nation_key": "Nation Key", "region_key": "Region Key"},
    value_columns={"name": "Nation Name", "place": "Place"},
    combine_columns={"Place": {"columns": ["Region Name", "Nation Name 2"], "method": "concat", "sep": " "}},
    normalize={"Place": "title"},
    dtypes={"nation_key": "int64", "region_key": "int64", "name": "string", "place": "string"},
    post_filters={"exclude": {"name": ["NATION_3"]}},
)


@query("csv_roundtrip", """
SELECT CAST(n_nationkey AS BIGINT) AS nation_key, CAST(n_regionkey AS BIGINT) AS region_key, n_name AS name,
       array_to_string(list_transform(regexp_extract_all(lower(r_name || ' ' || n_name), '(\\p{L}+|[^\\p{L}]+)'),
                       lambda x: upper(x[1]) || x[2:]), '') AS place
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_3'""")
def csv_roundtrip(spark, d):
    """Export a joined table as CSV to the shared folder, read it back with declared
    string columns, and clean it with a spec (S-1, S-3, S-9, P-6, K-1)."""
    T = Tables(spark, d)
    j = T.nation.join(T.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("Nation  Key"), F.col("n_regionkey").alias("Region   Key"),
        F.col("n_name").alias("Nation Name"), F.col("r_name").alias("Region Name"),
        F.col("n_name").alias("Nation Name 2"))
    path = os.path.join(checkpoint_dir(spark), f"export-{uuid.uuid4().hex[:12]}")
    RD.export_csv(j, path)
    raw = RD.read_csv(spark, path)
    return compile_spec(NATION_SPEC)(raw).select("nation_key", "region_key", "name", "place")
