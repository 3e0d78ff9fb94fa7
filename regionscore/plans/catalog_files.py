"""File readers over the driver's tables: each query exports a whole table to the
shared folder in an awkward form and reads it back in splits."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.plans.catalog import query
from regionscore.session import checkpoint_dir
from regionscore.sources import readers as RD
from regionscore.sources.split_records import read_json_object
from regionscore.sources.tables import Tables, read_table

#: Files that a table is exported to.
FILES = 4


def scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def as_json_objects(df: DataFrame, key: str, path: str) -> None:
    """One JSON object {key: record} a file, by hash of the key; the first entry, of the key '', is an empty record."""
    part = F.pmod(F.xxhash64(key), F.lit(FILES)).cast("int")
    name = F.regexp_replace(F.to_json(F.struct(F.col(key).alias("k"))), r'\A\{"k":|\}\z', "")
    line = F.concat(F.lit(","), name, F.lit(":"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    rows = df.select(part.alias("part"), F.lit(1).alias("place"), line.alias("line"))
    ends = df.sparkSession.createDataFrame([(p, k, t) for p in range(FILES) for k, t in ((0, '{"": {}'), (2, "}"))], rows.schema)
    (rows.unionByName(ends).repartition("part").sortWithinPartitions("part", "place")
     .select("part", "line").write.partitionBy("part").option("lineSep", "\n").text(path))


@query("json_object_file", "SELECT url, page_id, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS digest FROM pages")
def json_object_file(spark, d):
    """pages as files of one JSON object {url: record} each, read in splits (S-7)."""
    path = scratch(spark, "objects")
    as_json_objects(Tables(spark, d).pages.select("url", "page_id", "html"), "url", path)
    rows = read_json_object(spark, path, "struct<page_id:bigint,html:string>", "key", last_wins=False).filter("key != ''")
    return rows.select(F.col("key").alias("url"), "page_id", F.length("html").cast("long").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("digest"))


#: Encoding told, Spark's name to write it, separator, and a suffix that only it can spell (a curly quote is ASCII's ? in latin-1).
ENCODED = [("utf-8", "UTF-8", ",", " — é 한"), ("latin-1", "ISO-8859-1", ",", " éÿ"), ("cp1252", "ISO-8859-1", ",", " “é”"), ("UTF-16LE", "UTF-16LE", "\t", " 한 é")]


@query("csv_encodings", "SELECT e.encoding, e.sep, key, name || e.suffix AS name, nation FROM (VALUES "
       + ", ".join(f"('{e}', '{'tab' if s == chr(9) else s}', '{x}')" for e, _, s, x in ENCODED) + """) AS e(encoding, sep, suffix),
  (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier
   UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, CAST(n_nationkey AS VARCHAR) FROM nation)""")
def csv_encodings(spark, d):
    """supplier and nation in four encodings and two separators, told apart and read as one table (S-2, S-4)."""
    T = Tables(spark, d)
    rows = T.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"),
                             F.col("s_nationkey").cast("string").alias("nation")).unionByName(
        T.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("name"),
                        F.col("n_nationkey").cast("string").alias("nation")))
    path = scratch(spark, "encoded")
    for enc, charset, sep, suffix in ENCODED:
        # bytes of cp1252 are written as the latin-1 characters of the same codes
        suffix = suffix.encode("cp1252").decode("latin-1") if enc == "cp1252" else suffix
        first = "﻿key" if charset == "UTF-16LE" else "key"
        out = rows.select(F.col("key").alias(first), F.concat("name", F.lit(suffix)).alias("name"), "nation")
        out.write.option("header", True).option("encoding", charset).option("sep", sep).csv(f"{path}/{enc}")
    told = {r.path: (r.encoding, r.sep) for r in RD.detect_format(spark, [f"{path}/{e[0]}" for e in ENCODED]).collect()}  # a row a file
    read = RD.read_union(spark, list(told), ["key", "name", "nation"], list(told.values()))
    formats = spark.createDataFrame([(f, e, "tab" if s == "\t" else s) for f, (e, s) in told.items()], "source_file string, encoding string, sep string")
    return read.join(F.broadcast(formats), "source_file").select("encoding", "sep", "key", "name", "nation")


@query("csv_quoted_lines", "SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM documents WHERE text <> ''")
def csv_quoted_lines(spark, d):
    """documents as CSV, whose texts hold line ends and quotes, read in splits (S-1, S-9)."""
    docs = Tables(spark, d).documents.filter("text <> ''").select(F.col("doc_id").alias("Doc\nid"), F.col("text").alias(" Whole  text"), "source")
    path = scratch(spark, "quoted")
    (docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    rows = RD.read_csv(spark, path, quoted_lines=True)
    return rows.select(F.col("Doc id").cast("long").alias("doc_id"), "source", F.length("Whole text").cast("long").alias("n_chars"),
                       F.md5(F.col("Whole text").cast("binary")).alias("digest"))


@query("discover_files", """
SELECT 'found' AS folder, CAST(c_nationkey AS VARCHAR) AS nation, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'missing', NULL, 0""")
def discover_files(spark, d):
    """customer in files of several names, of which those of one prefix are read; a missing folder is an empty table (S-5, S-6)."""
    path = scratch(spark, "folder")
    rows = Tables(spark, d).customer.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("nation"))
    rows.write.option("header", True).csv(path)
    rows.write.mode("append").json(path)  # .json files, which the pattern leaves out
    found = RD.discover(spark, path, "part-", ["key", "nation"]).groupBy("nation").agg(F.count("*").alias("n"))
    none = RD.discover(spark, path + "-missing", "part-", ["key", "nation"]).agg(F.max("nation").alias("nation"), F.count("*").alias("n"))
    return found.select(F.lit("found").alias("folder"), "nation", "n").unionByName(none.select(F.lit("missing").alias("folder"), "nation", "n"))


TABLES = ["nation", "supplier", "documents", "events"]


@query("registry_dtypes", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", column_name AS "column", CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint'
    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE 'string' END AS dtype, false AS failed FROM (DESCRIBE {t})""" for t in TABLES)
    + """ UNION ALL SELECT 'absent', NULL, NULL, true""")
def registry_dtypes(spark, d):
    """Column types over two registries of tables, one of which is not there (S-11)."""
    tables = [{t: (lambda t=t: read_table(spark, d, t)) for t in group} for group in (TABLES[:2], [*TABLES[2:], "absent"])]
    found = RD.inspect_registry(spark, tables)
    dtype = F.when(F.col("dtype") == "timestamp_ntz", "timestamp").otherwise(F.col("dtype"))
    return found.select("table", "column", dtype.alias("dtype"), F.col("error").isNotNull().alias("failed"))
