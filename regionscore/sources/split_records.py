"""Records of files that plain line splitting can't cut, read in splits.

Spark's text source cuts a file at every occurrence of a separator, in as many
tasks as the file has splits, but a separator may stand inside a record: a brace
in a JSON string, a line feed in a quoted CSV field, two bytes of UTF-16 that are
halves of other characters. Whether it does is told by all that stands before it
in the file: a state of two values, which each piece keeps or flips, and a total,
to which each piece adds an amount that depends on the state it begins in. Both
are prefix scans:

1. in each split, pieces give their state relative to the split's begin, and the
   split its flip and its amounts for either state (a window in one split);
2. over the splits of a file, a row each, the state and total at each begin;
3. pieces know where they stand, so which of them end a record; the number of
   record ends before each split comes by a second scan over splits;
4. pieces are grouped by (file, record).

No file is one task, however large: the largest unit is a split of
``spark.sql.files.maxPartitionBytes``, or a record.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.session import checkpoint_dir

#: Byte order marks of UTF-16.
UTF16 = {"UTF-16LE": "FFFE", "UTF-16BE": "FEFF"}


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pieces(spark: SparkSession, paths: list[str] | str, separator: str, encoding: str = "UTF-8") -> DataFrame:
    """file, split, at (ascending in a split), value (bytes without the separator)."""
    lines = spark.read.option("lineSep", separator).option("encoding", encoding).text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))


def numbered(found: DataFrame, ends: Callable[[Column, Column], Column]) -> DataFrame:
    """``found`` (file, split, at, flip, step0, step1 and others), stored, with record: how many records of the file ended before.

    ``flip`` is 0 or 1; ``step0`` and ``step1`` are what a piece adds to the total if it begins in state 0 or 1.
    ``ends(state, total)`` says of the state and total after a piece whether a record ends there. Adds state and
    total, both after the piece.
    """
    found = _stored(found, "pieces")
    own = Window.partitionBy("file", "split").orderBy("at")
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    skinny = found.select("file", "split", "at", "flip", "step0", "step1")

    # splits: their flip, and what they add if they begin in either state
    own_state = skinny.withColumn("p", sofar("flip", before) % 2)
    splits = own_state.groupBy("file", "split").agg(
        (F.sum("flip") % 2).alias("flip"), F.sum(F.when(F.col("p") == 0, F.col("step0")).otherwise(F.col("step1"))).alias("sum0"),
        F.sum(F.when(F.col("p") == 0, F.col("step1")).otherwise(F.col("step0"))).alias("sum1"))
    splits = (splits.withColumn("state0", sofar("flip", earlier) % 2)
              .withColumn("sum", F.when(F.col("state0") == 0, F.col("sum0")).otherwise(F.col("sum1")))
              .select("file", "split", "state0", sofar("sum", earlier).alias("total0")))
    splits = _stored(splits, "splits")

    def placed(rows: DataFrame, at: DataFrame) -> DataFrame:
        rows = rows.join(at, ["file", "split"]).withColumn("begins", (F.col("state0") + sofar("flip", before)) % 2)
        step = F.when(F.col("begins") == 0, F.col("step0")).otherwise(F.col("step1"))
        rows = rows.withColumn("state", (F.col("begins") + F.col("flip")) % 2).withColumn("total", F.col("total0") + F.sum(step).over(upto))
        return rows.withColumn("last", ends(F.col("state"), F.col("total")).cast("int"))

    cuts = placed(skinny, splits).groupBy("file", "split").agg(F.sum("last").alias("cuts"))
    splits = _stored(splits.join(cuts.withColumn("cuts0", sofar("cuts", earlier)).drop("cuts"), ["file", "split"]), "splits")
    rows = placed(found, splits)
    return rows.withColumn("record", F.col("cuts0") + sofar("last", before)).drop("state0", "total0", "cuts0", "begins", "last")


def joined(rows: DataFrame, text: Column, separator: str) -> DataFrame:
    """file, record, text (of all its pieces, with the separator between them), total (after the record)."""
    parts = F.sort_array(F.collect_list(F.struct("split", "at", text.alias("text"), "total")))
    out = rows.groupBy("file", "record").agg(parts.alias("parts"))
    return out.select("file", "record", F.array_join("parts.text", separator).alias("text"),
                      F.element_at("parts", -1)["total"].alias("total"))


# JSON -------------------------------------------------------------------------------

def json_object_entries(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file, record, text: consecutive parts of the object in each file, each a JSON object of some of its entries.

    Files are cut at closing braces. The state is whether a piece begins in a string (an escape never spans pieces,
    as a brace is never escaped), the total the depth of braces outside strings; a record ends where depth comes
    back to one, and at the end of the object.
    """
    raw = pieces(spark, paths, "}").withColumn("text", F.col("value").cast("string"))
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    opened = lambda k: F.aggregate(F.transform(F.split(bare, '"'), lambda x, i: F.when(i % 2 == k, count(x, "{")).otherwise(0)),
                                   F.lit(0), lambda a, b: a + b)
    raw = raw.withColumn("quotes", count(bare, '"')).withColumn("flip", (F.col("quotes") % 2).cast("int"))
    # begun outside a string, the brace that ends the piece is outside if the number of quotes is even
    raw = (raw.withColumn("step0", opened(0) - F.when(F.col("flip") == 0, 1).otherwise(0))
           .withColumn("step1", opened(1) - F.when(F.col("flip") == 1, 1).otherwise(0)))
    rows = numbered(raw.drop("value", "quotes"), lambda state, depth: (state == 0) & (depth <= 1))
    found = joined(rows, F.col("text"), "}")
    body = F.regexp_replace("text", r"(?s)\A[\ufeff\s]*[{,]?", "")
    body = F.when(F.col("total") == 1, F.concat(body, F.lit("}"))).otherwise(body)  # else the brace was that of the object
    return found.select("file", "record", F.concat(F.lit("{"), body, F.lit("}")).alias("text")).filter(~F.col("text").rlike(r"\A\{\s*\}\z"))


def read_json_object(spark: SparkSession, paths: list[str] | str, value_schema: T.StructType | str, key_name: str = "url",
                     last_wins: bool = True) -> DataFrame:
    """JSON object files {key: record} -> one row per entry, all record keys kept (S-7).

    Of entries with one key in a file the last counts, as in Python, unless ``last_wins`` is False. A value that is no
    object has null fields; a part that is no JSON raises an error, as does a file that ends inside its object.
    """
    kind = value_schema if isinstance(value_schema, str) else value_schema.simpleString()
    part = json_object_entries(spark, paths).withColumn("m", F.from_json("text", f"map<string,{kind}>", {"mode": "FAILFAST"}))
    rows = part.select("file", "record", F.posexplode("m").alias("at", key_name, "_r"))
    if last_wins:
        rows = rows.groupBy("file", key_name).agg(F.max_by("_r", F.struct("record", "at")).alias("_r"))
    return rows.select(key_name, "_r.*")


# CSV --------------------------------------------------------------------------------

def csv_records(spark: SparkSession, paths: list[str] | str, encoding: str = "UTF-8") -> DataFrame:
    """file, record, text: the lines of CSV files in any encoding of one byte, UTF-8 or UTF-16 (LE or BE).

    Quoted fields may hold line ends. For UTF-16 the state is whether a piece begins in the middle of a character:
    the two bytes of a line feed may be the end of one character and the begin of the next. The total counts quotes;
    a record ends at a whole character, outside quotes.
    """
    wide = encoding in UTF16
    raw = pieces(spark, paths, "\n", encoding if wide else "UTF-8")
    raw = raw.withColumn("text", F.decode("value", "ISO-8859-1"))  # a character a byte
    if wide:
        quote = r'"\x00' if encoding == "UTF-16LE" else r'\x00"'
        quotes = lambda s: F.regexp_count(s, F.lit(rf"(?s)\G(?:..)*?{quote}"))
        odd = (F.length("text") % 2).cast("int")
        raw = raw.withColumn("flip", odd).withColumn("step0", quotes(F.col("text"))).withColumn("step1", quotes(F.substr("text", F.lit(2))))
        feed = "\n\x00" if encoding == "UTF-16LE" else "\x00\n"
    else:
        quotes = F.length("text") - F.length(F.replace("text", F.lit('"')))
        raw = raw.withColumn("flip", F.lit(0)).withColumn("step0", quotes).withColumn("step1", quotes)
        feed = "\n"
    rows = numbered(raw.drop("value"), lambda state, quoted: (state == 0) & (quoted % 2 == 0))
    text = F.col("text") if encoding == "ISO-8859-1" else F.decode(F.encode("text", "ISO-8859-1"), encoding)
    return joined(rows, F.col("text"), feed).select("file", "record", F.regexp_replace(text, "\\A\ufeff|\r\\z", "").alias("text"))


def read_csv_records(spark: SparkSession, paths: list[str] | str, sep: str = ",", encoding: str = "UTF-8",
                     columns: list[str] | None = None) -> DataFrame:
    """CSV files with a header, in splits whatever their encoding and their quoted line ends; all columns are strings.

    Each file's fields go by its own header: columns that it lacks are null. Without ``columns`` the names are those
    of all headers, which are read first. The column source_file names the file.
    """
    lines = csv_records(spark, paths, encoding).filter(F.col("text") != "")
    names = lines.filter("record = 0").select("file", "text")
    fields = lambda n: F.from_csv("text", ", ".join(f"c{i} string" for i in range(n)), {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})
    heads = {r.file: r.text for r in names.collect()}  # a line a file
    parsed = {f: _header(spark, text, sep) for f, text in heads.items()}
    columns = columns or list(dict.fromkeys(c for cs in parsed.values() for c in cs))
    out = None
    for head in {tuple(cs) for cs in parsed.values()}:
        rows = lines.filter((F.col("record") > 0) & F.col("file").isin([f for f, cs in parsed.items() if tuple(cs) == head]))
        rows = rows.withColumn("r", fields(len(head))).select(
            *[F.col(f"r.c{head.index(c)}").alias(c) if c in head else F.lit(None).cast("string").alias(c) for c in columns],
            F.col("file").alias("source_file"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, "source_file"]))
    return out


def _header(spark: SparkSession, text: str, sep: str) -> list[str]:
    """Names of a header line, with runs of white space as one blank."""
    import csv
    import io
    return [" ".join(c.split()) for c in next(csv.reader(io.StringIO(text, newline=""), delimiter=sep))]
