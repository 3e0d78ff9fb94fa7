"""Source readers and sinks (S-1…S-11, K-1…K-5).

CSV sources are read with a declared schema (all strings first, then
``try_cast`` after stripping thousands commas), so no inference pass runs and a
bad cell becomes null instead of failing the job.  Multi-file sources are one
read over a list of paths / a glob; the file of each row is available from
``_metadata.file_path``.  Sinks write Parquet stages and CSV / JSON exports.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.functions.scalar import to_number
from regionscore.sources.split_records import UTF16, read_csv_records, read_json_object

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Declared dtype names accepted in source specs.
DTYPE_NAMES = {"string": "string", "str": "string", "float64": "double", "float": "double",
               "int64": "bigint", "int": "bigint"}
# Encodings tried, in order, when a file's encoding is not known (with "," and tab).
ENCODINGS = ["utf-8", "latin-1", "cp1252"]
# ---------------------------------------------------------------------------

SPARK_CHARSETS = {"latin-1": "ISO-8859-1", "cp1252": "ISO-8859-1"}
#: Bytes from 0x80 to 0x9F that are no characters of cp1252.
NO_CP1252 = r"[\x81\x8D\x8F\x90\x9D]"


def norm_column_name(name: str) -> str:
    """Newlines and runs of spaces -> one space, trimmed (S-9)."""
    return re.sub(r"\s+", " ", str(name)).strip()


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[norm_column_name(c) for c in df.columns])


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def apply_dtypes(df: DataFrame, dtypes: dict[str, str], strict: bool = False) -> DataFrame:
    """Cast declared columns: strings trimmed, numbers via comma-stripping ``try_cast``.

    A declared column that is absent is skipped (``strict`` raises instead).
    """
    out = {}
    for c, t in dtypes.items():
        if c not in df.columns:
            if strict:
                raise KeyError(f"declared column {c!r} missing; have {df.columns}")
            continue
        kind = DTYPE_NAMES.get(t, t)
        if kind == "string":
            out[c] = F.trim(F.col(c).cast("string"))
        elif kind == "double":
            out[c] = to_number(F.col(c))
        else:  # digit for digit: a double holds 53 bits only, and an overflow is null, not a failed job
            s = F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "")
            out[c] = F.coalesce(s.try_cast(kind), s.try_cast("decimal(38,9)").try_cast(kind))
    return df.withColumns(out) if out else df


def read_csv(spark: SparkSession, paths: list[str] | str, sep: str = ",", encoding: str = "utf-8",
             columns: list[str] | None = None, quoted_lines: bool = False, with_file: bool = False) -> DataFrame:
    """CSV with header; with ``columns`` the schema is declared (all strings).

    UTF-16 files, and files whose quoted fields hold line ends (``quoted_lines``), are read in splits as well.
    """
    charset = SPARK_CHARSETS.get(encoding, encoding)
    if charset.upper().startswith("UTF-16") or quoted_lines:
        out = read_csv_records(spark, paths, sep, charset, columns)
        return out if with_file else out.drop("source_file")
    r = spark.read.option("header", True).option("sep", sep).option("encoding", charset).option("escape", '"').option("mode", "PERMISSIVE")
    if columns:
        r = r.schema(string_schema(columns))
    else:
        r = r.option("inferSchema", False)
    df = r.csv(paths)
    if with_file:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    df = normalise_columns(df)
    return from_cp1252(df) if encoding == "cp1252" else df


def from_cp1252(df: DataFrame) -> DataFrame:
    """Strings and names that were read as latin-1 as cp1252, which Spark doesn't decode."""
    codes = [i for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    plain, real = "".join(map(chr, codes)), bytes(codes).decode("cp1252")
    table = str.maketrans(plain, real)
    return df.select(*[F.translate(F.col(f"`{c}`"), plain, real).alias(c.translate(table)) for c in df.columns])


def detect_format(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, encoding, sep) per file (S-2), from all its lines, which are read in splits like any text.

    A byte order mark gives UTF-16LE or UTF-16BE and tab; else UTF-8 if every line is valid in it. Any bytes are valid
    latin-1, but 0x80 to 0x9F are control characters there, which no text has: a file that has them is cp1252, if all
    of them are characters of it. Tab when the file has more tabs than commas.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    raw, plain = F.col("value").cast("binary"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    count = lambda c: F.sum(F.length(plain) - F.length(F.replace(plain, F.lit(c))))
    mark = F.hex(F.substring(raw, 1, 2))
    found = lines.groupBy("path").agg(
        F.max(F.when(mark == UTF16["UTF-16LE"], "UTF-16LE").when(mark == UTF16["UTF-16BE"], "UTF-16BE")).alias("wide"),
        F.min(F.is_valid_utf8("value")).alias("utf8"), F.max(plain.rlike(r"[\x80-\x9F]")).alias("high"),
        F.max(plain.rlike(NO_CP1252)).alias("undefined"), (count("\t") > count(",")).alias("tabs"))
    kind = F.when(F.col("utf8"), F.lit(ENCODINGS[0])).when(F.col("high") & ~F.col("undefined"), F.lit(ENCODINGS[2])).otherwise(F.lit(ENCODINGS[1]))
    return found.select("path", F.coalesce("wide", kind).alias("encoding"),
                        F.when(F.col("wide").isNotNull() | F.col("tabs"), F.lit("\t")).otherwise(F.lit(",")).alias("sep"))


def read_union(spark: SparkSession, paths: list[str], columns: list[str] | None = None,
               formats: list[tuple[str, str]] | None = None) -> DataFrame:
    """Multi-file source: one read per (encoding, sep) group, union by name (S-4)."""
    groups: dict[tuple[str, str], list[str]] = {}
    for p, fmt in zip(paths, formats or [("utf-8", ",")] * len(paths)):
        groups.setdefault(fmt, []).append(p)
    parts = [read_csv_records(spark, ps, sep, enc, columns) if enc in UTF16
             else read_csv(spark, ps, sep, enc, columns, with_file=True) for (enc, sep), ps in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def discover(spark: SparkSession, directory: str, prefix: str, columns: list[str]) -> DataFrame:
    """All ``prefix*.csv`` files of a folder as one table; a missing folder is an empty table (S-5, S-6).

    Any other failure (permission, unreadable file) is raised.
    """
    r = (spark.read.option("header", True).option("pathGlobFilter", f"{prefix}*.csv")
         .option("enforceSchema", False).schema(string_schema(columns)))
    try:
        df = r.csv(directory)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], string_schema(columns + ["source_file"]))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def header_report(spark: SparkSession, paths: list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """(path, missing, n_lines) per file: which of ``columns`` its header lacks, and how many lines it has.

    Files to leave out of ``read_union`` or ``discover`` are those with a missing column: a report, not a silent skip.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value"),
                                          F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    head = F.min_by(F.col("value"), F.struct("at", "i"))
    names = F.transform(F.split(F.col("head"), sep), lambda x: F.trim(F.regexp_replace(x, '^\ufeff|"', "")))
    return lines.groupBy("path").agg(head.alias("head"), F.count(F.lit(1)).alias("n_lines")).select(
        "path", F.array_except(F.array(*[F.lit(c) for c in columns]), names).alias("missing"), "n_lines")


def explode_json_map(spark: SparkSession, path: str, value_schema: T.StructType, key_name: str = "url") -> DataFrame:
    """A JSON object {key: record} file -> one row per entry, all record keys kept (S-7); read in splits."""
    return read_json_object(spark, path, value_schema, key_name)


def inspect_dtypes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, dtype) over a catalog of tables, columns namespaced by table (S-11)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, c, t) for name, df in tables.items() for c, t in df.dtypes]
    return spark.createDataFrame(rows, "table string, column string, dtype string")


def inspect_registry(spark: SparkSession, registries: list[dict]) -> DataFrame:
    """(table, column, dtype, error) over registries of {name: function that gives a DataFrame} (S-11).

    A table that cannot be opened gives one row with its error; a name in two registries is a ValueError.
    """
    names = [n for r in registries for n in r]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"tables registered twice: {twice}")
    rows = []
    for name, open_table in ((n, f) for r in registries for n, f in r.items()):
        try:
            rows += [(name, c, t, None) for c, t in open_table().dtypes]
        except AnalysisException as e:
            rows.append((name, None, None, e.getCondition() or type(e).__name__))
    return spark.createDataFrame(rows, "table string, column string, dtype string, error string")


# Sinks ---------------------------------------------------------------------------------

def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet stage table (K-1)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One record per line (K-3)."""
    df.write.mode("overwrite").json(path)


def write_counts(df: DataFrame, name_col: str, path: str) -> None:
    """Ordered frequency export (K-2): most common first."""
    counts = df.groupBy(name_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name_col)
    export_csv(counts, path)


def to_markdown(small: DataFrame, max_rows: int = 200) -> str:
    """Markdown table of a small report (K-4); a larger one says how many rows it has in all."""
    rows = small.limit(max_rows + 1).collect()
    more = f"{max_rows} of {small.count()} rows" if len(rows) > max_rows else ""
    rows = rows[:max_rows]
    cols = small.columns
    head = "| " + " | ".join(cols) + " |\n|" + "---|" * len(cols) + "\n"
    return head + "".join("| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |\n" for r in rows) + more
