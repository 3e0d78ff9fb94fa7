"""Operator 3: document fingerprints as Merkle trees over sections and paragraphs.

Sections are separated by two line feeds, paragraphs are the lines of a section,
and leaves are runs of up to four words in a paragraph that end early at a
sentence end; leaves keep their white space, so that the leaves of a text say
all of it. A node's hash is the hash of its kind, the number and the hashes of
its children; the root is the fingerprint. Equal texts have equal roots, and a
root that differs leads through differing sections and paragraphs to the leaves.

Hashes are 60 bits of md5 for inner nodes and sha-256 for the root, so that
DuckDB can express them too. Everything is a column expression: no Python runs
on the executors.

Neighbours (the next document by descending doc_id) come from one shuffle of
the texts by ranges of doc_id. The cut points are ids that occur; the document
at a cut point is copied into the range that follows it, so that every range
holds its last document's successor, and no window ever spans all rows.

Defined results: null text is the empty text, which has a root of its own; null
ids come last in the order; of rows with one id, the smaller text comes first;
a single document is its own successor; an empty table gives no rows. The
likeness of two texts is 1 if the roots are equal, else the Dice coefficient of
their distinct leaf hashes, which is below 1 and symmetric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import hash60, named, partitions, row_of, whole_text

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SECTION, PARAGRAPH = "\n\n", "\n"
LEAF = rf"{WS}*(?:{WORD}*[^\x20\x09-\x0D.!?]{WS}+){{0,3}}{WORD}+{WS}*|{WS}+"


def node(kind: str, children: Column) -> Column:
    """Hash of an inner node over its children's hashes."""
    return hash60(F.concat(F.lit(kind), F.size(children).cast("string"), F.lit(":"),
                           F.array_join(children.cast("array<string>"), ",")))


def leaves(text: Column) -> Column:
    """Leaf hashes of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), hash60)


def tree(text: Column) -> Column:
    """Array of sections, each an array of paragraphs, each an array of leaf hashes."""
    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), leaves))


def paragraph_hashes(sections: Column) -> Column:
    return F.transform(sections, lambda s: F.transform(s, lambda p: node("p", p)))


def root(paragraphs: Column) -> Column:
    """Fingerprint: 64 hex digits."""
    top = F.transform(paragraphs, lambda s: node("s", s))
    return F.sha2(F.concat(F.lit("d"), F.size(top).cast("string"), F.lit(":"),
                           F.array_join(top.cast("array<string>"), ",")).cast("binary"), 256)


def with_tree(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """``rows`` with <prefix>paragraphs (hashes), <prefix>leaves (distinct hashes) and <prefix>root of a text column."""
    return (rows.withColumn(f"{prefix}tree", tree(F.col(text)))
            .withColumn(f"{prefix}leaves", F.array_distinct(F.flatten(F.flatten(f"{prefix}tree"))))
            .withColumn(f"{prefix}paragraphs", paragraph_hashes(F.col(f"{prefix}tree")))
            .withColumn(f"{prefix}root", root(F.col(f"{prefix}paragraphs"))).drop(f"{prefix}tree"))


def likeness(a: str, b: str) -> Column:
    """Of the texts whose tree columns have the prefixes a and b; 1 for equal roots only."""
    both = F.size(F.array_intersect(f"{a}leaves", f"{b}leaves"))
    total = F.size(f"{a}leaves") + F.size(f"{b}leaves")
    return (F.when(F.col(f"{a}root") == F.col(f"{b}root"), 1.0).when(total == 0, 0.0)
            .otherwise(F.least(2.0 * both / total, F.lit(0.999999))))


def differing_paragraphs(a: str, b: str) -> Column:
    """Positions (from 0, sections joined) of the paragraphs of a that differ from those of b at the same position."""
    x, y = F.flatten(f"{a}paragraphs"), F.flatten(f"{b}paragraphs")
    differs = F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q))
    return F.filter(F.transform(differs, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())


def ranges(docs: DataFrame, doc_id: str, count: int) -> list:
    """At most ``count`` cut points that occur among the ids, ascending; the last is the largest id."""
    steps = [(i + 1) / count for i in range(count - 1)]
    quantiles = F.percentile_approx(doc_id, steps, max(10_000, 20 * count)) if steps else F.array().cast("array<long>")
    found = docs.agg(quantiles.alias("q"), F.max(doc_id).alias("m")).first()
    return sorted({*(found["q"] or []), found["m"]}) if found["m"] is not None else [None]


def range_of(x: Column, cuts: Column, n: int) -> Column:
    """Index of the first cut that is at least x, by binary search."""
    step = lambda at, _: F.when(F.get(cuts, F.floor((at["lo"] + at["hi"]) / 2).cast("int")) >= x, F.struct(
        at["lo"].alias("lo"), F.floor((at["lo"] + at["hi"]) / 2).cast("int").alias("hi"))).otherwise(F.struct(
            (F.floor((at["lo"] + at["hi"]) / 2) + 1).cast("int").alias("lo"), at["hi"].alias("hi")))
    start = F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi"))
    return F.when(x.isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), start, step)["lo"])


def with_successor(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row (a struct of its columns), text, its tree, and the text and tree of the next one.

    The columns of the trees have the prefixes own_ and next_.
    """
    n = partitions(docs.sparkSession)
    cuts = ranges(docs, doc_id, 4 * n)
    at = F.array(*[F.lit(c).cast("long") for c in cuts])
    rows = docs.select(row_of(docs).alias("row"), named(doc_id).cast("long").alias("id"), whole_text(text).alias("text"))
    rows = rows.withColumn("b", F.least(range_of(F.col("id"), at, len(cuts)), F.lit(len(cuts) - 1)))
    here = F.struct(F.col("b").alias("range"), F.lit(False).alias("copy"))
    after = F.struct(((F.col("b") + 1) % len(cuts)).alias("range"), F.lit(True).alias("copy"))
    rows = (rows.withColumn("place", F.explode(F.when(F.col("id").eqNullSafe(F.get(at, F.col("b"))), F.array(here, after))
                                               .otherwise(F.array(here))))
            .select("row", "id", "text", "place.*").repartition(n, "range"))
    rows = with_tree(rows, "text", "own_")
    order = Window.partitionBy("range").orderBy("copy", F.col("id").desc_nulls_last(), "text")
    for c in ("text", "own_root", "own_leaves"):
        rows = rows.withColumn(c.replace("own_", "next_") if c != "text" else "next_text", F.lead(c).over(order))
    return rows.filter(~F.col("copy")).drop("copy", "range")


def edited_text(text: str, other: str) -> Column:
    """The text with its last third replaced by as many first characters of the other."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - k), F.substring(F.col(other), F.lit(1), k))
