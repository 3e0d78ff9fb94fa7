"""Operator 4: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are made in Arrow batches: xxHash64 of the word shingles, and the
majority of every bit. Links are found on distinct fingerprints only. Each bit
position has a vector of radius+1 bits, and each of the 2^(radius+1)-1 tables
keeps the positions whose vector has an odd product with the table's. At most
``radius`` differing positions span less than the whole space, so that some
table keeps none of them: every pair within the radius meets in a bucket there.

A bucket of at most ``bucket_limit`` fingerprints is compared within one task,
which gives one star of links for each of the bucket's linked parts, never all
pairs. Larger buckets are counted first and never gathered: their members are
covered again by tables over the bits that the bucket leaves open. Every level
halves the open bits, and a few open bits allow a few fingerprints only, so that
this ends with no pair left out and no cap on a bucket.

Components come from alternating large and small stars over the links; stars
and labels are tables in the shared folder, so that joins with a hot centre have
plain exchanges on both sides, which Spark splits.

Defined results: null text counts as empty, and texts without a word have the
fingerprint zero and link like any other; the component is the smallest id in
reach, null ids counting last; repeated rows have one component; an empty table
gives no rows. Texts are processed whole, in blocks of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.llm.common import fresh, row_of, shared_table, whole_text

BLOCK = 1 << 20
SPACE = b" \t\n\r\x0b\f"


def word_blocks(raw: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text in lists of about a megabyte, each begun with the last ``overlap`` of the one before."""
    at, kept = 0, []
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and raw[end] not in SPACE:
            end += 1
        words = kept + raw[at:end].split()
        yield words
        kept = words[-overlap:] if overlap else []
        at = end


def fingerprint(text: str, shingle: int) -> int:
    """SimHash as a signed 64-bit integer."""
    ones, total, few = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.encode("utf-8").lower(), shingle - 1):  # bytes: A-Z and ASCII white space only
        few = words
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[:len(words) - shingle + 1].tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)),
                             np.uint64, len(starts))
        for k in range(0, len(hashes), 8192):
            ones += np.unpackbits(hashes[k:k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        if not few:
            return 0
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(few), 42)).view(np.int64))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """row (a struct of the columns of ``docs`` but the text) and fp, the fingerprint as a signed long."""
    rows = docs.select(row_of(docs, text).alias("row"), whole_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["row", "fp"])

    return rows.mapInArrow(run, rows.select("row", F.lit(0).cast("long").alias("fp")).schema)


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the positions set in ``free``; of any ``radius`` positions, one mask at least keeps none."""
    places = [i for i in range(64) if free >> i & 1]
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << p for j, p in enumerate(places) if bin((1 + j % vectors) & v).count("1") % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(groups: DataFrame, radius: int) -> DataFrame:
    """groups: fps, an array of fingerprints. Links (hi, lo) of every member to the least of its linked part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            his, los = [], []
            for k in range(len(column)):
                fps = np.sort(np.asarray(column[k].values, dtype=np.int64))
                part = np.arange(len(fps))
                near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
                while True:  # every member takes the least label in reach
                    least = np.where(near, part[None, :], len(fps)).min(axis=1)
                    least = least[least]
                    if (least == part).all():
                        break
                    part = least
                moved = part != np.arange(len(fps))
                his.append(fps[moved])
                los.append(fps[part[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.array([], np.int64), pa.int64())
                                              for x in (his, los)], ["hi", "lo"])

    return groups.select("fps").mapInArrow(run, "hi long, lo long")


def links(nodes: DataFrame, radius: int, bucket_limit: int = 256) -> DataFrame:
    """nodes: fp, distinct. Links (hi, lo), hi > lo, that connect all pairs within ``radius``, as a table."""
    if bucket_limit < 100:
        raise ValueError("bucket_limit below 100 would need more levels than there are open bits")
    agreed = [0]  # by the path of tables so far: the bits that a bucket's members share
    level = nodes.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"), "fp")
    found = None
    while True:
        children = [m | c for m in agreed for c in covering_masks(~m & (1 << 64) - 1, radius)]
        width = len(children) // len(agreed)
        masks = F.array(*[F.lit(signed(m)) for m in children])
        keyed = (level.withColumn("path", F.explode(F.sequence(F.col("path") * width, F.col("path") * width + (width - 1))))
                 .withColumn("key", F.col("fp").bitwiseAND(F.get(masks, F.col("path")))))
        buckets = shared_table(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        small = (keyed.join(buckets.filter(F.col("n") <= bucket_limit), ["path", "key"])
                 .groupBy("path", "key").agg(F.collect_list("fp").alias("fps")))
        own = shared_table(bucket_links(small, radius).distinct(), "links")
        found = own if found is None else found.union(own)
        hot = buckets.filter(F.col("n") > bucket_limit).select("path", "key")
        if hot.isEmpty():
            return found
        level, agreed = shared_table(keyed.join(hot, ["path", "key"]), "hot"), children


def connected(edges: DataFrame) -> DataFrame:
    """Stars (hi, lo) of a graph given by edges (hi, lo), hi > lo: lo is the least node in reach of hi."""

    def with_least(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) with the least v of each u, and u itself if it is less."""
        least = shared_table(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        return pairs.join(least, "u")

    seen = None
    while True:
        # large stars: neighbours above u go to the least neighbour of u
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        edges = shared_table(with_least(both).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        # small stars: u and its neighbours below go to the least of them
        pairs = with_least(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        edges = shared_table(pairs.select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")),
                                                            F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                             .select("e.*").filter("hi > lo").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges
        seen = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id",
                    bucket_limit: int = 256, rid: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, fp, component_id (least id in reach) and keeper (rid of one row with that id).

    rid is a column of ``docs`` if ``rid`` names it, else it numbers the rows in the order of one scan.
    """
    numbers = F.col(rid) if rid else F.monotonically_increasing_id()
    ids = docs.select(F.col(doc_id).alias("doc_id"), numbers.alias("rid"), F.col(text).alias("text"))
    prints = shared_table(fingerprints(ids, shingle).select("row.doc_id", "row.rid", "fp"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    nodes = shared_table(prints.groupBy("fp").agg(least), "nodes")
    stars = connected(links(nodes.select("fp"), radius, bucket_limit))
    roots = shared_table(nodes.join(stars.select(F.col("hi").alias("fp"), F.col("lo").alias("root")), "fp", "left")
                         .withColumn("root", F.coalesce("root", "fp")), "roots")
    parts = shared_table(roots.groupBy("root").agg(F.min("first").alias("part")), "parts")
    classes = shared_table(roots.select("fp", "root").join(parts, "root").select("fp", "part"), "classes")
    return prints.join(classes, "fp").select("rid", "doc_id", "fp", F.col("part.doc_id").alias("component_id"),
                                             F.col("part.rid").alias("keeper"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates: the one with the least id.

    The rows are numbered once, in a table in the shared folder.
    """
    rid = fresh(docs.columns, "_rid")
    rows = shared_table(docs.select("*", F.monotonically_increasing_id().alias(rid)), "rows", "zstd")
    kept = near_duplicates(rows, rid=rid, **options).filter("rid = keeper").select(F.col("rid").alias(rid))
    return rows.join(kept, rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
