"""Operator 10: mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed shuffled order (md5 of the
id), repeated up to ``max_epochs`` times. A document's virtual finish time is
the number of words its source has sent when it ends, divided by the source's
weight. All queue entries are ordered by finish time and cut at the budget.

Only a skinny (source, key, size) table is shuffled, never the text. Rows that
share their key and size are counted first and queue as one group, copy after
copy, so that a group of any number of copies is one row. A source that holds a
third of the rows is split into sqrt(n) hash buckets: bucket sums are added up
first, and a window only runs inside one bucket. The result of the cut is one
place per source and epoch, a key with a size and the copies taken of it, so
that applying it needs no shuffle, but for the rows of a group that the cut
divides: those are stored once and numbered by partition sums.

Defined results: null or empty text has size 0, and is in the mix when its place
in the queue is; a null source is a source of its own, last in order; of rows
with one key and size (without an id and with equal texts, or of one id) as many
are taken as fit, the first in scan order; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import WORD, named, row_of, shared_table, whole_text

#: Above this many sources the per-source table is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def queue_columns(text: str, source: str, doc_id: str) -> dict[str, Column]:
    """sk: source with nulls marked; key: place in the shuffled order; size: words."""
    name = F.when(named(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), named(source).cast("string")))
    own = F.coalesce(named(doc_id).cast("string"), F.md5(whole_text(text).cast("binary")))
    return {"sk": name, "key": F.md5(own.cast("binary")), "size": word_count(named(text))}


def source_targets(queue: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """One row per source: size, weight, target (water level under the caps).

    The windows run over one row per source.
    """
    src = queue.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n"))
    by_name, all_rows = Window.orderBy("sk"), Window.partitionBy()
    src = (src.withColumn("rank", F.row_number().over(by_name))
           .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                         (F.col("rank") - 1) % len(weights) + 1))
           .withColumn("cap", F.col("source_size") * float(max_epochs))
           .withColumn("budget", F.sum("source_size").over(all_rows) * share))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("w").over(after))
    full = F.col("level") >= F.col("cap") / F.col("w")
    src = (src.withColumn("level", F.min(F.when(~full, F.struct(F.col("cap") / F.col("w"), "sk", "level")))
                          .over(all_rows)["level"]))
    return src.select("sk", "source_size", "n", "w", "budget", "level",
                      F.when(F.col("level").isNull(), F.col("cap"))
                      .otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
             text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, bool]:
    """One row per source: sk, source_size, target, last: for each epoch the last place in the mix (null: none).

    A place is (key, size, m, n): rows before (key, size) are taken in that epoch, and m of the n rows there.
    Beside it, if the sources are few enough for a broadcast.
    """
    spark = docs.sparkSession
    queue = shared_table(docs.select(*[c.alias(n) for n, c in queue_columns(text, source, doc_id).items()])
                         .groupBy("sk", "key", "size").agg(F.count("*").alias("n")), "queue")
    targets = source_targets(queue, weights, share, max_epochs)
    total = targets.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max("level").alias("level"),
                        F.max("budget").alias("budget")).first()
    n, level, budget = int(total["n"] or 0), total["level"], total["budget"]
    buckets = max(1, math.isqrt(n))
    small = int(total["k"]) <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)

    # place of each document in its own queue: sums of hash buckets first, then a window inside one bucket
    queue = queue.withColumn("b", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2.0 ** 32).cast("int"))
    sums = queue.groupBy("sk", "b").agg(F.sum(F.col("size") * F.col("n")).alias("s"))
    earlier = Window.partitionBy("sk").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sk", "b", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("off"))
    inside = Window.partitionBy("sk", "b").orderBy("key", "size")
    placed = (queue.withColumn("cum", F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
              .join(offsets, ["sk", "b"])
              .join(hint(targets.select("sk", "source_size", "w")), "sk"))
    entries = (placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
               .withColumn("sent", F.col("epoch") * F.col("source_size") + F.col("off") + F.col("cum"))
               .select("sk", "key", "size", "n", "epoch", "sent", "w"))

    # cut at the budget: sums of finish-time ranges, then a window only inside the range that holds the cut. A group
    # is cut into its copies in each range; one of size 0 is one unit.
    order = ["finish", "sk", "epoch", "key", "size", "copy"]
    units = entries.withColumn("low", F.lit(0)).withColumn("high", F.col("n"))
    if level and budget:
        span = level / buckets
        range_of = lambda sent: F.least(F.floor(sent / F.col("w") / span), F.lit(4 * buckets))
        whole = F.col("size") * F.col("n")
        upto = lambda f: F.when(f < F.col("f1"), 0).when(f >= F.col("f2"), F.col("n")).otherwise(
            F.greatest(F.lit(0), F.least(F.col("n"), F.floor(((f + 1) * F.lit(span) * F.col("w") - F.col("sent")) / F.greatest("size", F.lit(1))))))
        units = (entries.withColumn("f1", range_of(F.col("sent") + F.col("size"))).withColumn("f2", range_of(F.col("sent") + whole))
                 .withColumn("f", F.explode(F.sequence("f1", "f2")))
                 .withColumn("low", upto(F.col("f") - 1)).withColumn("high", upto(F.col("f")))
                 .filter("high > low"))
        totals = units.groupBy("f").agg(F.sum(F.col("size") * (F.col("high") - F.col("low"))).alias("s"))
        upto_f = totals.withColumn("cum", F.sum("s").over(Window.orderBy("f")))
        cut = upto_f.filter(F.col("cum") > budget).agg(F.min(F.struct("f", "cum", "s")).alias("c")).first()["c"]
        if cut is not None:
            copies = (units.filter(F.col("f") == cut["f"])
                      .withColumn("copy", F.explode(F.when(F.col("size") > 0, F.sequence(F.col("low") + 1, F.col("high"))).otherwise(F.array("n"))))
                      .withColumn("finish", (F.col("sent") + F.col("size") * F.col("copy")) / F.col("w"))
                      .withColumn("cum", F.sum("size").over(Window.partitionBy("f").orderBy(*order)) + (cut["cum"] - cut["s"]))
                      .filter(F.col("cum") <= budget).withColumn("high", F.col("copy")))
            names = ["sk", "epoch", "key", "size", "high", "n"]
            units = units.filter(F.col("f") < cut["f"]).select(names).union(copies.select(names))
    place = F.struct("key", "size", F.col("high").alias("m"), "n")
    taken = units.groupBy("sk").agg(
        F.array(*[F.max(F.when(F.col("epoch") == e, place)) for e in range(max_epochs)]).alias("last"))
    return shared_table(targets.select("sk", "source_size", "target").join(taken, "sk", "left"), "mix_plan"), small


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with nr, from 1 in scan order within each (sk, key, size); stored once, and counted by partition first."""
    group = ["sk", "key", "size"]
    stored = shared_table(rows.withColumn("rid", F.monotonically_increasing_id()), "divided", "zstd")
    own = stored.select("rid", *group, F.shiftright("rid", 33).alias("p"))
    earlier = Window.partitionBy(*group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (own.groupBy(*group, "p").agg(F.count("*").alias("c"))
               .select(*group, "p", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("off")))
    nr = F.row_number().over(Window.partitionBy(*group, "p").orderBy("rid")) + F.col("off")
    return stored.join(own.join(offsets, [*group, "p"]).select("rid", nr.alias("nr")), "rid").drop("rid")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
        text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: row (a struct of its columns), size, source_size, target, copies, taken."""
    plan, small = mix_plan(docs, weights, share, max_epochs, text, source, doc_id)
    own = queue_columns(text, source, doc_id)
    rows = (docs.select(row_of(docs).alias("row"), *[c.alias(n) for n, c in own.items()])
            .join(F.broadcast(plan) if small else plan, "sk", "left").withColumn("nr", F.lit(None).cast("long")))
    here, at = F.struct("key", "size"), lambda p: F.struct(p.key.alias("key"), p.size.alias("size"))
    if not plan.filter(F.exists("last", lambda p: p.m < p.n)).isEmpty():
        divided = F.coalesce(F.exists("last", lambda p: (at(p) == here) & (p.m < p.n)), F.lit(False))
        rows = rows.filter(~divided).unionByName(numbered(rows.filter(divided).drop("nr")))
    taken = lambda p: (at(p) > here) | ((at(p) == here) & (F.coalesce("nr", F.lit(1)) <= p.m))
    copies = F.when(F.col("last").isNull(), 0).otherwise(F.size(F.filter("last", lambda p: F.coalesce(taken(p), F.lit(False)))))
    return (rows.withColumn("copies", copies)
            .select("row", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it."""
    return (mix(docs, **options).filter("copies > 0")
            .withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("row.*"))
