"""Exact, interpolating quantiles per group that never hold a whole group in one task.

``median`` / ``percentile`` in Spark keep a per-group value map in memory in
one task; a group holding a third of the rows would sink that task.  Here:

1. an approximate quantile sketch (a partial aggregate of bounded size) gives a
   bracket of two values around each wanted quantile;
2. one more scan finds the segment of each value among the bounds of its group's
   brackets, and counts rows by segment; inside brackets, a few in ten thousand,
   by value as well;
3. sums over segments, a few a group, say in which segment a wanted rank lies, and
   sums over its values which of them it is. A segment of more than
   ``WINDOW_ROWS`` values is cut at quantiles of these first, and such pieces are
   summed before a window looks into them.

The result equals pandas ``quantile`` / Spark ``percentile`` (linear
interpolation), whatever the brackets were: their error is below their width,
and the nearest values outside are kept for ranks just beyond.

Rows get their group's bracket by a broadcast join when the groups, which are
counted, are at most ``BROADCAST_GROUPS``.  Beyond that they join by group and a
salt of the value's hash, so that a hot group is spread over ``SALTS`` tasks and
no aggregate can rest on a partitioning by group alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.session import cut_lineage

BROADCAST_GROUPS, SALTS = 100_000, 64
#: Values that one window may rank.
WINDOW_ROWS = 1_000_000


def attach(rows: DataFrame, small: DataFrame, keys: list[str], few: bool, spread: Column) -> DataFrame:
    """Each row with the columns of its group's one row in ``small``; ``few``: the groups may be broadcast."""
    if not keys:
        return rows.crossJoin(F.broadcast(small))  # one row
    if few:
        return rows.join(F.broadcast(small), keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
            .join(salted, [*keys, "_salt"]).drop("_salt"))


def _asked(probs: dict[str, float], accuracy: int) -> list[float]:
    """Lower and upper end of a bracket around each quantile."""
    return [min(1.0, max(0.0, p + side * 3.0 / accuracy)) for p in probs.values() for side in (-1, 1)]


def exact_quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float],
                    chunks: int = 3334, accuracy: int | None = None, brackets: DataFrame | None = None) -> DataFrame:
    """One row per group with a column per entry of ``probs`` ({name: p}); without keys one row.

    Null and NaN values, and rows with a null key, don't count. A bracket spans
    about two in ``chunks`` of a group's rows. ``brackets``: keys and _b, if they
    are known already.
    """
    accuracy = accuracy or 3 * chunks
    base = df.select(*keys, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if keys:
        base = base.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    if brackets is None:
        brackets = base.groupBy(*keys).agg(F.percentile_approx("_v", _asked(probs, accuracy), accuracy).alias("_b"))
    # bounds in order; between which neighbours of them a bracket lies
    covers = lambda x, y: F.exists(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: (
        (F.get("_b", 2 * i) <= x) & (F.get("_b", 2 * i + 1) >= y)))
    brackets = brackets.withColumn("_cuts", F.array_sort(F.array_distinct("_b")))
    brackets = cut_lineage(brackets.withColumn("_in", F.transform("_cuts", lambda x, j: (j > 0) & covers(F.get("_cuts", j - 1), x))).drop("_b"))
    few = not keys or brackets.count() <= BROADCAST_GROUPS
    tagged = attach(base, brackets, keys, few, F.col("_v"))
    v = F.col("_v")
    # bounds below the value: comparisons that are compiled, with nulls past the last bound
    segment = sum((F.coalesce((v > F.get("_cuts", F.lit(i))).cast("int"), F.lit(0)) for i in range(2 * len(probs))), F.lit(0))
    tagged = tagged.withColumn("_s", segment)
    inside = F.coalesce((v == F.get("_cuts", F.col("_s"))) | F.get("_in", F.col("_s")), F.lit(False))
    counts = cut_lineage(tagged.groupBy(*keys, "_s", F.when(inside, v).alias("_x"))
                         .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))

    segments = counts.groupBy(*keys, "_s").agg(F.sum("_c").alias("_w"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_w").over(own.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = segments.select(*keys, "_s", before.alias("_before"), F.sum("_w").over(own).alias("_n"), "_rows")
    largest = segments.agg(F.max("_rows")).first()[0] or 0
    # where a segment has rows outside brackets, they come before its bound
    ranked = counts.join(segments.drop("_rows"), [*keys, "_s"]).withColumn("_order", F.coalesce("_x", F.lit(float("-inf"))))
    if largest > WINDOW_ROWS:
        ranked = prefix_sums(ranked, [*keys, "_s"], "_order", ["_c"], chunks=min(10_000, 2 * -(-largest // WINDOW_ROWS)))
        ranked = ranked.withColumn("_upto", F.col("_before") + F.col("_c_before") + F.col("_c"))
    else:
        ranked = ranked.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy("_order")))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))

        def at(rank):
            value = F.coalesce("_x", F.when(rank == F.col("_upto"), F.col("_most")).otherwise(F.col("_least")))
            return F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), value))
        first, second = at(F.floor(pos) + 1), at(F.ceil(pos) + 1)
        part = F.max(pos - F.floor(pos))
        aggs.append(F.when(part > 0, first + part * (second - first)).otherwise(first).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def exact_median(df: DataFrame, keys: list[str], col: str, name: str | None = None, **kw) -> DataFrame:
    return exact_quantiles(df, keys, col, {name or col: 0.5}, **kw)


def quantiles_long(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float], chunks: int = 3334) -> DataFrame:
    """Quantiles of several columns in ONE pass: unpivot to (keys, column, value) and
    group by (keys, column); rows (keys..., column, <prob names>). The sketches of all columns are one aggregate."""
    values = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    if keys:
        values = values.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    some = lambda i: F.when(~F.isnan(f"_v{i}"), F.col(f"_v{i}"))
    sketch = values.groupBy(*keys).agg(*[F.percentile_approx(some(i), _asked(probs, 3 * chunks), 3 * chunks).alias(f"_b{i}") for i in range(len(cols))])
    pick = lambda what: F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{what}{i}").alias("x")) for i, c in enumerate(cols)])).alias("_e")
    brackets = sketch.select(*keys, pick("_b")).select(*keys, "_e.column", F.col("_e.x").alias("_b")).where(F.col("_b").isNotNull())
    long = values.select(*keys, pick("_v")).select(*keys, "_e.column", F.col("_e.x").alias("_val"))
    return exact_quantiles(long, [*keys, "column"], "_val", probs, chunks, brackets=brackets)


def exact_medians(df: DataFrame, keys: list[str], cols: list[str], **kw) -> DataFrame:
    """Median of several columns per group: one quantile pass, pivoted back to one column each."""
    long = quantiles_long(df, keys, cols, {"_median": 0.5}, **kw)
    return long.groupBy(*keys).pivot("column", list(cols)).agg(F.first("_median"))


def prefix_sums(df: DataFrame, keys: list[str], order_col: str, sum_cols: list[str],
                chunks: int = 64, accuracy: int = 10000) -> DataFrame:
    """Add ``<c>_before`` = sum of c over rows of the same group with a smaller ``order_col``.

    ``df`` should already be aggregated to one row per (group, order value).  Each
    group is cut into chunks at approximate quantiles: a window over <= ``chunks``
    rows per group plus windows over (group, chunk) slices, never a window over a
    whole group or a global window on one task.
    """
    cut_probs = [i / chunks for i in range(1, chunks)]
    cuts = cut_lineage(df.groupBy(*keys).agg(F.percentile_approx(order_col, cut_probs, accuracy).alias("_cuts")))
    few = not keys or cuts.count() <= BROADCAST_GROUPS
    tagged = attach(df, cuts, keys, few, F.col(order_col))
    tagged = tagged.withColumn("_chunk", F.size(F.filter("_cuts", lambda x: x < F.col(order_col)))).drop("_cuts")
    per_chunk = tagged.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_cs_{c}") for c in sum_cols])
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_cs_{c}").over(wk), F.lit(0)).alias(f"_cb_{c}") for c in sum_cols])
    wc = Window.partitionBy(*keys, "_chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(before, on=[*keys, "_chunk"], how="inner")
    return out.select(*[F.col(c) for c in tagged.columns if c != "_chunk"], *[
        (F.col(f"_cb_{c}") + F.coalesce(F.sum(c).over(wc), F.lit(0))).alias(f"{c}_before") for c in sum_cols])


def hash_rank(df: DataFrame, strata: list[str], key: str, seed: int, rank_col: str = "_rank",
              n_col: str = "_n", prefix_hex: int = 3) -> DataFrame:
    """Rank rows inside each stratum by ``md5(key|seed)`` (1-based) and attach the stratum size.

    The md5 prefix splits every stratum into 16**prefix_hex slices, so even a
    stratum with a third of all rows is ranked by many tasks in parallel.
    The order equals ``ORDER BY md5(key || '|' || seed), key`` in SQL.
    """
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    d = df.withColumn("_h", h).withColumn("_chunk", F.conv(F.substring("_h", 1, prefix_hex), 16, 10).cast("int"))
    per = d.groupBy(*strata, "_chunk").agg(F.count(F.lit(1)).alias("_cc"))
    wk = Window.partitionBy(*strata)
    before = per.select(*strata, "_chunk",
                        F.coalesce(F.sum("_cc").over(wk.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
                                   F.lit(0)).alias("_before"),
                        F.sum("_cc").over(wk).alias(n_col))
    wc = Window.partitionBy(*strata, "_chunk").orderBy("_h", key)
    out = d.join(before, on=[*strata, "_chunk"], how="inner")
    return out.withColumn(rank_col, F.col("_before") + F.row_number().over(wc)).drop("_h", "_chunk", "_before")
