"""Wide-table assembly: N-way full outer joins with key hygiene (J-1…J-4, J-6, F-4).

Full outer joins cannot be broadcast and are not reorderable; each one is a
sort-merge join on the key.  Inputs are already one row per key (aggregated),
so the joined sides stay at grain size.  Null / blank keys never match in
Spark (they did in pandas), so they are split off first into a quarantine
output rather than silently merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionscore.functions.keys import is_blank_key


def drop_blank_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows whose keys are null, blank or a null-like spelling go to rejected."""
    bad = reduce(lambda a, b: a | b, [is_blank_key(k) for k in keys])
    return df.where(~bad), df.where(bad)


def outer_assemble(tables: dict[str, DataFrame], keys: list[str] | str,
                   suffix: str = "{col}_{name}") -> DataFrame:
    """Fold ``full_outer`` joins over ``tables`` in order (USING-style keys).

    Only the keys a table has take part in its join (composite-key variant).
    A non-key column already present on the left gets ``suffix`` on the
    right table's copy, e.g. ``price_policy``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    items = list(tables.items())
    out = items[0][1]
    for name, df in items[1:]:
        on = [k for k in keys if k in df.columns and k in out.columns]
        if not on:
            raise ValueError(f"table {name!r} shares no key with the assembled table")
        clash = {c: suffix.format(col=c, name=name) for c in df.columns if c in out.columns and c not in on}
        if clash:
            df = df.withColumnsRenamed(clash)
        out = out.join(df, on=on, how="full_outer")
    return out


def quarantine_report(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Counts of rejected (blank-key) rows per input table."""
    parts = []
    for name, df in tables.items():
        _, rej = drop_blank_keys(df, [k for k in keys if k in df.columns])
        parts.append(rej.agg(F.count(F.lit(1)).alias("n_rejected")).withColumn("table", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts).select("table", "n_rejected")
