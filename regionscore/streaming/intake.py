"""Structured Streaming forms of the resumable collection, first-wins dedup and
entity-signal steps (R-1…R-3).

* ``stream_intake``: file source with an explicit schema, ``foreachBatch``
  append to a Parquet sink, progress in ``checkpointLocation`` — a rerun
  resumes after the last committed batch, nothing is written twice (the sink
  write for a batch id is idempotent: it overwrites that batch's folder).
* ``stream_dedup``: ``withWatermark`` + ``dropDuplicatesWithinWatermark``;
  state is bounded by the watermark delay.
* ``dedup_with_late``: the same with a side output of the rows that come later
  than the delay allows, which Spark's operator drops without a trace.
* ``stream_signal``: stateful ``groupBy(entity).agg(avg, count)`` in update mode;
  state is one row per entity, and a batch writes the entities that it changed.

Checkpoints and sinks live under the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.session import checkpoint_dir


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def read_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(source_dir)


def stream_intake(df: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Run the stream to completion of the available input (``availableNow``)."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink_path, f"batch={batch_id}"))

    q = (df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_dedup(df: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def dedup_with_late(df: DataFrame, keys: list[str], ts: str, delay: str, sink: str, checkpoint: str) -> None:
    """First row per key to ``sink``/kept, rows behind the watermark to ``sink``/late. Runs over all available input.

    The watermark of a batch is the largest time of the batches before it, less ``delay``. Of a key's rows in a batch
    the least counts, by time and then the other columns; a key that an earlier batch kept is looked for in the hours
    from the watermark's on. Those are the state: kept keys in a folder for each hour of their time, of which a batch
    reads the live ones and removes those that have passed, so that state is bounded by the delay, and the largest time
    so far, which each batch hands to the next. The outputs of a batch are folders of their own, which a replayed batch
    replaces; it reads the state of earlier batches only.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state, marks = os.path.join(sink, "state"), os.path.join(sink, "marks")
        top = spark.read.parquet(os.path.join(marks, f"batch={batch_id - 1}")).first()["mark"] if batch_id else None
        mark = None if top is None else spark.range(1).select(F.lit(top) - F.expr(f"interval {delay}")).first()[0]
        behind = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark), F.lit(False))
        batch.where(behind).write.mode("overwrite").parquet(os.path.join(sink, "late", f"batch={batch_id}"))
        least = F.min(F.struct(F.col(ts).alias("_ts"), *[c for c in batch.columns if c not in (ts, *keys)])).alias("_first")
        fresh = batch.where(~behind).groupBy(*keys).agg(least)
        fresh = fresh.select(*[F.col("_first._ts").alias(c) if c == ts else F.col(c) if c in keys else F.col(f"_first.{c}") for c in batch.columns])
        hour = F.floor(F.unix_timestamp(ts) / 3600)
        if batch_id and _exists(spark, state):
            live = spark.read.parquet(state).where(F.col("_batch") < batch_id)
            if mark is not None:
                live = live.where(F.col("_hour") >= F.floor(F.unix_timestamp(F.lit(mark)) / 3600))
            same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
            fresh = fresh.alias("f").join(live.select(*keys).alias("s"), reduce(lambda x, y: x & y, same), "left_anti")
        kept = os.path.join(sink, "kept", f"batch={batch_id}")
        fresh.write.mode("overwrite").parquet(kept)
        (spark.read.schema(fresh.schema).parquet(kept).where(F.col(ts).isNotNull()).select(*keys, F.lit(batch_id).alias("_batch"), hour.alias("_hour"))
         .write.mode("append").partitionBy("_hour").parquet(state))
        largest = batch.agg(F.max(ts).alias("mark")).select(F.greatest("mark", F.lit(top)).alias("mark") if top is not None else "mark")
        largest.write.mode("overwrite").parquet(os.path.join(marks, f"batch={batch_id}"))
        if mark is not None:  # what no later batch asks for, nor this one if it is run again
            first = spark.range(1).select(F.floor(F.unix_timestamp(F.lit(mark)) / 3600)).first()[0]
            for name in _folders(spark, state):
                if name.startswith("_hour=") and name[6:].lstrip("-").isdigit() and int(name[6:]) < first:
                    _remove(spark, os.path.join(state, name))
        if batch_id > 1:
            _remove(spark, os.path.join(marks, f"batch={batch_id - 2}"))

    q = (df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def _folders(spark: SparkSession, path: str) -> list[str]:
    store, at = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def stream_signal(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def run_to_table(df: DataFrame, mode: str, checkpoint: str, sink_path: str, keys: list[str] | None = None) -> DataFrame:
    """Drive a streaming query over all available input into Parquet and read the result.

    Every batch is a folder of its own. ``update`` mode (aggregates) writes the
    groups that a batch changed, and the last batch's row of each of ``keys`` counts.
    """
    spark = df.sparkSession

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink_path, f"batch={batch_id}"))

    q = (df.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(sink_path)
    if mode == "update":
        rest = [c for c in out.columns if c not in (*keys, "batch")]
        last = F.max_by(F.struct(*rest), "batch").alias("_last")
        return out.groupBy(*keys).agg(last).select(*keys, *[f"_last.{c}" for c in rest])
    return out.drop("batch")


EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stream(spark, sf_dir, EVENTS_SCHEMA, glob="events.parquet")


def intake_events(spark: SparkSession, sf_dir: str, sink: str | None = None, ckpt: str | None = None) -> DataFrame:
    sink = sink or _scratch(spark, "intake-sink")
    ckpt = ckpt or _scratch(spark, "intake-ckpt")
    stream_intake(events_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "ts"), sink, ckpt)
    return spark.read.parquet(sink).drop("batch")


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events_stream(spark, sf_dir).select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"), "ts")
    d = stream_dedup(s, ["user_id", "event_type", "hour"], "ts", "1 hour").select("user_id", "event_type", "hour")
    return run_to_table(d, "append", _scratch(spark, "dedup-ckpt"), _scratch(spark, "dedup-sink"))


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream_signal(events_stream(spark, sf_dir), ["event_type"], "value")
    return run_to_table(s, "update", _scratch(spark, "signal-ckpt"), _scratch(spark, "signal-sink"), ["event_type"])


def late_events(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """The events in four parts, a batch each, of as many files as they have partitions: those that come behind the watermark."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(os.path.join(sf_dir, "events.parquet"))
    source, sink, checkpoint = _scratch(spark, "late-source"), _scratch(spark, "late-sink"), _scratch(spark, "late-ckpt")
    for k in range(4):  # a run takes the files that came since the last
        events.where(F.col("event_id") % 4 == k).write.mode("append").parquet(source)
        stream = read_stream(spark, source, EVENTS_SCHEMA).withColumn("hour", F.date_trunc("hour", "ts"))
        dedup_with_late(stream, ["user_id", "event_type", "hour"], "ts", delay, sink, checkpoint)
    both = [spark.read.parquet(os.path.join(sink, side)).select("event_id", "user_id", "event_type", "hour", F.lit(side).alias("side"))
            for side in ("kept", "late")]
    return both[0].unionByName(both[1])
