"""Dedup with late rows in batches, against a plain walk over them."""

import datetime as dt
import os
import random

import pytest

from regionscore.streaming import intake as ST

SCHEMA = "event_id long, user string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def brute(batches):
    top, kept, late = None, {}, []
    for batch in batches:
        mark = None if top is None else top - dt.timedelta(hours=1)
        fresh = [r for r in batch if mark is None or r[2] is None or r[2] >= mark]
        late += [r[0] for r in batch if r not in fresh]
        live = mark and mark.replace(minute=0, second=0, microsecond=0)
        first = {}
        for r in sorted(fresh, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
            first.setdefault(r[1], r)
        for user, r in first.items():
            if not any(k[1] == user and k[2] is not None and (live is None or k[2] >= live) for k in kept.values()):
                kept[r[0]] = r
        times = [r[2] for r in batch if r[2] is not None]
        top = max([t for t in [top, *times] if t is not None], default=None)
    return sorted(kept), sorted(late)


@pytest.mark.parametrize("seed,files", [(1, 1), (1, 5), (2, 3)])
def test_equal_a_walk_over_the_batches(spark, tmp_path, seed, files):
    rng, batches = random.Random(seed), []
    for b in range(5):
        batches.append([(b * 100 + i, rng.choice("abcdefgh") if rng.random() < 0.9 else None,
                         START + dt.timedelta(minutes=b * 40 + rng.randrange(-90, 60)) if rng.random() < 0.95 else None) for i in range(25)])
    source, sink, checkpoint = (str(tmp_path / x) for x in ("source", "sink", "ckpt"))
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).repartition(files).write.mode("append").parquet(source)
        ST.dedup_with_late(ST.read_stream(spark, source, SCHEMA), ["user"], "ts", "1 hour", sink, checkpoint)
    got = tuple(sorted(r.event_id for r in spark.read.parquet(os.path.join(sink, side)).collect()) for side in ("kept", "late"))
    assert got == brute(batches)
    hours = [n for n in os.listdir(os.path.join(sink, "state")) if n.startswith("_hour=")]
    assert 0 < len(hours) <= 4 and len([n for n in os.listdir(os.path.join(sink, "marks")) if n.startswith("batch=")]) == 2
