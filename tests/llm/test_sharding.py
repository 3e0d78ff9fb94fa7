"""Shards against a plain running sum, with hot ids and texts, and files read back in order."""

import zlib

from regionscore.llm.sharding import ROW_BYTES, assign_shards, write_shards

SCHEMA = "doc_id long, text string, shard string, slot int, `a.b` string, size int"


def brute(rows, shards):
    """doc_id, size, crc, shard, slot of rows in order."""
    keyed = []
    for doc_id, text in rows:
        data = (text or "").encode()
        keyed.append((doc_id is None, doc_id or 0, len(data) + ROW_BYTES, zlib.crc32(data), doc_id))
    keyed.sort(key=lambda r: r[:4])
    total, before, slots, out = sum(r[2] for r in keyed), 0, {}, []
    for _, _, size, crc, doc_id in keyed:
        shard = (2 * before + size) * shards // (2 * total)
        before += size
        slots[shard] = slots.get(shard, -1) + 1
        out.append((str(doc_id), size, crc, shard, slots[shard]))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "dot", 7) for i, t in rows], SCHEMA).repartition(5)


def found(df):
    return sorted((str(r.row.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in df.collect())


def test_equal_a_running_sum(spark):
    rows = [(i, None if i % 17 == 0 else "é" * (i * 7919 % 300)) for i in range(400)]
    rows += [(5, "same text")] * 300 + [(None, "same text")] * 300 + [(None, None), (None, ""), (3, ""), (9, "x" * 50_000)]
    for shards in (1, 7, 24):
        got = found(assign_shards(table(spark, rows), shards))
        assert got == brute(rows, shards)
    sizes = {}
    for _, size, _, shard, _ in got:
        sizes[shard] = sizes.get(shard, 0) + size
    target = sum(sizes.values()) / 24
    assert all(abs(v - target) <= 50_008 for v in sizes.values())


def test_few_rows_none_and_long_ones(spark):
    assert assign_shards(table(spark, [])).count() == 0
    assert found(assign_shards(table(spark, [(1, None)]))) == [("1", ROW_BYTES, 0, 12, 0)]
    rows = [(1, "a"), (2, "b" * 100_000), (3, "c")]
    got = assign_shards(table(spark, rows))
    assert found(got) == brute(rows, 24)
    assert got.first().row.asDict()["a.b"] == "dot"
    assert assign_shards(table(spark, rows), carry=["doc_id"]).first().row.asDict().keys() == {"doc_id"}


def test_files_hold_slots_in_order(spark, tmp_path):
    rows = [(i, "word " * (i % 50)) for i in range(300)]
    name = write_shards(table(spark, rows), str(tmp_path / "out"), 5)
    assert name == "_shard"
    read = spark.read.parquet(str(tmp_path / "out"))
    assert {c for c in read.columns if c != name} == {"doc_id", "text", "shard", "slot", "a.b", "size"}
    at = {(int(i), s): k for i, _, _, s, k in brute(rows, 5)}
    for shard in range(5):
        ids = []
        for f in sorted((tmp_path / "out" / f"_shard={shard}").glob("*.parquet")):
            ids += [r.doc_id for r in spark.read.parquet(str(f)).collect()]
        assert [at[i, shard] for i in ids] == list(range(len(ids)))
    assert read.count() == len(rows)
