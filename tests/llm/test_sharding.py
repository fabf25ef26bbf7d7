"""Contiguous shards against plain running sums."""

import random
import zlib

from podspark.llm import sharding


def brute(rows, shards):
    """(id, text) in order of id, checksum and size, cut where the middle of a document passes an equal share."""
    sized = sorted(((k, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    total, at, slots, out = sum(r[2] for r in sized), 0, [0] * shards, []
    for k, crc, size in sized:
        shard = (2 * at + size) * shards // (2 * total)
        out.append((k, size, crc, "bytes", shard, slots[shard]))
        slots[shard] += 1
        at += size
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shards_equal_running_sums(spark):
    rng = random.Random(4)
    for n, shards in ((1, 8), (5, 8), (300, 8), (400, 3)):
        rows = [(rng.choice([None, rng.randrange(100)]), rng.choice([None, "", "é" * rng.randrange(50), "same text", "w " * rng.randrange(900)])) for _ in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert got(sharding.assign(docs, shards=shards)) == brute(rows, shards)
        assert got(sharding.assign(docs.repartition(3), shards=shards)) == brute(rows, shards)


def test_one_id_in_a_third_of_all_rows_is_spread(spark):
    rows = [(None, "copy of one text")] * 500 + [(7, f"text {k}") for k in range(500)] + [(k, "x" * (k % 90)) for k in range(1000, 1500)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got(found) == brute(rows, 8)
    by = {}
    for r in found.collect():
        by.setdefault(r.shard, []).append(r)
    total = sum(r.size for rs in by.values() for r in rs)
    for rs in by.values():
        assert abs(sum(r.size for r in rs) - total / 8) <= 91 and sorted(r.slot for r in rs) == list(range(len(rs)))


def test_odd_tables(spark):
    assert got(sharding.assign(spark.createDataFrame([], "doc_id bigint, text string"))) == []
    long = "long text " * 300_000
    named = spark.createDataFrame([("b", long, 1, "p"), ("a", "x", 2, "q"), ("a", "x", 2, "q")], "`my.id` string, text string, size int, Shard string")
    assert [(r[0], r.size, r.shard) for r in sharding.assign(named, "my.id", shards=2).orderBy("size").collect()] == [("a", 2, 0), ("a", 2, 0), ("b", 3_000_001, 1)]


def test_written_shards_hold_the_rows(spark, tmp_path):
    rows = [(k, f"text number {k} " * (k % 17), "src", k % 5) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot string, Row int")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4, rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(tuple(r.row) for r in back) == rows
    want = {k: (shard, slot) for k, _, _, _, shard, slot in got(sharding.assign(docs, shards=4))}
    assert all((r.shard, r.slot) == want[r.row.doc_id] for r in back)
    for shard in range(4):
        ids = [r.row.doc_id for r in sorted((r for r in back if r.shard == shard), key=lambda r: r.slot)]
        assert ids == sorted(ids)
