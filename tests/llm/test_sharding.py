"""Shards by sampled splitters against a plain cut of all records in order."""

import hashlib
import random
import zlib

import pytest

from lumenframe.llm import sharding


def plain(rows, shards):
    """Sorted (doc_id, size, crc, shard, slot): records in order of hash and id, cut by the middle of what stays together."""
    key = lambda r: (-1 if r[1] is None else int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0)
    recs = [(key(r)[0], r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in sorted(rows, key=key)]
    total, groups = sum(r[2] for r in recs), {}
    for r in recs:
        groups[r[0]] = groups.get(r[0], 0) + r[2]
    out, at, first, slots = [], 0, {}, {}
    for th, doc, size, crc in recs:
        first.setdefault(th, at)
        middle = 2 * at + size if groups[th] * sharding.WHOLE * shards > total else 2 * first[th] + groups[th]
        shard = middle * shards // (2 * total)
        out.append((str(doc), size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    return sorted(out)


def got(plan):
    return sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in plan.collect())


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abcdé \n") for _ in range(r.randint(0, 300)))) for i in range(400)]
    rows += [(1000 + i, "the same text " * 9) for i in range(300)]  # a group of a third of all bytes
    rows += [(2000 + i, "") for i in range(250)] + [(3000 + i, None) for i in range(40)]  # very many small records
    rows += [(5, "like in all columns " * 20)] * 200 + [(None, "no id")] * 30 + [(None, None)]
    rows += [(4000 + i, t) for i in range(60) for t in (f"pair {i} " * r.randint(1, 9),) for _ in (0, 1)]
    rows += [(5000, "very long " * 9000)]
    r.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, size long, th long, rh long, n int, w int, copy int, range int, middle int, m map<string,int>"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1, 1, 1, 1, {"a": 1}) for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("shards,ranges,draws", [(40, None, 64), (7, 3, 64), (1, None, 64), (40, 60, 2), (300, 13, 1)])
def test_any_sample_gives_the_same_shards(spark, monkeypatch, shards, ranges, draws):
    monkeypatch.setattr(sharding, "_draw", lambda rows, chance, cut, salt, f=sharding._draw: f(rows, chance * draws / 64, cut, salt))
    rows = corpus(1)
    plan = sharding.shard_plan(table(spark, rows), shards, ranges=ranges)
    assert plan.columns[:5] == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert got(plan) == plain(rows, shards)


def test_sizes_are_near_equal_and_small_groups_whole(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randint(0, 60) + str(i)) for i in range(3000)] + [(9000 + i, "copy " * 20) for i in range(1500)] + [(20000 + i, f"twin {i % 90}") for i in range(180)]
    plan = sharding.shard_plan(table(spark, rows), 40).cache()
    sizes = [x.b for x in plan.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * max(120, sum(sizes) / 40 / sharding.WHOLE)
    assert all(len({x.shard for x in plan.where(f"doc_id >= 20000 AND doc_id % 90 = {k}").collect()}) == 1 for k in (0, 7, 89))


def test_overfull_ranges_are_subdivided(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.xxhash64("id").alias("th"), F.lit(0).cast("long").alias("doc"), F.col("id").alias("rh"), F.lit(1).cast("long").alias("n"), F.lit(10).cast("long").alias("size"), F.lit(10).cast("long").alias("w"))
    bounds, found = sharding.splitters(rows, 40, 40_000, F.lit(False), draws=0.5)  # twenty samples bound no forty ranges
    assert sum(b for b, _ in found.values()) == 40_000 and max(b for b, _ in found.values()) <= 4_000 and len(bounds) >= 20


def test_empty_table(spark):
    assert sharding.shard_plan(table(spark, []), 40).count() == 0


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows = corpus(2)
    docs = table(spark, rows)
    sharding.write_shards(docs, f"file://{tmp_path}/s", 8)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted((str(r.doc_id), str(r.text)) for r in back.collect()) == sorted((str(i), str(t)) for i, t in rows)
    mine = lambda r: (str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), r.shard, r.slot)
    assert sorted(map(mine, back.collect())) == plain(rows, 8)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumnRenamed("w", "slot"), f"file://{tmp_path}/t", 8)
