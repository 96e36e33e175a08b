"""Sharding by sampled splitters: shards of near equal bytes, cut from the documents in the order of their texts' hashes.

Keys are drawn with a chance in proportion to their size, quantiles of the sample bound the ranges, and ranges that come out overfull are drawn from
again and subdivided, so each range is a fair piece of work.  Within a range records are sorted and summed up; the totals of the
ranges before give each record its place in all bytes, and the place gives its shard.  So shards hang on the data alone, not on the sample:
another sample, another number of ranges or a task that runs again gives the same shards.

Equal texts lie side by side.  A group of them stays in one shard if it is a small part of one; larger groups are cut, by document, like all else.
DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, written

#: Bytes that a record counts besides its text.
OVERHEAD = 16
#: Groups of equal texts of less than one part in so many of a shard stay whole: there can't be more than shards times this many larger ones.
WHOLE = 20
#: Sampled keys for each range.
DRAWS = 64
_ID0 = -(1 << 63)


def _hashable(docs: DataFrame) -> list[Column]:
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema.fields]


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """A record's key: 60 bits of its text's MD5 (-1 for a null text), its id (null first), a hash of all its columns."""
    text = F.col(f"`{text_col}`").cast("string")
    th = F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))
    return [th, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_ID0)), F.xxhash64(*_hashable(docs))]


def _range_of(bounds: list[tuple]) -> Column:
    """The number of bounds at or below a row's (th, doc, rh), by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([dict(zip(("th", "doc", "rh"), b)) for b in bounds])), "array<struct<th: long, doc: long, rh: long>>")
    key = F.struct("th", "doc", "rh")

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(table, mid) <= key
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~above, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])


def _draw(rows: DataFrame, chance: Column, cut: Column, salt: int) -> list[tuple]:
    """Sampled keys in order, each with the weight that it stands for; a key whose chance is one or more is always among them."""
    u = F.pmod(F.xxhash64("rh", "th", F.lit(salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = rows.withColumn("p", chance).where(u < F.col("p"))
    whole = [F.col("th"), F.when(cut, F.col("doc")).otherwise(F.lit(_ID0)).alias("doc"), F.when(cut, F.col("rh")).otherwise(F.lit(_ID0)).alias("rh")]
    return sorted((r.th, r.doc, r.rh, r.w / min(1.0, r.p)) for r in drawn.select(*whole, "w", "p").collect())


def _quantiles(drawn: list[tuple], n: int) -> list[tuple]:
    """Up to n - 1 keys that part the drawn weight evenly."""
    total, seen, step, out = sum(d[3] for d in drawn), 0.0, 1, set()
    for *key, w in drawn:
        if step < n and seen >= total * step / n:
            out.add(tuple(key))
            step = math.floor(seen * n / total) + 1
        seen += w
    return sorted(out)


def splitters(rows: DataFrame, n_ranges: int, total: int, cut: Column, draws: int = DRAWS) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """(bounds, {range: (bytes, records)}) of rows (th, doc, rh, n, size, w); ranges of more than twice their share are drawn from again and subdivided while that parts them."""
    share = max(1.0, total / n_ranges)
    bounds = _quantiles(_draw(rows, F.col("w") * F.lit(draws / share), cut, 0), n_ranges)
    stuck: set[tuple] = set()
    for salt in range(1, 10):
        ranged = rows.withColumn("range", _range_of(bounds))
        found = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("w").alias("w"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("n")).collect()}
        start = lambda k: bounds[k - 1] if k else None
        over = [k for k, r in found.items() if r.w > 2 * share and start(k) not in stuck]
        if not over or salt == 9:
            break
        again = ranged.where(F.col("range").isin(over))
        drawn = _draw(again, F.col("w") * F.lit(draws / share), cut, salt)
        more, before = set(bounds), len(bounds)
        for k in over:
            lo, hi = (bounds[k - 1] if k else None), (bounds[k] if k < len(bounds) else None)
            mine = [d for d in drawn if (lo is None or d[:3] >= lo) and (hi is None or d[:3] < hi)]
            new = set(_quantiles(mine, math.ceil(found[k].w / share))) - more
            if not new:
                stuck.add(lo)  # one key, or one group that stays whole
            more |= new
        bounds = sorted(more)
        if len(bounds) == before:
            break
    return bounds, {k: (int(r.bytes), int(r.n)) for k, r in found.items()}


def shard_plan(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, th, doc, rh, copy) of every record; shard sizes differ by no more than a record or a small group at either end.

    A size is the text's UTF-8 bytes and ``OVERHEAD``; a null text has no bytes.  Records go in the order of their texts' hashes, null texts first, then ids, null first.
    ``slot`` numbers a shard's records from 0 in that order.  (th, doc, rh) tells records apart but for those that are alike in all columns, which
    ``copy`` numbers from 1: they are counted before they are shuffled, so any number of them is one row of work.  An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark, text = docs.sparkSession, F.col(f"`{text_col}`").cast("string")
    th, doc, rh = _keys(docs, id_col, text_col)
    raw = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), th.alias("th"), doc.alias("doc"), rh.alias("rh"))
    slim = written(raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("n")), "shard-keys")
    total, count = slim.agg(F.sum(F.col("n") * F.col("size")), F.sum("n")).first()
    if not count:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), "th", "doc", "rh", F.lit(1).cast("long").alias("copy"))
    # texts that are a large part of a shard: a bounded number
    large = [r.th for r in slim.groupBy("th").agg(F.sum(F.col("n") * F.col("size")).alias("b")).where(F.col("b") * WHOLE * shards > total).select("th").collect()]
    cut = F.col("th").isin(large) if large else F.lit(False)
    # a row's work is its bytes and a record's usual bytes, so that no range has very many small ones
    rows = slim.withColumn("w", F.col("n") * F.col("size") + F.lit(math.ceil(total / count)))
    keys = rows.count()
    n_ranges = ranges or max(shards, partitions(spark))
    bounds, found = splitters(rows, n_ranges, total + keys * math.ceil(total / count), cut)
    at, place = {}, (0, 0)
    for k in sorted(found):
        at[k], place = place, (place[0] + found[k][0], place[1] + found[k][1])
    firsts = [F.lit([at.get(k, place)[j] for k in range(len(bounds) + 1)]).cast("array<long>") for j in (0, 1)]
    ranged = rows.withColumn("range", _range_of(bounds)).repartitionByRange(max(1, len(bounds) + 1), "range")
    order = Window.partitionBy("range").orderBy("th", "doc", "rh").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "th")
    before = lambda what: F.coalesce(F.sum(what).over(order), F.lit(0))
    t = ranged.withColumn("b0", before(F.col("n") * F.col("size")) + F.get(firsts[0], F.col("range"))).withColumn("r0", before("n") + F.get(firsts[1], F.col("range")))
    t = t.withColumn("g0", F.min("b0").over(group)).withColumn("g", F.sum(F.col("n") * F.col("size")).over(group))
    t = t.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    # twice the middle of what goes as one
    middle = F.when(cut, 2 * (F.col("b0") + (F.col("copy") - 1) * F.col("size")) + F.col("size")).otherwise(2 * F.col("g0") + F.col("g"))
    placed = t.withColumn("middle", middle * shards).select("doc_id", "size", "text_crc32", F.expr(f"cast(middle div {2 * total} as int)").alias("shard"), (F.col("r0") + F.col("copy") - 1).alias("nth"), "th", "doc", "rh", "copy")
    placed = written(placed, "shards")
    discard(slim)
    first = {r.shard: r.nth for r in placed.groupBy("shard").agg(F.min("nth").alias("nth")).collect()}  # a row for each shard
    start = F.lit([first.get(k, 0) for k in range(shards)]).cast("array<long>")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.get(start, F.col("shard"))).alias("slot"), "th", "doc", "rh", "copy")


def write_shards(docs: DataFrame, path: str, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs' rows, all columns, as a Parquet table in folders ``shard=k`` of files whose rows are in the order of their ``slot``, which is a column; docs has no column of either name."""
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs already has a column shard or slot")
    plan = shard_plan(docs, shards, id_col=id_col, text_col=text_col)
    names, tag = docs.columns, "__shard_"
    keyed = docs.select("*", *[k.alias(tag + n) for k, n in zip(_keys(docs, id_col, text_col), ("th", "doc", "rh"))])
    p = plan.select(*[F.col(c).alias(tag + c) for c in ("th", "doc", "rh", "copy")], "shard", "slot")
    keys = [tag + c for c in ("th", "doc", "rh")]
    again = p.where(F.col(tag + "copy") > 1).select(*keys).distinct()
    alone = keyed.join(again, keys, "left_anti").withColumn(tag + "copy", F.lit(1).cast("long"))
    alike = keyed.join(again, keys, "left_semi").groupBy(*[f"`{c}`" for c in [*names, *keys]]).agg(F.count(F.lit(1)).alias(tag + "n"))
    alike = alike.withColumn(tag + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(tag + "n")))).drop(tag + "n")
    out = alone.unionByName(alike).join(p, [*keys, tag + "copy"]).select(*[f"`{c}`" for c in names], "shard", "slot")
    out.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sampled_splitters(spark, sf_dir):
    """Shard and slot of all documents in 40 shards of near equal bytes; see ``shard_plan`` for nulls, ties, repeats and empty tables."""
    p = shard_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return p.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS MATERIALIZED (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, coalesce(('0x' || md5(text)[1:15])::BIGINT, -1) AS th,
       xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT)) AS crc FROM documents, tab),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY th, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b0, row_number() OVER (ORDER BY th, doc_id NULLS FIRST) AS nth,
       sum(size) OVER ()::BIGINT AS total, sum(size) OVER (PARTITION BY th)::BIGINT AS g FROM d),
p AS (SELECT *, CASE WHEN g * 800 > total THEN 2 * b0 + size ELSE 2 * min(b0) OVER (PARTITION BY th) + g END * 40 // (2 * total) AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, NULL::INT AS grown_shard FROM p"""
