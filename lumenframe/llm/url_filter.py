"""URL filtering: a blocked Bloom filter before an exact hash join.

The list has canonical URLs: a host (which also covers its subdomains) and the start of a
path.  A page's URL stands for a bounded set of keys, each of its host's suffixes
with each start of its path that is as long as some listed path.  The keys are
tested against a blocked Bloom filter (all bits of a key lie in one 512-bit block);
the few that pass are joined with the list, which removes false positives.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, written

#: Bytes of the Bloom filter at most: 16 bits a key up to 2^24 listed URLs, fewer a key beyond.
FILTER_BYTES = 32 << 20
#: 64-bit words of the filter that one row brings to the driver, at most.
_SEGMENT = 1 << 15
#: Bytes of listed URLs that may be broadcast for the exact join; larger lists are shuffled by key.
BROADCAST_BYTES = 8 << 20
#: Page keys of one listed URL that may meet in one place of the shuffled join, and listed URLs at most that are dealt to several places.
CROWD, CROWDED = 1 << 16, 1 << 18
_U = np.uint64


class BlockedBloom:
    """Blocked Bloom filter over 64-bit keys."""

    def __init__(self, blocks: int, probes: int):
        self.probes, self.mask, self.words = probes, _U(blocks - 1), np.zeros(blocks * 8, np.uint64)

    @classmethod
    def sized(cls, n: int, bits_per_key: int = 16, most: int = FILTER_BYTES) -> "BlockedBloom":
        """An empty filter for n keys in at most ``most`` bytes; with fewer bits a key it has fewer probes and lets more pass."""
        blocks = 1
        while blocks * 512 < n * bits_per_key and blocks * 128 <= most:
            blocks *= 2
        return cls(blocks, int(min(8, max(1, round(0.69 * blocks * 512 / max(1, n))))))

    def add(self, keys: np.ndarray) -> None:
        for at, bit in self._places(keys.astype(np.uint64)):
            np.bitwise_or.at(self.words, at, bit)

    def _places(self, keys: np.ndarray):
        h = mix(keys)
        block = ((h & self.mask) << _U(3)).astype(np.int64)
        g = mix(h ^ _U(0x5851F42D4C957F2D))
        for i in range(self.probes):
            if i == 7:
                g = mix(g)
            place = (g >> _U(9 * (i % 7))) & _U(511)
            yield block + (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63))

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key]).astype(np.uint64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at, bit in self._places(keys):
            out &= (self.words[at] & bit) != 0
        return out


def bloom_of(keys: DataFrame, n: int, most: int = FILTER_BYTES) -> BlockedBloom:
    """The filter of n keys (key long): each key goes to its segment of the filter, tasks set the bits, and only segments come to the driver."""
    out = BlockedBloom.sized(n, most=most)
    blocks, probes, width = len(out.words) // 8, out.probes, min(_SEGMENT, len(out.words))

    def dealt(it):
        part = BlockedBloom(blocks, 1)
        for b in it:
            key = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            (first, _), *_ = part._places(key)
            yield pa.RecordBatch.from_arrays([pa.array(first // width, pa.int64()), b.column(0)], ["segment", "key"])

    def built(it):
        part, seen = BlockedBloom(blocks, probes), set()
        for b in it:
            part.add(b.column(1).to_numpy(zero_copy_only=False))
            seen.update(b.column(0).to_pylist())
        for k in sorted(seen):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.words[k * width : (k + 1) * width].tobytes()], pa.binary())], ["segment", "words"])

    placed = keys.select("key").mapInArrow(dealt, "segment long, key long").repartition("segment")
    for r in placed.mapInArrow(built, "segment long, words binary").toLocalIterator():
        out.words[r.segment * width : (r.segment + 1) * width] |= np.frombuffer(r.words, np.uint64)
    return out


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _dealt(hits: DataFrame, rules: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """hits and rules with a salt each: keys of more than ``crowd`` hits are dealt to several places, and their rules repeated in each; hits without a key are dealt everywhere.

    Keys are counted before they are shuffled.  At most ``CROWDED`` keys are crowded, as there are no more with so many hits each; they are broadcast.
    """
    least = max(crowd, hits.where("key IS NOT NULL").count() // CROWDED)
    crowded = hits.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("key", F.ceil(F.col("n") / least).cast("int").alias("salts"))
    crowded = written(crowded, "url-crowds")
    salts = F.coalesce("salts", F.lit(1))
    places = F.when(F.col("key").isNull(), F.lit(partitions(hits.sparkSession))).otherwise(salts)
    spread = F.pmod(F.xxhash64("url", *[c for c in hits.columns if c.startswith("keep_")]), places).cast("int")
    dealt = hits.join(F.broadcast(crowded), "key", "left").withColumn("salt", spread).drop("salts")
    return dealt, rules.join(F.broadcast(crowded), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")


def filter_urls(pages: DataFrame, listed: DataFrame, *, url_col: str = "url", default: str = "allow", keep: list[str] = (), filter_bytes: int = FILTER_BYTES, broadcast_bytes: int = BROADCAST_BYTES, crowd: int = CROWD) -> DataFrame:
    """(*keep, url, host, path, rule, verdict) of every row of pages.

    ``listed`` has rows (host, path, verdict).  A listed URL fits its host and all
    subdomains where the page's path starts with its path; the longest rule wins (then the one with the longer host, then
    allow before block).  Unlisted pages get ``default``.  Null urls and those without :// have empty
    host and path, fit only rules with an empty host, and are judged like the rest.  Repeated rows
    each get a row; listed rows with nulls are left out; an empty list leaves every page to ``default``.
    """
    spark = pages.sparkSession
    rules = listed.select(F.col("host").cast("string").alias("rule_host"), F.col("path").cast("string").alias("rule_path"), F.col("verdict").cast("string").alias("rule_verdict")).dropna()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("key", F.xxhash64("rule_host", F.lit("\0"), "rule_path"))
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("rule") * 2 + 16).alias("bytes"), F.collect_set(F.char_length("rule_path")).alias("lengths")).first()
    kept = spark.sparkContext.broadcast(bloom_of(rules.select("key"), size.n, filter_bytes))
    names = list(keep)
    rows = pages.select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(names)], F.col(f"`{url_col}`").cast("string").alias("url"))
    ids = [f"keep_{i}" for i in range(len(names))]
    rows = rows.groupBy(*ids, "url").agg(F.count(F.lit(1)).cast("int").alias("copies")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = F.array(*[F.lit(x) for x in sorted(size.lengths or [])]).cast("array<int>")
    starts = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.xxhash64(h, F.lit("\0"), p))))
    rows = rows.withColumn("keys", keys)

    def possible(it):
        """Leaves each row only those of its keys that the filter may hold."""
        for b in it:
            col = b.column(b.num_columns - 1)
            n, flat = col.value_lengths().to_numpy(zero_copy_only=False), col.flatten()
            ok = kept.value.test(flat.to_numpy().astype(np.uint64)) if len(flat) else np.zeros(0, bool)
            left = np.add.reduceat(np.append(ok, False).astype(np.int64), np.cumsum(n) - n) * (n > 0)
            at = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(at, flat.filter(pa.array(ok)))], names=b.schema.names)

    rows = rows.mapInArrow(possible, rows.schema)
    hits = rows.select(*ids, "url", "host", "path", "copies", F.explode_outer("keys").alias("key"))
    if (size.bytes or 0) <= broadcast_bytes:
        exact, same = F.broadcast(rules), ["key"]
    else:
        hits, exact = _dealt(written(hits, "url-hits"), rules, crowd)
        same = ["key", "salt"]
    fits = F.col("path").startswith(F.col("rule_path")) & ((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host"))))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule").alias("n"), F.char_length("rule_host").alias("m"), F.col("rule"), F.col("rule_verdict")))).alias("best")
    equal = functools.reduce(lambda a, b: a & b, [hits[c] == exact[c] for c in same])
    judged = hits.join(exact, equal & fits, "left").groupBy(*ids, "url", "host", "path", "copies").agg(best)
    out = judged.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(i).alias(c) for i, c in zip(ids, names)], "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


#: The query's list: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rules_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def op6_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rules_table(spark), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, p, v)),
q AS (SELECT page_id, row_number() OVER () AS rid, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
j AS (SELECT rid, page_id, host, path, r.h || r.p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(r.h || r.p) DESC NULLS LAST, length(r.h) DESC) AS k
      FROM q LEFT JOIN r ON starts_with(path, r.p) AND (host = r.h OR ends_with(host, '.' || r.h)))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""
