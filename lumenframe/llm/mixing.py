"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output divided by its share
of the input.  Each document's count inverts the Poisson distribution of that mean
at a uniform number hashed from a seed and the document's id; documents are exploded
by their counts and shuffled globally by a hash of id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions

#: Bytes of rate tables that may be broadcast (a table row is at most about 24 bytes and 8 for each count).
BROADCAST_BYTES = 8 << 20


def _hash52(*parts: Column) -> Column:
    """A 52-bit integer from the MD5 of the parts, portable to other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(src, rate, cdf) of each source; the null source is one of its own.

    ``weights`` are target shares by source (sources that it lacks get none); without them
    a source's share is its document count to ``power``.  The output's expected
    size is ``epochs`` times the input's.  ``cdf`` has P(count <= k), up to where
    nothing is left in 52 bits.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("src")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        share = F.pow("n", F.lit(float(power)))
    elif weights:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in (str(kv[0]), float(kv[1]))])
        share = F.when(F.col("src").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(pairs, F.col("src").cast("string")), F.lit(0.0)))
    else:
        share = F.lit(0.0)
    shares = counts.withColumn("w", share)
    total = shares.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    rated = shares.crossJoin(F.broadcast(total)).select("src", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") * float(epochs) / F.col("n")).otherwise(0.0).alias("rate"))  # total is one row
    # log p(k) = -rate + k ln(rate) - ln k!, summed up row by row so that no term under- or overflows and no step copies what came before
    most = F.when(F.col("rate") > 0, F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24)).otherwise(0).cast("int")
    terms = rated.select("src", "rate", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    upto = Window.partitionBy("src").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("rate") <= 0, F.lit(0.0)).when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln("rate") - F.ln("k"))
    summed = terms.withColumn("lp", F.sum(step).over(upto)).withColumn("c", F.sum(F.exp("lp")).over(upto))
    return summed.groupBy("src").agg(F.first("rate").alias("rate"), F.array_sort(F.collect_list(F.struct("k", "c")))["c"].alias("cdf"))


def replicate(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 17, copy_col: str = "copy", shuffle: bool = True) -> DataFrame:
    """docs' rows, each as often as its Poisson count says, in a globally shuffled order.

    All columns stay; ``copy_col`` numbers a row's copies from 1 and must not be a column of docs.
    A row's count hangs on seed, id and its source's rate alone; rows repeating an id
    get the same count each.  A null id hashes as the text "null".  An empty table stays empty.
    """
    if copy_col in docs.columns:
        raise ValueError(f"docs already has a column {copy_col!r}")
    table = rates(docs, source_col, weights, power, epochs)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    names = list(docs.columns)
    src, tag, salt, times, place = fresh(docs, "__mix_src", "__mix_u", "__mix_salt", "__mix_n", "__mix_key")
    left = docs.withColumn(src, F.col(f"`{source_col}`")).withColumn(tag, _hash52(F.lit(str(seed)), ident) / F.lit(float(1 << 52)))
    size = table.agg(F.sum(24 + 8 * F.size("cdf") + F.coalesce(F.octet_length(F.col("src").cast("string")), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = left.join(F.broadcast(table), left[src].eqNullSafe(table["src"]))
    else:  # too many sources: both sides are dealt by source and a salt, so that no large source meets in one task
        salts = partitions(docs.sparkSession)
        left = left.withColumn(salt, F.pmod(F.xxhash64(tag), F.lit(salts)).cast("int"))
        right = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = left.join(right, left[src].eqNullSafe(right["src"]) & (left[salt] == right[salt]))
    # columns are told apart by their tables: docs may have ones called src, rate or cdf
    count = F.size(F.filter(table["cdf"], lambda c: c <= left[tag]))
    out = joined.select(*[left[f"`{c}`"] for c in names], count.alias(times)).where(F.col(times) > 0).select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy_col))
    if not shuffle:
        return out
    key = _hash52(F.lit(f"{seed}/order"), ident, F.col(f"`{copy_col}`").cast("string"))
    return out.withColumn(place, key).sort(place).drop(place)


def op8_mixing(spark, sf_dir):
    return replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(n)) AS aw, sum(n) AS an FROM c),
r AS (SELECT source, sqrt(n) / aw * an / n AS rate FROM c, t),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
      FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::BIGINT)) AS k FROM r)),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT *, ('0x' || md5('17:' || doc_id)[1:13])::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, count(*) AS n FROM d JOIN f ON d.source = f.source AND f.cdf <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, n.n + 1))::INT AS copy FROM d JOIN n USING (doc_id)
"""
