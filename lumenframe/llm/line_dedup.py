"""Line dedup: hashes in key order, per-document keep bitmaps as the result.

Lines' hashes are range-partitioned with document and position as the secondary sort key, and windows that stream over the
sorted ranges tell each key's documents and the one that keeps its lines.  Keys with so large a share of all lines that there can be but
few of them don't travel: their totals are gathered from partial aggregates and broadcast.  What returns to a document is a compressed
bitmap of the lines it keeps: only the 64-line words with a dropped line are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, identified, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"
#: A key with one in so many of all lines is heavy: there can't be more heavy keys than this, of 40 bytes each.
HEAVY = 20_000
#: Rows of a heavy key at least.
LEAST_ROWS = 1024


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: str = "last") -> DataFrame:
    """(doc_id, text_hash, dropped, n_dropped) of each document that loses a line.

    ``dropped`` maps a word's number to 64 bits, one for each line: 1 is dropped; a word
    that is absent keeps all its lines.  Keys of at least ``min_chars`` code points
    in at least ``min_docs`` documents keep their lines only in the document with
    the largest (``keep="last"``) or smallest (``"first"``) id that has them.

    Null and empty texts are one empty line and lose nothing (unless min_chars is 0).  Rows with a
    null id count for no key and lose nothing.  Repeated rows of an id are one document;
    each of its texts has a bitmap of its own, told apart by ``text_hash``.
    """
    d = identified(docs, id_col, text_col).where("doc_id IS NOT NULL")
    lines = (
        d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "text_hash", "pos")
    )
    lines = written(lines, "lines")  # texts are read once; the passes below read hashes
    one = F.max if keep == "last" else F.min
    least = max(LEAST_ROWS, -(-lines.count() // HEAVY))
    heavy = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h1", "h2")
    held = lines.join(F.broadcast(heavy), ["h1", "h2"]).select("h1", "h2", "doc_id").distinct()
    totals = written(held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), one("doc_id").alias("keeper")), "heavy-lines")
    marked = lines.join(F.broadcast(totals), ["h1", "h2"], "left")
    spread = marked.where("keeper IS NOT NULL").select("doc_id", "text_hash", "pos", "n_docs", "keeper")
    # all others of one key lie in one range, sorted by document and position
    runs = marked.where("keeper IS NULL").select("h1", "h2", "doc_id", "text_hash", "pos").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    key = Window.partitionBy("h1", "h2")
    first = F.coalesce(F.col("doc_id") != F.lag("doc_id").over(key.orderBy("doc_id", "text_hash", "pos")), F.lit(True))
    runs = runs.withColumn("first", first.cast("long")).withColumn("n_docs", F.sum("first").over(key)).withColumn("keeper", one("doc_id").over(key))
    lost = spread.unionByName(runs.select("doc_id", "text_hash", "pos", "n_docs", "keeper")).where((F.col("n_docs") >= min_docs) & (F.col("doc_id") != F.col("keeper"))).select("doc_id", "text_hash", "pos")
    words = lost.groupBy("doc_id", "text_hash", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bitmaps = words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
    bitmaps = written(bitmaps, "bitmaps")
    discard(lines, totals)
    return bitmaps


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row, with text rid of the dropped lines."""
    d = identified(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kept = F.expr(r"array_join(filter(lines, (x, i) -> (shiftright(coalesce(try_element_at(dropped, cast(i div 64 as bigint)), 0L), i % 64) & 1L) = 0L), '\n')")
    return (
        d.join(bitmaps, ["doc_id", "text_hash"], "left")
        .withColumn("lines", lines_of(F.col("text")))
        .select(
            "doc_id",
            F.when(F.col("n_dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM s),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, g.keeper IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
