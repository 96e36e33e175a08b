"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised bytewise (A-Z lower-cased, every other ASCII character that is no
digit or letter a separator) into words joined by single spaces.  The automaton
holds each benchmark item's windows of consecutive words, as numbers of words; a text is scanned once, and the
places of matches are mapped to byte spans of the original.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, discard, identified, kept_rows, string_bytes, written

#: Nodes that one automaton may have, about 50 bytes each; benchmarks of more are scanned in blocks.
AUTOMATON_NODES = 4 << 20
#: Windows of one item that stay together; longer items are cut, so that blocks can be dealt evenly.
PIECE_WINDOWS = 4096

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


#: Characters of a word number, and those of a word that no item has.
_DIGITS, _UNKNOWN = 3, "\xff" * 3


def _digits(number: int) -> str:
    """A word number as three characters from ranges of their own, so a match can't begin within a word; few nodes have more than 64 children to look through."""
    return chr(number & 63) + chr(64 + (number >> 6 & 63)) + chr(256 + (number >> 12))


class Machine:
    """The automaton over word numbers: windows of all items, their lengths and the items that hold them.

    A text is a string of three characters a word; words that no item has look all alike, and no window holds them.
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, str] = {}
        self.lengths: list[int] = []
        self.holders: list[list[str]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for ident, text in items:
            words = [self.numbers.setdefault(w, _digits(len(self.numbers))) for w in words_of(text)]
            for i in range(max(1, len(words) - width + 1) if words else 0):
                held = words[i : i + width]
                part = "".join(held)
                k = self.automaton.get(part, -1)
                if k < 0:
                    k = len(self.lengths)
                    self.automaton.add_word(part, k)
                    self.lengths.append(len(held))
                    self.holders.append([])
                if ident not in self.holders[k][-1:]:
                    self.holders[k].append(ident)
        if self.lengths:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of the text, merged runs [first, last) of hit words, and the sorted ids of items found."""
        words = words_of(text)
        if not self.lengths or not words:
            return len(words), [], []
        number = self.numbers.get
        found = list(self.automaton.iter("".join([number(w, _UNKNOWN) for w in words])))
        runs: list[tuple[int, int]] = []
        ends = [((end + 1) // _DIGITS, self.lengths[k]) for end, k in found]
        for first, last in sorted((end - n, end) for end, n in ends):
            if runs and first <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
            else:
                runs.append((first, last))
        return len(words), runs, sorted({x for k in {k for _, k in found} for x in self.holders[k]})


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as [first, last) bytes of the original text."""
    if not runs:
        return []
    flat = np.frombuffer(text.translate(_TO_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flat, [False]])))
    return [(int(edge[2 * a]), int(edge[2 * b - 1])) for a, b in runs]


_SCHEMA = "doc_id long, row_hash long, n_words long, runs array<struct<first:long,last:long>>, spans array<struct<first:long,last:long>>, items array<string>"


def _scanner(items, width: int):
    types = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def run(it):
        machine = Machine(items.value, width)  # built once a task
        pairs = lambda xs: [{"first": a, "last": b} for a, b in xs]
        for b in batches(it):
            raw, at = string_bytes(b.column(2))
            data, n, runs, spans, ids = raw.tobytes(), [], [], [], []
            for i in range(b.num_rows):
                text = data[at[i] : at[i + 1]]
                k, hit, found = machine.scan(text)
                n.append(k)
                runs.append(pairs(hit))
                spans.append(pairs(byte_spans(text, hit)))
                ids.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(runs, pa.list_(types)), pa.array(spans, pa.list_(types)), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "row_hash", "n_words", "runs", "spans", "items"])

    return run


def _merge_runs(column: str):
    return F.expr(
        f"""aggregate(array_sort(flatten(collect_list({column}))), cast(array() as array<struct<first:bigint,last:bigint>>), (a, r) ->
              CASE WHEN size(a) = 0 OR element_at(a, -1).last < r.first THEN array_append(a, r)
                   ELSE array_append(slice(a, 1, size(a) - 1), named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, r.last))) END)"""
    )


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, width: int, nodes: int) -> list:
    """The benchmark's items in blocks of at most about ``nodes`` nodes, each a broadcast of (item, words); one block at least.

    Items are cut into pieces that overlap by one word less than a window, which leaves each window whole.
    """

    def cut(it):
        for b in it:
            out: list[list] = [[], [], [], []]
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                for i in range(0, max(1, len(words) - width + 1) if words else 0, PIECE_WINDOWS):
                    piece = words[i : i + PIECE_WINDOWS + width - 1]
                    for col, v in zip(out, (item, i, b" ".join(piece), _DIGITS * max(1, len(piece) - width + 1) * min(width, len(piece)))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.int64()))], ["item", "at", "words", "nodes"])

    spark = benchmark.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.encode(F.col(f"`{item_text_col}`").cast("string"), "UTF-8").alias("text")).dropna()
    pieces = written(items.mapInArrow(cut, "item string, at long, words binary, nodes long"), "benchmark-pieces")
    total = pieces.agg(F.sum("nodes")).first()[0] or 0
    n = 1 if total <= nodes else 2 * -(-total // nodes)  # hashed blocks are uneven: half-full on average
    blocks = []
    for k in range(n):
        part = pieces.where(F.pmod(F.xxhash64("item", "at"), F.lit(n)) == k)
        blocks.append(spark.sparkContext.broadcast(sorted((r.item, bytes(r.words)) for r in part.select("item", "words").collect())))
    discard(pieces)
    return blocks


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, automaton_nodes: int = AUTOMATON_NODES) -> DataFrame:
    """(doc_id, n_words, runs, spans, items) of every row of docs.

    ``runs`` are maximal runs [first, last) of hit words, ``spans`` the same as bytes of the
    original UTF-8 text, ``items`` the sorted ids of items with a window in the text.
    An item of fewer than ``width`` words, but not none, is one window.  Null and empty texts have
    no words; null item texts no window, null item ids none either.  Repeated rows each get a row;
    an empty benchmark hits nothing.

    An automaton has at most about ``automaton_nodes`` nodes, three for each word of each window at most; a larger benchmark
    comes in blocks, each with an automaton and a scan of its own, and the hits are merged.
    """
    d = identified(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    scans = [d.mapInArrow(_scanner(items, width), _SCHEMA) for items in _blocks(benchmark, item_col, item_text_col, width, automaton_nodes)]
    if len(scans) == 1:
        return scans[0].drop("row_hash")
    parts = scans[0].withColumn("block", F.lit(0))
    for k, part in enumerate(scans[1:], 1):
        parts = parts.unionByName(part.withColumn("block", F.lit(k)))
    # repeated rows are told once by each block, then there are as many rows of a document as blocks
    once = parts.groupBy("doc_id", "row_hash", "block").agg(*[F.first(c).alias(c) for c in ("n_words", "runs", "spans", "items")], F.count(F.lit(1)).cast("int").alias("copies"))
    merged = once.groupBy("doc_id", "row_hash").agg(F.max("n_words").alias("n_words"), _merge_runs("runs").alias("runs"), _merge_runs("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies"))
    return merged.select("doc_id", "n_words", "runs", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("c")).drop("c")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, automaton_nodes: int = AUTOMATON_NODES) -> DataFrame:
    """docs without the rows that have a window of a benchmark item; all columns stay.  Larger benchmarks are applied in blocks, one after another."""
    for items in _blocks(benchmark, item_col, item_text_col, width, automaton_nodes):
        docs = kept_rows(docs, text_col, lambda items=items: _clean(Machine(items.value, width)))
    return docs


def _clean(machine: Machine):
    def judge(raw, at):
        data = raw.tobytes()
        return np.array([not machine.scan(data[a:z])[1] for a, z in zip(at[:-1].tolist(), at[1:].tolist())], bool)

    return judge


def op3_decontamination(spark, sf_dir):
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w, least(len(ws), 10) AS n
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM
          (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
           FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)) d
        JOIN win w ON d.w = w.w AND d.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
