"""Token ids in fixed-width packed blocks.

A table of blocks is the file format: each row is one block of a shard, holding whole documents
in ascending id order.  ``payload`` has every id in the fewest bits that the
vocabulary needs, least significant bit first, so the k-th id of a block is at bit
k * bits: numpy unpacks blocks whole, and any id or range of ids is reached by its block's
offset and a multiplication.  A manifest gives each shard's first position in the corpus.

Texts are tokenised by the tokenizers library.  A batch's texts are cut at places where the byte-level
pre-tokeniser always cuts too (before a lone space or newline between visible characters, after such a
newline, and from an ASCII letter to ASCII punctuation), each distinct piece is encoded once, and the
ids are gathered back by vectorised indexing.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, identified, partitions, shared_path, span_hashes, string_bytes

#: Ids after which a block is closed (at the end of a document).
BLOCK_IDS = 1 << 18
#: Distinct pieces that a worker remembers; beyond, it starts afresh.
CACHE_PIECES = 1 << 20


#: The characters that byte-level vocabularies write for bytes: visible Latin-1 characters for themselves, the others from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b if b in _VISIBLE else 256 + k - len([v for v in _VISIBLE if v < b]) for b, k in zip(range(256), range(256))}


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in ``bits`` bits, least significant bit first; the last byte is filled up with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of 8 ids, so pieces meet at byte ends
        part = ids[i : i + (1 << 16)].astype(np.uint64)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids first to last - 1 of a block, as unsigned 32-bit integers; reads only their bytes."""
    n = last - first
    if n <= 0:
        return np.zeros(0, "<u4")
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    lo = first * bits
    raw = np.frombuffer(payload, np.uint8, (last * bits + 7) // 8 - lo // 8, lo // 8)
    at = lo % 8 + bits * np.arange(n, dtype=np.int64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class PieceEncoder:
    """Ids of whole texts, each distinct piece encoded once."""

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.limit = cache
        self.by_piece = self._joint()
        self._clear()

    def _joint(self) -> bool:
        """Whether pieces may be encoded apart: for byte-level pre-tokenisation only; other vocabularies are encoded text by text."""
        import json

        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE"

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # known pieces' hashes, ascending, and of each the entry
        self.entry = np.zeros(0, np.int64)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Adds unknown pieces: a lone word is one pre-token, which the model encodes itself; others go through the whole tokenizer."""
        flat: list[int] = []
        n = np.zeros(len(pieces), np.int64)
        odd, order = [], []
        tokenize = self.tok.model.tokenize
        for i, p in enumerate(pieces):
            if (p[1:] if p[:1] == b" " else p).decode("utf-8").isalpha():
                got = tokenize(p.decode("latin-1").translate(_BYTE_CHARS))
                flat += [t.id for t in got]
                n[i] = len(got)
                order.append(i)
            else:
                odd.append(i)
        rest = self._ids([pieces[i].decode("utf-8") for i in odd]) if odd else []
        n[odd] = [len(x) for x in rest]
        order = np.array(order + odd, np.int64)
        new_starts = self.starts[-1] + np.concatenate([[0], np.cumsum(n[order])])
        self.flat = np.concatenate([self.flat, np.array(flat, "<u4"), *rest])
        entry = np.empty(len(pieces), np.int64)
        entry[order] = len(self.starts) - 1 + np.arange(len(pieces))
        self.starts = np.concatenate([self.starts, new_starts[1:]])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, at, keys), np.insert(self.entry, at, entry)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return known, at

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and n+1 offsets."""
        data = raw.tobytes()
        if not self.by_piece or any(s in data for s in self.specials):
            got = self._ids([data[a:b].decode("utf-8") for a, b in zip(at[:-1], at[1:])])
            return np.concatenate([*got, np.zeros(0, "<u4")]), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        cuts = piece_cuts(raw, at)
        if not len(cuts):
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        ends = np.append(cuts[1:], len(raw))
        hashes = span_hashes(raw, cuts, ends)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._clear()
        new = np.flatnonzero(~self._find(keys)[0])
        if len(new):
            a, b = cuts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(keys[new], [data[x:y] for x, y in zip(a, b)])
        entry = self.entry[self._find(keys)[1]][back]
        lo = self.starts[entry]
        n = self.starts[entry + 1] - lo
        out_at = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(lo - out_at[:-1], n) + np.arange(out_at[-1])]
        return ids, out_at[np.searchsorted(cuts, at)]


def piece_cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of pieces: starts of texts and places where the pre-tokeniser always cuts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    pad = np.concatenate([np.full(3, 32, np.uint8), raw, np.full(2, 32, np.uint8)])
    p3, p2, p1, c, nx = pad[:n], pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3], pad[4 : n + 4]
    # a byte that surely ends a visible character: visible ASCII, or the last byte of a character whose lead byte starts no Unicode space
    ends_visible = (p1 > 32) & (p1 < 127) | (p1 >= 128) & ((p2 >= 0xC3) & (p2 <= 0xDF) | (p2 >= 128) & (p2 < 0xC0) & ((p3 == 0xE0) | (p3 >= 0xE4) & (p3 <= 0xEF)))
    starts_visible = (nx > 32) & (nx < 127) | (nx >= 0xC3) & (nx != 0xE1) & (nx != 0xE2) & (nx != 0xE3)
    lone = ((c == 32) | (c == 10)) & ends_visible & starts_visible
    cut = lone.copy()
    cut[1:] |= lone[:-1] & (c[:-1] == 10)
    letter = (p1 >= 97) & (p1 <= 122) | (p1 >= 65) & (p1 <= 90)
    cut |= letter & ((c > 32) & (c < 48) | (c >= 58) & (c < 65) | (c >= 91) & (c < 97) | (c >= 123) & (c < 127))
    heads = at[:-1][at[:-1] < at[1:]]
    inner = at[1:-1]
    for off in (0, 1, -1):  # what a cut sees must lie in its own text; near an end, only the end itself cuts
        k = inner + off
        cut[k[(k >= 0) & (k < n)]] = False
    cut[heads] = True
    return np.flatnonzero(cut)


_BLOCKS = "shard int, block int, first long, n_ids long, bits int, doc_ids array<long>, lengths array<long>, payload binary"


def _writer(path: str, bits: int, end_id: int | None, block_ids: int):
    def run(it):
        from pyspark import TaskContext

        enc, shard, block, first = PieceEncoder(path), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ids_of, lengths, n = [], [], 0

        def close():
            ids = np.concatenate([*held, np.zeros(0, "<u4")])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([bits], pa.int32()), pa.array([ids_of], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(ids, bits)], pa.binary())],
                ["shard", "block", "first", "n_ids", "bits", "doc_ids", "lengths", "payload"],
            )

        for b in batches(it):
            raw, at = string_bytes(b.column(1))
            ids, cut = enc.encode(raw, at)
            if end_id is not None:
                ids, cut = np.insert(ids, cut[1:], end_id).astype("<u4"), cut + np.arange(len(cut))
            for k, doc in enumerate(b.column(0).to_pylist()):
                held.append(ids[cut[k] : cut[k + 1]])
                ids_of.append(doc)
                lengths.append(int(cut[k + 1] - cut[k]))
                n += lengths[-1]
                if n >= block_ids:
                    yield close()
                    held, ids_of, lengths, block, first, n = [], [], [], block + 1, first + n, 0
        if ids_of:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, end_id: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Writes docs' ids under path: ``blocks`` and, of one row a shard, ``manifest``.

    Documents are in ascending id order over all shards (null ids first; ties by a hash of the text).
    Null texts are empty; an empty text has only ``end_id``, or nothing where that is None.  Repeated rows are
    written each.  An empty table gives no blocks.  A lost executor's shard is written again, alike.
    """
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1)
    spark = docs.sparkSession
    d = identified(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    dealt = d.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(_writer(tokenizer, bits_for(vocabulary), end_id, block_ids), _BLOCKS).write.parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # a shard's base sums up the shards before it: as many rows as there are shards
    bases = shards.selectExpr("shard", "n_ids", "sum(n_ids) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_ids AS base")
    bases.coalesce(1).write.parquet(f"{path}/manifest")


_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _digest(it):
    for b in it:
        out: list[list] = [[], [], [], []]
        for row in b.to_pylist():
            ids, at = unpack(row["payload"], row["bits"], 0, row["n_ids"]), 0
            for doc, n in zip(row["doc_ids"], row["lengths"]):
                for col, v in zip(out, (doc, row["base"] + row["first"] + at, n, zlib.crc32(ids[at : at + n].tobytes()))):
                    col.append(v)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    blocks, manifest = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/manifest").select("shard", "base")
    # the manifest has a row of 12 bytes for each written shard
    return blocks.join(F.broadcast(manifest), "shard").mapInArrow(_digest, _DOCS)


def _whole(it):
    for b in it:
        rows: list[list] = [[], [], []]
        for row in b.to_pylist():
            ids, at = unpack(row["payload"], row["bits"], 0, row["n_ids"]), 0
            for doc, n in zip(row["doc_ids"], row["lengths"]):
                for col, v in zip(rows, (doc, row["base"] + row["first"] + at, ids[at : at + n].astype(np.int64))):
                    col.append(v)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64()))], ["doc_id", "start", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files."""
    blocks, manifest = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/manifest").select("shard", "base")
    return blocks.join(F.broadcast(manifest), "shard").mapInArrow(_whole, "doc_id long, start long, ids array<long>")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> np.ndarray:
    """Ids first to last - 1 of the corpus: reads the blocks that hold them, and of those only their bytes."""
    shards = spark.read.parquet(f"{path}/manifest").where((F.col("base") < last) & (F.col("base") + F.col("n_ids") > first)).collect()
    parts = []
    for s in sorted(shards, key=lambda s: s.base):
        a, b = max(0, first - s.base), min(s.n_ids, last - s.base)
        rows = spark.read.parquet(f"{path}/blocks").where((F.col("shard") == s.shard) & (F.col("first") < b) & (F.col("first") + F.col("n_ids") > a)).select("first", "n_ids", "bits", "payload").orderBy("first").collect()
        parts += [unpack(bytes(r.payload), r.bits, max(0, a - r.first), min(r.n_ids, b - r.first)) for r in rows]
    return np.concatenate([*parts, np.zeros(0, "<u4")])


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50257, end_id=2)
    return read_digests(spark, path)


def op1_token_output(spark, sf_dir):
    return token_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
