"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the white-space word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte map that lower-cases A-Z and leaves all else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix), vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M1
        x ^= x >> _U(27)
        x *= _M2
        x ^= x >> _U(31)
    return x


def seeded(seed: int, n: int = 1) -> np.ndarray:
    """n fixed odd 64-bit multipliers drawn from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + _U(seed)) | _U(1)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset a temporary folder stands
    in on a single machine, and a cluster, whose machines would each have their own, is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/lumenframe-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Within, an execution's shuffle files go when it ends, not when the driver's garbage happens to be collected."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


_FOLDERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def folders_open(spark: SparkSession, some: bool):
    """Within, a task that writes to a few folders has a file open in each, so its rows aren't sorted by folder, and spilled, before."""
    before = spark.conf.get(_FOLDERS, "0")
    if some:
        spark.conf.set(_FOLDERS, "8")
    try:
        yield
    finally:
        spark.conf.set(_FOLDERS, before)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, in folders by some columns: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_end(spark), folders_open(spark, bool(by)):
        df.write.partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


_READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Rows that a reader of blobs holds at once.
BLOB_ROWS = 64


@contextlib.contextmanager
def blob_reads(spark: SparkSession):
    """Within, Parquet files are read few rows at a time: of 4,096, the default, with a blob each, a task would hold hundreds of megabytes."""
    before = spark.conf.get(_READ, "4096")
    spark.conf.set(_READ, str(min(int(before), BLOB_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(_READ, before)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path in whichever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t.scratch_path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes of rows that go to a Python worker, and come back, in one Arrow batch.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_BYTES``, so a worker's memory hangs on no number of rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(key, "64m"))
    if not held or not 0 < int(held[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text): other columns, whatever their names, play no part."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, at, data) = len(column), column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space words of many texts at once.

    Returns each word's 64-bit hash, its first byte, its end and n+1 offsets of the texts' words.
    The hash is a polynomial over the bytes modulo 2**64, shifted to the word's own
    origin by the inverse power, then mixed with the length.
    """
    inside = ~SPACE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = (bool(inside[0]), bool(inside[-1])) if len(raw) else (False, False)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    hashes = span_hashes(raw, starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BLOCK = 1 << 16
with np.errstate(over="ignore"):
    _R = _U(0xD1342543DE82EF95)
    _POW = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * _BLOCK, _R, np.uint64))])
    _INV = _U(pow(int(_R), -1, 1 << 64))
    _IPOW = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * _BLOCK, _INV, np.uint64))])


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order of start; equal spans hash alike wherever they lie."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = starts[i]
            j = max(int(np.searchsorted(starts, lo + _BLOCK)), i + 1)
            hi = int(ends[i:j].max())
            if hi - lo > 2 * _BLOCK:  # one very long span somewhere: it goes alone, by pieces
                long = np.flatnonzero(ends[i:j] - starts[i:j] > _BLOCK)
                for k in long + i:
                    out[k] = _long_hash(raw[starts[k] : ends[k]])
                short = np.setdiff1d(np.arange(i, j), long + i)
                if len(short):
                    out[short] = span_hashes(raw, starts[short], ends[short])
            else:
                prefix = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(_BYTE[raw[lo:hi]] * _POW[: hi - lo], out=prefix[1:])
                a, b = starts[i:j] - lo, ends[i:j] - lo
                out[i:j] = _closed((prefix[b] - prefix[a]) * _IPOW[a], b - a)
            i = j
    return out


def _closed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + n.astype(np.uint64) * _GOLD)


def _long_hash(span: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    with np.errstate(over="ignore"):
        for k in range(0, len(span), _BLOCK):
            part = span[k : k + _BLOCK]
            total = (total + scale * int((_BYTE[part] * _POW[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
            scale = scale * int(_POW[_BLOCK]) % (1 << 64)
    return _closed(np.array([total], np.uint64), np.array([len(span)]))[0]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, and n+1 offsets.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    counts = np.diff(offsets)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(over="ignore"):
        mult = seeded(7, width)
        if len(words) >= width:
            m = len(words) - width + 1
            acc = np.zeros(m, np.uint64)
            for k in range(width):
                acc += mix(words[k : k + m] + mult[k])
            acc = mix(acc)
        else:
            acc = np.zeros(0, np.uint64)
        full = counts >= width
        take = np.repeat(offsets[:-1] - out_at[:-1], n) + np.arange(out_at[-1])
        out = np.zeros(out_at[-1], np.uint64)
        of_full = np.repeat(full, n)
        out[of_full] = acc[take[of_full]]
        for i in np.flatnonzero(~full & (counts > 0)):
            w = words[offsets[i] : offsets[i + 1]]
            out[out_at[i]] = mix(np.array([mix(w + mult[: len(w)]).sum(dtype=np.uint64) + _U(len(w)) * _GOLD], np.uint64))[0]
    return out, out_at


def batches(it, limit: int = 2 << 20, column: int = -1):
    """Arrow batches cut so that each has at most about ``limit`` bytes of one column, the last by default, or one row."""
    for b in it:
        if not b.num_rows:
            continue
        col = b.column(column % b.num_columns)
        if b.nbytes <= limit:
            yield b
            continue
        _, at = string_bytes(col)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def kept_rows(docs: DataFrame, text_col: str, prepare) -> DataFrame:
    """Rows of docs, all columns, whose text a judge keeps; ``prepare()`` makes the judge once a task: (bytes, offsets) -> mask."""
    bounded_batches(docs.sparkSession)
    k = docs.columns.index(text_col)

    def run(it):
        judge = prepare()
        for whole in it:
            for b in batches([whole], 2 << 20, k):
                yield b.filter(pa.array(judge(*string_bytes(b.column(k)))))

    return docs.mapInArrow(run, docs.schema)

