"""Indexes of reduced files, and their merge by many tasks at once.

Executors walk the part files, each file in one task, and read the records' heads alone.  What they find is a small table: kept, it lets readers go to
single frames; summed up, it says where each frame lies in the merged file, so tasks copy ranges of frames into place side by side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from . import headers, store
from .readers import RcReader, find

INDEX = "path string, part int, frame_id long, offset long, c1 long, c2 long, packed long"
#: Bytes of a row group of an index: what a reader skips or reads at once.
GROUP_BYTES = 1 << 18
#: Bytes that a merging task holds before it writes them.
COPY_BYTES = 8 << 20
_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_KINDS = [pa.string(), pa.int32()] + [pa.int64()] * 5


def rc_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, frame_id, offset, c1, c2, packed) of every frame of reduced files: where its two streams lie, and how long they are.  Files are walked by the tasks."""
    files = find(path)

    def run(it):
        reader = RcReader({"path": path})
        for b in it:
            for file, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[list] = [[] for _ in _NAMES]
                for slot in reader.slices(file):
                    for col, v in zip(rows, (file, part, *slot)):
                        col.append(v)
                    if len(rows[0]) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _KINDS)], _NAMES)
                        rows = [[] for _ in _NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _KINDS)], _NAMES)

    listed = spark.createDataFrame(list(zip(files, range(len(files)))), "path string, part int")  # a row for each file
    return listed.repartition(len(files)).mapInArrow(run, INDEX)


def write_index(spark: SparkSession, path: str, out: str) -> None:
    """Writes the index of reduced files as a table in ranges of frames, for the ``index`` option of the ``rc`` source."""
    rows = rc_index(spark, path).repartitionByRange(F.col("frame_id")).sortWithinPartitions("frame_id")
    rows.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", 5000).parquet(out)


def merge_files(spark: SparkSession, path: str, out: str, tasks: int | None = None) -> int:
    """Merges part files into the file ``out``, by ``tasks`` tasks at once; returns its number of frames, missing ones included.

    Of a frame in several parts the last part's stays; a missing frame has noughts in the seek table.  The driver writes the header and makes room; each
    task writes its frames' entries and bytes at their places, so a task that runs again writes the same.  The file gets its name
    when the tasks' frames and bytes add up to what was planned.  Works where all tasks mount the store; elsewhere an index of the parts serves as well.
    """
    files = find(path)
    with store.open_read(files[0]) as f:
        head = headers.read_reduced_header(f.read(headers.REDUCED_SIZE))
    level = head["reduction_level"]
    w = 3 if level in (1, 2) else 1
    # of a frame that one part has twice the later record stays, too
    index = layout.merge_parts(rc_index(spark, path).withColumn("nth", F.struct("part", "offset")), "nth").persist()
    placed = layout.prefix_sum(index.withColumn("size", F.col("c1") + F.col("c2")), "frame_id", "size", "place")
    total = index.agg(F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.col("c1") + F.col("c2")).alias("bytes")).first()
    nz = 0 if total["last"] is None else total["last"] + 1
    body = headers.REDUCED_SIZE + 4 * w * nz
    folder, name = out.rstrip("/").rsplit("/", 1)
    store.make_folder(folder)
    hidden = f"{folder}/.{name}.merging"
    store.allocate(hidden, body + (total.bytes or 0))
    store.patch(hidden, 0, headers.write_reduced_header(**{**head, "nz": nz}))

    def run(it):
        n, size, start, held, entries = 0, 0, None, [], []
        source, f = None, None

        def flush():
            store.patch(hidden, body + start, b"".join(held))
            i = 0  # entries of frames that follow one another go at once
            while i < len(entries):
                j = i + 1
                while j < len(entries) and entries[j][0] == entries[j - 1][0] + 1:
                    j += 1
                store.patch(hidden, headers.REDUCED_SIZE + 4 * w * entries[i][0], b"".join(e[1] for e in entries[i:j]))
                i = j

        for b in it:
            for file, frame, at, c1, c2, packed, place in zip(*(c.to_pylist() for c in b.columns)):
                if file != source:
                    if f is not None:
                        f.close()
                    source, f = file, store.open_read(file)
                f.seek(at)
                data = f.read(c1 + c2)
                if len(data) != c1 + c2:
                    raise ValueError(f"{file}: frame {frame} is cut short")
                if start is None:
                    start = place
                held.append(data)
                entries.append((frame, b"".join(int(v).to_bytes(4, "little") for v in (c1, c2, packed)[:w])))
                n, size = n + 1, size + len(data)
                if place + len(data) - start > COPY_BYTES:
                    flush()
                    start, held, entries = None, [], []
        if entries:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["n", "bytes"])

    ranges = placed.select("path", "frame_id", "offset", "c1", "c2", "packed", "place")
    ranges = (ranges.repartitionByRange(tasks, "frame_id") if tasks else ranges.repartitionByRange("frame_id")).sortWithinPartitions("frame_id")
    done = ranges.mapInArrow(run, "n long, bytes long").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    if (done.n or 0, done.bytes or 0) != (total.n, total.bytes or 0) or store.size(hidden) != body + (total.bytes or 0):
        raise RuntimeError(f"merged {done.n} frames of {done.bytes} bytes, not {total.n} of {total.bytes}")
    index.unpersist()
    store.move(hidden, out)
    return nz
