"""Frame files of a folder as a stream: ``seq``, ``mrc`` and raw chunks that a camera leaves there one after another.

Which files a batch takes is decided once and noted in a log before Spark hears of it, so a batch that runs again, also after a restart, has the same files
with the same numbers.  An offset is a number of log entries.  Files go in order of their modification time, or of their names where a camera numbers them; the last ones, which may still be
written to, are held back; a name that was taken once is not taken again.  A file's frames are counted when it is taken, so each frame has its
place in the whole run from the start, and a file is read by as many tasks as it has ranges of frames.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import store
from ..sources.readers import MrcReader, Range, RawReader, SeqReader, natural

CHUNKS = "path string, chunk_id long, index long, frame_id long, pixels binary"
#: Bytes of frames in an Arrow batch.
BATCH_BYTES = 8 << 20
#: Tasks of a batch.
MOST_TASKS = 256
_INNER = {"seq": (SeqReader, ".seq"), "mrc": (MrcReader, ".mrc"), "raw": (RawReader, ".bin")}


@dataclass
class Slice(InputPartition):
    """Frames first to last - 1 of a chunk; ``base`` is the run's number of its first frame."""

    path: str
    chunk: int
    base: int
    first: int
    last: int


@dataclass
class Slices(InputPartition):
    """Slices one after another, read by one task."""

    slices: list


def grouped(slices: list[Slice], most: int = MOST_TASKS) -> list[InputPartition]:
    """The slices themselves or, if they are more than ``most``, so many runs of them with about as many frames each; neighbours in a file are read as one."""
    if len(slices) <= most:
        return slices
    total, before, out = sum(s.last - s.first for s in slices), 0, {}
    for s in slices:
        run = out.setdefault(before * most // max(1, total), [])
        before += s.last - s.first
        if run and (run[-1].path, run[-1].chunk, run[-1].last) == (s.path, s.chunk, s.first):
            run[-1] = Slice(s.path, s.chunk, s.base, run[-1].first, s.last)
        else:
            run.append(s)
    return [Slices(run) for run in out.values()]


class ChunkReader(DataSourceStreamReader):
    """Options: ``path`` (folder), ``log`` (folder of the log, beside the checkpoint), ``kind`` seq, mrc or raw with that source's own options,
    ``suffix``, ``order`` "time" or "name" (2 before 10), ``hold_back`` last files that stay (1), ``skip_first`` files that are passed over (0), ``files_per_batch`` (0: all there are),
    ``frames_per_partition`` (more where a batch would have over MOST_TASKS tasks), ``stop_file``: once it is there no file is held back, so the run's last chunk is taken too, and
    ``clean``: "off", "delete", or "archive" with ``archive`` (folder) for files whose batch is done.
    """

    def __init__(self, options):
        self.options = o = dict(options)
        for key in ("path", "log"):
            if not o.get(key):
                raise ValueError(f"the option {key} is needed")
        kind, suffix = _INNER[o.get("kind", "seq")]
        self.inner, self.suffix = kind(o), o.get("suffix", suffix)
        self.hold, self.skip, self.most = int(o.get("hold_back", 1)), int(o.get("skip_first", 0)), int(o.get("files_per_batch", 0))
        self.by_name = o.get("order", "time") == "name"
        self.step, self.clean = int(o.get("frames_per_partition", 200)), o.get("clean", "off")
        if self.clean not in ("off", "delete", "archive") or (self.clean == "archive" and not o.get("archive")):
            raise ValueError("clean is off, delete or archive, and archive needs a folder")
        self.entries: list[dict] | None = None
        self.cleaned = 0

    def _entry(self, k: int) -> str:
        return store.join(self.options["log"], f"{k:012d}.json")

    def _load(self) -> list[dict]:
        """The log's entries; each holds the number of the next chunk and frame after it."""
        if self.entries is None:
            store.make_folder(self.options["log"])
            self.entries = []
            while store.exists(self._entry(len(self.entries) + 1)):
                self.entries.append(store.read_json(self._entry(len(self.entries) + 1)))
        return self.entries

    def initialOffset(self):
        return {"entry": 0}

    def latestOffset(self):
        entries = self._load()
        taken = {f["path"].rsplit("/", 1)[-1] for e in entries for f in e["files"]} | {n for e in entries for n in e["passed"]}
        there = [(natural(p) if self.by_name else t, p) for p, _, t in store.listing(self.options["path"]) if p.endswith(self.suffix)]
        stop = self.options.get("stop_file")
        hold = 0 if stop and store.exists(stop) else self.hold
        there = sorted(there)[: max(0, len(there) - hold)]
        fresh = [p for _, p in there if p.rsplit("/", 1)[-1] not in taken]
        passed_before = sum(len(e["passed"]) for e in entries)
        passed = [p.rsplit("/", 1)[-1] for p in fresh[: max(0, self.skip - passed_before)]]
        fresh = fresh[len(passed) :]
        fresh = fresh[: self.most] if self.most else fresh
        if fresh or passed:
            chunk, frame = (entries[-1]["next_chunk"], entries[-1]["next_frame"]) if entries else (0, 0)
            files = []
            for path in fresh:
                n = self.inner.count(path)
                files.append({"path": path, "chunk": chunk, "base": frame, "n": n})
                chunk, frame = chunk + 1, frame + n
            entry = {"files": files, "passed": passed, "next_chunk": chunk, "next_frame": frame}
            store.write_json(self._entry(len(entries) + 1), entry)
            entries.append(entry)
        return {"entry": len(entries)}

    def partitions(self, start, end):
        files = [f for e in self._load()[start["entry"] : end["entry"]] for f in e["files"]]
        return grouped([Slice(f["path"], f["chunk"], f["base"], a, min(f["n"], a + self.step)) for f in files for a in range(0, f["n"], self.step)])

    def read(self, partition):
        for p in partition.slices if isinstance(partition, Slices) else [partition]:
            yield from self._slice(p)

    def _slice(self, p):
        rows, size = [], 0
        for _, frame, data in self.inner.frames(Range(p.path, p.first, p.last, p.base)):
            rows.append((frame, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield _batch(p, rows)
                rows, size = [], 0
        if rows:
            yield _batch(p, rows)

    def commit(self, end):
        """Removes or archives the files of entries that are done; what a failure leaves is removed with the next."""
        if self.clean == "off":
            return
        for e in self._load()[self.cleaned : end["entry"]]:
            for f in e["files"]:
                if not store.exists(f["path"]):
                    continue
                if self.clean == "delete":
                    store.delete(f["path"])
                else:
                    store.make_folder(self.options["archive"])
                    store.move(f["path"], store.join(self.options["archive"], f["path"].rsplit("/", 1)[-1]))
        self.cleaned = max(self.cleaned, end["entry"])


def _batch(p: Slice, rows) -> pa.RecordBatch:
    frames = pa.array([f for f, _ in rows], pa.int64())
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([p.path] * n, pa.string()), pa.array([p.chunk] * n, pa.int64()), pa.array([f - p.base for f, _ in rows], pa.int64()), frames, pa.array([d for _, d in rows], pa.binary())],
        ["path", "chunk_id", "index", "frame_id", "pixels"],
    )


class FrameChunks(DataSource):
    @classmethod
    def name(cls):
        return "frame_chunks"

    def schema(self):
        return CHUNKS

    def streamReader(self, schema):
        return ChunkReader(self.options)


def arriving(spark: SparkSession, path: str, log: str, kind: str = "seq", **options) -> DataFrame:
    """A stream of (path, chunk_id, index, frame_id, pixels) of a folder's frame files; see ``ChunkReader`` for the options."""
    spark.dataSource.register(FrameChunks)
    r = spark.readStream.format("frame_chunks").option("log", log).option("kind", kind)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def run_until_stopped(query, stop_file: str, poll: float = 2.0) -> None:
    """Waits until the stop file is there, lets the query take what is left, the last chunk included, and ends it; an error of the query is raised."""
    while query.isActive:
        if store.exists(stop_file):
            query.processAllAvailable()
            query.stop()
            return
        query.awaitTermination(poll)
    query.awaitTermination()
