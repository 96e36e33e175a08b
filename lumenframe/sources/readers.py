"""Frame files as Spark data sources: raw_frames, mrc, seq and rc.

Each plans its own splits: a range of frames of a file, of which a task reads just those bytes.  Filters on frame_id are pushed down and
prune ranges before anything is read.  Files are found by a path or glob pattern in any store that ``store`` opens, alike on the driver and executors.
"""

from __future__ import annotations

import itertools
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import codecs, kernels
from . import headers, store

FRAMES = "path string, frame_id long, pixels binary"
SPARSE = "path string, frame_id long, y int, x int, v int"


def natural(path: str) -> list:
    """A sort key by which 2 comes before 10."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", path) if p]


def find(path: str) -> list[str]:
    return sorted(store.find(path), key=natural)


@dataclass
class Range(InputPartition):
    """Frames first to last - 1 of a file."""

    path: str
    first: int
    last: int
    base: int


class _FrameReader(DataSourceReader):
    """Common part: splits, and the range of frame ids that pushed filters leave."""

    def __init__(self, options):
        self.options = options
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.step = int(options.get("frames_per_partition", 200))
        self.lo, self.hi, self.only = 0, 1 << 62, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_id",):
                yield f
                continue
            v = getattr(f, "value", None)
            if isinstance(f, EqualTo):
                self.lo, self.hi = max(self.lo, v), min(self.hi, v + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.lo = max(self.lo, v)
            elif isinstance(f, GreaterThan):
                self.lo = max(self.lo, v + 1)
            elif isinstance(f, LessThanOrEqual):
                self.hi = min(self.hi, v + 1)
            elif isinstance(f, LessThan):
                self.hi = min(self.hi, v)
            elif isinstance(f, In):
                self.only = set(v) if self.only is None else self.only & set(v)
                self.lo, self.hi = max(self.lo, min(v)), min(self.hi, max(v) + 1)
            else:
                yield f

    def _wanted(self, frame_id: int) -> bool:
        return self.lo <= frame_id < self.hi and (self.only is None or frame_id in self.only)

    def partitions(self):
        """Ranges of files.  Frames are numbered within their file, with ``numbering`` "run" over all files, or from the number that ``id_pattern`` finds in a file's name."""
        out, base = [], 0
        numbered, named = self.options.get("numbering", "file") == "run", self.options.get("id_pattern")
        for path in find(self.path):
            start = base if numbered else 0
            if named:
                m = re.search(named, path.rsplit("/", 1)[-1])
                if not m:
                    continue
                start = int(m[1])
            n = self.count(path)
            for a in range(0, n, self.step):
                b = min(n, a + self.step)
                if not self.ordered or (start + b > self.lo and start + a < self.hi):
                    out.append(Range(path, a, b, start))
            base += n
        return out or [Range("", 0, 0, 0)]

    #: Whether a frame's id follows from its place.
    ordered = True

    def read(self, partition):
        if partition.path:
            yield from self.frames(partition)  # an empty path stands for no files at all


class _StrideReader(_FrameReader):
    """Dense frames at a fixed stride."""

    def layout(self, path: str) -> tuple[int, int, int, int]:
        """First byte, stride, bytes of a frame, frames of the header (or -1)."""
        raise NotImplementedError

    def count(self, path):
        first, stride, size, n = self.layout(path)
        there = max(0, store.size(path) - first)
        whole = there // stride + (there % stride >= size and stride > size)
        return whole if n < 0 else min(n, whole)

    def convert(self, path, data):
        return data

    def frames(self, p):
        first, stride, size, _ = self.layout(p.path)
        prefix = int(self.options.get("record_prefix", 0))
        with store.open_read(p.path) as f:
            for k in range(p.first, p.last):
                frame_id = p.base + k
                if not self.ordered:  # the prefix is the frame's id
                    f.seek(first + k * stride)
                    frame_id = int.from_bytes(f.read(prefix), "little")
                if self._wanted(frame_id):
                    f.seek(first + k * stride + prefix)
                    yield (p.path, frame_id, self.convert(p.path, f.read(size)))


class RawReader(_StrideReader):
    """Headerless frames; each may follow a prefix of ``record_prefix`` bytes, which with ``prefix_id`` is its id."""

    @property
    def ordered(self):
        return str(self.options.get("prefix_id", "false")).lower() != "true"

    def layout(self, path):
        o = self.options
        size = int(o["ny"]) * int(o["nx"]) * int(o.get("bytes", 2))
        return int(o.get("offset", 0)), size + int(o.get("record_prefix", 0)), size, -1


class MrcReader(_StrideReader):
    def layout(self, path):
        with store.open_read(path) as f:
            h = headers.read_mrc_header(f.read(1024))
        size = h["nx"] * h["ny"] * headers.MRC_BITS[h["mode"]] // 8
        return 1024 + h["nsymbt"], size, size, h["nz"]


class SeqReader(_StrideReader):
    def layout(self, path):
        with store.open_read(path) as f:
            h = headers.read_seq_header(f.read(1024))
        size = h["width"] * h["height"] * h["bit_depth"] // 8
        return headers.SEQ_DATA, h["true_image_size"], size, h["allocated_frames"] or -1


@dataclass
class IndexSplit(InputPartition):
    """A row group of an index (see ``index``): ``n`` frames of ids lo to hi."""

    path: str
    group: int
    lo: int
    hi: int
    n: int


class RcReader(_FrameReader):
    """Reduced files.  A part file is one split, walked through as it is read; of a merged file a split is a range of its seek table.

    With ``index``, a table of ``index.write_index``, a split is a row group of that: of those whose ids can't be wanted nothing is read, of the
    others only the wanted frames.
    """

    def __init__(self, options):
        self.index = options.get("index")
        super().__init__({"path": self.index or "", **options})

    def head(self, f):
        return headers.read_reduced_header(f.read(headers.REDUCED_SIZE))

    @staticmethod
    def is_part(path):
        return bool(re.search(r"_part\d+$", path))

    def slices(self, path, first: int = 0, last: int | None = None):
        """(frame_id, offset, c1, c2, packed) of each frame of a part file, or of entries first to last - 1 of a merged one; payloads are not read."""
        with store.open_read(path) as f:
            h = self.head(f)
            level, mode = h["reduction_level"], h["rc_operation_mode"]
            two = level in (1, 2)
            if not self.is_part(path):
                w, last = 3 if two else 1, h["nz"] if last is None else last
                table = np.frombuffer(f.read(4 * w * last), "<u4").reshape(-1, w).astype(np.int64)
                c1, c2 = table[:, 0], table[:, 1] if two else np.zeros(len(table), np.int64)
                at = headers.REDUCED_SIZE + 4 * w * h["nz"] + np.concatenate([[0], np.cumsum(c1 + c2)])
                for k in range(first, len(table)):
                    if c1[k]:
                        yield k, int(at[k]), int(c1[k]), int(c2[k]), int(table[k, 2]) if two else 0
                return
            bitmap, size, at = -(-h["nx"] * h["ny"] // 8), store.size(path), headers.REDUCED_SIZE
            kind = struct.Struct("<" + "I" * ((2 if two else 1) if mode == 0 else (4 if two else 2)))
            while at < size:
                f.seek(at)
                v = kind.unpack(f.read(kind.size))
                if mode == 0:
                    c1, c2, packed = bitmap, v[1] if two else 0, v[1] if two else 0
                else:
                    c1, c2, packed = v[1], v[2] if two else 0, v[3] if two else 0
                at += kind.size
                yield v[0], at, c1, c2, packed
                at += c1 + c2

    def partitions(self):
        if self.index:
            return self._zones() or [Range("", 0, 0, 0)]
        out = []
        for path in find(self.path):
            if self.is_part(path):
                out.append(Range(path, 0, -1, 0))
                continue
            with store.open_read(path) as f:
                n = self.head(f)["nz"]
            out += [Range(path, a, min(n, a + self.step), 0) for a in range(0, n, self.step) if a < self.hi and a + self.step > self.lo]
        return out or [Range("", 0, 0, 0)]

    def _zones(self):
        """Row groups of the index that can have a wanted id, from the footers alone."""
        import pyarrow.parquet as pq

        out = []
        for path in find(self.index):
            meta = pq.read_metadata(store.open_read(path))
            column = meta.schema.to_arrow_schema().get_field_index("frame_id")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(column).statistics
                lo, hi = (stats.min, stats.max) if stats is not None and stats.has_min_max else (0, 1 << 62)
                inside = self.only is None or any(lo <= k <= hi for k in self.only)
                if inside and hi >= self.lo and lo < self.hi and meta.row_group(g).num_rows:
                    out.append(IndexSplit(path, g, lo, hi, meta.row_group(g).num_rows))
        return out

    def frames(self, p):
        if isinstance(p, IndexSplit):
            import pyarrow.parquet as pq

            t = pq.ParquetFile(store.open_read(p.path)).read_row_group(p.group, ["path", "frame_id", "offset", "c1", "c2"]).to_pydict()
            by: dict[str, list] = {}
            for path, *at in zip(*t.values()):
                if self._wanted(at[0]):
                    by.setdefault(path, []).append(tuple(at))
            for path, slices in sorted(by.items()):
                yield from self.decoded(path, sorted(slices, key=lambda x: x[1]))
            return
        slices = self.slices(p.path) if p.last < 0 else self.slices(p.path, p.first, p.last)
        yield from self.decoded(p.path, (x[:4] for x in slices if self._wanted(x[0])))

    def decoded(self, path, slices):
        with store.open_read(path) as f:
            h = self.head(f)
            n, two = h["nx"] * h["ny"], h["reduction_level"] in (1, 2)
            codec = codecs.CODEC_NAMES[h["compression_scheme"]] if h["rc_operation_mode"] else None
            for frame, at, c1, c2 in slices:
                f.seek(at)
                bitmap, vals = f.read(c1), f.read(c2)
                if len(bitmap) != c1 or len(vals) != c2:
                    raise ValueError(f"{path}: frame {frame} is cut short")
                spot = np.flatnonzero(kernels.unpack_bits(codecs.decompress(bitmap, codec) if codec else bitmap, n))
                v = kernels.unpack_values(codecs.decompress(vals, codec) if codec else vals, h["target_bit_depth"], len(spot)) if two else np.ones(len(spot), np.int64)
                k = len(spot)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k, pa.string()), pa.array(np.full(k, frame, np.int64)), pa.array((spot // h["nx"]).astype(np.int32)), pa.array((spot % h["nx"]).astype(np.int32)), pa.array(v.astype(np.int32))], ["path", "frame_id", "y", "x", "v"])


class ReducingReader(_FrameReader):
    """Frames of an inner format, packed where they are read: dense pixels never leave the reading task."""

    def __init__(self, options):
        super().__init__(options)
        self.inner = {"raw_frames": RawReader, "mrc": MrcReader, "seq": SeqReader}[options.get("source", "raw_frames")](options)

    def count(self, path):
        return self.inner.count(path)

    def frames(self, p):
        from ..operators.frames import Geometry, Threshold, packer, record_batch

        o = self.options
        geom = Geometry(int(o["ny"]), int(o["nx"]), o.get("dtype", "<u2"))
        t = np.frombuffer(store.read(o["threshold"]), "<i8")
        if len(t) != geom.pixels:
            raise ValueError("the threshold file's shape is not the frames'")
        codec = o.get("codec", "zlib")
        pack = packer(Threshold(t, geom), geom, level=int(o.get("level", 1)), depth=int(o.get("depth", 12)), codec=None if codec == "none" else codec, codec_level=int(o.get("codec_level", 1)))
        self.inner.lo, self.inner.hi, self.inner.only = self.lo, self.hi, self.only
        rows, size = [], 0
        for _, f, data in self.inner.frames(p):
            rows.append(pack(f, geom.image(data)))
            size += len(rows[-1][3]) + len(rows[-1][4])
            if size > 16 << 20:
                yield record_batch(rows)
                rows, size = [], 0
        if rows:
            yield record_batch(rows)


class HeaderReader(DataSourceReader):
    """One row a file, with its header's fields as a map."""

    def __init__(self, options, parse):
        self.options, self.parse = options, parse

    def partitions(self):
        return [Range(p, 0, 1, 0) for p in find(self.options["path"])]

    def read(self, partition):
        with store.open_read(partition.path) as f:
            h = self.parse(f.read(1024))
        yield (partition.path, {k: v.hex() if isinstance(v, bytes) else str(v) for k, v in h.items()})


@dataclass
class _Done(WriterCommitMessage):
    written: str
    final: str
    more: tuple = ()  # (written, final) of further files

    def files(self):
        return [f for f in [(self.written, self.final), *self.more] if f[0]]


class _FileWriter(DataSourceWriter):
    """One file a task, under a temporary name until the job commits."""

    def __init__(self, options, overwrite):
        self.options = options
        self.path = options["path"].rstrip("/")
        store.make_folder(self.path)
        self.before = [p for p, _, _ in store.listing(self.path)] if overwrite else []

    def _open(self, name):
        from pyspark import TaskContext

        c = TaskContext.get()
        return store.join(self.path, f".{name}.{c.taskAttemptId()}"), store.join(self.path, name)

    def commit(self, messages):
        """What is overwritten goes only now: a job that fails leaves it."""
        files = [f for m in messages if m for f in m.files()]
        if len({final for _, final in files}) < len(files):
            raise ValueError("several tasks have frames of one file")
        for p in self.before:
            store.delete(p)
        for written, final in files:
            store.move(written, final)

    def abort(self, messages):
        for m in messages:
            for written, _ in m.files() if m else ():
                store.delete(written)


def _in_order(rows, key, stream: bool):
    """rows by ascending key: as they come where ``stream`` says that they are sorted, which is held to, else sorted here."""
    if not stream:
        yield from sorted(rows, key=key)
        return
    last = None
    for r in rows:
        if last is not None and key(r) < last:
            raise ValueError("rows are not sorted by frame_id within partitions")
        last = key(r)
        yield r


class DenseWriter(_FileWriter):
    """Frames (frame_id, pixels) as raw, MRC or SEQ files, ascending by id within a task.

    With ``sorted`` rows must come in this order, and are written as they come; else a task holds its rows to sort them.  The number of frames
    in a header is put in at the end, where the store can write there; else a task's rows are held.

    A task writes one file by its own number or, with ``frames_per_file``, one for every so many frame ids, by the number that these have in common; the rows of
    such a file must lie in one task.
    """

    def __init__(self, options, overwrite, kind):
        super().__init__(options, overwrite)
        self.kind = kind

    def write(self, rows):
        from pyspark import TaskContext

        o, task = self.options, TaskContext.get().partitionId()
        ny, nx = (int(o[k]) if k in o else 0 for k in ("ny", "nx"))
        prefix, local = int(o.get("record_prefix", 0)), store.is_local(self.path)
        frames = _in_order(((r["frame_id"], bytes(r["pixels"])) for r in rows), lambda r: r[0], str(o.get("sorted", "false")).lower() == "true")
        per = int(o.get("frames_per_file", 0))

        def head(n):
            if self.kind == "mrc":
                return headers.write_mrc_header(nx, ny, n, int(o.get("mode", 6)))
            return headers.write_seq_header(nx, ny, n).ljust(headers.SEQ_DATA, b"\0") if self.kind == "seq" else b""

        def put(number, frames):
            if self.kind != "raw" and not local:
                frames = list(frames)
            n_known = len(frames) if isinstance(frames, list) else 0
            tmp, final = self._open(f"{o.get('stem', 'frames')}_{number:03d}.{ {'raw': 'bin'}.get(self.kind, self.kind)}")
            with store.open_write(tmp) as f:
                f.write(head(n_known))
                n = 0
                for k, data in frames:
                    if self.kind == "raw" and prefix:
                        f.write(int(k).to_bytes(prefix, "little"))
                    f.write(data.ljust(-(-len(data) // 1024) * 1024, b"\0") if self.kind == "seq" else data)
                    n += 1
            if self.kind != "raw" and n != n_known:
                store.patch(tmp, 0, head(n))
            return tmp, final

        files = [put(number, rows) for number, rows in itertools.groupby(frames, lambda r: r[0] // per if per else task)]
        return _Done(*files[0], tuple(files[1:])) if files else _Done("", "")  # no rows, no file


class RcWriter(_FileWriter):
    """Packed records (frames.RECORD) as part files, or with ``merged`` as one file with a seek table (from one task; ``index.merge_files`` merges by many)."""

    def write(self, rows):
        from pyspark import TaskContext

        o, task = self.options, TaskContext.get().partitionId()
        merged, local = str(o.get("merged", "false")).lower() == "true", store.is_local(self.path)
        recs = _in_order(((r["frame_id"], r["level"], bytes(r["bitmap"]), bytes(r["vals"] or b""), r["packed_bytes"]) for r in rows), lambda r: r[0], str(o.get("sorted", "false")).lower() == "true")
        if merged or not local:
            recs = list(recs)
        known = len(recs) if isinstance(recs, list) else 0
        recs = iter(recs)
        start = next(recs, None)
        if start is None:
            return _Done("", "")  # no rows, no file
        recs = itertools.chain([start], recs)
        level, mode = start[1], 0 if o.get("codec", "zlib") == "none" else 1
        if merged:
            recs = list(recs)
        head = lambda nz: headers.write_reduced_header(
            reduction_level=level, rc_operation_mode=mode, target_bit_depth=int(o.get("depth", 12)), nx=int(o["nx"]), ny=int(o["ny"]), nz=nz,
            compression_scheme=codecs.CODEC_IDS[o.get("codec", "zlib")] if mode else 0, compression_level=int(o.get("codec_level", 1)), source_file_type=int(o.get("source_type", 0)),
            source_file_name=o.get("source", ""), dark_file_name=o.get("dark", ""), dark_threshold_epsilon=int(o.get("eps", 0)), source_bit_depth=16, source_dtype=1, target_dtype=1,
        )
        nz = int(o.get("nz", 0)) or (max(r[0] for r in recs) + 1 if merged else known)
        stem, two = o.get("stem", "run"), level in (1, 2)
        tmp, final = self._open(f"{stem}.rc{level}" if merged else f"{stem}.rc{level}_part{task:03d}")
        with store.open_write(tmp) as f:
            f.write(head(nz))
            if merged:
                by = {r[0]: r for r in recs}
                for k in range(nz):
                    r = by.get(k)
                    sizes = (len(r[2]), len(r[3]), r[4]) if r else (0, 0, 0)
                    f.write(struct.pack("<III", *sizes) if two else struct.pack("<I", sizes[0]))
                for k in sorted(by):
                    f.write(by[k][2] + by[k][3])
            else:
                n = 0
                for k, _, bitmap, vals, packed in recs:
                    if mode == 0:
                        f.write(struct.pack("<II", k, packed) if two else struct.pack("<I", k))
                    else:
                        f.write(struct.pack("<IIII", k, len(bitmap), len(vals), packed) if two else struct.pack("<II", k, len(bitmap)))
                    f.write(bitmap + vals)
                    n += 1
        if not merged and not nz:
            store.patch(tmp, 0, head(n))
        return _Done(tmp, final)


class TripletWriter(_FileWriter):
    """Sparse rows (frame_id, y, x, v) as files of (row, column, value) triplets: the reduced header, then of each frame a count and its triplets.

    A file holds frames from its header's frame offset on; one without a row has a count of nought.  Rows must be sorted by frame within a task.
    """

    def write(self, rows):
        from pyspark import TaskContext

        o, task = self.options, TaskContext.get().partitionId()
        tmp, final = self._open(f"{o.get('stem', 'run')}_{task:03d}.coo")
        local = store.is_local(self.path)
        first, now, held, parts, f = None, None, [], [], None

        def head(nz):
            return headers.write_reduced_header(reduction_level=1, rc_operation_mode=0, target_bit_depth=int(o.get("depth", 16)), nx=int(o["nx"]), ny=int(o["ny"]), nz=nz, frame_offset=first or 0)

        def put(data):
            parts.append(data) if f is None else f.write(data)

        def close(until):
            nonlocal held
            put(struct.pack("<I", len(held)) + np.array(held, "<u2").tobytes())
            for _ in range(now + 1, until):
                put(struct.pack("<I", 0))
            held = []

        for r in rows:
            k = r["frame_id"]
            if first is None:
                first = now = k
                if local:
                    f = store.open_write(tmp)
                    f.write(head(0))
            elif k < now:
                raise ValueError("rows are not sorted by frame_id within partitions")
            elif k > now:
                close(k)
                now = k
            held.append((r["y"], r["x"], r["v"]))
        if first is None:
            return _Done("", "")  # no rows, no file
        close(now + 1)
        if f is None:
            with store.open_write(tmp) as out:
                out.write(b"".join([head(now + 1 - first), *parts]))
        else:
            f.close()
            store.patch(tmp, 0, head(now + 1 - first))
        return _Done(tmp, final)


class TripletReader(_FrameReader):
    """Triplet files as sparse rows; a file is a split."""

    def partitions(self):
        return [Range(p, 0, -1, 0) for p in find(self.path)]

    def frames(self, p):
        with store.open_read(p.path) as f:
            h = headers.read_reduced_header(f.read(headers.REDUCED_SIZE))
            for k in range(h["frame_offset"], h["frame_offset"] + h["nz"]):
                (n,) = struct.unpack("<I", f.read(4))
                data = f.read(6 * n)
                if len(data) != 6 * n:
                    raise ValueError(f"{p.path}: frame {k} is cut short")
                if self._wanted(k):
                    t = np.frombuffer(data, "<u2").reshape(-1, 3).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([p.path] * n, pa.string()), pa.array(np.full(n, k, np.int64)), *(pa.array(np.ascontiguousarray(t[:, j])) for j in range(3))], ["path", "frame_id", "y", "x", "v"])


def _source(short: str, reader, schema: str, writer=None):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return short

        def schema(self):
            return schema

        def reader(self, schema):
            return reader(self.options)

        def writer(self, schema, overwrite):
            if writer is None:
                raise ValueError(f"{short} can't be written")
            return writer(self.options, overwrite)

    Source.__name__ = Source.__qualname__ = f"{short}_source"
    return Source


_HEADERS = "path string, header map<string,string>"
SOURCES = [
    _source("raw_frames", RawReader, FRAMES, lambda o, w: DenseWriter(o, w, "raw")),
    _source("mrc", MrcReader, FRAMES, lambda o, w: DenseWriter(o, w, "mrc")),
    _source("seq", SeqReader, FRAMES, lambda o, w: DenseWriter(o, w, "seq")),
    _source("rc", RcReader, SPARSE, RcWriter),
    _source("triplets", TripletReader, SPARSE, TripletWriter),
    _source("reduced_frames", ReducingReader, "frame_id long, level int, n int, bitmap binary, vals binary, bitmap_bytes int, vals_bytes int, packed_bytes int"),
    _source("rc_header", lambda o: HeaderReader(o, headers.read_reduced_header), _HEADERS),
    _source("mrc_header", lambda o: HeaderReader(o, headers.read_mrc_header), _HEADERS),
    _source("seq_header", lambda o: HeaderReader(o, headers.read_seq_header), _HEADERS),
]


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to a session; filters reach them where Python filter pushdown is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in SOURCES:
        spark.dataSource.register(s)
    return spark


def reduce_files(spark: SparkSession, path: str, source: str, dark, eps: int, geom, threshold_file: str, **options):
    """Packed records of frame files, thresholded and packed by the tasks that read them.

    ``dark`` is a table (y, x, t) or an array; thresholds are written once to ``threshold_file``, which all executors must reach.
    """
    from ..operators.frames import _threshold

    store.write(threshold_file, _threshold(dark, eps, geom).t.astype("<i8").tobytes())
    r = spark.read.format("reduced_frames").option("source", source).option("ny", geom.ny).option("nx", geom.nx).option("dtype", geom.dtype).option("threshold", threshold_file)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)
