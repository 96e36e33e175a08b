"""Exact removal of repeated byte windows by depth-limited most-significant-digit passes.

All windows of ``threshold`` bytes are ordered by a radix sort that looks no deeper than the threshold and only
asks which windows are equal, so its first digit may be any function of the window.  The passes are

1. the window's minimiser (its smallest hashed k-gram).  Consecutive windows that share it form one run, and runs, not windows, are dealt - about one
   for every twenty bytes.  Runs whose minimiser is in one document alone drop out.
2. the bytes themselves.  The runs that are left send their own bytes, each run once, to the task of their minimiser.  Equal runs
   are told by comparing them whole; the windows of the others are sorted by eight bytes after eight, ends first, and groups of one document drop out
   after each digit.  What is equal in the last digit is equal in every byte.
3. Where one minimiser has more bytes than a task may hold, its windows are dealt again by all their bytes.

Every pass first combines what a task has itself: of equal keys only the smallest document's go on, the others are known to repeat it,
so a passage that a third of all documents share reaches a sorting task once for each task that read it.  Records travel as packed arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, batches, discard, identified, mix, partitions, string_bytes, written

#: Bytes of text whose runs a task combines before it sends them on.
COMBINE_BYTES = 8 << 20
#: Bytes of runs that a sorting task settles at once, range by range of the first digit; windows of a minimiser with more are dealt again.
SETTLE_BYTES = 16 << 20
#: Windows of one run at most; a minimiser that repeats makes longer ones, which are cut.
_RUN = 48
_U = np.uint64
_C1, _C2, _C3 = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def _minima(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    return np.minimum(g[: len(g) - (width - have)], g[width - have :]) if have < width else g


def runs_of(raw: np.ndarray, at: np.ndarray, threshold: int, gram: int):
    """(minimiser, first window, windows) of all runs of the texts."""
    n = len(raw)
    if n < threshold:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    u = _words(raw)
    with np.errstate(over="ignore"):
        m = n - gram + 1
        g = u[:m] * _C1
        g ^= (u[gram - 8 : gram - 8 + m] * _C2) >> _U(29)
        g *= _C3
        g ^= g >> _U(32)
    low = _minima(g, threshold - gram + 1)
    # the last threshold - 1 places of a text start no window
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(at[:-1], at[1:] - threshold + 1), 1)
    np.add.at(edge, at[1:], -1)
    valid = np.cumsum(edge)[: len(low)] == 0
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    size = np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True)) + 1 - starts
    parts = -(-size // _RUN)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, size = np.repeat(starts, parts) + nth * _RUN, np.minimum(_RUN, np.repeat(size, parts) - nth * _RUN)
    return low[starts], starts, size


# Packed records: a table of documents (id, text hash), then columns of records as byte planes.
_OPEN = (("h", 6), ("doc", 3), ("lo", 4), ("n", 1))
_PLACE = (("doc", 3), ("lo", 4))
_FLAG = (("doc", 3), ("lo", 4), ("n", 1))
_SENT = (("run", 4), ("doc", 3), ("lo", 4))


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def pack(r: dict[str, np.ndarray], ids: np.ndarray, ties: np.ndarray, fields) -> bytes:
    """r's ``doc`` points into ids and ties."""
    used, doc = np.unique(r["doc"], return_inverse=True)
    out = [np.array([len(doc), len(used)], "<u8").tobytes(), ids[used].astype("<i8").tobytes(), ties[used].astype("<i8").tobytes()]
    return b"".join(out + [_planes(doc if name == "doc" else r[name], width) for name, width in fields])


def unpacked(blobs: list[bytes], fields, share: tuple[int, int] = (0, 1)) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Records of all blobs; with a share (k, m) of several those whose ``h`` is k modulo m."""
    parts: dict = {name: [] for name, _ in fields}
    ids, ties, base = [], [], 0
    for blob in blobs:
        n, d = (int(v) for v in np.frombuffer(blob, "<u8", 2))
        at = 16
        ids.append(np.frombuffer(blob, "<i8", d, at))
        ties.append(np.frombuffer(blob, "<i8", d, at + 8 * d))
        at += 16 * d
        for name, width in fields:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            at += n * width
            x = wide.view("<u8").ravel()
            if name == "h" and share[1] > 1:
                mine = x % _U(share[1]) == share[0]
            x = x[mine] if share[1] > 1 else x
            parts[name].append(x if name == "h" else x.astype(np.int64) + (base if name == "doc" else 0))
        base += d
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return {name: cat(xs, np.uint64 if name == "h" else np.int64) for name, xs in parts.items()}, cat(ids, np.int64), cat(ties, np.int64)


def _take(r: dict, which) -> dict:
    return {k: v[which] for k, v in r.items()}


_NAMES = ["kind", "part", "payload"]
_OUT = "kind int, part long, payload binary"
#: Kinds of rows: records to sort, final flags, open runs, runs with their bytes.
_SORT, _FINAL, _STILL, _BYTES = 0, 1, 2, 3


def _row(kind: int, part: int, payload: bytes):
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([payload], pa.binary())], _NAMES)


def _dealt(kind: int, part: np.ndarray, make):
    """A row of ``make(records)`` for each part that has records."""
    order = np.argsort(part, kind="stable")
    for idx in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(idx):
            yield _row(kind, int(part[idx[0]]), make(idx))


def _by_document(kind: int, r: dict, ids, ties, n: int, fields):
    """Records, dealt to the parts of their documents."""
    part = (mix(ids.astype(np.uint64)) % _U(n)).astype(np.int64)[r["doc"]]
    return _dealt(kind, part, lambda idx: pack(_take(r, idx), ids, ties, fields))


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a 48-bit first digit."""
    return ((h >> _U(16)) * _U(ranges) >> _U(32)).astype(np.int64)


def _groups(h: np.ndarray, ids: np.ndarray):
    """Order by h, starts of groups, and which groups have several ids; ids are the records' own."""
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    owner = ids[order]
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
    return order, first, several


def _ids(b) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _minimiser_pass(threshold: int, gram: int, n: int):
    """Texts -> runs by minimiser.  One that several of a task's documents have is open at once, and goes on as a witness (n = 0) alone."""

    def send(parts, ids, ties):
        r = {k: np.concatenate([p[k] for p in parts]) for k in _NAMES_OF_OPEN}
        ids, ties = np.concatenate(ids), np.concatenate(ties)
        order, first, several = _groups(r["h"], ids[r["doc"]])
        many = np.repeat(several, np.diff(np.append(first, len(order))))
        if many.any():
            yield from _by_document(_STILL, _take(r, order[many]), ids, ties, n, _PLACE)
        witness = order[first[several]]
        r["n"][witness] = 0
        goes = np.concatenate([order[~many], witness])
        yield from _dealt(_SORT, _range(r["h"][goes], n), lambda idx: pack(_take(r, goes[idx]), ids, ties, _OPEN))

    def run(it):
        parts, ids, ties, docs, size = [], [], [], 0, 0
        for b in batches(it, 1 << 20):
            raw, at = string_bytes(b.column(2))
            h, lo, k = runs_of(raw, at, threshold, gram)
            doc = np.searchsorted(at, lo, "right") - 1
            parts.append({"h": mix(h) >> _U(16), "doc": doc + docs, "lo": lo - at[doc], "n": k})
            own = _ids(b)
            ids.append(own[0])
            ties.append(own[1])
            docs += b.num_rows
            size += len(raw)
            if size >= COMBINE_BYTES or docs >= 1 << 22:
                yield from send(parts, ids, ties)
                parts, ids, ties, docs, size = [], [], [], 0, 0
        if parts:
            yield from send(parts, ids, ties)

    return run


_NAMES_OF_OPEN = [name for name, _ in _OPEN]


def _shared_minimisers(n: int):
    """Ranges of minimisers -> the runs whose minimiser several documents have."""

    def settle(blobs):
        m = -(-sum(map(len, blobs)) // SETTLE_BYTES)
        for k in range(m):
            r, ids, ties = unpacked(blobs, _OPEN, (k, m))
            order, first, several = _groups(r["h"], ids[r["doc"]])
            # a witness stands for several documents
            several |= np.logical_or.reduceat(r["n"][order] == 0, first) if len(first) else False
            open_ = order[np.repeat(several, np.diff(np.append(first, len(order))))]
            open_ = open_[r["n"][open_] > 0]
            if len(open_):
                yield from _by_document(_STILL, _take(r, open_), ids, ties, n, _PLACE)

    return _parts(settle)


def _parts(settle):
    """Rows sorted by kind and part: records go to ``settle`` part by part, all other rows pass."""

    def run(it):
        part, held = None, []
        for b in it:
            for kind, p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind != _SORT:
                    yield _row(kind, p, blob)
                    continue
                if p != part and held:
                    yield from settle(held)
                    held = []
                part = p
                held.append(blob)
        if held:
            yield from settle(held)

    return run


def _heads(blob: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Minimisers and window counts of a blob's runs, and how many bytes they have."""
    k, size = (int(v) for v in np.frombuffer(blob, "<u8", 2))
    wide = np.zeros((k, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * k, 16).reshape(6, k).T
    return wide.view("<u8").ravel(), np.frombuffer(blob, np.uint8, k, 16 + 6 * k).astype(np.int64), size


class _Runs:
    """Runs with their bytes: places in one buffer, records that point at them."""

    def __init__(self, raw, start, n, h, run, doc, lo, ids, ties, threshold):
        self.u, self.raw, self.start, self.n, self.h = _words(raw), raw, start, n, h
        self.run, self.doc, self.lo, self.ids, self.ties, self.threshold = run, doc, lo, ids, ties, threshold

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of each run, runs of a class being equal in every byte, and one run of each class."""
        u, t, start, n = self.u, self.threshold, self.start, self.n
        key = self.h * _GOLD
        with np.errstate(over="ignore"):
            for o in [*range(0, t - 7, 8), *([t - 8] if t % 8 else [])]:
                key = mix(key * _GOLD + u[start + o])
                key += u[start + n - 1 + o]
            key = mix(key + n.astype(np.uint64))
        order = np.argsort(key)
        s = key[order]
        head = np.append(True, s[1:] != s[:-1])[: len(s)]
        of = np.empty(len(s), np.int64)
        of[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(s) else order
        # the key only proposes: bytes decide, and what differs from its head is a class of its own
        same = n == n[of]
        length = n + t - 1
        for o in range(0, int(length.max(initial=0)), 8):
            k = np.flatnonzero(same & (length > o) & (of != np.arange(len(of))))
            at = np.minimum(o, length[k] - 8)
            same[k] &= u[start[k] + at] == u[start[of[k]] + at]
        of = np.where(same, of, np.arange(len(of)))
        reps, cls = np.unique(of, return_inverse=True)
        return cls, reps

    def settle(self):
        """(records known to repeat, classes and the least id of each, the records of that id)."""
        cls, reps = self.classes()
        of = cls[self.run]
        least = np.full(len(reps), np.iinfo(np.int64).max)
        owner = self.ids[self.doc]
        np.minimum.at(least, of, owner)
        mine = owner == least[of]
        return np.flatnonzero(~mine), of, reps, least, np.flatnonzero(mine)

    def flags(self, which, first=0, n=None):
        return {"doc": self.doc[which], "lo": self.lo[which] + first, "n": self.n[self.run[which]] if n is None else n}

    def blob(self, which, of, reps) -> bytes:
        """The records ``which`` and, once each, the bytes of their classes' representatives."""
        used, run = np.unique(of[which], return_inverse=True)
        start, n = self.start[reps[used]], self.n[reps[used]]
        length = n + self.threshold - 1
        ends = np.cumsum(length)
        data = self.raw[np.repeat(start - (ends - length), length) + np.arange(length.sum())]
        head = [np.array([len(used), len(data)], "<u8").tobytes(), _planes(self.h[reps[used]], 6), _planes(n, 1), data.tobytes()]
        return b"".join([*head, pack({"run": run, "doc": self.doc[which], "lo": self.lo[which]}, self.ids, self.ties, _SENT)])

    @classmethod
    def of_blobs(cls, blobs: list[bytes], threshold: int, keep) -> "_Runs":
        """Runs of all blobs whose minimiser ``keep`` takes."""
        h, n, raw, rest, bases, chosen, base = [], [], [], [], [], [], 0
        for blob in blobs:
            own_h, own_n, size = _heads(blob)
            mine = keep(own_h)
            at = 16 + 7 * len(own_h)
            h.append(own_h[mine])
            n.append(own_n[mine])
            raw.append(np.frombuffer(blob, np.uint8, size, at)[np.repeat(mine, own_n + threshold - 1)])
            rest.append(blob[at + size :])
            bases.append(np.full(int(np.frombuffer(rest[-1], "<u8", 1)[0]), base))
            chosen.append(mine)
            base += len(mine)
        r, ids, ties = unpacked(rest, _SENT)
        chosen, run = np.concatenate(chosen), r["run"] + np.concatenate(bases)
        here = chosen[run]
        n = np.concatenate(n)
        length = n + threshold - 1
        return cls(np.concatenate(raw), np.cumsum(length) - length, n, np.concatenate(h), (np.cumsum(chosen) - 1)[run[here]], r["doc"][here], r["lo"][here], ids, ties, threshold)

    def windows(self, of, reps, least, mine):
        """Windows of the classes that share a minimiser with another document's class: (class, offset in its run)."""
        order, first, several = _groups(self.h[reps], least)
        open_ = order[np.repeat(several, np.diff(np.append(first, len(order))))]
        n = self.n[reps[open_]]
        return np.repeat(open_, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def equal_windows(self, cls, offset, reps, least):
        """Groups of equal windows of several documents: (windows in group order, their group).  Digits of eight bytes, ends first."""
        t, place = self.threshold, self.start[reps[cls]] + offset
        left, group = np.arange(len(cls)), None
        for o in [0, *([t - 8] if t > 8 else []), *range(8, t - 8, 8)]:
            digit = self.u[place[left] + o]
            if group is None:
                order = np.argsort(digit)
            else:
                order = np.lexsort((digit, group))
                group = group[order]
            digit, left = digit[order], left[order]
            new = np.append(True, digit[1:] != digit[:-1])[: len(left)]
            if group is not None:
                new[1:] |= group[1:] != group[:-1]
            first = np.flatnonzero(new)
            if not len(first):
                return left, np.zeros(0, np.int64)
            owner = least[cls[left]]
            keep = np.repeat(np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first), np.diff(np.append(first, len(left))))
            group = (np.cumsum(new) - 1)[keep]
            left = left[keep]
        return left, group


def _window_flags(runs: _Runs, windows, cls, of, mine):
    """Flags of the given windows (class, offset) at all places of their class's least document."""
    by = mine[np.argsort(of[mine], kind="stable")]
    first = np.searchsorted(of[by], cls)
    times = np.searchsorted(of[by], cls, "right") - first
    at = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    which = by[at]
    return runs.flags(which, np.repeat(windows, times), np.ones(len(which), np.int64))


def _later(runs: _Runs, left, group, cls, least):
    """Of equal windows those whose document is not the smallest."""
    if not len(left):
        return left
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    owner = least[cls[left]]
    return left[owner != np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(left))))]


def _byte_pass(threshold: int, gram: int, n: int):
    """A part's open runs, then its documents' texts -> the runs with their bytes."""

    def send(raws, parts, ids, ties):
        raw = np.concatenate(raws)
        r = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        runs = _Runs(raw, r["place"], r["n"], r["h"], np.arange(len(r["n"])), r["doc"], r["lo"], np.concatenate(ids), np.concatenate(ties), threshold)
        repeats, of, reps, _, mine = runs.settle()
        if len(repeats):
            yield from _by_document(_FINAL, runs.flags(repeats), runs.ids, runs.ties, n, _FLAG)
        yield from _dealt(_SORT, _range(runs.h[reps[of[mine]]], n), lambda idx: runs.blob(mine[idx], of, reps))

    def run(it):
        part, blobs, index = None, [], None
        raws, parts, ids, ties, base, docs = [], [], [], [], 0, 0
        for whole in it:
            for b in batches([whole], 2 << 20, 4):
                kinds, owners = b.column(0).to_pylist(), b.column(1).to_pylist()
                texts = [i for i, k in enumerate(kinds) if k != 0]
                for p, kind, blob in zip(owners, kinds, b.column(5)):
                    if p != part:
                        part, blobs, index = p, [], {}
                    if kind == 0:
                        blobs.append(blob.as_py())
                        index = None
                if not texts:
                    continue
                if index is None:
                    index, blobs = _Index(blobs, _PLACE), []
                if not index:
                    continue
                t = b.slice(texts[0], len(texts))  # a part's texts come after its records
                if any(owners[i] != part for i in texts):
                    raise RuntimeError("a batch holds texts of two parts")
                raw, at = string_bytes(t.column(4))
                own, own_tie = t.column(2).to_numpy(zero_copy_only=False).astype(np.int64), t.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, found = index.find(own, own_tie)
                if not len(doc):
                    continue
                still = np.zeros(len(raw) + 1, bool)
                still[at[doc] + index.r["lo"][found]] = True
                h, place, k = runs_of(raw, at, threshold, gram)
                goes = still[place]
                h, place, k = h[goes], place[goes], k[goes]
                doc = np.searchsorted(at, place, "right") - 1
                parts.append({"h": mix(h) >> _U(16), "doc": doc + docs, "lo": place - at[doc], "n": k, "place": place + base})
                raws.append(raw)
                ids.append(own)
                ties.append(own_tie)
                docs += len(own)
                base += len(raw)
                if base >= COMBINE_BYTES:
                    yield from send(raws, parts, ids, ties)
                    raws, parts, ids, ties, base, docs = [], [], [], [], 0, 0
        if parts:
            yield from send(raws, parts, ids, ties)

    return run


class _Index:
    """Records of a part by document."""

    def __init__(self, blobs: list[bytes], fields):
        self.r, ids, ties = unpacked(blobs, fields)
        self.keys, back = np.unique(np.stack([ids, ties], 1), axis=0, return_inverse=True) if len(ids) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        owner = back.ravel()[self.r["doc"]] if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((self.r["lo"], owner))
        self.r = _take(self.r, order)
        self.first = np.searchsorted(owner[order], np.arange(len(self.keys) + 1))
        self.at = {(int(d), int(t)): k for k, (d, t) in enumerate(self.keys.tolist())}

    def __bool__(self):
        return bool(len(self.keys))

    def find(self, ids, ties):
        """(text number, record) of all records of the texts."""
        known = [(i, k) for i, x in enumerate(zip(ids.tolist(), ties.tolist())) if (k := self.at.get(x)) is not None]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, k = np.array(known).T
        n = self.first[k + 1] - self.first[k]
        return np.repeat(doc, n), np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def spans(self, threshold: int) -> dict:
        """Merged [first, last) of each document."""
        lo, hi = self.r["lo"], self.r["lo"] + self.r["n"] - 1 + threshold
        owner = np.repeat(np.arange(len(self.keys)), np.diff(self.first))
        reach = np.maximum.accumulate(hi + (owner << 33)) if len(hi) else hi
        new = np.append(True, (lo + (owner << 33))[1:] > reach[:-1])[: len(lo)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(lo)) - 1
        out: dict = {}
        for k, a, z in zip(owner[first].tolist(), lo[first].tolist(), (reach[last] - (owner[last] << 33)).tolist() if len(first) else []):
            out.setdefault(tuple(self.keys[k].tolist()), []).append((a, z))
        return out


def _settled(threshold: int, n: int, settle_bytes: int, deeper: bool):
    """Runs with their bytes -> final flags.  With ``deeper``, windows of minimisers of more than ``settle_bytes`` go on, to be dealt by all their bytes."""

    def shares(blobs):
        """(blobs, which minimisers, whether they are settled here): ranges of minimisers of about ``settle_bytes``, then the large ones in pieces."""
        h, size = (np.concatenate(x) for x in zip(*((a, b + threshold - 1) for a, b, _ in map(_heads, blobs))))
        h, back = np.unique(h, return_inverse=True)
        size = np.bincount(back, size).astype(np.int64)
        large = h[size > settle_bytes] if deeper else h[:0]
        size[np.isin(h, large)] = 0
        bins = np.cumsum(size) // settle_bytes
        ends = np.flatnonzero(np.append(bins[1:] != bins[:-1], True))
        for lo, hi in zip(np.append(0, ends[:-1] + 1), ends):
            yield blobs, lambda x, lo=h[lo], hi=h[hi]: (x >= lo) & (x <= hi) & ~np.isin(x, large), True
        held, total = [], 0
        for blob in blobs if len(large) else []:
            x, k, _ = _heads(blob)
            held.append(blob)
            total += int((k + threshold - 1)[np.isin(x, large)].sum())
            if total >= settle_bytes:
                yield held, lambda x: np.isin(x, large), False
                held, total = [], 0
        if held and total:
            yield held, lambda x: np.isin(x, large), False

    def settle(blobs):
        for some, keep, whole in shares(blobs):
            runs = _Runs.of_blobs(some, threshold, keep)
            repeats, of, reps, least, mine = runs.settle()
            if len(repeats):
                yield from _by_document(_FINAL, runs.flags(repeats), runs.ids, runs.ties, n, _FLAG)
            if whole:
                cls, offset = runs.windows(of, reps, least, mine)
            else:
                k = runs.n[reps]
                cls, offset = np.repeat(np.arange(len(reps)), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            if not len(cls):
                continue
            left, group = runs.equal_windows(cls, offset, reps, least)
            gone = _later(runs, left, group, cls, least)
            if len(gone):
                yield from _by_document(_FINAL, _window_flags(runs, offset[gone], cls[gone], of, mine), runs.ids, runs.ties, n, _FLAG)
            if whole:
                continue
            # each window on its own, those that are settled left out
            rest = np.ones(len(cls), bool)
            rest[gone] = False
            cls, offset = cls[rest], offset[rest]
            at = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=len(reps)))])
            place = runs.start[reps[cls]] + offset
            times = np.diff(at)[of[mine]]
            w = np.repeat(at[of[mine]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            who = np.repeat(mine, times)
            one = np.ones(len(place), np.int64)
            deep = _Runs(runs.raw, place, one, _window_digit(runs.u, place, threshold), w, runs.doc[who], runs.lo[who] + offset[w], runs.ids, runs.ties, threshold)
            every = np.arange(len(w))
            yield from _dealt(_BYTES, _range(deep.h[w], n), lambda idx: deep.blob(every[idx], w, np.arange(len(place))))

    return _parts(settle)


def _window_digit(u, place, threshold):
    h = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for o in [*range(0, threshold - 7, 8), *([threshold - 8] if threshold % 8 else [])]:
            h = mix(h * _GOLD + u[place + o])
    return h >> _U(16)


def _sorted(df: DataFrame, n: int, work) -> DataFrame:
    return df.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("kind", "part").mapInArrow(work, _OUT)


def _with_texts(records: DataFrame, d: DataFrame, n: int) -> DataFrame:
    """(kind, part, doc_id, tie, text, payload): of each part first its records (kind 0), then its texts."""
    none = lambda t: F.lit(None).cast(t)
    rows = records.select(F.lit(0).alias("kind"), F.pmod("part", F.lit(n)).cast("int").alias("part"), none("long").alias("doc_id"), none("long").alias("tie"), none("string").alias("text"), "payload")

    def parts(it):
        for b in it:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((mix(ids.astype(np.uint64)) % _U(n)).astype(np.int32))], ["doc_id", "tie", "text", "part"])

    texts = d.mapInArrow(parts, "doc_id long, tie long, text string, part int").select(F.lit(1).alias("kind"), "part", "doc_id", "tie", "text", none("binary").alias("payload"))
    return rows.unionByName(texts).repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind")


def _cutter(threshold: int):
    """A part's flags, then its documents' texts -> spans [first, last) of removed bytes of each document."""

    def run(it):
        part, flags, index = None, [], None
        for b in it:
            out: list[list] = [[], [], []]
            for kind, p, doc, tie, text, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                if p != part:
                    part, flags, index = p, [], None
                if kind == 0:
                    flags.append(blob.as_py())
                    continue
                if index is None:
                    index, flags = _Index(flags, _FLAG).spans(threshold), []
                out[0].append(doc)
                out[1].append(text.as_py())
                out[2].append(index.get((doc, tie), []))
            if out[0]:
                pairs = pa.array([[{"first": a, "last": z} for a, z in s] for s in out[2]], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pairs], ["doc_id", "text", "spans"])

    return run


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 50, gram: int = 16, settle_bytes: int = SETTLE_BYTES) -> DataFrame:
    """(doc_id, text, spans) of every row: maximal runs of UTF-8 bytes covered by windows that a smaller id also has.

    Null texts are empty; texts shorter than ``threshold`` bytes have no window.  Rows that repeat an id don't count as
    earlier for one another.  Rows with a null id come before all ids and lose nothing.
    """
    if not 8 <= gram <= min(16, threshold):
        raise ValueError("gram must be from 8 to 16 and at most threshold")
    n = partitions(docs.sparkSession)
    none = -(1 << 63)  # stands for the null id
    d = identified(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(none)).alias("doc_id"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    open_runs = written(_sorted(d.mapInArrow(_minimiser_pass(threshold, gram, n), _OUT), n, _shared_minimisers(n)).select("part", "payload"), "open-runs")
    sent = _with_texts(open_runs, d, n).mapInArrow(_byte_pass(threshold, gram, n), _OUT)
    settled = written(_sorted(sent, n, _settled(threshold, n, settle_bytes, True)), "repeats")
    discard(open_runs)
    flags = settled.where(F.col("kind") == _FINAL).select("part", "payload")
    again = settled.where(F.col("kind") == _BYTES)
    if not again.isEmpty():
        deep = again.select(F.lit(_SORT).alias("kind"), "part", "payload")
        deeper = written(_sorted(deep, n, _settled(threshold, n, settle_bytes, False)).select("part", "payload"), "repeated-windows")
        flags = flags.unionByName(deeper)
    cut = _with_texts(flags, d, n).mapInArrow(_cutter(threshold), "doc_id long, text string, spans array<struct<first:long,last:long>>")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))


def remove_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of rows with (doc_id, text, spans): kept has the remaining bytes."""

    def run(it):
        for b in it:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data, at, left = text.encode(), 0, []
                for s in spans:
                    left.append(data[at : s["first"]])
                    at = s["last"]
                kept = b"".join([*left, data[at:]])
                for col, v in zip(out, (len(data), len(data) - len(kept), len(spans), kept)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark, sf_dir):
    kept = remove_spans(repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
