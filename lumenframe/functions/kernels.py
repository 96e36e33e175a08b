"""Numpy kernels over whole frames; the Arrow operators call these batch by batch."""

from __future__ import annotations

import numpy as np


def pack_bits(mask: np.ndarray) -> bytes:
    """A boolean image as a bitmap, one bit a pixel in scan order, least significant first."""
    return np.packbits(np.asarray(mask, bool).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n).astype(bool)


def pack_values(values: np.ndarray, depth: int) -> bytes:
    """Integers of ``depth`` bits as one little-endian bit stream; the last byte is filled up."""
    v = np.asarray(values, np.uint64)
    if len(v) and int(v.max()) >> depth:
        raise ValueError(f"a value needs more than {depth} bits")
    bits = ((v[:, None] >> np.arange(depth, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_values(data: bytes, depth: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * depth).reshape(n, depth)
    return (bits.astype(np.int64) << np.arange(depth)).sum(1)


def scaled(values: np.ndarray, depth: int, always: bool = False) -> np.ndarray:
    """Values fitted to ``depth`` bits where the largest does not fit (or always)."""
    v = np.asarray(values, np.int64)
    top = (1 << depth) - 1
    if not len(v) or (v.max() <= top and not always):
        return v
    lo, hi = int(v.min()), int(v.max())
    return np.ceil((v - lo) / max(1, hi - lo) * top).astype(np.int64)


def index_bytes(index: np.ndarray, width: int = 3) -> bytes:
    """Linear indices as little-endian integers of ``width`` bytes."""
    v = np.asarray(index, "<u8")
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def bitshuffle(data: bytes, item: int) -> bytes:
    """Bits of equal weight of all items brought together; a tail of fewer than eight items stays as it is."""
    n = len(data) // item // 8 * 8
    head = np.frombuffer(data, np.uint8, n * item).reshape(n, item)
    bits = np.unpackbits(head, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * item :]


def unbitshuffle(data: bytes, item: int) -> bytes:
    n = len(data) // item // 8 * 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * item).reshape(item * 8, n // 8), axis=1, bitorder="little") if n else np.zeros((item * 8, 0), np.uint8)
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * item :]


def label(frame: np.ndarray, y: np.ndarray, x: np.ndarray, ny: int, nx: int) -> np.ndarray:
    """8-connected components of the pixels of many frames at once.

    Returns each pixel's label: the smallest y * nx + x of its component.  Pixels are joined to the four neighbours that follow in scan
    order; labels sink to each edge's minimum and jump to their label's label until nothing changes.
    """
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    frame, y, x = (np.asarray(v, np.int64) for v in (frame, y, x))
    _, rank = np.unique(frame, return_inverse=True)
    cell = (rank * (ny + 2) + y + 1) * (nx + 2) + x + 1
    order = np.argsort(cell, kind="stable")
    cells = cell[order]
    a, b = [], []
    for step in (1, nx + 1, nx + 2, nx + 3):
        at = np.searchsorted(cells, cells + step)
        hit = np.flatnonzero((at < n) & (cells[np.minimum(at, n - 1)] == cells + step))
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        before = lab.copy()
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while True:
            jumped = lab[lab]
            if (jumped == lab).all():
                break
            lab = jumped
        if (lab == before).all():
            break
        open_ = lab[a] != lab[b]
        a, b = a[open_], b[open_]
    out = np.empty(n, np.int64)
    out[order] = (y * nx + x)[order][lab]
    return out


def _sunk(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes is joined to by edges a-b."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while True:
            jumped = lab[lab]
            if (jumped == lab).all():
                break
            lab = jumped
        apart = lab[a] != lab[b]
        a, b = a[apart], b[apart]
    return lab


def level_components(level: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, pixels) of an image's foreground at each of n thresholds; a pixel is foreground at the thresholds 0 to level - 1.

    Pixels join from the highest threshold down: at each one the edges to pixels that are new there join the components that there are, so every
    edge is looked at once.  What a threshold has is its pixels less the joins so far.
    """
    ny, nx = level.shape
    pixels = np.bincount(level.ravel(), minlength=n + 1)[::-1].cumsum()[::-1][1:]
    index = np.arange(ny * nx).reshape(ny, nx)
    a, b, w = [], [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        here = (slice(0, ny - dy), slice(max(0, -dx), nx - max(0, dx)))
        there = (slice(dy, ny), slice(max(0, dx), nx - max(0, -dx)))
        both = np.minimum(level[here], level[there])
        on = both > 0
        a.append(index[here][on])
        b.append(index[there][on])
        w.append(both[on])
    a, b, w = np.concatenate(a), np.concatenate(b), np.concatenate(w)
    order = np.argsort(-w, kind="stable")
    a, b, w = a[order], b[order], w[order]
    cuts = np.searchsorted(-w, -np.arange(n, -1, -1), "left")  # edges of weight n, n - 1, ... 1
    root, joins, out = np.arange(ny * nx), 0, np.zeros(n, np.int64)

    def top(x):
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    for k in range(n):
        x, y = top(a[cuts[k] : cuts[k + 1]]), top(b[cuts[k] : cuts[k + 1]])
        apart = x != y
        nodes, local = np.unique(np.concatenate([x[apart], y[apart]]), return_inverse=True)
        if len(nodes):
            half = len(local) // 2
            low = _sunk(local[:half], local[half:], len(nodes))
            root[nodes] = nodes[low]
            joins += len(nodes) - len(np.unique(low))
        out[n - 1 - k] = pixels[n - 1 - k] - joins
    return out, pixels.astype(np.int64)


def event_rows(frame, y, x, v, ny: int, nx: int, border: str = "keep") -> dict[str, np.ndarray]:
    """Components of sparse pixels with their sums: area, w = sum v, wy = sum v*y, wx = sum v*x, vmax, vmin, and the peak pixel (ties: first in scan order)."""
    frame, y, x, v = (np.asarray(c, np.int64) for c in (frame, y, x, v))
    if border == "drop":
        ok = (y > 0) & (y < ny - 1) & (x > 0) & (x < nx - 1)
        frame, y, x, v = frame[ok], y[ok], x[ok], v[ok]
    lab = label(frame, y, x, ny, nx)
    order = np.lexsort((y * nx + x, -v, lab, frame))
    frame, y, x, v, lab = (c[order] for c in (frame, y, x, v, lab))
    if not len(v):
        return {k: np.zeros(0, np.int64) for k in ("frame_id", "lab", "area", "w", "wy", "wx", "vmax", "vmin", "py", "px")}
    head = np.flatnonzero(np.append(True, (frame[1:] != frame[:-1]) | (lab[1:] != lab[:-1])))
    total = lambda c: np.add.reduceat(c, head)
    return {
        "frame_id": frame[head], "lab": lab[head], "area": total(np.ones_like(v)), "w": total(v), "wy": total(v * y), "wx": total(v * x),
        "vmax": v[head], "vmin": np.minimum.reduceat(v, head), "py": y[head], "px": x[head],
    }


def gaussian_sigma(counts: np.ndarray, centres: np.ndarray, rounds: int = 200) -> float:
    """Width of the Gaussian that fits a histogram best by least squares (damped Gauss-Newton from the histogram's own moments)."""
    c, h = np.asarray(counts, float), np.asarray(centres, float)
    if c.sum() <= 0:
        return 0.0
    mean = (c * h).sum() / c.sum()
    p = np.array([c.max(), mean, max(1e-9, np.sqrt((c * (h - mean) ** 2).sum() / c.sum()))])
    damp, model = 1e-3, lambda p: p[0] * np.exp(-((h - p[1]) ** 2) / (2 * p[2] ** 2))
    err = ((model(p) - c) ** 2).sum()
    for _ in range(rounds):
        m = model(p)
        d = h - p[1]
        jac = np.stack([m / p[0] if p[0] else np.exp(-(d**2)), m * d / p[2] ** 2, m * d**2 / p[2] ** 3], 1)
        a = jac.T @ jac
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), jac.T @ (c - m), rcond=None)[0]
        trial = p + step
        new = ((model(trial) - c) ** 2).sum() if abs(trial[2]) > 1e-12 else np.inf
        if new < err:
            done = err - new <= 1e-12 * err
            p, err, damp = trial, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(abs(p[2]))
