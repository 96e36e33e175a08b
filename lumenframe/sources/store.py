"""Files in whatever store an executor reaches: plain and ``file:`` paths as they are, others by their URI (HDFS, S3 and the like, as Arrow knows them)."""

from __future__ import annotations

import fnmatch
import json
import re
import uuid

from pyarrow import fs

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):")


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    m = _SCHEME.match(path)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)
    return fs.FileSystem.from_uri(path)


def is_local(path: str) -> bool:
    return isinstance(resolve(path)[0], fs.LocalFileSystem)


def join(path: str, *names: str) -> str:
    return "/".join([path.rstrip("/"), *names])


def listing(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in ns) of the files of a folder, or of those that match a pattern; hidden ones are left out.  Paths keep the scheme of ``path``."""
    store, at = resolve(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    if not any(c in at for c in "*?["):
        info = store.get_file_info(at)
        if info.type == fs.FileType.File:
            return [(head + at, info.size, info.mtime_ns or 0)]
        base, pattern = at, None
    else:
        parts = at.split("/")
        k = next(i for i, p in enumerate(parts) if any(c in p for c in "*?["))
        base, pattern = "/".join(parts[:k]) or "/", at
    deep = pattern is not None and "/" in pattern[len(base) :].lstrip("/")
    found = store.get_file_info(fs.FileSelector(base, recursive=deep, allow_not_found=True))
    out = [(head + i.path, i.size, i.mtime_ns or 0) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    if pattern is not None:
        depth = pattern.count("/")
        out = [o for o in out if o[0][len(head) :].count("/") == depth and fnmatch.fnmatchcase(o[0][len(head) :], pattern)]
    return sorted(out)


def find(path: str) -> list[str]:
    found = [p for p, _, _ in listing(path)]
    if not found:
        raise FileNotFoundError(f"no files at {path}")
    return found


def open_read(path: str):
    """A seekable file."""
    store, at = resolve(path)
    return store.open_input_file(at)


def read(path: str) -> bytes:
    with open_read(path) as f:
        return f.readall()


def size(path: str) -> int:
    store, at = resolve(path)
    return store.get_file_info(at).size or 0


def exists(path: str) -> bool:
    store, at = resolve(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def open_write(path: str):
    store, at = resolve(path)
    return store.open_output_stream(at)


def allocate(path: str, size: int) -> None:
    """A new file of noughts, in a store whose files can be written at any place: a file system that all tasks mount."""
    if not is_local(path):
        raise ValueError(f"{path}: files of this store can't be written at several places at once")
    with open(resolve(path)[1], "wb") as f:
        f.truncate(size)


def patch(path: str, at: int, data: bytes) -> None:
    """Writes into an existing file of such a store."""
    if not is_local(path):
        raise ValueError(f"{path}: files of this store can't be written at a place")
    with open(resolve(path)[1], "r+b") as f:
        f.seek(at)
        f.write(data)


def make_folder(path: str) -> None:
    store, at = resolve(path)
    store.create_dir(at, recursive=True)


def move(path: str, to: str) -> None:
    """Gives a file another name; where a store can't replace a file, the old one goes first."""
    store, at = resolve(path)
    target = resolve(to)[1]
    try:
        store.move(at, target)
    except OSError:
        if store.get_file_info(target).type != fs.FileType.File:
            raise
        store.delete_file(target)
        store.move(at, target)


def delete(path: str) -> None:
    store, at = resolve(path)
    if store.get_file_info(at).type == fs.FileType.File:
        store.delete_file(at)


def write(path: str, data: bytes) -> None:
    """A whole file at once: it appears under its name when it is complete."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open_write(hidden) as f:
        f.write(data)
    move(hidden, path)


def write_json(path: str, value) -> None:
    write(path, json.dumps(value).encode())


def read_json(path: str):
    return json.loads(read(path))
