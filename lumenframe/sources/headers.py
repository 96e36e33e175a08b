"""File headers: the reduced format's 321 bytes, MRC and SEQ."""

from __future__ import annotations

import struct

#: Fixed values of the file format: (field, struct code) in file order, little-endian without padding.
REDUCED_FIELDS = [
    ("uid", "Q"), ("version_major", "B"), ("version_minor", "B"), ("reduction_level", "B"), ("rc_operation_mode", "B"),
    ("target_bit_depth", "B"), ("nx", "H"), ("ny", "H"), ("nz", "I"), ("l2_statistics", "B"), ("l4_centroiding", "B"),
    ("compression_scheme", "B"), ("compression_level", "B"), ("source_file_type", "B"), ("source_header_length", "H"),
    ("source_header_position", "B"), ("source_file_name", "100s"), ("dark_file_name", "100s"), ("dark_threshold_epsilon", "H"),
    ("has_dark_data", "B"), ("frame_offset", "I"), ("dark_frame_offset", "I"), ("num_dark_frames", "I"), ("source_bit_depth", "B"),
    ("source_dtype", "B"), ("target_dtype", "B"), ("checksum", "32s"), ("futures", "42s"),
]
_REDUCED = struct.Struct("<" + "".join(c for _, c in REDUCED_FIELDS))
REDUCED_SIZE = 321
#: The number that files of one writer begin with; others don't, so it is not tested on reading.
MAGIC = 158966344846346
assert _REDUCED.size == REDUCED_SIZE


def read_reduced_header(data: bytes) -> dict:
    if len(data) < REDUCED_SIZE:
        raise ValueError(f"a reduced file's header has {REDUCED_SIZE} bytes, not {len(data)}")
    out = dict(zip((n for n, _ in REDUCED_FIELDS), _REDUCED.unpack(data[:REDUCED_SIZE])))
    for name in ("source_file_name", "dark_file_name"):
        out[name] = out[name].split(b"\0")[0].decode("utf-8", "replace")
    if not 1 <= out["reduction_level"] <= 4 or not out["nx"] or not out["ny"]:
        raise ValueError("not a reduced file's header")
    return out


def write_reduced_header(**fields) -> bytes:
    values = []
    unknown = set(fields) - {n for n, _ in REDUCED_FIELDS}
    if unknown:
        raise ValueError(f"unknown header fields {sorted(unknown)}")
    defaults = {"uid": MAGIC, "version_minor": 1, "rc_operation_mode": 1}
    for name, code in REDUCED_FIELDS:
        v = fields.get(name, defaults.get(name, b"" if code.endswith("s") else 0))
        if code.endswith("s"):
            v = v.encode() if isinstance(v, str) else bytes(v)
            if len(v) > int(code[:-1]):
                raise ValueError(f"{name} is longer than {code[:-1]} bytes")
        values.append(v)
    return _REDUCED.pack(*values)


#: Fixed values of the MRC format: numpy type by mode.
MRC_TYPES = {0: "i1", 1: "<i2", 2: "<f4", 4: "<c8", 6: "<u2"}
MRC_BITS = {0: 8, 1: 16, 2: 32, 4: 64, 6: 16}


def read_mrc_header(data: bytes) -> dict:
    if len(data) < 1024:
        raise ValueError("an MRC header has 1024 bytes")
    ints = struct.unpack_from("<10i", data, 0)
    out = dict(zip(("nx", "ny", "nz", "mode", "nxstart", "nystart", "nzstart", "mx", "my", "mz"), ints))
    out.update(zip(("xlen", "ylen", "zlen", "alpha", "beta", "gamma"), struct.unpack_from("<6f", data, 40)))
    out.update(zip(("mapc", "mapr", "maps"), struct.unpack_from("<3i", data, 64)))
    out.update(zip(("amin", "amax", "amean"), struct.unpack_from("<3f", data, 76)))
    out.update(zip(("ispg", "nsymbt"), struct.unpack_from("<2i", data, 88)))
    out.update(zip(("xorg", "yorg", "zorg"), struct.unpack_from("<3f", data, 196)))
    out["rms"] = struct.unpack_from("<f", data, 216)[0]
    if out["mode"] not in MRC_TYPES:
        raise ValueError(f"MRC mode {out['mode']} is not supported")
    return out


def write_mrc_header(nx: int, ny: int, nz: int, mode: int = 6, ext: int = 0, **stats) -> bytes:
    head = bytearray(1024)
    struct.pack_into("<10i", head, 0, nx, ny, nz, mode, 0, 0, 0, nx, ny, nz)
    struct.pack_into("<6f", head, 40, nx, ny, nz, 90, 90, 90)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    struct.pack_into("<3f", head, 76, stats.get("amin", 0), stats.get("amax", 0), stats.get("amean", 0))
    struct.pack_into("<2i", head, 88, 0, ext)
    head[208:212] = b"MAP "
    head[212:216] = b"\x44\x44\x00\x00"
    return bytes(head)


SEQ_MAGIC, SEQ_HEADER, SEQ_DATA = 0xFEED, 1024, 8192


def read_seq_header(data: bytes) -> dict:
    if len(data) < SEQ_HEADER:
        raise ValueError("a SEQ header has 1024 bytes")
    if struct.unpack_from("<I", data, 0)[0] != SEQ_MAGIC:
        raise ValueError("not a SEQ file")
    out = dict(zip(("version", "header_size"), struct.unpack_from("<iI", data, 28)))
    out["description"] = data[36:548].decode("utf-16-le", "replace").split("\0")[0]
    out.update(zip(("width", "height", "bit_depth", "bit_depth_real", "image_bytes", "image_format", "allocated_frames", "origin", "true_image_size"), struct.unpack_from("<9I", data, 548)))
    out["frame_rate"] = struct.unpack_from("<d", data, 584)[0]
    out.update(zip(("description_format", "reference_frame", "fixed_size", "flags"), struct.unpack_from("<4I", data, 592)))
    out["compression"] = struct.unpack_from("<I", data, 620)[0]
    if out["bit_depth"] not in (8, 16):
        raise TypeError(f"SEQ bit depth {out['bit_depth']} is not supported")
    return out


def write_seq_header(width: int, height: int, frames: int, bit_depth: int = 16, frame_rate: float = 100.0, stride: int | None = None) -> bytes:
    n = width * height * bit_depth // 8
    head = bytearray(SEQ_HEADER)
    struct.pack_into("<I", head, 0, SEQ_MAGIC)
    head[4:24] = "Norpix seq".encode("utf-16-le")
    struct.pack_into("<iI", head, 28, 5, SEQ_HEADER)
    struct.pack_into("<9I", head, 548, width, height, bit_depth, bit_depth, n, 100, frames, 0, stride or -(-n // 1024) * 1024)
    struct.pack_into("<d", head, 584, frame_rate)
    return bytes(head)
