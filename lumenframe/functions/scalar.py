"""Scalar column functions and small helpers of the frame model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of the ten pixel type codes (u8 u16 u32 u64 i8 i16 i32 i64 f32 f64); unsigned ones are widened.
PIXEL_TYPES = [T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 0), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
NUMPY_TYPES = ["u1", "<u2", "<u4", "<u8", "i1", "<i2", "<i4", "<i8", "<f4", "<f8"]


def type_code(kind: int, bits: int) -> int:
    """Code of the smallest type of a kind (0 unsigned, 1 signed, 2 float) that holds ``bits`` bits."""
    sizes = {0: [8, 16, 32, 64], 1: [8, 16, 32, 64], 2: [32, 64]}
    if kind not in sizes or not 0 < bits <= 64:
        raise ValueError(f"no pixel type of kind {kind} and {bits} bits")
    return {0: 0, 1: 4, 2: 8}[kind] + next(i for i, s in enumerate(sizes[kind]) if bits <= s)


def linear_index(y: Column | str, x: Column | str, nx: int) -> Column:
    return (F.col(y) if isinstance(y, str) else y) * nx + (F.col(x) if isinstance(x, str) else x)


def row_of(index: Column, nx: int) -> Column:
    return F.floor(index / nx).cast("int")


def column_of(index: Column, nx: int) -> Column:
    return F.pmod(index, F.lit(nx)).cast("int")


def ratio_rounded(total: str, weight: str, mode: str = "half_up") -> Column:
    """total / weight as an integer by exact integer arithmetic: half away from nought, half to even, or floor (weights and totals are not negative)."""
    if mode == "half_up":
        return F.expr(f"cast((2 * {total} + {weight}) div (2 * {weight}) as int)")
    if mode == "floor":
        return F.expr(f"cast({total} div {weight} as int)")
    if mode == "half_even":
        q = f"({total} div {weight})"
        return F.expr(f"cast({q} + CASE WHEN 2 * ({total} - {q} * {weight}) > {weight} OR (2 * ({total} - {q} * {weight}) = {weight} AND {q} % 2 = 1) THEN 1 ELSE 0 END as int)")
    raise ValueError(f"unknown rounding {mode!r}")


def clamped(value: Column, bits: int, signed: bool = False) -> Column:
    """Clipped to an integer type's range, then truncated."""
    lo, hi = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value)).cast("long")


def wrapped16(value: Column) -> Column:
    """Unsigned 16-bit wrap-around, for comparison with files made by wrapping arithmetic."""
    return value.bitwiseAND(F.lit(65535))


def part_name(stem: str, level: int, part: int) -> str:
    return f"{stem}.rc{level}_part{part:03d}"


def part_number(path: Column) -> Column:
    return F.regexp_extract(path, r"_part(\d+)$", 1).cast("int")


def part_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\.rc\d_part\d+$", 1)


def pixel_size_angstrom(magnification: Column | float) -> Column:
    """Pixel size from the magnification in thousands."""
    return F.lit(0.102) / ((magnification if isinstance(magnification, Column) else F.lit(float(magnification))) / 60)


def resolution_angstrom(k: Column, nx: int, pixel: float) -> Column:
    return F.lit(float(nx)) / k * F.lit(pixel * 10)


def frame_time(frame_id: Column, fps: float) -> Column:
    """The frame's time from the start of its run, as a timestamp after the epoch."""
    return F.timestamp_micros((frame_id.cast("double") / F.lit(float(fps)) * F.lit(1_000_000.0)).cast("long"))


def message_json(session_id: Column, kind: Column, message: Column, data: Column) -> Column:
    return F.to_json(F.struct(session_id.alias("session_id"), kind.alias("type"), message.alias("message"), data.alias("mapped_data")))


def message_of(json: Column) -> Column:
    return F.from_json(json, "session_id string, type string, message string, mapped_data map<string,string>")


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are alike but for their case."""
    return F.lower(a) == F.lower(b)


def log_time(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy-HH:mm:ss")
