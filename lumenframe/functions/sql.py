"""Functions for plain SQL: packing and unpacking of bits, values and whole frames, by Arrow batches.

``pack_bits(array<int>, n)`` and ``unpack_bits(binary, n)`` turn indices of set pixels into a bitmap and back; ``pack_values(array<int>, depth)`` and
``unpack_values(binary, depth, n)`` do so for values; ``compress`` and ``decompress`` take a codec's name.  ``unpack_frame`` is a table function: with LATERAL it gives a record's pixels (y, x, v).
A null argument gives null, or no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf

from . import codecs, kernels


def _each(work, kind: pa.DataType, *columns) -> pa.Array:
    """work(*values) of each row, null where an argument is."""
    cols = [c.to_pylist() if not pa.types.is_list(c.type) else c for c in columns]
    out = []
    for row in zip(*cols):
        row = [v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) and v.is_valid else None if isinstance(v, pa.ListScalar) else v for v in row]
        out.append(None if any(v is None for v in row) else work(*row))
    return pa.array(out, kind)


def _bits(at, n):
    mask = np.zeros(n, bool)
    mask[np.asarray(at, np.int64)] = True
    return kernels.pack_bits(mask)


@arrow_udf(T.BinaryType())
def pack_bits(at: pa.Array, n: pa.Array) -> pa.Array:
    return _each(_bits, pa.binary(), at, n)


@arrow_udf(T.ArrayType(T.IntegerType()))
def unpack_bits(bitmap: pa.Array, n: pa.Array) -> pa.Array:
    return _each(lambda b, k: np.flatnonzero(kernels.unpack_bits(b, k)).astype(np.int32), pa.list_(pa.int32()), bitmap, n)


@arrow_udf(T.BinaryType())
def pack_values(values: pa.Array, depth: pa.Array) -> pa.Array:
    return _each(lambda v, d: kernels.pack_values(np.asarray(v, np.int64), d), pa.binary(), values, depth)


@arrow_udf(T.ArrayType(T.IntegerType()))
def unpack_values(data: pa.Array, depth: pa.Array, n: pa.Array) -> pa.Array:
    return _each(lambda b, d, k: kernels.unpack_values(b, d, k).astype(np.int32), pa.list_(pa.int32()), data, depth, n)


@arrow_udf(T.BinaryType())
def compress(data: pa.Array, codec: pa.Array) -> pa.Array:
    return _each(lambda b, c: codecs.compress(b, c), pa.binary(), data, codec)


@arrow_udf(T.BinaryType())
def decompress(data: pa.Array, codec: pa.Array) -> pa.Array:
    return _each(lambda b, c: codecs.decompress(b, c), pa.binary(), data, codec)


@udtf(returnType=T.StructType([T.StructField(c, T.IntegerType()) for c in "yxv"]), useArrow=True)
class unpack_frame:
    """(y, x, v) of a record's two streams: bitmap and packed values (or null: all 1) of frames ``nx`` wide with ``pixels`` pixels; ``codec`` null or 'none' for plain streams."""

    def eval(self, bitmap, vals, depth: int, codec: str, nx: int, pixels: int):
        if bitmap is None:
            return
        plain = codec is None or codec == "none"
        at = np.flatnonzero(kernels.unpack_bits(bytes(bitmap) if plain else codecs.decompress(bytes(bitmap), codec), pixels))
        v = np.ones(len(at), np.int64) if vals is None else kernels.unpack_values(bytes(vals) if plain else codecs.decompress(bytes(vals), codec), depth, len(at))
        yield from zip((at // nx).tolist(), (at % nx).tolist(), v.tolist())


def register_functions(spark: SparkSession) -> SparkSession:
    """Makes the functions known to a session's SQL."""
    for f in (pack_bits, unpack_bits, pack_values, unpack_values, compress, decompress):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("unpack_frame", unpack_frame)
    return spark
