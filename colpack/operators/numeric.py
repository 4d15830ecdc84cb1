"""Compression of numeric array columns, one typed block a row."""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from colpack.errors import InvalidParameter
from colpack.functions import codec, typed


def _array(values: pa.Array, dtype: str) -> np.ndarray:
    """An Arrow list's elements as an array of the type, checked to fit it."""
    if values.null_count:
        raise InvalidParameter("an array with null elements")
    form = typed.NUMPY[typed.dtype_number(dtype)]
    if dtype == "uint64":
        found = [int(v) for v in values.to_pylist()]
        if found and not 0 <= min(found) <= max(found) < 1 << 64:
            raise InvalidParameter("an element is outside uint64")
        return np.array(found, form)
    plain = values.to_numpy(zero_copy_only=False)
    if form.kind in "iu" and len(plain) and not np.iinfo(form).min <= plain.min() <= plain.max() <= np.iinfo(form).max:
        raise InvalidParameter(f"an element is outside {dtype}")
    return plain.astype(form)


def compress_numeric(col, dtype: str = "int64", codec_name: str = "zstd", level: int = 3) -> Column:
    """Typed blocks of an array column, by one context a task.

    Null stays null; an empty array, null elements and values outside the type are errors.
    """
    typed.dtype_number(dtype)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = codec.Encoder(codec_name, level)
        try:
            for batch in batches:
                yield pa.array([typed.encode(encoder, _array(x.values, dtype), dtype) if x.is_valid else None for x in batch], pa.binary())
        finally:
            encoder.close()

    return run(col)


def _list(batch: pa.Array, decoder: codec.Decoder, dtype: str, reinterpret: bool) -> pa.Array:
    found = [None if b is None else typed.decode(decoder, b, dtype, reinterpret) for b in batch.to_pylist()]
    sizes = [0 if x is None else len(x) for x in found]
    flat = np.concatenate([x for x in found if x is not None]) if any(sizes) else np.zeros(0, typed.NUMPY[typed.dtype_number(dtype)])
    if dtype == "uint64":
        values = pa.array([Decimal(int(v)) for v in flat], pa.decimal128(20, 0))
    else:
        kinds = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        kind = kinds[typed.spark_type(dtype)]
        values = pa.array(flat.astype(kind.to_pandas_dtype()), kind)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in found]))


def decompress_numeric(col, dtype: str = "int64", reinterpret: bool = False) -> Column:
    """Arrays of typed blocks.  Another type than a block was made of is an error unless reinterpret is set."""
    kind = typed.spark_type(dtype)

    @F.arrow_udf(f"array<{kind}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = codec.Decoder()
        try:
            for batch in batches:
                yield _list(batch, decoder, dtype, reinterpret)
        finally:
            decoder.close()

    return run(col)


def compress_numeric_once(col, dtype: str = "int64") -> Column:
    """compress_numeric() with a context of its own for every array."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([typed.encode(codec.Encoder(), _array(x.values, dtype), dtype) if x.is_valid else None for x in batch], pa.binary())

    return run(col)


def decompress_numeric_once(col, dtype: str = "int64", reinterpret: bool = False) -> Column:
    """decompress_numeric() with a context of its own for every batch."""
    kind = typed.spark_type(dtype)

    @F.arrow_udf(f"array<{kind}>")
    def run(batch: pa.Array) -> pa.Array:
        return _list(batch, codec.Decoder(), dtype, reinterpret)

    return run(col)
