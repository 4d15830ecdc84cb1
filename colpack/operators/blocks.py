"""Compression of binary columns, one block a row.

The columns are Arrow iterator functions: a task makes one context and reuses it for all its batches.
Null stays null.  Strict columns raise; try_ columns return struct<payload, error>.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from colpack.errors import ColpackError
from colpack.functions import codec


def mapped(values: pa.Array, f: Callable) -> pa.Array:
    return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.binary())


def compress(col, codec_name: str = "zstd", level: int = 3, checksum: bool = False) -> Column:
    """Blocks of a binary column."""
    options = {"codec": codec_name, "level": level, "checksum": checksum}
    codec.Encoder(**options).close()  # wrong options fail here, not on the executors

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = codec.Encoder(**options)
        try:
            for batch in batches:
                yield mapped(batch, encoder.compress)
        finally:
            encoder.close()

    return run(col)


def decompress(col) -> Column:
    """Raw bytes of a column of blocks."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = codec.Decoder()
        try:
            for batch in batches:
                yield mapped(batch, decoder.decompress)
        finally:
            decoder.close()

    return run(col)


def compress_once(col) -> Column:
    """compress() with a context of its own for every value."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return mapped(batch, codec.compress)

    return run(col)


def decompress_once(col) -> Column:
    """decompress() with a context of its own for every value."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return mapped(batch, codec.decompress)

    return run(col)


TRIED = pa.struct([("payload", pa.binary()), ("error", pa.string())])


def tried(values: pa.Array, f: Callable) -> pa.Array:
    out = []
    for v in values.to_pylist():
        try:
            out.append(None if v is None else {"payload": f(v), "error": None})
        except ColpackError as e:
            out.append({"payload": None, "error": e.code})
    return pa.array(out, TRIED)


def try_compress(col, **options) -> Column:
    """struct<payload, error>: a block, or the code of what is wrong with the input."""

    @F.arrow_udf("struct<payload:binary,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = codec.Encoder(**options)
        for batch in batches:
            yield tried(batch, encoder.compress)

    return run(col)


def try_decompress(col) -> Column:
    """struct<payload, error>: raw bytes, or the code of what is wrong with the block."""

    @F.arrow_udf("struct<payload:binary,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = codec.Decoder()
        for batch in batches:
            yield tried(batch, decoder.decompress)

    return run(col)


def register(spark) -> None:
    """compress and decompress as SQL functions colpack_compress and colpack_decompress."""

    @F.arrow_udf("binary")
    def colpack_compress(batch: pa.Array) -> pa.Array:
        encoder = codec.Encoder()
        return mapped(batch, encoder.compress)

    @F.arrow_udf("binary")
    def colpack_decompress(batch: pa.Array) -> pa.Array:
        decoder = codec.Decoder()
        return mapped(batch, decoder.decompress)

    spark.udf.register("colpack_compress", colpack_compress)
    spark.udf.register("colpack_decompress", colpack_decompress)
