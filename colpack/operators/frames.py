"""Framed byte streams.

A stream is an ordered set of chunks.  It is cut into frames of frame_size raw bytes, whatever the
chunks; a serialised stream is, for each frame, its block's length as four little-endian bytes and
the block, and then four zero bytes.  Frames are rows, so they are encoded side by side.
"""

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colpack.errors import ColpackError, InvalidParameter
from colpack.functions import codec
from colpack.functions.header import le_bytes

DEFAULT_FRAME, LEAST_FRAME, MOST_FRAME = 64 << 10, 4 << 10, 1 << 20
END = bytes(4)


def frame_size_valid(size: Column) -> Column:
    return size.between(LEAST_FRAME, MOST_FRAME)


def check_frame_size(size: int) -> int:
    if not LEAST_FRAME <= size <= MOST_FRAME:
        raise InvalidParameter(f"frame size {size} is not within {LEAST_FRAME} to {MOST_FRAME}")
    return size


def frame(df: DataFrame, keys: list[str], payload: str, frame_size: int = DEFAULT_FRAME) -> DataFrame:
    """(keys, frame_no, payload) of streams that are one binary value each; an empty or null one has no frame."""
    check_frame_size(frame_size)
    size = F.octet_length(payload)
    cuts = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.floor((size - 1) / frame_size).cast("int")), lambda i: F.substring(F.col(payload), i * frame_size + 1, F.lit(frame_size))))
    return df.select(*keys, F.posexplode(cuts).alias("frame_no", "payload"))


def frame_chunks(df: DataFrame, keys: list[str], order: str, payload: str, frame_size: int = DEFAULT_FRAME) -> DataFrame:
    """(keys, frame_no, payload) of streams whose chunks are rows in order; empty and null chunks add nothing.

    Frame boundaries do not depend on the chunks': a chunk that crosses them is cut, and the cuts of a
    frame, at most frame_size bytes together, are put together again.
    """
    check_frame_size(frame_size)
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.octet_length(payload).cast("bigint")
    placed = df.where(size > 0).select(*keys, F.col(payload).alias("__b"), (F.sum(size).over(by) - size).alias("__from"), size.alias("__n"))
    last = F.col("__from") + F.col("__n") - 1
    hit = placed.withColumn("frame_no", F.explode(F.sequence(F.floor(F.col("__from") / frame_size).cast("int"), F.floor(last / frame_size).cast("int"))))
    start = F.greatest(F.col("frame_no").cast("bigint") * frame_size, F.col("__from"))
    end = F.least((F.col("frame_no").cast("bigint") + 1) * frame_size, last + 1)
    cut = hit.select(*keys, "frame_no", start.alias("__at"), F.substring(F.col("__b"), (start - F.col("__from") + 1).cast("int"), (end - start).cast("int")).alias("__b"))
    pieces = F.array_sort(F.collect_list(F.struct("__at", "__b")))
    return cut.groupBy(*keys, "frame_no").agg(pieces.alias("__p")).select(*keys, "frame_no", joined_bytes(F.transform("__p", lambda p: p["__b"])).alias("payload"))


def joined_bytes(parts: Column) -> Column:
    """The concatenation of an array of binary values, in linear time and without Python."""
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.hex(b)), ""))


def reassemble(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(keys, payload): the frames of each stream in order, put together.  For streams that fit a value."""
    parts = F.array_sort(F.collect_list(F.struct("frame_no", payload)))
    return df.groupBy(*keys).agg(joined_bytes(F.transform(parts, lambda f: f[payload])).alias("payload"))


def rendered_frame(block: Column) -> Column:
    """A block as it stands in a serialised stream."""
    return F.concat(le_bytes(F.octet_length(block), 4), block)


def serialize(df: DataFrame, keys: list[str], block: str = "block") -> DataFrame:
    """(keys, stream): the serialised stream of each key's encoded frames, with the end marker."""
    parts = F.array_sort(F.collect_list(F.struct("frame_no", rendered_frame(F.col(block)).alias("b"))))
    return df.groupBy(*keys).agg(F.concat(joined_bytes(F.transform(parts, lambda f: f["b"])), F.lit(END)).alias("stream"))


def serialized_or_empty(stream: Column) -> Column:
    """A stream without frames is the end marker alone."""
    return F.coalesce(stream, F.lit(END))


FRAMES = pa.struct([("status", pa.string()), ("frames", pa.list_(pa.struct([("frame_no", pa.int32()), ("offset", pa.int64()), ("comp_len", pa.int32()), ("payload", pa.binary())])))])
FRAMES_DDL = "struct<status:string,frames:array<struct<frame_no:int,offset:bigint,comp_len:int,payload:binary>>>"


def parse(stream: bytes, decoder: codec.Decoder, most: int = codec.compress_bound(MOST_FRAME)) -> dict:
    """status and the good frames before whatever ends a serialised stream.

    OK at the marker, behind which nothing is read; OK_NO_EOS at the end of a frame; TRUNCATED_HEADER
    within a length; FRAME_TOO_LARGE, TRUNCATED_FRAME and CORRUPTED_FRAME as they say.
    """
    frames, at = [], 0
    while True:
        head = stream[at : at + 4]
        if len(head) < 4:
            return {"status": "TRUNCATED_HEADER" if head else "OK_NO_EOS", "frames": frames}
        (n,) = struct.unpack("<I", head)
        if not n:
            return {"status": "OK", "frames": frames}
        if n > most:
            return {"status": "FRAME_TOO_LARGE", "frames": frames}
        block = stream[at + 4 : at + 4 + n]
        if len(block) < n:
            return {"status": "TRUNCATED_FRAME", "frames": frames}
        try:
            payload = decoder.decompress(block)
        except ColpackError:
            return {"status": "CORRUPTED_FRAME", "frames": frames}
        frames.append({"frame_no": len(frames), "offset": at, "comp_len": n, "payload": payload})
        at += 4 + n


def parse_stream(col) -> Column:
    """struct<status, frames> of a column of serialised streams; null stays null."""

    @F.arrow_udf(FRAMES_DDL)
    def run(batch: pa.Array) -> pa.Array:
        decoder = codec.Decoder()
        return pa.array([None if s is None else parse(s, decoder) for s in batch.to_pylist()], FRAMES)

    return run(col)


def unframe(df: DataFrame, keys: list[str], stream: str = "stream") -> DataFrame:
    """(keys, status, frame_no, offset, comp_len, payload): a row for each good frame of each stream."""
    return df.select(*keys, parse_stream(F.col(stream)).alias("__s")).select(*keys, "__s.status", F.inline("__s.frames"))
