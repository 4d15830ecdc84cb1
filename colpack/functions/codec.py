"""Blocks: a self-describing header and a payload.

Header, little-endian: magic 'CPK1', version u8, codec u8, dtype u8, flags u8, raw length u64, and
with flag 1 a crc32 u32 of the raw bytes.  A payload that would not be smaller is stored, so a block
is at most OVERHEAD bytes longer than its input.
"""

import struct
import zlib

import zstandard

from colpack.errors import ContextClosed, CorruptedData, EmptyInput, InvalidParameter

MAGIC, VERSION = b"CPK1", 1
STORED, ZLIB, ZSTD = 0, 1, 2
CODECS = {"stored": STORED, "zlib": ZLIB, "zstd": ZSTD}
CHECKSUM = 1
HEAD = struct.Struct("<4sBBBBQ")
OVERHEAD = HEAD.size + 4
#: A block whose header claims more than this is refused before memory is set aside.
MOST_RAW = 1 << 31


def compress_bound(n: int) -> int:
    """Longest block that n raw bytes can give."""
    return n + OVERHEAD


class Encoder:
    """A reusable compression context; close() frees it and may be called again."""

    def __init__(self, codec: str = "zstd", level: int = 3, checksum: bool = False):
        if codec not in CODECS:
            raise InvalidParameter(f"codec {codec!r} is none of {sorted(CODECS)}")
        if not 1 <= level <= 9:
            raise InvalidParameter(f"level {level} is not within 1 to 9")
        self.codec, self.level, self.checksum = CODECS[codec], level, checksum
        self._zstd = zstandard.ZstdCompressor(level=level) if self.codec == ZSTD else None
        self.closed = False

    def pack(self, data) -> bytes:
        """The compressed payload alone."""
        if self.codec == ZSTD:
            return self._zstd.compress(data)
        return zlib.compress(data, self.level) if self.codec == ZLIB else bytes(data)

    def compress(self, data, dtype: int = 0, flags: int = 0, packed: bytes | None = None, raw_len: int | None = None) -> bytes:
        """A block of data; packed and raw_len are for payloads that a transform has prepared."""
        if self.closed:
            raise ContextClosed("the encoder is closed")
        if not len(data):
            raise EmptyInput("nothing to compress")
        payload, codec = self.pack(data) if packed is None else packed, self.codec
        if len(payload) >= len(data):
            payload, codec, flags = bytes(data), STORED, 0
        flags |= CHECKSUM * self.checksum
        head = HEAD.pack(MAGIC, VERSION, codec, dtype, flags, len(data) if raw_len is None else raw_len)
        return b"".join((head, struct.pack("<I", zlib.crc32(data)) if self.checksum else b"", payload))

    def close(self) -> None:
        self._zstd, self.closed = None, True


class Decoder:
    """A reusable decompression context; close() frees it and may be called again."""

    def __init__(self):
        self._zstd = zstandard.ZstdDecompressor()
        self.closed = False

    def open(self, block) -> tuple[bytes, int, int]:
        """(payload after the general codec, dtype, flags); the payload still has its transform."""
        if self.closed:
            raise ContextClosed("the decoder is closed")
        if not len(block):
            raise EmptyInput("nothing to decompress")
        if len(block) < HEAD.size:
            raise CorruptedData("shorter than a header")
        magic, version, codec, dtype, flags, raw = HEAD.unpack_from(block)
        if magic != MAGIC or version != VERSION or codec > ZSTD or not raw or raw > MOST_RAW:
            raise CorruptedData("no valid header")
        at = HEAD.size + 4 * (flags & CHECKSUM)
        if len(block) < at:
            raise CorruptedData("shorter than its header")
        payload = bytes(block[at:])
        try:
            if codec == ZSTD:
                payload = self._zstd.decompress(payload, max_output_size=raw)
            elif codec == ZLIB:
                inflater = zlib.decompressobj()
                payload = inflater.decompress(payload, raw)
                if not inflater.eof and (inflater.decompress(inflater.unconsumed_tail, 1) or not inflater.eof):
                    raise CorruptedData("more data than the header says")
        except (zstandard.ZstdError, zlib.error) as e:
            raise CorruptedData(str(e)) from None
        if len(payload) != raw:
            raise CorruptedData(f"{len(payload)} bytes where the header says {raw}")
        return payload, dtype, flags

    def decompress(self, block) -> bytes:
        """The raw bytes of any block, those of a typed one little-endian."""
        return self.finish(block, *self.open(block))

    def finish(self, block, payload: bytes, dtype: int, flags: int) -> bytes:
        """The raw bytes of a block that open() has opened."""
        from colpack.functions.typed import untransform

        data = untransform(payload, dtype, flags)
        if flags & CHECKSUM and zlib.crc32(data) != struct.unpack_from("<I", block, HEAD.size)[0]:
            raise CorruptedData("the checksum differs")
        return data

    def close(self) -> None:
        self._zstd, self.closed = None, True


def compress(data, **options) -> bytes:
    """One-shot compression of a block."""
    return Encoder(**options).compress(data)


def decompress(block) -> bytes:
    """One-shot decompression of a block."""
    return Decoder().decompress(block)
