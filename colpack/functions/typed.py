"""Numeric arrays: a transform that knows the element width, before the general codec.

Elements are taken as unsigned integers of their width, so floats keep their bits.  The transforms
are byte transposition, and wrapping delta, zigzag and then transposition; the smaller result wins.
"""

import numpy as np

from colpack.errors import CorruptedData, EmptyInput, InvalidParameter, TypeMismatch
from colpack.functions.codec import Decoder, Encoder

#: Element types by their number in the header, with the Spark type that holds each.
DTYPES = {
    "int8": (1, "<i1", "tinyint"),
    "uint8": (2, "<u1", "smallint"),
    "int16": (3, "<i2", "smallint"),
    "uint16": (4, "<u2", "int"),
    "int32": (5, "<i4", "int"),
    "uint32": (6, "<u4", "bigint"),
    "int64": (7, "<i8", "bigint"),
    "uint64": (8, "<u8", "decimal(20,0)"),
    "float32": (9, "<f4", "float"),
    "float64": (10, "<f8", "double"),
}
NUMPY = {number: np.dtype(form) for number, form, _ in DTYPES.values()}
TRANSPOSED, DELTA = 2, 4


def dtype_number(name: str) -> int:
    if name not in DTYPES:
        raise InvalidParameter(f"dtype {name!r} is none of {sorted(DTYPES)}")
    return DTYPES[name][0]


def spark_type(name: str) -> str:
    dtype_number(name)
    return DTYPES[name][2]


def _bits(values: np.ndarray) -> np.ndarray:
    return values.view(f"<u{values.dtype.itemsize}")


def _transpose(words: np.ndarray) -> bytes:
    return words.view(np.uint8).reshape(len(words), -1).T.tobytes()


def _delta(words: np.ndarray) -> np.ndarray:
    """Differences modulo the width, as zigzag codes: small moves either way get small numbers."""
    width = 8 * words.dtype.itemsize
    step = words.copy()
    step[1:] -= words[:-1]
    sign = (step.view(f"<i{words.dtype.itemsize}") >> (width - 1)).view(words.dtype)
    return (step << words.dtype.type(1)) ^ sign


def _undelta(codes: np.ndarray) -> np.ndarray:
    one = codes.dtype.type(1)
    step = (codes >> one) ^ (~(codes & one) + one)
    return np.cumsum(step, dtype=codes.dtype)


#: Bytes of an array that is too short for a transform to pay.
TINY = 64


def encode(encoder: Encoder, values: np.ndarray, dtype: str) -> bytes:
    """A typed block of an array, by the transform that packs it best; arrays of up to TINY bytes have none."""
    number = dtype_number(dtype)
    values = np.ascontiguousarray(values, NUMPY[number])
    if not len(values):
        raise EmptyInput("an array without elements")
    raw = values.tobytes()
    if len(raw) <= TINY:
        return encoder.compress(raw, number, 0, encoder.pack(raw))
    words = _bits(values)
    with np.errstate(over="ignore"):
        forms = {0: raw, TRANSPOSED: _transpose(words), TRANSPOSED | DELTA: _transpose(_delta(words))}
    packed = {flags: encoder.pack(form) for flags, form in forms.items()}
    flags = min(packed, key=lambda f: (len(packed[f]), f))
    return encoder.compress(raw, number, flags, packed[flags])


def untransform(payload: bytes, dtype: int, flags: int) -> bytes:
    """Little-endian element bytes of an opened payload."""
    if not flags & TRANSPOSED:
        return payload
    if dtype not in NUMPY or len(payload) % NUMPY[dtype].itemsize:
        raise CorruptedData("its length does not fit its type")
    width = NUMPY[dtype].itemsize
    words = np.frombuffer(payload, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel()
    if flags & DELTA:
        with np.errstate(over="ignore"):
            words = _undelta(words)
    return words.tobytes()


def decode(decoder: Decoder, block, dtype: str, reinterpret: bool = False) -> np.ndarray:
    """The array in a block.  Another type than it was made of is an error, or with reinterpret a new view of the bytes."""
    number = dtype_number(dtype)
    payload, made, flags = decoder.open(block)
    if made != number and not reinterpret:
        raise TypeMismatch(f"the block holds type {made}, not {number} ({dtype})")
    return from_bytes(decoder.finish(block, payload, made, flags), dtype)


def from_bytes(data: bytes, dtype: str) -> np.ndarray:
    """Little-endian bytes as an array; none give an empty one, a broken element is an error."""
    form = NUMPY[dtype_number(dtype)]
    if len(data) % form.itemsize:
        raise CorruptedData(f"{len(data)} bytes are no whole number of {dtype}")
    return np.frombuffer(data, form)
