"""The codec core: fixtures, errors and round trips on arbitrary input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from colpack.errors import ColpackError, ContextClosed, CorruptedData, EmptyInput, InvalidParameter, TypeMismatch
from colpack.functions import codec, typed

BLOCKS = [b"hello world", b"a" * 400, b"test" * 100, bytes([0, 255, 170, 85, 66]), "Hello, 世界! 🌍".encode(), b"The quick brown fox jumps over the lazy dog. " * 1000, bytes(i * 7 % 256 for i in range(10000))]


@pytest.mark.parametrize("options", [{}, {"codec": "zlib"}, {"codec": "stored"}, {"level": 9, "checksum": True}, {"codec": "zlib", "checksum": True}])
@pytest.mark.parametrize("data", BLOCKS)
def test_block_round_trip(data, options):
    block = codec.compress(data, **options)
    assert codec.decompress(block) == data
    assert len(block) <= codec.compress_bound(len(data))


def test_contexts_are_reused_and_closed_twice():
    encoder, decoder = codec.Encoder(), codec.Decoder()
    for data in BLOCKS * 2:
        assert decoder.decompress(encoder.compress(data)) == data
    for context, call in ((encoder, encoder.compress), (decoder, decoder.decompress)):
        context.close()
        context.close()
        with pytest.raises(ContextClosed):
            call(b"x")


@pytest.mark.parametrize("data", [bytes.fromhex(h) for h in ("DEADBEEFCAFEBABE", "00010203", "0102030405060708", "00")] + [b"\xff" * 100, b"CPK1" + bytes(12), b"CPK1\x01\x02\x00\x00" + b"\x05" + bytes(7) + b"junk"])
def test_garbage_is_an_error(data):
    with pytest.raises(CorruptedData):
        codec.decompress(data)


def test_empty_is_an_error():
    for f in (codec.compress, codec.decompress):
        with pytest.raises(EmptyInput):
            f(b"")
    with pytest.raises(EmptyInput):
        typed.encode(codec.Encoder(), np.zeros(0, np.int64), "int64")


@pytest.mark.parametrize("options", [{"codec": "lz"}, {"level": 0}, {"level": 10}])
def test_wrong_options(options):
    with pytest.raises(InvalidParameter):
        codec.Encoder(**options)


def test_checksum_and_truncation_are_noticed():
    block = bytearray(codec.compress(bytes(range(256)), codec="stored", checksum=True))
    with pytest.raises(CorruptedData):
        codec.decompress(bytes(block[:-1]))
    block[-1] ^= 1
    with pytest.raises(CorruptedData):
        codec.decompress(bytes(block))


def test_a_header_that_claims_too_much_is_refused():
    block = bytearray(codec.compress(b"a" * 1000))
    block[8:16] = (1 << 40).to_bytes(8, "little")
    with pytest.raises(CorruptedData):
        codec.decompress(bytes(block))
    small = bytearray(codec.compress(b"a" * 1000, codec="zlib"))
    small[8:16] = (10).to_bytes(8, "little")
    with pytest.raises(CorruptedData):
        codec.decompress(bytes(small))


@given(st.binary(min_size=1, max_size=5000), st.sampled_from(["zstd", "zlib", "stored"]))
@settings(deadline=None)
def test_any_bytes_round_trip(data, name):
    assert codec.decompress(codec.compress(data, codec=name)) == data


@given(st.binary(max_size=300))
@settings(deadline=None)
def test_decoding_anything_never_crashes(data):
    for d in (data, b"CPK1" + data, b"CPK1\x01" + data):
        try:
            codec.decompress(d)
        except ColpackError:
            pass


@pytest.mark.parametrize("dtype", typed.DTYPES)
@given(data=st.data())
@settings(deadline=None, max_examples=40)
def test_any_array_round_trips_bit_for_bit(dtype, data):
    values = data.draw(arrays(typed.NUMPY[typed.dtype_number(dtype)], st.integers(1, 200)))
    back = typed.decode(codec.Decoder(), typed.encode(codec.Encoder(), values, dtype), dtype)
    assert back.tobytes() == values.tobytes()


@pytest.mark.parametrize("dtype", ["int8", "int64", "uint64", "int16", "uint32"])
def test_extremes(dtype):
    info = np.iinfo(typed.NUMPY[typed.dtype_number(dtype)])
    values = np.array([info.min, info.max, info.min, 0, info.max, info.max - 1], info.dtype)
    assert (typed.decode(codec.Decoder(), typed.encode(codec.Encoder(), values, dtype), dtype) == values).all()


def test_floats_keep_their_bits():
    values = np.array([float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 5e-324])
    assert typed.decode(codec.Decoder(), typed.encode(codec.Encoder(), values, "float64"), "float64").tobytes() == values.tobytes()


def test_another_type_is_noticed_or_reinterpreted():
    block = typed.encode(codec.Encoder(), np.arange(1, 6), "int64")
    with pytest.raises(TypeMismatch):
        typed.decode(codec.Decoder(), block, "int32")
    assert typed.decode(codec.Decoder(), block, "int32", reinterpret=True).tolist() == [1, 0, 2, 0, 3, 0, 4, 0, 5, 0]
    assert codec.decompress(block) == np.arange(1, 6, dtype="<i8").tobytes()


def test_typed_beats_untyped_on_a_sequence():
    values = np.arange(1000)
    assert len(typed.encode(codec.Encoder(), values, "int64")) * 20 < len(codec.compress(values.tobytes()))


def test_bytes_as_elements():
    assert typed.from_bytes(b"", "int64").tolist() == []
    with pytest.raises(CorruptedData):
        typed.from_bytes(b"123", "int64")
