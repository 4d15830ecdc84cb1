"""Ways to use the codecs: comparison, choice and accounting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colpack.functions.header import is_block
from colpack.operators.blocks import compress, decompress


def ratio(raw: Column, block: Column) -> Column:
    """Aggregate: raw bytes for each compressed byte; below 1 where blocks are longer."""
    return F.sum(F.octet_length(raw)) / F.sum(F.octet_length(block))


def compare_codecs(df: DataFrame, payload: str, codecs=("zlib", "zstd")) -> DataFrame:
    """(codec, n_blocks, raw_bytes, compressed_bytes), a row for each codec; empty payloads, which make no block, count nowhere."""
    sized = df.where(F.octet_length(payload) > 0).select(F.octet_length(payload).cast("bigint").alias("raw"), *(F.octet_length(compress(F.col(payload), c)).cast("bigint").alias(c) for c in codecs))
    long = sized.select("raw", F.inline(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(c).alias("n")) for c in codecs))))
    return long.groupBy("codec").agg(F.count("*").alias("n_blocks"), F.sum("raw").alias("raw_bytes"), F.sum("n").alias("compressed_bytes"))


def smaller(a: Column, b: Column) -> Column:
    """The shorter of two encodings, the second if they are as long."""
    return F.when(F.octet_length(a) < F.octet_length(b), a).otherwise(b)


def decode_either(payload: Column) -> Column:
    """Blocks decompressed, other bytes as they are."""
    return F.when(is_block(payload), decompress(F.when(is_block(payload), payload))).otherwise(payload)


def frame_size_advice(payload: Column) -> Column:
    size = F.octet_length(payload)
    return F.when(size < 10 << 10, 4 << 10).when(size <= 1 << 20, 64 << 10).otherwise(256 << 10)
