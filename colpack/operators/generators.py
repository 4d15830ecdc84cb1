"""Deterministic test data as native rows and columns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colpack.operators.frames import joined_bytes

#: What the text generators repeat.
PATTERN = "This is a test pattern that repeats. "
SENTENCE = "the quick brown fox jumps over lazy dog "
LINE = "Test pattern for large file compression.\n"


def repeated_text(text: str, size: int) -> Column:
    """text repeated and cut to size characters."""
    return F.substring(F.repeat(F.lit(text), -(-size // len(text))), 1, size)


def bytes_of(size: int, value) -> Column:
    """size bytes, value(i) for the i-th from 0."""
    return joined_bytes(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.unhex(F.lpad(F.hex(value(i).cast("bigint")), 2, "0"))))


def mixed_bytes(size: int) -> Column:
    """Half runs of ten values, half of 256."""
    return bytes_of(size, lambda i: F.when(i % 100 < 50, i % 10).otherwise((i * 7) % 256))


def pseudo_random_bytes(size: int) -> Column:
    return bytes_of(size, lambda i: (i * 7) % 256)


def sequence_rows(spark: SparkSession, n: int, step: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * step).alias("value"))


def repeating_frames(spark: SparkSession, total: int, frame_size: int, line: str = LINE) -> DataFrame:
    """(frame_no, payload) of a stream of total bytes that repeats line, frame by frame and never in one value."""
    frames = spark.range(-(-total // frame_size)).select(F.col("id").cast("int").alias("frame_no"))
    start = F.col("frame_no").cast("bigint") * frame_size
    size = F.least(F.lit(frame_size), F.lit(total) - start).cast("int")
    text = F.substring(F.repeat(F.lit(line), frame_size // len(line) + 2), (start % len(line) + 1).cast("int"), size)
    return frames.select("frame_no", F.encode(text, "utf-8").alias("payload"))
