"""Framed files: one serialised stream a file, suffix .cpk.

read_framed() lists and opens files by Spark's own binaryFile source, so it reads whatever store Spark
reads.  The data source 'colpack' writes a file a partition; files appear only when the whole job
commits, and a failed task leaves none.
"""

import os
import shutil
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from colpack.functions import codec
from colpack.operators.blocks import compress
from colpack.operators.frames import DEFAULT_FRAME, END, check_frame_size, frame, joined_bytes, parse, parse_stream, serialize, serialized_or_empty, unframe

SUFFIX = ".cpk"


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, frame_no, offset, comp_len, payload): a row for each good frame of each framed file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    return unframe(files.select("path", F.col("content").alias("stream")), ["path"])


@dataclass
class Written(WriterCommitMessage):
    pending: str
    final: str


class FramedSource(DataSource):
    """format('colpack'): rows (frame_no, payload) in and out of a folder of framed files."""

    @classmethod
    def name(cls) -> str:
        return "colpack"

    def schema(self) -> str:
        return "path string, frame_no int, payload binary"

    def reader(self, schema) -> "FramedReader":
        return FramedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "content" in schema.fieldNames():
            return FilesWriter(self.options["path"], schema.fieldNames().index("path"), schema.fieldNames().index("content"))
        return FramedWriter(self.options["path"], check_frame_size(int(self.options.get("frame_size", DEFAULT_FRAME))), schema.fieldNames().index("payload"))


@dataclass
class OneFile(InputPartition):
    path: str


class FramedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [OneFile(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(SUFFIX)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            found = parse(f.read(), codec.Decoder())
        if not found["status"].startswith("OK"):
            raise ValueError(f"{partition.path}: {found['status']}")
        for x in found["frames"]:
            yield partition.path, x["frame_no"], x["payload"]


class FramedWriter(DataSourceWriter):
    """Rows' payloads, in the order in which they come, make one stream a partition, cut anew into frames."""

    def __init__(self, path: str, frame_size: int, column: int):
        self.path, self.frame_size, self.column = path, frame_size, column
        self.job = uuid.uuid4().hex

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        name = uuid.uuid4().hex
        pending = os.path.join(self.path, f".{self.job}-{name}.pending")
        encoder, tail = codec.Encoder(), b""
        try:
            with open(pending, "wb") as f:
                for row in rows:
                    tail += row[self.column] or b""
                    while len(tail) >= self.frame_size:
                        self._put(f, encoder, tail[: self.frame_size])
                        tail = tail[self.frame_size :]
                if tail:
                    self._put(f, encoder, tail)
                f.write(END)
        except BaseException:
            os.remove(pending)
            raise
        return Written(pending, os.path.join(self.path, f"part-{name}{SUFFIX}"))

    @staticmethod
    def _put(f, encoder, data: bytes) -> None:
        block = encoder.compress(data)
        f.write(struct.pack("<I", len(block)) + block)

    def commit(self, messages) -> None:
        for m in filter(None, messages):
            os.replace(m.pending, m.final)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what failed attempts of this job have left."""
        for f in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if f.startswith(f".{self.job}-"):
                os.remove(os.path.join(self.path, f))


class FilesWriter(DataSourceWriter):
    """Rows (path, content) become files of their own, named as the last part of path; all appear at commit."""

    def __init__(self, folder: str, path: int, content: int):
        self.folder, self.path, self.content = folder, path, content
        self.job = uuid.uuid4().hex

    def write(self, rows):
        pending = os.path.join(self.folder, f".{self.job}", uuid.uuid4().hex)
        os.makedirs(pending)
        for row in rows:
            with open(os.path.join(pending, os.path.basename(row[self.path])), "wb") as f:
                f.write(row[self.content] or b"")
        return Written(pending, self.folder)

    def commit(self, messages) -> None:
        for m in filter(None, messages):
            for name in os.listdir(m.pending):
                os.replace(os.path.join(m.pending, name), os.path.join(m.final, name))
        self.abort(messages)

    def abort(self, messages) -> None:
        shutil.rmtree(os.path.join(self.folder, f".{self.job}"), ignore_errors=True)


def compress_files(spark: SparkSession, path: str, out: str, frame_size: int = DEFAULT_FRAME) -> None:
    """Every file at path becomes a framed file of its name and SUFFIX in the folder out; Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    encoded = frame(files, ["path"], "content", frame_size).select("path", "frame_no", compress(F.col("payload")).alias("block"))
    streams = files.select("path").join(serialize(encoded, ["path"]), "path", "left")
    made = streams.select(F.concat("path", F.lit(SUFFIX)).alias("path"), serialized_or_empty(F.col("stream")).alias("content"))
    made.write.format("colpack").option("path", out).mode("append").save()


def decompress_files(spark: SparkSession, path: str, out: str) -> None:
    """Every framed file at path becomes its original, without SUFFIX, in the folder out; a broken one fails the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    parsed = files.select("path", parse_stream(F.col("content")).alias("s"))
    checked = F.when(F.col("s.status").startswith("OK"), joined_bytes(F.transform("s.frames", lambda f: f["payload"]))).otherwise(F.raise_error(F.concat("path", F.lit(": "), F.col("s.status"))).cast("binary"))
    back = parsed.select(F.regexp_replace("path", rf"\{SUFFIX}$", "").alias("path"), checked.alias("content"))
    back.write.format("colpack").option("path", out).mode("append").save()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedSource)
