"""Queries (spark, sf_dir) -> DataFrame, one for each operator, over the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colpack.functions import header
from colpack.operators import blocks, frames, generators, numeric, recipes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(column: str):
    return F.encode(F.col(column), "utf-8")


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("raw"))


def block_roundtrip(spark, sf_dir):
    back = blocks.decompress_once(blocks.compress_once(F.col("raw")))
    return _texts(spark, sf_dir).select("doc_id", back.alias("b")).select("doc_id", F.md5("b").alias("digest"), F.octet_length("b").cast("bigint").alias("n_bytes"))


def context_roundtrip(spark, sf_dir):
    back = blocks.decompress(blocks.compress(F.col("raw")))
    return _texts(spark, sf_dir).select("doc_id", back.alias("b")).select("doc_id", F.md5("b").alias("digest"))


def block_empty_policy(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 10 == 0, F.lit(b"")).otherwise(F.col("raw"))
    done = _texts(spark, sf_dir).select("doc_id", blocks.try_compress(raw).alias("c"))
    return done.select("doc_id", "c.error", blocks.decompress(F.col("c.payload")).alias("b")).select("doc_id", "error", F.md5("b").alias("digest"))


def block_corrupt_policy(spark, sf_dir):
    """Every tenth block is garbage, cut short, of a wrong magic or empty."""
    made = _texts(spark, sf_dir).select("doc_id", blocks.compress(F.col("raw"), checksum=True).alias("b"))
    kind, b = F.col("doc_id") % 10, F.col("b")
    broken = (
        F.when(kind == 1, F.unhex(F.lit("DEADBEEFCAFEBABE")))
        .when(kind == 2, F.substring(b, F.lit(1), F.octet_length(b) - 1))
        .when(kind == 3, F.concat(F.unhex(F.lit("00")), F.substring(b, F.lit(2), F.octet_length(b))))
        .when(kind == 4, F.lit(b""))
        .otherwise(b)
    )
    done = made.select("doc_id", blocks.try_decompress(broken).alias("d"))
    return done.select("doc_id", "d.error", F.md5("d.payload").alias("digest"))


def checksum_crc32(spark, sf_dir):
    """The checksum in the header against the native function's."""
    made = _texts(spark, sf_dir).select("doc_id", F.crc32("raw").alias("crc"), blocks.compress(F.col("raw"), checksum=True).alias("b"))
    return made.select("doc_id", (header.parse_le(F.col("b"), 17, 4) == F.col("crc")).alias("same"))


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _orders_arrays(spark, sf_dir, value) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", value.alias("v"))))
    packed = _lines(spark, sf_dir).groupBy("l_orderkey").agg(ordered.alias("p"))
    return packed.select("l_orderkey", F.transform("p", lambda x: x["l_linenumber"]).alias("n"), F.transform("p", lambda x: x["v"]).alias("v"))


def _back(df: DataFrame, dtype: str, name: str, number: str | None = "l_linenumber") -> DataFrame:
    done = df.select("l_orderkey", "n", numeric.decompress_numeric_once(numeric.compress_numeric_once(F.col("v"), dtype), dtype).alias("v"))
    return done.select("l_orderkey", F.inline(F.arrays_zip(F.col("n").alias(number), F.col("v").alias(name))))


def typed_roundtrip_int64(spark, sf_dir):
    return _back(_orders_arrays(spark, sf_dir, F.col("l_partkey")), "int64", "l_partkey")


def typed_roundtrip_int32(spark, sf_dir):
    return _back(_orders_arrays(spark, sf_dir, F.col("l_suppkey").cast("int")), "int32", "l_suppkey")


def typed_roundtrip_double(spark, sf_dir):
    return _back(_orders_arrays(spark, sf_dir, F.col("l_extendedprice")), "float64", "l_extendedprice")


def typed_context_roundtrip(spark, sf_dir):
    df = _orders_arrays(spark, sf_dir, F.col("l_partkey"))
    done = df.select("l_orderkey", numeric.decompress_numeric(numeric.compress_numeric(F.col("v"), "int64"), "int64").alias("v"))
    return done.select("l_orderkey", F.size("v").cast("bigint").alias("n"), F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def typed_all_dtypes(spark, sf_dir):
    """One array of each of the ten element types for each part brand, there and back."""
    kinds = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64")
    value = {k: (F.col("p_size") if k in ("int8", "uint8") else F.col("p_retailprice") if k[0] == "f" else F.col("p_partkey") % 32768 if "16" in k else F.col("p_partkey")) for k in kinds}
    spark_kind = {k: numeric.typed.spark_type(k) for k in kinds}
    packed = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", *(v.cast(spark_kind[k]).alias(k) for k, v in value.items())))).alias("p"))
    done = packed.select("p_brand", *(numeric.decompress_numeric(numeric.compress_numeric(F.col(f"p.{k}"), k), k).alias(k) for k in kinds))
    whole = lambda k: F.aggregate(F.col(k), F.lit(0).cast("bigint"), lambda a, x: a + F.round(x.cast("double") * 100).cast("bigint")).alias(f"sum_{k}")
    return done.select("p_brand", *map(whole, kinds))


def typed_reinterpret_i64_i32(spark, sf_dir):
    """Blocks of int64 read as int32: by the decoder and by the native expression, which must agree."""
    df = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array("l_partkey").alias("v"))
    both = df.select("l_orderkey", "l_linenumber", numeric.decompress_numeric(numeric.compress_numeric(F.col("v")), "int32", reinterpret=True).alias("d"), header.reinterpret_i64_as_i32(F.col("v")).alias("native"))
    return both.select("l_orderkey", "l_linenumber", F.get("d", F.lit(0)).alias("lo"), F.get("native", F.lit(1)).alias("hi"))


def int64_to_le_bytes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.hex(header.le_bytes(F.col("o_custkey") - 500, 8))).alias("le"))


def bytes_to_int64(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(header.le_bytes(F.col("o_custkey") - 500, 8), header.le_bytes(F.col("o_orderkey"), 8)).alias("b"))
    return made.select("o_orderkey", header.int64_from_le(F.col("b")).alias("v")).select("o_orderkey", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(1)).alias("second"))


def typed_vs_untyped(spark, sf_dir):
    df = _orders_arrays(spark, sf_dir, F.col("l_partkey"))
    raw = frames.joined_bytes(F.transform("v", lambda x: header.le_bytes(x, 8)))
    sized = df.select(F.octet_length(raw).alias("raw"), F.octet_length(blocks.compress(raw)).alias("untyped"), F.octet_length(numeric.compress_numeric(F.col("v"))).alias("typed"))
    no_larger = F.sum("typed") <= F.sum("untyped")
    return sized.agg(F.count("*").alias("n_arrays"), F.sum("raw").alias("raw_bytes"), no_larger.alias("typed_no_larger"))


def _layout(frame_size):
    def run(spark, sf_dir):
        cut = frames.frame(_texts(spark, sf_dir), ["doc_id"], "raw", frame_size)
        return cut.select("doc_id", "frame_no", F.octet_length("payload").cast("bigint").alias("n_bytes"))

    return run


def frame_size_bounds(spark, sf_dir):
    sizes = spark.range(13).select(F.expr("cast(shiftleft(1, cast(id + 9 as int)) as int)").alias("frame_size"))
    every = sizes.union(sizes.select(F.col("frame_size") - 1)).union(sizes.select(F.col("frame_size") + 1))
    return every.select("frame_size", frames.frame_size_valid(F.col("frame_size")).alias("valid"))


def frame_header_le32(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.lower(F.hex(header.le_bytes(F.octet_length("raw"), 4))).alias("le32"))


def _chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", _bytes("text").alias("raw"))


def _through(cut: DataFrame, key: str) -> DataFrame:
    """Frames encoded, serialised, parsed and put together again: (key, status, payload)."""
    encoded = cut.select(key, "frame_no", blocks.compress(F.col("payload")).alias("block"))
    parsed = frames.serialize(encoded, [key]).select(key, frames.parse_stream(F.col("stream")).alias("s"))
    return parsed.select(key, "s.status", frames.joined_bytes(F.transform("s.frames", lambda f: f["payload"])).alias("payload"))


def stream_multi_write(spark, sf_dir):
    """Turns of a conversation are the writes of a stream; its frames do not depend on them."""
    cut = frames.frame_chunks(_chunks(spark, sf_dir), ["conv_id"], "turn", "raw", 4096)
    return _through(cut, "conv_id").select("conv_id", "status", F.md5("payload").alias("digest"))


def stream_reassemble(spark, sf_dir):
    cut = frames.frame(_texts(spark, sf_dir), ["doc_id"], "raw", 4096)
    return frames.reassemble(cut, ["doc_id"]).select("doc_id", F.md5("payload").alias("digest"))


def stream_roundtrip_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", _bytes("html").alias("raw"))
    return _through(frames.frame(pages, ["page_id"], "raw"), "page_id").select("page_id", "status", F.md5("payload").alias("digest"))


def stream_empty_eos(spark, sf_dir):
    """Streams of every third document are empty, and their serialised form is the end marker alone."""
    texts = _texts(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(b"")).otherwise(F.col("raw")).alias("raw"))
    encoded = frames.frame(texts, ["doc_id"], "raw").select("doc_id", "frame_no", blocks.compress(F.col("payload")).alias("block"))
    streams = texts.select("doc_id").join(frames.serialize(encoded, ["doc_id"]), "doc_id", "left").select("doc_id", frames.serialized_or_empty(F.col("stream")).alias("stream"))
    parsed = streams.select("doc_id", F.lower(F.hex(F.expr("substring(stream, -4, 4)"))).alias("tail"), (F.octet_length("stream") == 4).alias("only_marker"), frames.parse_stream(F.col("stream")).alias("s"))
    return parsed.select("doc_id", "tail", "only_marker", "s.status", F.size("s.frames").cast("bigint").alias("n_frames"))


def stream_reset(spark, sf_dir):
    """A reset begins a stream anew: each role's turns of a conversation are a stream of its own."""
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", _bytes("text").alias("raw"))
    cut = frames.frame_chunks(chunks, ["conv_id", "role"], "turn", "raw", 4096)
    return frames.reassemble(cut, ["conv_id", "role"]).select("conv_id", "role", F.md5("payload").alias("digest"))


def stream_parse_status(spark, sf_dir):
    """Serialised streams broken in every way a reader may meet."""
    texts = _texts(spark, sf_dir)
    encoded = frames.frame(texts, ["doc_id"], "raw", 4096).select("doc_id", "frame_no", blocks.compress(F.col("payload")).alias("block"))
    s, n, kind = F.col("stream"), F.octet_length("stream"), F.col("doc_id") % 8
    broken = (
        F.when(kind == 1, F.substring(s, F.lit(1), n - 10))
        .when(kind == 2, F.concat(F.substring(s, F.lit(1), n - 4), F.unhex(F.lit("FFFFFF7F"))))
        .when(kind == 3, F.concat(F.substring(s, F.lit(1), n - 4), F.unhex(F.lit("1000"))))
        .when(kind == 4, F.substring(s, F.lit(1), n - 4))
        .when(kind == 5, F.concat(s, F.unhex(F.lit("DEADBEEF"))))
        .when(kind == 6, F.concat(F.substring(s, F.lit(1), n - 4), F.unhex(F.lit("0400000000010203"))))
        .when(kind == 7, F.unhex(F.lit("123456789ABC")))
        .otherwise(s)
    )
    parsed = frames.serialize(encoded, ["doc_id"]).select("doc_id", frames.parse_stream(broken).alias("p"))
    return parsed.select("doc_id", "p.status", F.size("p.frames").cast("bigint").alias("n_frames"))


def frame_content_size(spark, sf_dir):
    made = _texts(spark, sf_dir).select("doc_id", blocks.compress(F.col("raw")).alias("b"))
    return made.select("doc_id", header.content_size(F.col("b")).alias("n_bytes"), header.dtype_of(F.col("b")).alias("dtype"))


def compress_bound(spark, sf_dir):
    made = _texts(spark, sf_dir).select("doc_id", header.compress_bound(F.col("raw")).cast("bigint").alias("bound"), F.octet_length(blocks.compress(F.col("raw"), checksum=True)).alias("n"))
    return made.select("doc_id", "bound", (F.col("n") <= F.col("bound")).alias("holds"))


def ratio_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", _bytes("text").alias("raw"))
    sized = docs.select("lang", "raw", blocks.compress(F.col("raw")).alias("b"))
    shrinks = recipes.ratio(F.col("raw"), F.col("b")) > 1
    return sized.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("raw")).alias("raw_bytes"), shrinks.alias("shrinks"))


def gen_repeated(spark, sf_dir):
    return spark.range(1).select(F.md5(generators.repeated_text(generators.PATTERN, 102400)).alias("digest"))


def gen_text(spark, sf_dir):
    return spark.range(1).select(F.md5(generators.repeated_text(generators.SENTENCE, 102400)).alias("digest"))


def gen_mixed(spark, sf_dir):
    return spark.range(1).select(F.md5(generators.mixed_bytes(102400)).alias("digest"))


def gen_pseudo_random(spark, sf_dir):
    return spark.range(1).select(F.md5(generators.pseudo_random_bytes(10000)).alias("digest"))


def gen_seq_int64(spark, sf_dir):
    return generators.sequence_rows(spark, 1000, 10)


def codec_compare(spark, sf_dir):
    found = recipes.compare_codecs(_texts(spark, sf_dir), "raw")
    return found.select("codec", "n_blocks", "raw_bytes", (F.col("compressed_bytes") < F.col("raw_bytes")).alias("shrinks"))


def pick_smaller_roundtrip(spark, sf_dir):
    both = _texts(spark, sf_dir).select("doc_id", blocks.compress(F.col("raw"), "zlib").alias("a"), blocks.compress(F.col("raw"), "zstd").alias("b"))
    return both.select("doc_id", F.md5(blocks.decompress(recipes.smaller(F.col("a"), F.col("b")))).alias("digest"))


def dual_format_decode(spark, sf_dir):
    """Half of the values are blocks, half plain bytes."""
    mixed = _texts(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, blocks.compress(F.col("raw"))).otherwise(F.col("raw")).alias("x"))
    return mixed.select("doc_id", F.md5(recipes.decode_either(F.col("x"))).alias("digest"))


def frame_size_advice(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", recipes.frame_size_advice(_bytes("html")).alias("frame_size"))


def metrics_roundtrip_events(spark, sf_dir):
    """Each user's times and values as two typed arrays, there and back."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value")
    packed = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts_us", "event_id", "value"))).alias("p"))
    there = packed.select("user_id", *(numeric.compress_numeric(F.col(f"p.{c}"), k).alias(c) for c, k in (("event_id", "int64"), ("ts_us", "int64"), ("value", "float64"))))
    back = there.select("user_id", *(numeric.decompress_numeric(F.col(c), k).alias(c) for c, k in (("event_id", "int64"), ("ts_us", "int64"), ("value", "float64"))))
    return back.select("user_id", F.inline(F.arrays_zip("event_id", "ts_us", "value")))


def queries():
    found = (
        block_roundtrip, context_roundtrip, block_empty_policy, block_corrupt_policy, checksum_crc32,
        typed_roundtrip_int64, typed_roundtrip_int32, typed_roundtrip_double, typed_context_roundtrip, typed_all_dtypes, typed_reinterpret_i64_i32,
        int64_to_le_bytes, bytes_to_int64, typed_vs_untyped,
        frame_size_bounds, frame_header_le32, stream_multi_write, stream_reassemble, stream_roundtrip_pages, stream_empty_eos, stream_reset, stream_parse_status,
        frame_content_size, compress_bound, ratio_by_lang,
        gen_repeated, gen_text, gen_mixed, gen_pseudo_random, gen_seq_int64,
        codec_compare, pick_smaller_roundtrip, dual_format_decode, frame_size_advice, metrics_roundtrip_events,
    )
    return {f.__name__: f for f in found} | {f"frame_layout_{k}k": _layout(k << 10) for k in (4, 64, 256)}
