"""Oracle SQL (DuckDB).  Of what depends on the codec, queries return facts that hold for any."""

_N = "octet_length(encode(text))"
_LE = "array_to_string(list_transform(range(0, {bits}, 8), lambda s: printf('%02x', (({v} >> s) & 255)::int)), '')"
_DIGEST = "SELECT doc_id, md5(text) AS digest FROM documents"


def _le(value: str, bits: int) -> str:
    return _LE.format(v=value, bits=bits)


def _layout(size: int) -> str:
    return f"SELECT doc_id, i::INT AS frame_no, least({size}, n - i * {size})::BIGINT AS n_bytes FROM (SELECT doc_id, {_N} AS n FROM documents) d, LATERAL (SELECT unnest(range(0, (n + {size - 1}) // {size})) AS i) f"



def oracle_sql() -> dict[str, str]:
    cents = lambda c: f"sum(round(({c})::DOUBLE * 100)::BIGINT)::BIGINT"
    return {
        "block_roundtrip": f"SELECT doc_id, md5(text) AS digest, {_N}::BIGINT AS n_bytes FROM documents",
        "context_roundtrip": _DIGEST,
        "checksum_crc32": "SELECT doc_id, TRUE AS same FROM documents",
        "typed_vs_untyped": "SELECT count(DISTINCT l_orderkey) AS n_arrays, (8 * count(*))::BIGINT AS raw_bytes, TRUE AS typed_no_larger FROM lineitem",
        "ratio_by_lang": f"SELECT lang, count(*) AS n_docs, sum({_N})::BIGINT AS raw_bytes, TRUE AS shrinks FROM documents GROUP BY lang",
        "codec_compare": f"SELECT codec, count(*) AS n_blocks, sum({_N})::BIGINT AS raw_bytes, TRUE AS shrinks FROM documents, (SELECT unnest(['zlib', 'zstd']) AS codec) c WHERE {_N} > 0 GROUP BY codec",
        "block_empty_policy": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'EMPTY_INPUT' END AS error, CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS digest FROM documents",
        "block_corrupt_policy": "SELECT doc_id, CASE WHEN doc_id % 10 IN (1, 2, 3) THEN 'CORRUPTED_DATA' WHEN doc_id % 10 = 4 THEN 'EMPTY_INPUT' END AS error, CASE WHEN doc_id % 10 NOT IN (1, 2, 3, 4) THEN md5(text) END AS digest FROM documents",
        "typed_roundtrip_int64": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem",
        "typed_roundtrip_int32": "SELECT l_orderkey, l_linenumber, l_suppkey::INT AS l_suppkey FROM lineitem",
        "typed_roundtrip_double": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
        "typed_context_roundtrip": "SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS total FROM lineitem GROUP BY 1",
        "typed_all_dtypes": "SELECT p_brand, "
        + ", ".join(
            f"{cents(v)} AS sum_{k}"
            for k, v in {
                "int8": "p_size", "uint8": "p_size", "int16": "p_partkey % 32768", "uint16": "p_partkey % 32768", "int32": "p_partkey", "uint32": "p_partkey",
                "int64": "p_partkey", "uint64": "p_partkey", "float32": "p_retailprice::FLOAT", "float64": "p_retailprice",
            }.items()
        )
        + " FROM part GROUP BY 1",
        "typed_reinterpret_i64_i32": "SELECT l_orderkey, l_linenumber, (CASE WHEN (l_partkey & 4294967295) >= 2147483648 THEN (l_partkey & 4294967295) - 4294967296 ELSE l_partkey & 4294967295 END)::INT AS lo, (l_partkey >> 32)::INT AS hi FROM lineitem",
        "int64_to_le_bytes": f"SELECT o_orderkey, {_le('(o_custkey - 500)', 64)} AS le FROM orders",
        "bytes_to_int64": "SELECT o_orderkey, o_custkey - 500 AS first, o_orderkey AS second FROM orders",
        "frame_layout_4k": _layout(4 << 10),
        "frame_layout_64k": _layout(64 << 10),
        "frame_layout_256k": _layout(256 << 10),
        "frame_size_bounds": "SELECT (512 * 2 ** i + d)::INT AS frame_size, (512 * 2 ** i + d) BETWEEN 4096 AND 1048576 AS valid FROM range(13) r(i), (VALUES (0), (-1), (1)) t(d)",
        "frame_header_le32": f"SELECT doc_id, {_le(_N, 32)} AS le32 FROM documents",
        "stream_multi_write": "SELECT conv_id, 'OK' AS status, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
        "stream_reassemble": _DIGEST,
        "stream_roundtrip_pages": "SELECT page_id, 'OK' AS status, md5(html) AS digest FROM pages",
        "stream_empty_eos": f"SELECT doc_id, '00000000' AS tail, doc_id % 3 = 0 AS only_marker, 'OK' AS status, (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE ({_N} + 65535) // 65536 END)::BIGINT AS n_frames FROM documents",
        "stream_reset": "SELECT conv_id, role, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1, 2",
        "stream_parse_status": f"""SELECT doc_id,
            CASE doc_id % 8 WHEN 1 THEN 'TRUNCATED_FRAME' WHEN 2 THEN 'FRAME_TOO_LARGE' WHEN 3 THEN 'TRUNCATED_HEADER' WHEN 4 THEN 'OK_NO_EOS'
              WHEN 6 THEN 'CORRUPTED_FRAME' WHEN 7 THEN 'FRAME_TOO_LARGE' ELSE 'OK' END AS status,
            (CASE doc_id % 8 WHEN 1 THEN ({_N} + 4095) // 4096 - 1 WHEN 7 THEN 0 ELSE ({_N} + 4095) // 4096 END)::BIGINT AS n_frames FROM documents""",
        "frame_content_size": f"SELECT doc_id, {_N}::BIGINT AS n_bytes, 0 AS dtype FROM documents",
        "compress_bound": f"SELECT doc_id, ({_N} + 20)::BIGINT AS bound, true AS holds FROM documents",
        "gen_repeated": "SELECT md5(substr(repeat('This is a test pattern that repeats. ', 2768), 1, 102400)) AS digest",
        "gen_text": "SELECT md5(substr(repeat('the quick brown fox jumps over lazy dog ', 2561), 1, 102400)) AS digest",
        "gen_mixed": "SELECT md5(unhex(string_agg(printf('%02x', (CASE WHEN i % 100 < 50 THEN i % 10 ELSE (i * 7) % 256 END)::INT), '' ORDER BY i))) AS digest FROM range(0, 102400) r(i)",
        "gen_pseudo_random": "SELECT md5(unhex(string_agg(printf('%02x', ((i * 7) % 256)::INT), '' ORDER BY i))) AS digest FROM range(0, 10000) r(i)",
        "gen_seq_int64": "SELECT i, i * 10 AS value FROM range(1000) r(i)",
        "pick_smaller_roundtrip": _DIGEST,
        "dual_format_decode": _DIGEST,
        "frame_size_advice": "SELECT page_id, (CASE WHEN octet_length(encode(html)) < 10240 THEN 4096 WHEN octet_length(encode(html)) <= 1048576 THEN 65536 ELSE 262144 END)::INT AS frame_size FROM pages",
        "metrics_roundtrip_events": "SELECT user_id, event_id, epoch_us(ts) AS ts_us, value FROM events",
    }
