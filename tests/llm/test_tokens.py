"""Operators 3, 4 and 7 against the public libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colpack.llm import byte_bpe, packing, queries, token_counts
from colpack.llm.common import lean

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "a  b", " a", "a ", "a \n b", "  x y", "a \x1cb", "x\n\ny z\n", "İstanbul ΑΣ ΣΑΣ Σ", "a<|endoftext|>b <|startoftext|>'S IT'S", "é é ẛ̣", "J̌. J̌", "x\x1cy\x85z   q",
    "aaaaaaaaaaaaaaaaaaaaaaa" * 50, "日本語テキスト 😀😀🏳️‍🌈 ١٢٣ ½ Ⅷ", "\x00\x01", " " * 300, "'ll've 123456 ___ ***", "word. Word, (word) word!! don't", "ab" * 3000,
]
any_text = st.text(st.characters(max_codepoint=0x30000, blacklist_categories=("Cs", "Cn")), max_size=40)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_the_fixed_pattern_is_the_libraries():
    assert byte_bpe.BY_SPACES == public_tokenizers.PATTERN


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, tik, text):
    assert token_counts.TokenCounter.of(WORDS).count(text) == len(ids(library, text))
    bpe = byte_bpe.ByteBpe.of(RANKS, public_tokenizers.PATTERN)
    assert bpe.encode(text) == tik.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()
    assert np.frombuffer(packing.DocumentEncoder.of(WORDS).encode(text), "<u4").tolist() == ids(library, text)


@given(any_text)
@settings(deadline=None, max_examples=300)
def test_any_text(text):
    library = Tokenizer.from_file(WORDS) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = library
    assert token_counts.TokenCounter.of(WORDS).count(text) == len(ids(library, text))
    bpe = byte_bpe.ByteBpe.of(RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(bpe.encode(text)) == text.encode()
    assert np.frombuffer(packing.DocumentEncoder.of(WORDS).encode(text), "<u4").tolist() == ids(library, text)


def test_caches_are_bounded():
    cache = token_counts.WordCache(len, 10)
    assert [cache[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)] and len(cache) <= 10


def test_counts_of_all_documents(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op7_token_counts(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == {i: (len(t.encode()), n := len(ids(library, t)), n > 2048) for i, t in texts.items()}


def test_digests_of_all_documents(spark, sf, tik):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_byte_bpe(spark, sf).collect()}
    for i, t in texts.items():
        x = tik.encode_ordinary(t)
        assert found[i] == (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_packing_of_all_documents(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_best_fit_packing(spark, sf).collect()
    want, total = {}, 0
    for i, t in texts.items():
        x = np.array(ids(library, t) + [1], "<u4")
        total += len(x)
        want |= {(i, k): (s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(x), 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    check_sequences(rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 2


def check_sequences(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
@settings(deadline=None)
def test_plans_place_every_piece_once(counts):
    plan = packing.plan_sequences(counts, 64)
    placed = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            placed[x] += n
    assert placed == counts
    first_fit, left = 0, []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        k = next((k for k, room in enumerate(left) if room >= x), None)
        if k is None:
            left.append(64 - x)
        else:
            left[k] -= x
    assert sum(n for _, n in plan) <= 1.1 * len(left) + 1


def test_exact_complements_are_used():
    assert sum(n for _, n in packing.plan_sequences({40: 2, 24: 2, 50: 1, 10: 1, 4: 1, 30: 1, 20: 1, 8: 1, 6: 1}, 64)) == 4


ROWS = [(1, None, 5), (2, "", 6), (None, "Hello there world", 7), (3, "same text", 8), (3, "same text", 8), (4, "long " * 60000, 9)]


@pytest.mark.parametrize("run", [lambda d: token_counts.token_counts(d, WORDS), lambda d: byte_bpe.round_trip_digests(d, RANKS, public_tokenizers.PATTERN), lambda d: packing.pack_documents(d, WORDS)])
def test_edge_rows(spark, library, run):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens int")
    rows = run(df).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, None}
    if "sequence_id" in rows[0].asDict():
        check_sequences(rows)
        assert sum(r["length"] for r in rows) == sum(len(ids(library, t or "")) + 1 for _, t, _ in ROWS)
    else:
        assert len(rows) == len(ROWS)
        assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 0
    assert run(df.limit(0)).count() == 0


def test_encode_and_decode_columns(spark, tik):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id bigint, text string")
    ids_ = byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in ids_.collect()} == {1: tik.encode_ordinary("Hello world"), 2: []}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode_documents(ids_, RANKS, public_tokenizers.PATTERN).collect()} == {1: b"Hello world", 2: b""}


def test_ranks_survive_many_tasks(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, "a " * r.choice([5, 5, 5, 90, 700, 3000])) for i in range(300)], "doc_id bigint, text string").repartition(7)
    check_sequences(packing.pack_documents(df, WORDS).collect())


def test_workers_give_free_memory_back_when_a_task_ends():
    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) / 1024

    def run(batches):
        many = [bytes([i % 256]) * 800 for i in range(200_000)]
        yield from batches
        last.append(bytes(800))  # above all others in the heap, which therefore keeps what is freed below
        del many
        yield held()

    last = []
    before = held()
    *_, after_run = run([1])
    kept = after_run - before
    *_, _ = lean(run)([1])
    assert kept > 100
    assert held() - before < kept / 2


def test_the_library_sees_some_words_a_call(library):
    class Counted:
        calls: list[int] = []

        def encode_batch_fast(self, texts, **how):
            self.calls.append(sum(1 + t.count(" ") for t in texts))
            return library.encode_batch_fast(texts, **how)

    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(30_000)] + [f"é{i}_ẛ̣" for i in range(10_000)]
    encoder = packing.DocumentEncoder(WORDS)
    encoder.tokenizer = Counted()
    text = " ".join(words)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(library, text)
    assert max(Counted.calls) <= 10_000
