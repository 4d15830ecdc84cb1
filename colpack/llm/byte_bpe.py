"""Byte-level BPE encoding and decoding with a segment tree (operator 3).

The leaves of a word's segment tree are its byte positions.  A live leaf holds the rank of the pair
that starts there; every inner node holds the leftmost minimum below it.  The root names the next
merge, and a merge is three point updates: the merged position, the one swallowed and the live
neighbour on the left, each of logarithmic cost.  Ids equal those of the tiktoken library.
"""

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import kept_by_worker
from colpack.llm.token_counts import WordCache, plain_parts, splitter

#: Above all ranks.
NO_RANK = 1 << 32
#: Words, and pieces between spaces, whose ids a worker keeps at most.
CACHE_WORDS, CACHE_PIECES = 1_000_000, 700_000
#: Fixed value: the split pattern of the public vocabularies, for which a text may be cut before spaces.
BY_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that does not begin a word of its own: more white space or nothing follows.
LOOSE_SPACE = re.compile(r" (?:\s|$)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encodes and decodes by a rank file and a split pattern."""

    _of: dict[tuple[str, str], "ByteBpe"] = kept_by_worker()

    def __init__(self, path: str, pattern: str):
        self.by_spaces = pattern == BY_SPACES
        self.ranks = load_ranks(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.find = splitter(pattern)
        #: word, or piece between two spaces after its space -> its ids in decimal, joined by spaces
        self.words = WordCache(lambda word: " ".join(map(str, self.word_ids(word.encode()))), CACHE_WORDS)
        self.pieces = WordCache(self.piece_ids, CACHE_PIECES)

    @classmethod
    def of(cls, path: str, pattern: str) -> "ByteBpe":
        if (path, pattern) not in cls._of:
            cls._of[path, pattern] = cls(path, pattern)
        return cls._of[path, pattern]

    def word_ids(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, rank = len(data), self.ranks.get
        size = 1 << max(0, (n - 2).bit_length())
        # a leaf is rank << shift | position, so the minimum is the leftmost one of lowest rank
        shift = n.bit_length()
        none = NO_RANK << shift
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := rank(data[i : i + 2])) is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        end, before = [*range(1, n + 1)], [*range(-1, n)]  # end[i]: where the symbol at i ends and the next begins
        places = (1 << shift) - 1
        while (least := tree[1]) < none:
            i = least & places
            j = end[i]
            k = end[i] = end[j]
            before[k] = i
            r = rank(data[i : end[k]]) if k < n else None
            new = [(i, none if r is None else r << shift | i)]
            if j < size and tree[size + j] < none:
                new.append((j, none))
            h = before[i]
            if h >= 0:
                r = rank(data[h:k])
                new.append((h, none if r is None else r << shift | h))
            for at, value in new:  # point updates, upwards until a node stays as it is
                at += size
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    at >>= 1
                    if other < value:
                        value = other
                    if tree[at] == value:
                        break
                    tree[at] = value
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def piece_ids(self, piece: str) -> str:
        """Ids of what stands between two spaces, with the space before it."""
        parts = plain_parts(piece)
        if parts is None:
            return self.by_words(" " + piece)
        word = self.words[" " + parts[0]]
        return f"{word} {self.words[parts[1]]}" if len(parts) > 1 else word

    def by_words(self, text: str) -> str:
        return " ".join(map(self.words.__getitem__, self.find(text)))

    def encode_decimal(self, text: str) -> str:
        """The ids of a text in decimal, joined by single spaces.

        The pattern puts a space with the word after it, so a text whose every space stands before a
        word can be cut before each space.
        """
        if not self.by_spaces or LOOSE_SPACE.search(text):
            return self.by_words(text)
        head, *pieces = text.split(" ")
        out = " ".join(map(self.pieces.__getitem__, pieces))
        if not head:
            return out
        head = self.by_words(head)
        return f"{head} {out}" if pieces else head

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decimal(text).split()]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; a null text is the empty text, with no ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of every row; null ids are none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            data = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "decoded"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`").alias("__ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip_digests(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encodes, then decodes the ids.

    A null text is the empty text.  Repeated rows and null ids stay rows of their own; other columns
    are not read.  No shuffle; memory is bounded by a batch and the word cache.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = ByteBpe.of(ranks, pattern)
        tokens = {str(r).encode(): t for r, t in bpe.tokens.items()}.__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                decimal = bpe.encode_decimal(text or "").encode()
                ids = decimal.split()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(decimal).hexdigest())
                of_text.append(hashlib.sha256(b"".join(map(tokens, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
