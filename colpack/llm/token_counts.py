"""Token counts by heap-and-linked-list byte-pair merging (operator 7).

A word's symbols form a doubly linked list; a heap holds the ranks of adjacent pairs.  The lowest
rank is popped, its pair merged, and the pairs with the two neighbours pushed.  A word's count is
its initial symbols minus its merges; no identifiers are made.

The counts equal those of the ``tokenizers`` library for a byte-level BPE file with a word-end suffix.
"""

import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import kept_by_worker

#: Words whose counts a worker keeps at most; beyond, the older half goes.
CACHE_WORDS = 400_000
#: Longest word that a worker keeps.
LONGEST = 64
#: Letters whose lower case is newer than Python's tables, and the sigma that
#: str.lower() would treat by its neighbours.
LOWER = {"Σ": "σ", "\ua7cb": "\u0264", "\ua7dc": "\u019b"}
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Marks that stand behind words; each is a word of its own.
MARKS = frozenset(".,;:!?")
#: Code points from here on to the private planes were unassigned when the libraries were built.
UNASSIGNED = "[\\U000323b0-\\U000dffff]"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the rest for the code points from 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordCache(dict):
    """word -> value, computed by make at the first look-up; bounded by dropping the older half and by keeping no word of over LONGEST characters."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            for old in [w for w, _ in zip(self, range(self.most // 2))]:
                del self[old]
        value = self.make(word)
        if len(word) <= LONGEST:
            self[word] = value
        return value


def plain_parts(piece: str) -> tuple[str, ...] | None:
    """Words of a piece without white space where they are plain to see: letters, and at most one mark behind.

    Only letters up to Latin Extended-A count, which stay letters when composed and lower-cased; null
    leaves the piece to the pattern.
    """
    if piece.isalpha():
        return (piece,) if piece.isascii() or max(piece) < "\u0130" else None
    if piece[-1:] in MARKS and (word := piece[:-1]).isalpha() and (word.isascii() or max(word) < "\u0130"):
        return (word, piece[-1])
    return None


def splitter(pattern: str):
    """findall for a pattern in which code points that the libraries do not know are no letters."""
    plain = regex.compile(pattern).findall
    wary = None

    def find(text: str) -> list[str]:
        nonlocal wary
        if text.isascii() or max(text) < "\U000323b0":
            return plain(text)
        if wary is None:
            wary = regex.compile(rf"(?V1){pattern}".replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}--{UNASSIGNED}]\p{{N}}]").replace(r"[\p{L}]+", r"\p{L}+").replace(r"\p{L}+", rf"[\p{{L}}--{UNASSIGNED}]+"))
        return wary.findall(text)

    return find


class WordSplitter:
    """Splits a text into the words that such a tokenizer file merges separately.

    Special strings inside a text count as one token each, as in the library by default; what
    lies between them is composed (NFC), lower-cased code point by code point, and split.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        specials = [t["content"] for t in self.spec["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.find = splitter(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text without special strings; each splits into words by itself, as words hold no white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            for a, b in LOWER.items():
                text = text.replace(a, b)
        text = text.lower()
        # str.split() takes these separators for white space, the pattern doesn't
        return [text] if SEPARATORS.search(text) else text.split()

    def parts(self, text: str):
        """(chunks, special string after them or None), from left to right."""
        if self.special is None or "<|" not in text:
            yield self.chunks(text), None
            return
        at = 0
        for m in self.special.finditer(text):
            yield self.chunks(text[at : m.start()]), m.group()
            at = m.end()
        yield self.chunks(text[at:]), None


class HeapMerger:
    """Counts a word's tokens by merging with a heap over a linked list."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])

    def count(self, word: str) -> int:
        data = word.encode()
        n = len(data)
        symbols = [self.first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        rank, made, push, pop = self.rank.get, self.made, heapq.heappush, heapq.heappop
        # an entry is rank * 2**40 + position: the lowest rank comes first, ties from the left
        heap = [(r << 40) | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges = 0
        while heap:
            entry = pop(heap)
            r, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = after[i]
            # the entry is stale if either symbol has been merged since
            if j < 0 or symbols[i] < 0 or rank((symbols[i], symbols[j])) != r:
                continue
            merges += 1
            symbols[i], symbols[j] = made[r], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (new := rank((symbols[i], symbols[k]))) is not None:
                    push(heap, (new << 40) | i)
            h = before[i]
            if h >= 0 and (new := rank((symbols[h], symbols[i]))) is not None:
                push(heap, (new << 40) | h)
        return n - merges


class TokenCounter:
    _of: dict[str, "TokenCounter"] = kept_by_worker()

    def __init__(self, path: str):
        self.splitter = WordSplitter(path)
        word, find = WordCache(HeapMerger(self.splitter.spec).count).__getitem__, self.splitter.find
        self.cache = WordCache(lambda chunk: sum(map(word, find(chunk))))

    @classmethod
    def of(cls, path: str) -> "TokenCounter":
        """One per worker process and file, so that words are merged once."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def count(self, text: str) -> int:
        get = self.cache.__getitem__
        return sum(sum(map(get, chunks)) + (special is not None) for chunks, special in self.splitter.parts(text))


def token_counts(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of df.

    A null text counts as empty: no bytes, no tokens, not over the limit.  Repeated rows and null ids
    stay rows of their own.  Other columns of df are not read.  tokenizer is the path of a byte-level
    BPE file, readable on every worker.  No shuffle; memory is bounded by a batch and the word cache.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = TokenCounter.of(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
