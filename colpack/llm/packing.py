"""Best-fit packing of documents into training sequences (operator 4).

Documents become token ids and pieces of at most the capacity.  Sequences are planned on the
histogram of piece lengths, whose size the capacity bounds, so the plan does not grow with the
corpus: an index of available lengths yields the single, pair or triple of lengths that sums exactly
to a gap; each combination found is consumed as often as its counts allow; what has no exact
complement is packed by best fit, longest first.  A piece finds its place from its rank among the
pieces of its length, which is counted without gathering a length in one task.
"""

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colpack.llm.common import by_size, kept_by_worker, lean, materialize
from colpack.llm.token_counts import SEPARATORS, WordSplitter, plain_parts

CAPACITY = 4096
#: The id that ends every document.
END = 1
#: Pieces of text, and words, whose ids a worker keeps at most, and the longest of them that is kept.
CACHE, LONGEST = 500_000, 64
#: Bytes of text that are encoded together.
GROUP = 1 << 21
#: Words that the library sees in one call: it needs hundreds of bytes for each until the call ends.
CALL = 1 << 13


class DocumentEncoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    No word of these files crosses white space, so a text is encoded piece by piece and each piece
    only once.  Words not seen yet go to the library as one text with a space between any two, whose ids
    are cut where a token ends a word.
    """

    _of: dict[str, "DocumentEncoder"] = kept_by_worker()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = WordSplitter(path)
        model = self.splitter.spec["model"]
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix := model["end_of_word_suffix"]:
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "DocumentEncoder":
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def by_library(self, texts: list[str]) -> list[bytes]:
        calls = (self.tokenizer.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False) for k in range(0, len(texts), CALL))
        return [pack("<%dI" % len(ids), *ids) for call in calls for ids in (e.ids for e in call)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that stay one word each between spaces, some words a call."""
        return [ids for k in range(0, len(words), CALL) for ids in self._encode_some(words[k : k + CALL])]

    def _encode_some(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(np.append(True, self.ends[np.minimum(ids, len(self.ends) - 1)]))
        if len(cuts) != len(words) + 1 or cuts[-1] != len(ids):
            return self.by_library(words)
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def words_of(self, piece: str) -> tuple[str, ...] | None:
        """A piece's words in lower case, or None where only the library knows them."""
        if not piece:
            return ()
        if words := plain_parts(piece):
            return tuple(map(str.lower, words))
        if not piece.isascii() or SEPARATORS.search(piece) or self.splitter.special and self.splitter.special.search(piece):
            return None
        return tuple(self.splitter.find(piece.lower()))

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces, which are kept; the library sees each word that is new, however it is written, once."""
        words = {p: self.words_of(p) for p in pieces}
        new = [*{w for ws in words.values() if ws for w in ws if w not in self.words}]
        fresh = dict(zip(new, self.encode_words(new)))
        self.words |= fresh if max(map(len, new), default=0) <= LONGEST else {w: x for w, x in fresh.items() if len(w) <= LONGEST}
        get, far = self.words.get, fresh.get
        odd = [p for p, ws in words.items() if ws is None]
        found = dict(zip(odd, self.by_library(odd)))
        for p, ws in words.items():
            if ws is not None:
                found[p] = get(ws[0]) or far(ws[0]) if len(ws) == 1 else b"".join([get(w) or far(w) for w in ws])
        self.pieces |= {p: x for p, x in found.items() if len(p) <= LONGEST}
        return found

    def encode(self, text: str) -> bytes:
        data, _ = self.encode_all(pa.array([text], pa.string()))
        return bytes(data)

    def each(self, texts: pa.Array):
        """The ids of one text after the other."""
        data, bounds = self.encode_all(texts)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            yield bytes(data[a:b])

    def encode_all(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of texts one after another, and where each text's begin, the end of the last one included.

        A null is the empty text.  Pieces are looked up once for all texts, however often they stand there.
        """
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, SEPARATORS.pattern)).as_py():
            each = [[text] if SEPARATORS.search(text) else text.split() for text in texts.to_pylist()]
            pieces, starts = pa.array([p for ps in each for p in ps], pa.string()), np.cumsum([0, *map(len, each)])
        else:
            each = pc.utf8_split_whitespace(texts)
            pieces, starts = each.flatten(), np.asarray(each.offsets) - each.offsets[0].as_py()
        for cache in (self.pieces, self.words):
            shrink(cache, CACHE)
        pieces = pieces.dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.pieces.get, different)]
        if new := {p for p, x in zip(different, ids) if x is None}:
            learnt = self.learn(new)
            ids = [learnt[p] if x is None else x for p, x in zip(different, ids)]
        found = pa.array(ids, pa.large_binary()).take(pieces.indices)
        if not len(found):
            return memoryview(b""), np.zeros(len(texts) + 1, np.int64)
        bounds = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
        return memoryview(found.buffers()[2] or b"").cast("B"), bounds[starts]


def shrink(cache: dict, most: int) -> None:
    """Drop the older half of a cache that has outgrown its bound."""
    if len(cache) > most:
        for old in [*islice(cache, most // 2)]:
            del cache[old]


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): the pieces of every row, numbered by length within each task."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), Counter(), DocumentEncoder.of(tokenizer)
        for batch in batches:
            rows, out = [], ([], [], [], [], [])
            texts = batch.column(1)
            for row, data in enumerate(ids for first, n in by_size(texts, GROUP) for ids in encoder.each(texts.slice(first, n))):
                ids = memoryview(data + END.to_bytes(4, "little"))
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    cut = ids[4 * start : 4 * (start + capacity)]
                    n = len(cut) // 4
                    rows.append(row)
                    for column, value in zip(out, (piece, start, n, zlib.crc32(cut), seen[n])):
                        column.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array([part] * len(rows), pa.int32()), pa.array(out[4], pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


class LengthIndex:
    """Available lengths with their counts, and the sums that one, two or three of them make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.there = self.left > 0
        #: by sum: how many pairs of lengths make it, a length twice only if two are left
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        lengths = np.flatnonzero(self.there)
        for k, x in enumerate(lengths):
            self.pairs[x + lengths[k + 1 :]] += 1
        self.pairs[2 * np.flatnonzero(self.left > 1)] += 1

    def times(self, lengths) -> int:
        """How often a combination of lengths can be taken."""
        return min(int(self.left[x]) // n for x, n in Counter(lengths).items())

    def take(self, lengths) -> int:
        """Consume a combination as often as possible; returns how often."""
        times = self.times(lengths)
        for x, n in Counter(lengths).items():
            had = self.left[x]
            self.left[x] -= n * times
            self.pairs[2 * x] -= had > 1 >= self.left[x]
            if not self.left[x]:
                self.there[x] = False
                self.pairs[x + np.flatnonzero(self.there)] -= 1
        return times

    def pair(self, total: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths with this sum that are there besides those used, the most uneven first."""
        if total < 2 or not self.pairs[total]:
            return None
        low = np.arange(max(1, total - len(self.left) + 1), total // 2 + 1)
        for k in np.flatnonzero(self.there[low] & self.there[total - low]):
            found = (total - int(low[k]), int(low[k]))
            if self.times((*used, *found)):
                return found
        return None

    def complement(self, first: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside first exactly."""
        if self.left[gap] > (gap == first):
            return (gap,)
        if found := self.pair(gap, (first,)):
            return found
        third = np.arange(gap - 2, 0, -1)
        for c in third[self.there[third] & (self.pairs[gap - third] > 0)]:
            if found := self.pair(gap - int(c), (first, int(c))):
                return (int(c), *found)
        return None


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces in a sequence, number of such sequences), every piece placed once.

    Exact complements of short pieces may use up what longer ones need; if the plan misses the lower
    bound, those for which only pieces over half the capacity, or none, look for exact complements are
    tried as well, and the shortest is taken.
    """
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    best, fewest = [], None
    for shortest in (1, capacity // 2 + 1, capacity):
        plan = exact_then_best_fit(counts, capacity, shortest)
        n = sum(times for _, times in plan)
        if fewest is None or n < fewest:
            best, fewest = plan, n
        if fewest == bound:
            break
    return best


def exact_then_best_fit(counts: dict[int, int], capacity: int, shortest: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements of all pieces of at least shortest, then best fit of what is left, longest first."""
    index, plan = LengthIndex(counts, capacity), []
    if index.left[capacity]:
        plan.append(((capacity,), index.take((capacity,))))
    for first in range(capacity - 1, shortest - 1, -1):
        while index.left[first] and (rest := index.complement(first, capacity - first)):
            lengths = (first, *rest)
            plan.append((lengths, index.take(lengths)))
    gaps: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in bins:
            insort(gaps, gap)
        bins.setdefault(gap, []).append((lengths, n))

    for length in range(capacity - 1, 0, -1):
        n = int(index.left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            lengths, have = bins[gaps[at]].pop()
            used = min(n, have)
            if have > used:
                bins[gaps[at]].append((lengths, have - used))
            elif not bins[gaps[at]]:
                del bins[gaps.pop(at)]
            put((*lengths, length), used)
            n -= used
    return plan + [x for gap in gaps for x in bins[gap]]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the ranks at which runs begin, and each run's first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    rank, sequence = Counter(), 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((rank[x], sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(column, np.int64) for column in zip(*r)) for x, r in runs.items()}


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each row of df.

    A null text is the empty text and becomes the end id alone.  Repeated rows and null ids stay rows
    of their own; other columns are not read; an empty table gives no row.  Texts cross no shuffle: the
    small piece rows are written once, and a window over (length, task) counts finds the ranks.
    """
    pieces = materialize(cut_pieces(df, tokenizer, capacity, id_col, text_col), "pieces")
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    # at most capacity rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = places(plan_sequences(counts, capacity))
    ranked = pieces.join(each, ["length", "part"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    first, to, at = placed[int(length[rows[0]])]
                    k = np.searchsorted(first, rank[rows], side="right") - 1
                    sequence[rows], offset[rows] = to[k] + rank[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(run), f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
