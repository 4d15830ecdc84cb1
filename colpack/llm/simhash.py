"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 6).

A fingerprint has a bit set where more than half of the hashes of the text's shingles have.  Two
fingerprints within the distance share a variant within half of it of either.  Every different
fingerprint therefore emits all its variants within half the distance; variants meet in buckets, and
the fingerprints at one variant are linked to the one nearest to it, the links verified and deduplicated.
Links become components by distributed stars; components found early stand for their members later on.
"""

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpack.llm.common import cleaned_shuffles, drop_kept, lean, materialize
from colpack.llm.components import components

#: Odd factor that spreads variants over the buckets, and its inverse modulo 2**64.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 1 << 64)
#: Part of the space of variants that the first round takes, and rounds at least that take the rest, which bounds what is shuffled at a time.
FIRST_SHARE, ROUNDS = 64, 4
#: Variants that a bucket is to hold, and how many buckets a round has at least and at most.
BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 19, 256, 1 << 30
#: Fingerprints that are expanded at a time.
CHUNK = 1024
#: Fingerprints that a task expands in all, which keeps tasks short however few files hold them.
TASK = 1 << 14


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, seed)
    ends = starts[shingle:]
    counts, n = np.zeros(64, np.int64), len(ends)
    for k in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every row; a null text has no words and so fingerprint zero."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        drop_kept()
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_col, "fp"])

    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {kind}, fp bigint")


def masks(radius: int) -> np.ndarray:
    """All 64-bit words with at most radius bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links (a, b) that a spanning forest of them needs, the first ones first."""
    above: dict[int, int] = {}
    needed = []

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            needed.append(k)
    return np.array(needed, np.int64)


def _emitted(ball: np.ndarray, low: int, width: int, shift: int):
    """Fingerprints and their labels to the sorted runs of variants between low and low + width, a row a bucket."""

    def run(batches):
        drop_kept()
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            named = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            labels = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for chosen in (np.flatnonzero(~named), np.flatnonzero(named)):
                for k in range(0, len(chosen), CHUNK):
                    rows = chosen[k : k + CHUNK]
                    keys = (every[rows, None] ^ ball[None, :]) * np.uint64(SPREAD) - np.uint64(low)
                    row, which = np.nonzero(keys < np.uint64(width))
                    if not len(row):
                        continue
                    keys = keys[row, which]
                    bucket = (keys >> np.uint64(shift)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    bucket = bucket[order]
                    first = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
                    offsets = np.append(first, len(bucket)).astype(np.int64)
                    columns = [(8, keys[order] + np.uint64(low)), (2, which[order].astype("<u2"))]
                    if named[rows[0]]:
                        columns.append((8, labels[rows[row[order]]]))
                    data = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets * size), pa.py_buffer(values)]).cast(pa.binary()) for size, values in columns]
                    if len(data) < 3:
                        data.append(pa.nulls(len(first), pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *data], ["bucket", "keys", "which", "labels"])

    return run


def _met(ball: np.ndarray, distance: int):
    """A bucket's variants to links between labels: a spanning forest of those that the bucket holds."""

    def run(table: pa.Table) -> pa.Table:
        parts = [(k, w, n) for k, w, n in zip(*(table.column(c).to_pylist() for c in ("keys", "which", "labels")))]
        keys = np.frombuffer(b"".join(k for k, _, _ in parts), "<u8")
        which = np.frombuffer(b"".join(w for _, w, _ in parts), "<u2")
        labels = np.frombuffer(b"".join(n or bytes(len(k)) for k, _, n in parts), "<i8")
        named = np.repeat([n is not None for _, _, n in parts], [len(k) // 8 for k, _, _ in parts])
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        met = order[np.append(same, False) | np.insert(same, 0, False)] if len(keys) else order
        # at a variant the nearest fingerprint is the centre: what another is within the distance of, it is too
        met = met[np.lexsort((which[met], keys[met]))]
        variant = keys[met]
        fps = (variant * np.uint64(UNSPREAD)) ^ ball[which[met]]
        label = np.where(named[met], labels[met], fps.view(np.int64))
        first = np.flatnonzero(np.append(True, np.diff(variant) != 0)) if len(met) else met
        times = np.diff(np.append(first, len(met)))
        centre, to = np.repeat(fps[first], times), np.repeat(label[first], times)
        near = (np.bitwise_count(centre ^ fps) <= distance) & (label != to)
        pairs = np.unique(np.stack([np.minimum(to, label)[near], np.maximum(to, label)[near]]), axis=1)
        pairs = pairs[:, forest(*pairs)]
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return run


def _contracted(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, label) after the components that links between labels make."""
    roots = components(links).select(F.col("a").alias("was"), F.col("b").alias("root"))
    return materialize(labelled.join(roots, F.coalesce("label", "fp") == F.col("was"), "left").select("fp", F.coalesce("root", "label").alias("label")), "labelled")


def labelled(different: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, label): for every fingerprint one that links within distance reach, the same in a whole component; null for itself.

    different has one column fp without repeats.  A bucket holds a bounded number of variants: they are
    spread evenly, and no variant has more than a ball's worth of fingerprints.  A first round over a
    small share of the space of variants makes one label of nearly all of a dense group; later rounds link
    different labels only, and a bucket gives a spanning forest of its links, so links do not grow as
    the pairs of a group.
    """
    ball = masks((distance + 1) // 2)
    n = different.count()
    now = different.select("fp", F.lit(None).cast("bigint").alias("label"))
    rounds = max(ROUNDS, -(-n * len(ball) // (BUCKET * MOST_BUCKETS)))
    first = (1 << 64) // FIRST_SHARE
    bounds = [0, *(first + ((1 << 64) - first) * k // rounds for k in range(rounds + 1))]
    found = None
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        buckets = max(LEAST_BUCKETS, n * len(ball) * (high - low) // (BUCKET << 64))
        shift = ((high - low) // buckets).bit_length() - 1
        spread = now.repartition(max(1, -(-n // TASK))).mapInArrow(lean(_emitted(ball, low, high - low, shift)), "bucket int, keys binary, which binary, labels binary")
        links = materialize(spread.groupBy("bucket").applyInArrow(_met(ball, distance), "a bigint, b bigint").distinct(), "links")
        if number == 0:
            now = _contracted(now, links)
        else:
            found = links if found is None else found.union(links)
    return _contracted(now, found)


def class_components(classes: DataFrame, distance: int, least: str) -> DataFrame:
    """(fp, component): for every fingerprint of classes (fp, least), the least value that links reach."""
    named = classes.join(labelled(classes.select("fp"), distance), "fp").select("fp", least, F.coalesce("label", "fp").alias("root"))
    named = materialize(named, "named")
    first = materialize(named.groupBy("root").agg(F.min(least).alias("component")), "firsts")
    return materialize(named.join(first, "root").select("fp", "component"), "components")


def near_duplicates(df: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row.

    Rows whose fingerprints differ in at most distance bits are linked; component_id is the smallest id
    that links reach.  A null or wordless text has fingerprint zero and is linked like any other; equal
    fingerprints are expanded once; repeated rows stay; null ids never name a component unless it
    has no other id.  An empty table gives no row.  Other columns are not read.
    """
    with cleaned_shuffles(df.sparkSession):
        rows = materialize(fingerprints(df, shingle, id_col=id_col, text_col=text_col), "fingerprints")
        classes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
        named = class_components(classes, distance, "least")
    return rows.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: that of the smallest id, of equal ones the first in table order.

    A component of null ids alone keeps its first row.  Columns and their names stay as they are.
    """
    own = df.schema
    at = df.columns.index(text_col)

    def run(batches):
        from pyspark import TaskContext

        drop_kept()
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = batch.column(0)
            found = np.array([fingerprint(t, shingle) for t in rows.field(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(rows))), pa.array(found), rows], ["rid", "fp", "own"])
            rid += len(rows)

    with cleaned_shuffles(df.sparkSession):
        packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"))
        rows = materialize(packed.mapInArrow(lean(run), f"rid bigint, fp bigint, own {own.simpleString()}"), "fingerprinted")
        # nulls come after all ids
        key = F.struct(F.col(f"own.`{id_col}`").isNull().alias("none"), F.col(f"own.`{id_col}`").alias("id"), "rid")
        classes = materialize(rows.select("fp", key.alias("key")).groupBy("fp").agg(F.min("key").alias("least")), "classes")
        kept = class_components(classes, distance, "least").select(F.col("component.rid").alias("rid")).distinct()
        kept = materialize(kept, "kept")
    return rows.join(kept, "rid", "left_semi").select("own.*")
