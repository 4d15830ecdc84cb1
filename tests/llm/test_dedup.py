"""Operators 1, 6 and 9 against brute force and planted copies."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from colpack.llm import audio, passages, queries, simhash
from colpack.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if near(fps[a], fps[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", "  \t\n", "one", "One two\x0bthree", "a b c d", "É É É é K x y z " * 40, "a b c d " * 20000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates_of_all_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    found = queries.op6_simhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{f:016x}" for i, f in zip(ids, fps)}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(ids, fps, lambda a, b: (a ^ b).bit_count() <= 4)


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_links_find_every_pair_within_the_distance(spark, distance):
    r = random.Random(distance)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):
        fps.append(r.getrandbits(64))
        for _ in range(3):  # chains of near fingerprints
            fps.append(fps[-1] ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))))
    fps = sorted({*fps})
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    found = {r["fp"]: r["label"] for r in simhash.labelled(spark.createDataFrame([(x,) for x in signed], "fp bigint"), distance).collect()}
    root = brute_components(signed, fps, lambda a, b: (a ^ b).bit_count() <= distance)
    assert {x: x if y is None else y for x, y in found.items()} == root


def test_links_of_a_dense_group_are_linear(spark, monkeypatch):
    r = random.Random(4)
    middle = r.getrandbits(64)
    fps = {middle}
    while len(fps) < 2000:
        fps.add(middle ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 5))))
    signed = [int(x) for x in np.array([*fps], np.uint64).view(np.int64)]
    plain, links = simhash.materialize, []

    def counted(df, name):
        found = plain(df, name)
        links.append(found.count() if name == "links" else 0)
        return found

    monkeypatch.setattr(simhash, "materialize", counted)
    found = simhash.labelled(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()
    assert {r["label"] or r["fp"] for r in found} == {min(signed)}
    assert sum(links) <= 30 * len(fps)


def test_a_forest_joins_what_its_links_join():
    for seed in range(30):
        r = random.Random(seed)
        a, b = (np.array([r.randrange(40) for _ in range(60)]) for _ in range(2))
        kept = simhash.forest(a, b)
        every = range(40)
        pairs, some = {*zip(a.tolist(), b.tolist())}, {*zip(a[kept].tolist(), b[kept].tolist())}
        whole = brute_components(every, every, lambda x, y: (x, y) in pairs or (y, x) in pairs)
        assert brute_components(every, every, lambda x, y: (x, y) in some or (y, x) in some) == whole
        assert len(kept) == 40 - len({*whole.values()})


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    edges = path + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 2), (2, 3), (3, 2)]
    df = spark.createDataFrame(edges + [(None, 1)], "a bigint, b bigint")
    found = {r["a"]: r["b"] for r in components(df).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 560)} | {3: 2}
    assert components(df.limit(0)).count() == 0


ROWS = [(1, None, 0), (2, "", 0), (None, "", 0), (5, "x y z", 1), (4, "X  Y\tz", 1), (5, "x y z", 1), (None, "only one of null id here", 2)]


def test_near_duplicate_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, fp int")
    found = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    x = f"{brute_fingerprint('x y z'):016x}"
    zero = "0" * 16
    assert found == sorted([(1, zero, 1), (2, zero, 1), (None, zero, 1), (5, x, 4), (4, x, 4), (5, x, 4), (None, f"{brute_fingerprint(ROWS[-1][1]):016x}", None)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ROWS[-1][1]), (1, ""), (4, "X  Y\tz")]
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def planted(seed=3):
    """(rows, ids that hold a later copy of the exact passage, of the fuzzy one)."""
    r = random.Random(seed)
    exact, fuzzy, rows, has = words(r, 55), words(r, 120), [], ([], [])
    for i in range(90):
        t = words(r, r.randrange(0, 300))
        if i % 7 == 1:
            k = r.randrange(len(t) + 1)
            t = t[:k] + exact + t[k:]
            has[0].append(i)
        if i % 10 == 2:
            t = t + [x if r.random() > 0.04 else "zz" for x in fuzzy]
            has[1].append(i)
        rows.append((i, " ".join(t)))
    return rows, exact, fuzzy, has


def test_planted_passages_are_found_and_cut(spark):
    rows, exact, fuzzy, has = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = passages.repeated_passages(df).collect()
    assert {r["doc_id"] for r in found} == {*has[0][1:], *has[1][1:]}
    texts = dict(rows)
    for r in found:
        mine, there = texts[r["doc_id"]].split()[r["first_word"] : r["first_word"] + r["n_words"]], texts[r["source_id"]].split()[r["source_first_word"] : r["source_first_word"] + r["source_n_words"]]
        assert len({*mine} & {*there}) >= 0.75 * len({*mine}) and r["n_words"] >= 40
    left = {r["doc_id"]: r["text"] for r in passages.cut_repeats(df).collect()}
    assert [i for i, t in left.items() if " ".join(exact) in t] == has[0][:1]
    assert all(left[i] == texts[i] for i in texts if i not in has[0][1:] and i not in has[1][1:])


def spans(found):
    return sorted((r["doc_id"], r["first_word"], r["n_words"], r["source_id"]) for r in found)


@pytest.mark.parametrize("sizes", [(60, 35, 60), (60, 110, 60), (300, 200, 300), (300, 590, 300), (45, 60, 200, 160, 50), (400, 30, 12, 300, 45)])
def test_exact_passages_near_each_other_are_all_found(spark, sizes):
    r = random.Random(sum(sizes))
    shared = [words(r, n) for n in sizes[::2]]
    rows, want = [], []
    for i in (1, 2):
        text = []
        for k, part in enumerate(shared):
            if i == 2 and len(part) >= 40:
                want.append((len(text), len(part)))
            text += part + (words(r, sizes[2 * k + 1]) if k + 1 < len(shared) else [])
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    covered = {w for _, a, n, _ in spans(passages.repeated_passages(df).collect()) for w in range(a, a + n)}
    missed = [(a, n) for a, n in want if not {*range(a, a + n)} <= covered]
    assert not missed
    exact = {w for a, n in want for w in range(a, a + n)}
    assert len(covered - exact) <= 0.25 * len(exact)


def test_passages_whose_seeds_first_stand_elsewhere(spark):
    r = random.Random(11)
    shared = words(r, 70)
    rows = [(i, " ".join(words(r, 30) + shared[i : i + 7] + words(r, 30))) for i in range(64)]  # each shingle singly
    rows += [(i, " ".join(words(r, 50) + shared + words(r, 50))) for i in (100, 101, 102)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = passages.repeated_passages(df).collect()
    assert {(d, s) for d, a, n, s in spans(found) if a <= 50 and a + n >= 120} == {(101, 100), (102, 100)}
    assert {r["doc_id"] for r in found} == {101, 102}


def test_most_fuzzy_passages_are_found(spark):
    r = random.Random(12)
    rows, copies = [], []
    for i in range(200):
        passage = words(r, 60)
        changed = {*r.sample(range(60), 9)}  # 0.85 alike
        rows.append((i, " ".join(words(r, 40) + passage + words(r, 40))))
        copies.append((1000 + i, " ".join(words(r, 40) + ["zz%d" % r.randrange(9999) if k in changed else w for k, w in enumerate(passage)] + words(r, 40))))
    df = spark.createDataFrame(rows + copies, "doc_id bigint, text string").coalesce(1)
    found = {(r["doc_id"], r["source_id"]) for r in passages.repeated_passages(df).collect()}
    assert found <= {(1000 + i, i) for i in range(200)}
    assert len(found) >= 190


def test_parts_of_a_chain_hold_every_exact_passage():
    for seed in range(60):
        r = random.Random(seed)
        mine, there, exact, chain = [], [], [], []
        for _ in range(r.randrange(2, 8)):
            n = r.choice([8, 20, 40, 41, 60, 150])
            part = [r.randrange(60000) for _ in range(n)]
            chain.append((len(mine), len(there), n))
            if n >= 40:
                exact.append((len(mine), len(mine) + n))
            mine += part + [r.randrange(60000) for _ in range(r.randrange(1, 200))]
            there += part + [r.randrange(60000) for _ in range(r.randrange(1, 200))]
        doc, other = np.array(mine, np.uint16), np.array(there, np.uint16)
        found = passages.parts(chain, doc, other, 0)
        for a, b, c, d in found:
            assert b - a >= 40 and passages.common(doc[a:b], other[c:d]) >= 0.8 * max(b - a, d - c)
        assert all(any(a <= x and y <= b for a, b, *_ in found) for x, y in exact)
        assert all(b <= c for (_, b, *_), (c, *_) in zip(sorted(found), sorted(found)[1:]))


def test_passage_edge_rows(spark):
    long = " ".join(words(random.Random(9), 50))
    rows = [(1, None, "a"), (2, "", "b"), (3, "a b", "c"), (4, long, "d"), (None, long.upper(), "e"), (4, long, "f"), (5, "so " * 50000, "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, words string").coalesce(1)
    found = passages.repeated_passages(df).collect()
    assert sorted((str(r["doc_id"]), r["source_id"], r["n_words"]) for r in found) == [("4", 4, 50), ("None", 4, 50)]
    kept = passages.cut_repeats(df)
    assert kept.columns == df.columns
    assert [(r["doc_id"], r["text"]) for r in kept.orderBy("words").collect()] == [(1, None), (2, ""), (3, "a b"), (4, long), (None, ""), (4, ""), (5, "so " * 50000)]
    assert passages.repeated_passages(df.limit(0)).count() == passages.cut_repeats(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), min_size=5, max_size=120))
@settings(deadline=None)
def test_seeds_are_the_least_of_their_windows(hashes):
    _, all_places, all_hashes = passages.seeds(np.array(hashes, np.uint32), [len(hashes)], window=1)
    assert all_places.tolist() == list(range(len(hashes) - 4))
    h = all_hashes.view(np.uint64).tolist()
    _, found, _ = passages.seeds(np.array(hashes, np.uint32), [len(hashes)], window=16)
    chosen = set()
    for s in range(-15, len(h)):
        w = range(max(0, s), min(len(h), s + 16))
        low = min(h[i] for i in w)
        chosen |= {i for i in w if h[i] == low}
    assert set(found.tolist()) == chosen


@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200)), min_size=1, max_size=30, unique=True))
@settings(deadline=None)
def test_chains_are_in_order_and_the_first_is_best(points):
    p, q = (np.array(x) for x in zip(*points))
    found = passages.chains(p, q)
    runs = passages.runs(p, q)
    assert sorted(x for c in found for x in c) == runs
    for c in found:
        assert all(a + n <= x and b + n <= y for (a, b, n), (x, y, _) in zip(c, c[1:]))

    def score(c):
        return sum(n for *_, n in c) - sum(passages.GAP * (x - a - n + y - b - n) for (a, b, n), (x, y, _) in zip(c, c[1:]))

    best = [0.0] * len(runs)
    for i, (x, y, m) in enumerate(runs):
        best[i] = m + max([0.0, *(best[j] - passages.GAP * (x - a - n + y - b - n) for j, (a, b, n) in enumerate(runs) if a + n <= x and b + n <= y)])
    assert score(found[0]) == pytest.approx(max(best)) or len(found) == 1 and len(runs) == 1


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert passages.common(np.array(a, np.uint16), np.array(b, np.uint16)) == table[-1][-1]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=30))
def test_cover_tells_what_any_span_would(spans):
    cover, held = passages.Cover(), []
    for a, b in spans:
        assert cover.holds(a, b) == any(x <= a and b <= y for x, y in held)
        cover.add(a, b)
        held.append((a, b))


def test_spans_of_a_long_document_are_not_scanned_one_by_one():
    class Counted(int):
        seen = 0

        def __le__(self, other):
            Counted.seen += 1
            return int(self) <= int(other)

        def __lt__(self, other):
            Counted.seen += 1
            return int(self) < int(other)

        def __ge__(self, other):
            Counted.seen += 1
            return int(self) >= int(other)

    cover = passages.Cover()
    for i in range(3000):
        cover.add(Counted(50 * i), Counted(50 * i + 45))
        assert not cover.holds(Counted(50 * i), Counted(50 * i + 46))
    assert Counted.seen < 3000 * 100


def test_chains_are_read_as_rows():
    chain = pa.struct([("chain", pa.list_(pa.int32())), ("far", pa.bool_()), ("other_id", pa.int64()), ("start", pa.int32()), ("part", pa.binary())])
    one, two = ({"chain": [0, 7, 5], "far": True, "other_id": None, "start": 3, "part": b"ab"}, {"chain": [1, 2, 5, 9, 9, 5], "far": False, "other_id": 4, "start": 0, "part": b""})
    column = pa.array([[one], None, [], [two, one], [two]], pa.list_(chain))
    for some in (column, column.slice(1, 3), column.slice(3), column.slice(0, 0)):
        assert passages._chains_of(some) == some.to_pylist()


def test_recordings_align(spark):
    r = np.random.default_rng(5)
    song = r.integers(0, 256, 20000).astype(np.uint8).tobytes()
    other = r.integers(0, 256, 20000).astype(np.uint8).tobytes()
    rows = [(1, song, 0), (2, song, 0), (3, song[64 * 20 :], 0), (4, other, 0), (5, None, 0), (6, b"", 0), (None, song, 0), (7, song[:300], 0), (8, r.integers(0, 256, 3000).astype(np.uint8).tobytes() + song, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, media binary, class_id int").coalesce(1)
    found = audio.align_recordings(df, media_col="media", frame=256, hop=64).collect()
    assert len(found) == len(rows)
    classes = {r["doc_id"]: r["class_id"] for r in found}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, None: 1, 7: 7, 8: 1}
    third = next(r for r in found if r["doc_id"] == 3)
    assert third["offset"] == 20 and third["bit_errors"] == 0 and third["overlap"] == third["n_ints"]
    assert audio.align_recordings(df.limit(0), media_col="media", frame=256, hop=64).count() == 0


def aligned_by_hand(a, b):
    """(overlap, -bits, offset) of the longest alignment of two lists of integers, offset by offset."""
    best = None
    for offset in range(1 - len(a), len(b)):
        beside = [(a[i], b[i + offset]) for i in range(len(a)) if 0 <= i + offset < len(b)]
        votes = {(x, u) for (x, y), (u, v) in zip(beside, beside[1:]) if x == y and u == v}
        wrong = sum((x ^ y).bit_count() for x, y in beside)
        if len(votes) >= 2 and len(beside) >= 4 and wrong <= 0.15 * 32 * len(beside):
            best = max(best or (0,), (len(beside), -wrong, -offset))
    return best


def test_recordings_align_whoever_else_has_their_integers(spark):
    r = np.random.default_rng(8)
    song, noise = (r.integers(0, 256, n).astype(np.uint8).tobytes() for n in (12800, 12800))
    # the first two hold all integers of the next two, but neither aligns with them as a whole
    rows = [(1, song[:6400] + noise[:6400]), (2, noise[6400:] + song[6000:]), (3, song), (4, song[640:]), (5, song[:-640])]
    found = {r["doc_id"]: r for r in audio.align_recordings(spark.createDataFrame(rows, "doc_id bigint, media binary").coalesce(1), media_col="media", frame=256, hop=64).collect()}
    assert {i: (f["class_id"], f["n_links"]) for i, f in found.items()} == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (3, 1), 5: (3, 2)}


def test_links_of_all_documents_equal_those_found_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in audio.align_recordings(docs, frame=256, hop=64).collect()}
    ints = {i: audio.fingerprint((t or "").encode(), frame=256, hop=64).tolist() for i, t in texts.items() if not found[i]["is_copy"]}
    ints = {i: x for i, x in ints.items() if len(x) >= 4}
    assert len({*map(tuple, ints.values())}) == len(ints)
    held = {}
    for i, x in ints.items():
        for pair in {*zip(x, x[1:])}:
            held.setdefault(pair, []).append(i)
    links = [(a, b) for a, b in {(a, b) for ids in held.values() for a in ids for b in ids if a < b} if aligned_by_hand(ints[a], ints[b])]
    assert len(links) == sum(r["n_links"] for r in found.values() if not r["is_copy"])
    classes = {r["doc_id"]: r for r in queries.op1_chroma_fingerprints(spark, sf).collect()}
    assert {i: (r["class_id"], r["is_copy"]) for i, r in classes.items()} == {i: (r["class_id"], r["is_copy"]) for i, r in found.items()}
    assert all(classes[a]["class_id"] == classes[b]["class_id"] for a, b in links)


def hashed(ints):
    """Rows (rid, ints) and (hash, rid) of lists of integers."""
    return [(rid, x.astype("<u4").tobytes()) for rid, x in enumerate(ints)], [(int(h), rid) for rid, x in enumerate(ints) for h in np.unique(audio.neighbours(x)).view(np.int64)]


@pytest.mark.parametrize("few", [0, 4])
def test_near_copies_meet_few_of_their_class(spark, monkeypatch, few):
    monkeypatch.setattr(audio, "FEW", few)
    r = np.random.default_rng(3)
    ints = []
    for n in (160, 40):
        base = r.integers(0, 1 << 32, 24, dtype=np.uint32)
        others = [np.concatenate([base[:5], r.integers(0, 1 << 32, 30, dtype=np.uint32)]) for _ in range(6)]
        copies = [base.copy() for _ in range(n)]
        for x in copies:
            x[r.integers(5, 24, 4)] ^= np.uint32(0xFFFF)
        ints += others[:3] + copies + others[3:]  # what holds the frequent pairs first aligns with nothing
    rows, pairs = hashed(ints)
    links = {(a, b) for b in range(len(ints)) for a in range(b + 1, len(ints)) if audio.alignment(ints[a], ints[b])}
    different, each = spark.createDataFrame(rows, "rid bigint, ints binary"), spark.createDataFrame(pairs, "hash bigint, rid bigint")
    every = {(x["rid"], x["other"]) for x in audio.all_links(different, each).collect()}
    assert every == links and len(links) > 5000
    found = [(x["rid"], x["other"]) for x in audio.class_links(different, each, group=16).collect()]
    assert len(found) == len({*found}) and {*found} <= links and len(found) < len(links) / 4
    named = [{x["a"]: x["b"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} for edges in (sorted(links), found)]
    assert named[0] == named[1]


def test_all_of_different_labels_that_share_hashes_meet(spark):
    r = random.Random(6)
    has = {rid: r.sample(range(6), 3) for rid in range(60)}
    label = {rid: r.choice([0, 0, 0, 1, 2, rid]) for rid in has}
    often = {h: sum(h in hs for hs in has.values()) for h in range(6)}
    rows = [(h, rid, often[h], label[rid]) for rid, hs in has.items() for h in hs]
    found = audio.apart(spark.createDataFrame(rows, "hash bigint, rid bigint, n bigint, label bigint"), group=7).collect()
    assert sorted((x["rid"], x["other"]) for x in found) == sorted((a, b) for a in has for b in range(a) if label[a] != label[b] and len({*has[a]} & {*has[b]}) >= 2)


@given(st.integers(0, 1 << 30), st.integers(4, 30), st.integers(4, 30), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_every_offset_is_tried(seed, n, m, flips):
    r = np.random.default_rng(seed)
    some = r.integers(0, 1 << 32, 3, dtype=np.uint32)
    a, b = some[r.integers(0, 3, n)], some[r.integers(0, 3, m)]
    for x in r.integers(0, m, flips):
        b[x] ^= np.uint32(1 << int(r.integers(32)))
    best = aligned_by_hand(a.tolist(), b.tolist())
    with pytest.MonkeyPatch.context() as patched:
        for most in (64, 0):  # one by one, and by correlation
            patched.setattr(audio, "OFFSETS", most)
            assert audio.alignment(a, b) == (best and (-best[2], best[0], -best[1]))


def test_frequent_pairs_vote_by_correlation():
    silence = np.zeros(4000, np.uint32)
    tune = np.arange(1, 60, dtype=np.uint32) * np.uint32(0x9E3779B1)
    a, b = np.concatenate([silence, tune, silence]), np.concatenate([silence, silence, tune])
    assert audio.alignment(silence, silence[:100]) is None
    assert audio.alignment(a, b) == (4000, 4059, 0)


def test_every_two_that_share_hashes_meet_in_groups(spark):
    r = random.Random(2)
    has = {rid: r.sample(range(6), 3) for rid in range(40)}
    rows = [(h, rid) for rid, hs in has.items() for h in hs]
    found = audio.sharing(spark.createDataFrame(rows, "hash bigint, rid bigint"), group=7).collect()
    assert sorted((x["rid"], x["other"]) for x in found) == sorted((a, b) for a in has for b in range(a) if len({*has[a]} & {*has[b]}) >= 2)


def test_equal_texts_of_any_length_align(spark, sf):
    found = {r["doc_id"]: r for r in queries.op1_chroma_fingerprints(spark, sf).collect()}
    first = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        if r["text"]:
            assert found[r["doc_id"]]["class_id"] == found[first.setdefault(r["text"], r["doc_id"])]["class_id"]
    df = spark.createDataFrame([(1, b"ab"), (2, b"ab"), (3, b"abc"), (4, b""), (5, b""), (6, None)], "doc_id bigint, media binary").coalesce(1)
    short = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in audio.align_recordings(df, media_col="media").collect()}
    assert short == {1: (1, 0), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0)}


def test_long_frames_tell_low_semitones_apart():
    for note in range(12):
        tone = 110 * 2 ** (note / 12)
        samples = (128 + 100 * np.sin(2 * np.pi * tone * np.arange(16384) / audio.RATE)).astype(np.uint8)
        assert (audio.chroma(samples).argmax(axis=1) == note).all()


def test_integral_image_filters_equal_plain_sums():
    frames = np.random.default_rng(1).random((30, 12))
    found = audio.integers(frames)
    assert len(found) == 30 - audio.SPAN + 1
    kind, c, height, length = audio.filters()[2]
    assert kind == 2
    for t in range(len(found)):
        box = frames[t : t + length, c : c + height]
        a, b = box[length // 2 :].sum(), box[: length // 2].sum()
        value = np.log((1 + a) / (1 + b))
        level = int(value > -0.12) + int(value > 0) + int(value > 0.12)
        assert (int(found[t]) >> 2 * (15 - 2)) & 3 == level ^ (level >> 1)


def test_offsets_and_bit_errors():
    assert audio.best_offset(np.array([1, 2, 3, 9]), np.array([4, 5, 6, 9])) == (3, 3)
    a = np.arange(10, dtype=np.uint32)
    assert audio.bit_errors(a[3:], a, 3) == (7, 0)
    assert audio.bit_errors(a, a[3:], -3) == (7, 0)
    assert audio.bit_errors(a, a, 20) == (0, 0)
