import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from khatasort.llm import simhash


def slow_fingerprint(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    """component of each (doc_id, fp) by comparing all pairs."""
    best = list(range(len(rows)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                best[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", ["", " \n ", "One", "a B", "a b c", "A b\tc\nd e  f", "x " * 300, "ÄÖ é b A c d e"])
def test_fingerprint_equals_bitwise_count(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def reached(fps, u, v):
    """The smallest place that each fingerprint reaches by links (u, v)."""
    place = {int(f): i for i, f in enumerate(fps)}
    label = np.arange(len(fps))
    simhash._merge(label, np.array([place[int(x)] for x in u], dtype=int), np.array([place[int(x)] for x in v], dtype=int))
    return label


def every_slot(fps):
    every = sorted((s, (int(f) >> (48 - 16 * s)) & 0xFFFF, int(f)) for s in range(4) for f in fps)
    return np.array([e[0] for e in every]), np.array([e[2] for e in every], dtype=np.uint64)


def all_pairs(fps):
    """The same by comparing each fingerprint with all."""
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        simhash._merge(label, np.full(len(near), i), near)
    return label


def test_crowds_that_share_two_segments():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**32, 700, dtype=np.uint64)
    low = np.concatenate([centres ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 32, 700, dtype=np.uint64) for _ in range(k)], axis=0) for k in (1, 2, 3, 4)])
    upper = np.uint64(0xABCD1234) ^ np.where(rng.random(len(low)) < 0.3, np.uint64(1 << 3), np.uint64(0))  # two crowds, a bit apart
    fps = np.unique((upper << np.uint64(32)) | low)
    assert len(fps) > 2 * simhash.CROWD
    want = all_pairs(fps)
    assert 100 < len(set(want.tolist())) < len(fps)
    assert (reached(fps, *simhash.bucket_forest(*every_slot(fps))) == want).all()


def test_large_buckets_are_split(spark):
    rng = np.random.default_rng(6)
    upper = np.uint64(0x7777) << np.uint64(48)  # one segment shared by all
    centres = rng.integers(0, 2**48, 150, dtype=np.uint64)
    fps = np.unique(upper | np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 48, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 48, 150, dtype=np.uint64)) for _ in range(5)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for most in (20, 1 << 20):
        rows = simhash.links(frame, most).collect()
        u, v = (np.array([r[k] for r in rows], dtype=np.int64).view(np.uint64) for k in (0, 1))
        assert (reached(fps, u, v) == all_pairs(fps)).all()


def test_forest_equals_all_pairs():
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(8)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    every = [(s, (f >> (48 - 16 * s)) & 0xFFFF, f) for s in range(4) for f in fps]
    every.sort()
    u, v = simhash.bucket_forest(np.array([e[0] for e in every]), np.array([e[2] for e in every], dtype=np.uint64))
    place = {f: i for i, f in enumerate(fps)}
    label = np.arange(len(fps))
    simhash._merge(label, np.array([place[int(x)] for x in u]), np.array([place[int(x)] for x in v]))
    want = brute(list(enumerate(fps)))
    assert label.tolist() == want


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, slow_fingerprint(r.text or "")) for r in docs.orderBy("doc_id").collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(rows, brute(rows), strict=True)}
    assert got == want


def test_nulls_repeats_empty_and_extra_columns(spark):
    rows = [Row(doc_id=i, text=t, fp="x", label=1, node=2) for i, t in [(5, "a b c d"), (4, "A b c d"), (4, "A b c d"), (None, "a b c d"), (9, None), (8, ""), (None, " "), (7, "q r s t u v w")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, label int, node int")
    got = sorted(simhash.near_duplicates(docs).select("doc_id", "component_id").collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 4), (-1, 8), (4, 4), (4, 4), (5, 4), (7, 7), (8, 8), (9, 8)]
    kept = simhash.representatives(docs).collect()
    assert sorted(r.doc_id for r in kept) == [4, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}


def test_very_long_texts():
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
