"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits: a bit is set where it is set in over half of the XXH64 hashes of the text's word
shingles.  Two fingerprints link at ``most_bits`` = 3 or fewer differing bits, and documents that links reach from one
another form a component.

The ring.  A fingerprint is cut into four segments of 16 bits set in a ring.  If two fingerprints differ in at most 3
bits, there is a segment from which every chain of l consecutive segments differs in at most l * 3 / 4 bits: 0 bits in
the first segment, at most 1 over two, 2 over three, 3 over all four.  So each fingerprint is dealt out once per segment
by that segment's exact value; inside such a bucket the next segment is probed with its 17 values within one bit; the
third segment cuts again; and only what passes goes to the full Hamming check.

Where very many fingerprints share two segments, their other halves are searched by a second ring of 8-bit segments in place of pair by
pair; where more than ``BUCKET`` share one, the bucket is split over tasks by the next segment.

Exact copies share a fingerprint and are folded before anything is dealt out.  Buckets return a spanning forest, never
all pairs; components then come from alternating star contractions over the distinct fingerprints that have a link.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link like any other; fewer than
three words make one shingle; null doc_ids take part, but the component's id is its smallest doc_id that isn't null
(null if all are); repeated rows are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, digest_of, pinned, table

NAME = "op1_simhash_near_dedup"
ORACLE_SQL = None

SEGMENTS, WIDTH, MOST_BITS = 4, 16, 3
#: Candidate pairs that are looked at together, which bounds the memory of a bucket of any size.
BLOCK = 2_000_000
#: Pairs for each fingerprint by two segments, above which the other two are searched by a ring of their own; fingerprints that are looked through
#: together at least; fingerprints of a bucket before it is split.
CROWD, GATHERED, BUCKET = 1_000, 400_000, 1 << 20


def fingerprint(blob: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text."""
    words = blob.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * np.add.reduce(bits, axis=0, dtype=np.uint32) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(x, shingle, seed) for x in blobs(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] in a forest of smallest labels."""
    while True:
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        ra, rb = ra[apart], rb[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _probes(key: np.ndarray, width: int):
    """For sorted keys, whose lowest ``width`` bits are the next segment: for each way to be within one bit of it, the range of partners of each key."""
    yield np.arange(1, len(key) + 1), np.searchsorted(key, key, "right")  # equal: each with those after it
    for flip in range(width):
        bit = np.uint64(1 << flip)
        ask = key | bit  # the bit set in the partner only
        first, last = np.searchsorted(key, ask, "left"), np.searchsorted(key, ask, "right")
        yield first, np.where(key & bit == 0, last, first)


def _join(label: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
    """Merge the pairs that aren't joined yet, whose first three segments differ in 2 bits at most, and all four in MOST_BITS."""
    apart = label[left] != label[right]
    left, right = left[apart], right[apart]
    differ = value[left] ^ value[right]
    chain = np.bitwise_count(differ >> np.uint64(WIDTH)) <= 2
    left, right, differ = left[chain], right[chain], differ[chain]
    near = np.bitwise_count(differ) <= MOST_BITS
    _merge(label, left[near], right[near])


def _pairs(first: np.ndarray, count: np.ndarray):
    """(left, right) of all pairs of element i with the ``count[i]`` elements from ``first[i]`` on, in blocks of BLOCK pairs or one element's."""
    upto = np.cumsum(count)
    at = 0
    while at < len(count) and upto[-1]:
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + BLOCK, "right")))
        here = count[at:end]
        if total := int(here.sum()):
            yield np.repeat(np.arange(at, end), here), np.arange(total) - np.repeat(np.cumsum(here) - here, here) + np.repeat(first[at:end], here)
        at = end


def _crowd(label: np.ndarray, ring: np.ndarray, members: np.ndarray) -> None:
    """Links among many fingerprints whose upper halves are within one bit: the ring once more, on four segments of 8 bits of their lower halves."""
    low = ring[members] & np.uint64(0xFFFFFFFF)
    for slot in range(SEGMENTS):
        turn = np.uint64(8 * slot)
        turned = ((low << turn) | (low >> (np.uint64(32) - turn))) & np.uint64(0xFFFFFFFF)
        order = np.argsort(turned, kind="stable")
        key, own = turned[order] >> np.uint64(16), members[order]  # own and next segment
        for first, last in _probes(key, 8):
            for left, right in _pairs(first, np.maximum(last - first, 0)):
                a, b = own[left], own[right]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                near = np.bitwise_count(ring[a] ^ ring[b]) <= MOST_BITS
                _merge(label, a[near], b[near])


def bucket_forest(slot: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the fingerprints of whole buckets; a bucket is a slot and the value of that segment."""
    turn = (slot.astype(np.uint64) * np.uint64(WIDTH)) % np.uint64(64)
    back = (np.uint64(64) - turn) % np.uint64(64)
    ring = np.where(turn == 0, fp, (fp << turn) | (fp >> back))  # this slot's segment on top
    key = (slot.astype(np.uint64) << np.uint64(32)) | (ring >> np.uint64(32))  # slot, own segment, next segment
    order = np.argsort(key, kind="stable")
    key, ring, own = key[order], ring[order], fp[order]
    label = np.arange(len(own))
    begin, size = np.unique(key, return_index=True, return_counts=True)[1:]
    for first, last in _probes(key, WIDTH):
        count = np.maximum(last - first, 0)
        theirs = count[begin]
        for i in np.flatnonzero(size * theirs > CROWD * (size + theirs)).tolist():  # too many pairs of these with those
            mine = np.arange(begin[i], begin[i] + size[i])
            _crowd(label, ring, np.union1d(mine, np.arange(first[begin[i]], last[begin[i]])))
            count[mine] = 0
        for left, right in _pairs(first, count):
            _join(label, left, right, ring)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return own[moved], own[label[moved]]


def links(fps: DataFrame, most: int | None = None) -> DataFrame:
    """Spanning links (u > v) among the distinct fingerprints of ``fps``; no link between different ones is lost to reach.

    A bucket (slot and segment value) with more than ``most`` fingerprints is split by the upper half of its next segment: a fingerprint goes to the
    part of its own, and to those that differ from it in one bit which it has not set.  There are 4 * 2 ** 16 buckets at most, so the list of
    such buckets is bounded.
    """
    segment = lambda i: F.shiftrightunsigned("fp", (SEGMENTS - 1 - i % SEGMENTS) * WIDTH).bitwiseAND(0xFFFF).cast("int")
    slots = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), segment(i).alias("seg"), segment(i + 1).alias("next")) for i in range(SEGMENTS)))).alias("s")
    dealt = fps.select("fp", slots).select("s.slot", "s.seg", "s.next", "fp")
    full = dealt.groupBy("slot", "seg").agg(F.count("*").alias("n")).where(F.col("n") > F.lit(most or BUCKET)).select("slot", "seg", F.lit(True).alias("full"))
    upper = F.shiftright("next", 8)
    parts = F.concat(F.array(upper), F.filter(F.array(*(upper.bitwiseOR(1 << k) for k in range(8))), lambda x: x != upper))
    dealt = dealt.join(F.broadcast(full), ["slot", "seg"], "left")
    dealt = dealt.select("slot", "seg", F.explode(F.when(F.col("full"), parts).otherwise(F.array(F.lit(0)))).alias("part"), "fp")
    dealt = dealt.repartition("slot", "seg", "part").sortWithinPartitions("slot", "seg", "part")

    def run(batches):
        import pyarrow as pa

        def found(kept):
            slot, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
            u, v = bucket_forest(slot, fp.view(np.uint64))
            if len(u):
                u, v = u.view(np.int64), v.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        kept: list[tuple] = []
        rows, before = 0, None
        for batch in batches:
            slot, seg, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            bucket = (slot.astype(np.int64) << 32) | (seg.astype(np.int64) << 8) | part
            new = np.flatnonzero(np.diff(bucket, prepend=bucket[0] if before is None else before)) if len(bucket) else np.zeros(0, int)
            if len(new) and rows + new[-1] >= GATHERED:  # whole buckets are enough; the last one may go on
                cut = int(new[-1])
                yield from found([*kept, (slot[:cut], fp[:cut])])
                kept, rows, slot, fp = [], 0, slot[cut:], fp[cut:]
            if len(bucket):
                kept.append((slot, fp))
                rows, before = rows + len(slot), bucket[-1]
        if rows:
            yield from found(kept)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join on a long key that Spark can split where the left side is skewed.

    The right side comes from an aggregation by the key, whose partitioning would be taken over and bind the left side to
    it; joining on a reversible expression of the key gives both sides a shuffle of their own.
    """
    right = right.withColumnRenamed(key, "_right")
    return left.join(right, F.col(key).bitwiseXOR(F.lit(1)) == F.col("_right").bitwiseXOR(F.lit(1))).drop("_right")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and label (its component's smallest node) for every node with a link, by large and small star contractions.

    Each round is a few aggregations and equi joins; rounds end when the links are stars.  A hub's links are summed
    before they are shuffled, and its join can be split, so no task needs a whole component.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = pinned(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = split_join(both.where("v > u"), least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = pinned(small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    rows = pinned(fingerprints(docs, shingle, seed))
    distinct = pinned(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    label = components(links(distinct.select("fp")))
    named = distinct.join(label, distinct.fp == label.node, "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = split_join(named, ids, "label").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, or, where all are null, one of those (of repeated rows, one).

    Rows are told apart by id and text, so a text never answers for another one with its id.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest_of(F.col("text")).alias("digest"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text")).where("doc_id <=> component_id")
    found = found.select(F.col("doc_id.id").alias("_kept_id"), F.col("doc_id.digest").alias("_kept_digest")).distinct()
    rows = docs.withColumn("_digest", digest_of(F.col("text")))
    kept = rows.join(found, rows["doc_id"].eqNullSafe(found["_kept_id"]) & (rows["_digest"] == found["_kept_digest"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
