"""Benchmark decontamination over a distributed positional inverted index.

The training documents are cut into shards of bounded size.  A shard is one row: its documents, their word counts, its
words, and for every word the sorted list of token positions, as zstd-compressed differences.  All tokens are in it, so the
index serves any benchmark.  The shards are written once (to the shared checkpoint folder) and hold every document; a shard needs no other, so building
and searching shuffle nothing.

A test phrase is looked up in a shard from its rarest term: that term's positions, less its offset in the phrase, are
the candidates, and the lists of the other terms, each less its own offset and from the rarest on, are intersected with
them until none is left or all terms agree.  Documents are laid out with a gap between them, so no phrase crosses from
one into another.  ``near`` finds the documents where all terms of a phrase stand within a span of words, in any order.

Test phrases are the 13-word windows of every benchmark item (an item of fewer words is one phrase).  The driver reads items
one after another and sends them to the shards in blocks of ``BLOCK_WORDS`` words, one block at a time; what a block finds is kept by
document (only documents with a match have a row after the first block) and joined at the end, so the benchmark may be of any size, while no task and no driver holds more
than a block (or one item, if that is longer).

Defined cases: null and empty texts have no words, no hits and aren't contaminated; items without words are in no
document; repeated items (same id) count once per id, and items without id count once per text but add no id to the
list; repeated documents are judged each; words are cut at any ASCII character but letters and digits, after A-Z are
lower-cased; other columns are ignored; an empty benchmark leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, digest_of, pinned, table

NAME = "op8_benchmark_decontamination"

WINDOW = 13
#: Words in which all terms of a phrase must stand for a proximity match.
SPAN = 20
#: Tokens in a shard before it is closed (a longer document is a shard of its own) and test words in a block.
SHARD_TOKENS, BLOCK_WORDS = 1_000_000, 500_000
GAP = 64
#: Digests of contaminated texts that are broadcast at most (32 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Bytes that end a word become spaces; A-Z become a-z; bytes of other letters (from 0x80) stay.
_FOLD = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))


def words_of(blob: bytes) -> list[bytes]:
    return blob.translate(_FOLD).split()


class Phrases:
    """A block of test phrases: its words, distinct phrases as numbers of them, and the items each occurs in.

    items: (id or None, words).  An item without id goes by a digest of its words.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        found: dict[tuple[int, ...], set[int]] = {}
        keys: dict[tuple, int] = {}
        for name, words in items:
            own = keys.setdefault((name, None) if name is not None else (None, hashlib.sha256(b" ".join(words)).digest()), len(keys))
            terms = [number[w] for w in words]
            for i in range(max(1, len(terms) - window + 1) if terms else 0):
                found.setdefault(tuple(terms[i : i + window]), set()).add(own)
        self.words = list(number)
        self.keys = list(keys)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for length in sorted({len(x) for x in found}):
            own = [x for x in found if len(x) == length]
            self.by_length[length] = (np.array(own, dtype=np.int32), [sorted(found[x]) for x in own])


class Shard:
    """Postings of some documents: each word's sorted token positions, one list after another in ``places``, from ``starts`` on."""

    def __init__(self, n_words: np.ndarray, words: list[bytes], starts: np.ndarray, places: np.ndarray):
        self.n_words, self.words, self.starts, self.places = n_words, words, starts, places
        self.bases = np.concatenate([[0], np.cumsum(n_words + GAP)[:-1]]).astype(np.int64) if len(n_words) else np.zeros(0, np.int64)
        self.size = int(self.bases[-1] + n_words[-1]) + 1 if len(n_words) else 1

    @classmethod
    def build(cls, documents: list[np.ndarray], words: list[bytes]) -> Shard:
        """documents: the number of each word in ``words``."""
        n_words = np.array([len(x) for x in documents], dtype=np.int64)
        every = np.concatenate([np.zeros(0, np.int32), *documents])
        order = np.argsort(every, kind="stable")
        place = np.arange(len(every)) + np.repeat(np.arange(len(n_words)) * GAP, n_words)
        counts = np.bincount(every, minlength=len(words))
        return cls(n_words, words, np.concatenate([[0], np.cumsum(counts)]), place[order])

    def pack(self) -> tuple[bytes, bytes, bytes]:
        head = zstandard.compress(np.concatenate([[len(self.n_words)], self.n_words, np.diff(self.starts)]).astype("<i8").tobytes(), 1)
        return head, zstandard.compress(b"\n".join(self.words), 1), zstandard.compress(np.diff(self.places, prepend=0).astype("<i4").tobytes(), 1)

    @classmethod
    def unpack(cls, head: bytes, words: bytes, body: bytes) -> Shard:
        numbers = np.frombuffer(zstandard.decompress(head), "<i8")
        n = int(numbers[0])
        listed = zstandard.decompress(words)
        places = np.cumsum(np.frombuffer(zstandard.decompress(body), "<i4").astype(np.int64))
        return cls(numbers[1 : 1 + n], listed.split(b"\n") if listed else [], np.concatenate([[0], np.cumsum(numbers[1 + n :])]), places)

    def slots(self, words: list[bytes]) -> np.ndarray:
        """The number of each word's list, -1 where the shard has none."""
        number = {w: i for i, w in enumerate(self.words)}.get
        return np.array([number(w, -1) for w in words], dtype=np.int64)

    def alive(self, slots: np.ndarray, phrases: np.ndarray):
        """Phrases whose terms all have a list: their places in ``phrases``, their terms' lists, and those lists' lengths."""
        at = slots[phrases]
        own = np.flatnonzero((at >= 0).all(axis=1)) if len(at) else np.zeros(0, np.int64)
        at = at[own]
        return own, at, self.starts[at + 1] - self.starts[at]

    def list_of(self, slot: int) -> np.ndarray:
        return self.places[self.starts[slot] : self.starts[slot + 1]]

    def exact(self, slots: np.ndarray, phrases: np.ndarray):
        """(phrase number, sorted start positions) of each phrase that occurs."""
        own, at, lengths = self.alive(slots, phrases)
        for i, lists, from_rarest in zip(own.tolist(), at.tolist(), np.argsort(lengths, axis=1, kind="stable").tolist(), strict=True):
            starts = None
            for offset in from_rarest:
                place = self.list_of(lists[offset])
                if starts is None:
                    starts = place - offset
                else:
                    where = np.searchsorted(place, starts + offset)
                    where[where == len(place)] = 0
                    starts = starts[place[where] == starts + offset]
                if not len(starts):
                    break
            if len(starts):
                yield i, starts

    def proximity(self, slots: np.ndarray, phrases: np.ndarray, span: int):
        """(phrase number, sorted start positions) where every distinct term of the phrase occurs within ``span`` words, in any order, from the start position on."""
        own, at, lengths = self.alive(slots, phrases)
        for i, own_lists, from_rarest in zip(own.tolist(), at.tolist(), np.argsort(lengths, axis=1, kind="stable").tolist(), strict=True):
            lists = [self.list_of(s) for s in dict.fromkeys(own_lists[k] for k in from_rarest)]
            around = lists[0]  # places of the rarest term that have each other one in reach
            for x in lists[1:]:
                first = np.searchsorted(x, around - span + 1)
                around = around[(first < len(x)) & (x[np.minimum(first, len(x) - 1)] < around + span)]
                if not len(around):
                    break
            found = set()
            for place in around.tolist():
                near = [x[np.searchsorted(x, place - span + 1) : np.searchsorted(x, place + span)] for x in lists]
                for start in np.unique(np.concatenate(near)).tolist():
                    if start <= place < start + span and all(np.searchsorted(x, start) < np.searchsorted(x, start + span) for x in near):
                        found.add(start)
            if found:
                yield i, np.array(sorted(found))

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, places, "right") - 1


def blocks_of(benchmark: DataFrame, block_words: int | None = None):
    """The benchmark's items with words, as lists of (id as text, words) of bounded size; the last list may be empty."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if words := words_of((r.text or "").encode()):
            if held and size + len(words) > (block_words or BLOCK_WORDS):
                yield held
                held, size = [], 0
            held.append((r.item_id, words))
            size += len(words)
    yield held


def build_index(docs: DataFrame, shard_tokens: int | None = None) -> DataFrame:
    """One row a shard: shard (a number), ids (the documents' ids in order), head, words and body (packed postings)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    most = shard_tokens or SHARD_TOKENS

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        ids: list = []
        documents: list[np.ndarray] = []
        tokens = 0
        id_type = None
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__

        def shard():
            nonlocal key
            packed = Shard.build(documents, list(number)).pack()
            key += 1
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids], pa.list_(id_type)), *(pa.array([x], pa.binary()) for x in packed)], ["shard", "ids", "head", "words", "body"])

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, blob in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                found = words_of(blob)
                if ids and tokens + len(found) > most:
                    yield shard()
                    ids, documents, tokens = [], [], 0
                    number.clear()
                ids.append(doc_id)
                documents.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
                tokens += len(found) + GAP
        if ids:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(run, f"shard long, ids array<{kind}>, head binary, words binary, body binary")


def search(index: DataFrame, block: list, window: int = WINDOW, span: int = SPAN, every: bool = True) -> DataFrame:
    """What one block of items finds: shard, place (in it), doc_id, n_words, spans (of hit words), names and nameless (items found), near (ids by proximity).

    A row for every document, or, with ``every`` false, for those with a match.
    """
    sent = index.sparkSession.sparkContext.broadcast(Phrases(block, window))
    id_kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        import pyarrow as pa

        phrases = sent.value
        kinds = [pa.int64(), pa.int64(), None, pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.string())]
        for batch in batches:
            kinds[2] = batch.column("ids").type.value_type
            for key, ids, *packed in zip(*(batch.column(x) for x in ("shard", "ids", "head", "words", "body")), strict=True):
                shard = Shard.unpack(*(x.as_py() for x in packed))
                slots = shard.slots(phrases.words)
                marks = np.zeros(shard.size + 1, dtype=np.int32)
                found: defaultdict[int, set] = defaultdict(set)
                near: defaultdict[int, set] = defaultdict(set)
                for length, (terms, owners) in phrases.by_length.items():
                    for i, starts in shard.exact(slots, terms):
                        np.add.at(marks, starts, 1)
                        np.add.at(marks, starts + length, -1)
                        for d in np.unique(shard.document(starts)).tolist():
                            found[d].update(owners[i])
                    for i, starts in shard.proximity(slots, terms, span):
                        for d in np.unique(shard.document(starts)).tolist():
                            near[d].update(owners[i])
                hit = np.cumsum(marks) > 0
                turns = np.flatnonzero(np.diff(hit, prepend=False, append=False))
                begins, ends = turns[::2], turns[1::2]
                of = shard.document(begins)
                spans: defaultdict[int, list] = defaultdict(list)
                for d, x, y in zip(of.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    spans[d].append((x - int(shard.bases[d]), y - int(shard.bases[d])))
                named = lambda x: sorted(phrases.keys[k][0] for k in x if phrases.keys[k][0] is not None)
                docs = range(len(shard.n_words)) if every else sorted(found.keys() | near.keys())
                own = ids.values
                rows = [(key.as_py(), d, own[d].as_py(), int(shard.n_words[d]), spans.get(d, []), named(found.get(d, ())), [phrases.keys[k][1] for k in found.get(d, ()) if phrases.keys[k][0] is None], named(near.get(d, ()))) for d in docs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "place", "doc_id", "n_words", "spans", "names", "nameless", "near"])

    schema = f"shard long, place long, doc_id {id_kind}, n_words long, spans array<struct<begin: long, end: long>>, names array<string>, nameless array<binary>, near array<string>"
    return index.mapInArrow(run, schema)


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a found phrase), items (ids with a found phrase, as sorted strings), n_items, and near_items (ids with all words of a phrase within ``span`` words)."""
    index = pinned(build_index(docs))
    found, later = None, []
    for block in blocks_of(benchmark):
        if found is None:
            found = search(index, block, window, span)
        else:
            later.append(pinned(search(index, block, window, span, every=False)))
    if later:
        more = later[0]
        for x in later[1:]:
            more = more.union(x)
        lists = ("spans", "names", "nameless", "near")
        more = more.groupBy(F.col("shard").alias("_shard"), F.col("place").alias("_place")).agg(*(F.flatten(F.collect_list(x)).alias(f"_{x}") for x in lists))
        found = found.join(more, (F.col("shard") == F.col("_shard")) & (F.col("place") == F.col("_place")), "left")
        found = found.select("doc_id", "n_words", *(F.when(F.col(f"_{x}").isNull(), F.col(x)).otherwise(F.concat(x, f"_{x}")).alias(x) for x in lists))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(zero.alias("n"), zero.alias("upto")),
        lambda held, x: F.struct((held["n"] + F.greatest(zero, x["end"] - F.greatest(x["begin"], held["upto"]))).alias("n"), F.greatest(held["upto"], x["end"]).alias("upto")),
        lambda held: held["n"],
    )
    items = F.array_sort(F.array_distinct("names"))
    n_items = (F.size(items) + F.size(F.array_distinct("nameless"))).cast("long")
    return found.select("doc_id", "n_words", covered.alias("n_hit"), items.alias("items"), n_items.alias("n_items"), F.array_sort(F.array_distinct("near")).alias("near_items"))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """match() with contaminated: words are hit, and they are a twentieth of the document's or more."""
    return match(docs, benchmark).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text isn't contaminated.  A verdict depends on the text alone and is applied by it, so null and repeated ids are judged like any other."""
    keyed = docs.select(digest_of(F.col("text")).alias("doc_id"), "text")
    bad = pinned(judged(keyed, benchmark).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct())
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, digest_of(docs["text"]) == bad["_bad"], "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.array_join("near_items", ",").alias("near_items"))


ORACLE_SQL = """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark),
p as (select distinct item_id, least(13, len(words)) as n, words[i : i + least(13, len(words)) - 1] as phrase
  from (select item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) as i from b where len(words) > 0)),
lengths as (select distinct n from p),
starts as (select doc_id, n, i, words[i : i + n - 1] as phrase
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from w, lengths where len(words) >= n)),
found as (select s.doc_id, s.i, s.n, p.item_id from starts s join p on s.n = p.n and s.phrase = p.phrase),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from (select distinct doc_id, i, n from found)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from found) group by doc_id),
frequency as (select word, count(*) as times from (select unnest(words) as word from w) group by word),
terms as (select item_id, phrase, unnest(list_distinct(phrase)) as word from p),
rarest as (select item_id, phrase, arg_min(word, coalesce(times, 0)) as word from terms left join frequency using (word) group by item_id, phrase),
tokens as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from w), kept as (select * from tokens where word in (select word from rarest)),
around as (select doc_id, item_id, phrase, place, words from rarest join kept using (word) join w using (doc_id) where list_has_all(words[greatest(1, place - 19) : place + 19], phrase)),
near as (select doc_id, string_agg(item_id, ',' order by item_id) as near_items from (select distinct doc_id, cast(item_id as varchar) as item_id from around
  where len(list_filter(range(greatest(1, place - 19), place + 1), lambda s: list_has_all(words[s : s + 19], phrase))) > 0) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated, coalesce(near_items, '') as near_items
from w left join hits using (doc_id) left join items using (doc_id) left join near using (doc_id)
"""
