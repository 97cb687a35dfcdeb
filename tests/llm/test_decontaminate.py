import random

import duckdb
import numpy as np
from pyspark.sql import Row

from khatasort.llm import decontaminate as d

DOCS = "doc_id long, text string, items string, n_words int"


def views(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = d.query(spark, folder)
    want = views(folder).sql(d.ORACLE_SQL)
    order = want.columns
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.fetchall())
    assert got.where("contaminated").count() > 0


def slow(words, items, window=13):
    hit, names = set(), set()
    for name, own in items:
        for i in range(max(1, len(own) - window + 1) if own else 0):
            phrase = own[i : i + window]
            for s in range(len(words) - len(phrase) + 1):
                if words[s : s + len(phrase)] == phrase:
                    hit |= set(range(s, s + len(phrase)))
                    names.add(name)
    return len(hit), names


def slow_near(words, items, window, span):
    phrases = {(name, frozenset(own[i : i + window])) for name, own in items for i in range(max(1, len(own) - window + 1) if own else 0)}
    return {name for name, phrase in phrases if any(phrase <= set(words[s : s + span]) for s in range(len(words)))}


def test_random_words_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_TOKENS", 50)
    rng = random.Random(3)
    text = lambda n, kinds: " ".join(rng.choice("abcdefgh"[:kinds]) for _ in range(n))
    docs = [Row(doc_id=i, text=text(rng.randint(0, 60), 3), items="x", n_words=1) for i in range(60)]
    items = [Row(item_id=i, text=text(rng.choice([0, 1, 2, 4, 6, 9]), 4)) for i in range(12)]
    lists = [(str(r.item_id), r.text.split()) for r in items]
    want = {r.doc_id: (*slow(r.text.split(), lists, 4), slow_near(r.text.split(), lists, 4, 6)) for r in docs}
    for words in (1000, 7):  # one block, and many
        monkeypatch.setattr(d, "BLOCK_WORDS", words)
        rows = d.match(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), window=4, span=6).collect()
        assert {r.doc_id: (r.n_hit, set(r["items"]), set(r.near_items)) for r in rows} == want


def test_proximity_equals_brute_force():
    rng = random.Random(4)
    docs = [np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 40))], dtype=np.int32) for _ in range(10)]
    words = [b"w%d" % i for i in range(6)]
    shard = d.Shard.unpack(*d.Shard.build(docs, words).pack())
    phrases = np.array([[0, 1, 2], [3, 3, 4], [5, 9, 1]], dtype=np.int32)
    slots = shard.slots([b"w%d" % i for i in range(10)])
    got = {i: starts.tolist() for i, starts in shard.proximity(slots, phrases, 4)}
    want = {}
    for i, phrase in enumerate(phrases.tolist()):
        found = [int(base) + s for base, doc in zip(shard.bases, docs, strict=True) for s in range(len(doc)) if doc[s] in phrase and set(phrase) <= set(doc[s : s + 4].tolist())]
        if found:
            want[i] = found
    assert got == want


def test_nulls_empty_tables_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "A b-c d", "x", 3), (1, "A b-c d", "x", 3), (2, None, None, None), (None, "b c", "", 1), (3, "", "", 0), (4, "é ü", "", 0)], DOCS)
    bench = spark.createDataFrame([(7, "B c"), (7, "b C"), (None, "É ü"), (9, None), (10, "..")], "item_id long, text string")
    got = sorted((tuple(r) for r in d.judged(docs, bench).collect()), key=str)
    want = [(1, 4, 2, ["7"], 1, ["7"], True), (1, 4, 2, ["7"], 1, ["7"], True), (2, 0, 0, [], 0, [], False), (3, 0, 0, [], 0, [], False), (4, 2, 0, [], 0, [], False), (None, 2, 2, ["7"], 1, ["7"], True)]
    assert got == sorted(want, key=str)
    assert d.judged(docs.limit(0), bench).collect() == []
    assert d.judged(docs, bench.limit(0)).where("contaminated").count() == 0
    assert sorted(r.doc_id for r in d.clean_rows(docs, bench).collect()) == [2, 3, 4]
    none = spark.createDataFrame([(None, "b c"), (None, "B C"), (None, "a b c"), (5, "c d")], "item_id long, text string")
    assert {(r.doc_id, r.n_items, tuple(r["items"])) for r in d.match(docs, none).collect()} >= {(1, 3, ("5",)), (None, 1, ())}


def test_many_blocks_equal_one(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    one = sorted(map(str, d.match(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_WORDS", 500)
    assert len(list(d.blocks_of(bench))) > 2
    assert sorted(map(str, d.match(docs, bench).collect())) == one
    monkeypatch.setattr(d, "BROADCAST_ROWS", 1)  # the other way round of the last join
    kept = d.clean_rows(docs, bench).count()
    monkeypatch.undo()
    assert kept == d.clean_rows(docs, bench).count() == sum("contaminated=False" in x for x in map(str, d.judged(docs, bench).collect()))


def test_very_long_texts_and_repeated_phrases(spark):
    phrase = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"{'filler ' * 400000}{phrase} {phrase}"), (2, phrase * 1)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", phrase)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in d.judged(docs, bench).collect()}
    assert got == {1: (400026, 26, False), 2: (13, 13, True)}
