import math
from collections import Counter

import numpy as np

from khatasort.llm import lbl
from khatasort.llm.common import fold_of

DOCS = "doc_id long, text string, word string, n int, key string"


def brute(rows):
    tokens = lambda t: [*(w for w in (t or "").encode().lower().split()), b"\n"]
    counts = Counter(w for i, t in rows if fold_of(i, 7) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def test_table_equals_brute_force_and_beats_it(spark, monkeypatch):
    monkeypatch.setattr(lbl, "HEAD", 3000)  # so that both ways, sent words and joined words, are taken
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    n, want = brute(docs)
    rows = {r.doc_id: r for r in lbl.query(spark, folder).collect()}
    assert len(rows) == len(docs)
    for doc_id, n_tokens, n_known, base in want:
        r = rows[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, n, fold_of(doc_id, 7) == 2)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    held = [r for r in rows.values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.02


def test_probabilities_sum_to_one():
    shares = np.array([0.2, 0.5, 0.1, 0.1, 0.1])
    net = lbl.Network(shares)
    target = np.arange(5)
    for a in range(5):
        p = np.exp(net.log_probabilities(np.full(5, a), np.full(5, 3), target))
        assert abs(p.sum() - 1) < 1e-5
    v = lbl.Vocabulary([("a", 5), ("b", 3), ("c", 1), (lbl.END, 4)], 20, 8, classes=4)
    inside = (v.other_total + v.other_distinct + 1) / (v.other_total + v.other_distinct + 1)
    assert inside == 1 and v.other_total == 20 - 4 - 5 - 3 and v.other_distinct == 8 - 3


def test_training_learns_a_pattern():
    rng = np.random.default_rng(0)
    shares = np.array([0.05, 0.05, *[0.9 / 6] * 6])
    follow = np.array([2, 2, 3, 4, 5, 6, 7, 2])
    trainer = lbl.Trainer(lbl.Network(shares).flat(), shares, 1)
    for _ in range(800):
        first, second = rng.integers(0, 8, 512), rng.integers(0, 8, 512)
        trainer.step(first, second, np.where(rng.random(512) < 0.8, follow[first], rng.integers(0, 8, 512)))
    first = np.arange(8)
    got = trainer.net.log_probabilities(first, first, follow)
    assert np.exp(got).min() > 0.5


def test_nulls_repeats_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "A b a", "x", 1, "k"), (1, "A b a", "x", 1, "k"), (None, None, None, None, None), (2, "", "", 0, ""), (3, "word " * 50000, "", 0, "")], DOCS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n, want = brute(rows)
    got = lbl.scored(docs).collect()
    key = lambda x: (x[0] or 0, *x[1:3])
    assert sorted(((r.doc_id or 0, r.n_tokens, r.n_known) for r in got)) == sorted(key(w) for w in want)
    assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) for r in got)
    assert lbl.scored(docs.limit(0)).collect() == []


def test_tree_probabilities_sum_to_one_over_many_words():
    shares = 1 / np.arange(1, 6001)
    net = lbl.Network(shares / shares.sum())
    assert net.tree.inner.shape[1] >= 1
    every = np.arange(6000)
    for a in (0, 1, 5999):
        p = np.exp(net.log_probabilities(np.full(6000, a), np.full(6000, 7), every).astype(float))
        assert abs(p.sum() - 1) < 1e-4
    one = [net.log_probabilities(np.array([3]), np.array([7]), np.array([t]))[0] for t in (0, 700, 5999)]
    assert np.allclose(one, net.log_probabilities(np.full(6000, 3), np.full(6000, 7), every)[[0, 700, 5999]], atol=1e-4)


def test_every_word_with_enough_tokens_is_learned(spark):
    # Each word has one follower, so the model has to know all of them; 510 classes and one for the rest can't.
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(3000):
        at = rng.integers(0, 1500)
        texts.append(" ".join(f"w{(at + i) % 1500}" for i in range(60)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    counts = Counter(w for t in texts for w in t.split())
    vocabulary = lbl.Vocabulary([*counts.items(), (lbl.END, 3000)], 183_000, 1501)
    assert set(vocabulary.classes[:1500].tolist()) == set(range(2, 1502))
    rows = lbl.scored(docs).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens for r in rows)


def slow_path(tree, item):
    """The edges from the root to an item."""
    return [int(tree.top[item]), *(int(c) for c in tree.inner[item][::-1] if c >= 0)]


def test_scores_equal_a_slow_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "The of xyzzyx")], "doc_id long, text string"))
    counts, vocabulary, net = model = lbl.fitted(docs)
    table = {r.word: r["n"] for r in counts.collect()}
    total, distinct = sum(table.values()), len(table)
    ranked = sorted((w for w in table if w != lbl.END), key=lambda w: (-table[w], w))
    own = {w: i + 2 for i, w in enumerate(x for x in ranked if table[x] >= lbl.LEAST)}
    assert len(own) > 100 and len(net.tree.start) > net.tree.top_size
    rest = sum(n for w, n in table.items() if w not in own and w != lbl.END)
    kinds = sum(w not in own and w != lbl.END for w in table)
    edges, bias, m = net.rows[net.items :].astype(float), net.bias[net.items :].astype(float), net.m.astype(float)

    def chance(first, second, target):
        ahead = net.rows[first] @ m[0] + net.rows[second] @ m[1]
        found = 0.0
        for edge in slow_path(net.tree, target):
            begin, size = int(net.tree.start[edge]), int(net.tree.size[edge])
            scores = edges[begin : begin + size] @ ahead + bias[begin : begin + size]
            found += scores[edge - begin] - math.log(np.exp(scores).sum())
        return found / math.log(10)

    got = {r.doc_id: r for r in lbl.scored(docs, model).collect()}
    few = [r for r in docs.collect() if len((r.text or "").split()) < 120][:25]
    assert len(few) > 10
    for r in few:
        words = (r.text or "").encode().lower().decode().split()
        before, want = [0, 0], 0.0
        for w in [*words, None]:
            item = 0 if w is None else own.get(w, 1)
            want += chance(before[-1], before[-2], item)
            if item == 1:
                want += math.log10((table.get(w, 0) + 1) / (rest + kinds + 1))
            before.append(item)
        assert abs(got[r.doc_id].score - want) < 1e-3 * max(1, abs(want)), r.doc_id
    # normalised: the classes' probabilities, and those of the words that share one with an unseen word, sum to one
    assert abs(sum(10 ** chance(5, 9, i) for i in range(net.items)) - 1) < 1e-6
    assert abs(sum((n + 1) / (rest + kinds + 1) for w, n in table.items() if w not in own and w != lbl.END) + 1 / (rest + kinds + 1) - 1) < 1e-9
    assert total == vocabulary.total and distinct == vocabulary.distinct
