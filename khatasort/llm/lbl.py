"""Language-model scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are the words of the text with A-Z in lower case, then one end.  The model predicts a token's class from the two
tokens before it: every word with ``LEAST`` training tokens or more (as many as its two vectors have numbers) is a class of its
own, so classes grow with the corpus; the end is one, and all rarer words are one class together, inside which a word has
its smoothed share.  Classes are the leaves of a Huffman tree with ``BRANCH`` children a node.  With context vectors r,
position matrices M1 and M2, and target vectors q and biases b of the tree's edges, an edge's score is

    (M1 r[w1] + M2 r[w2]) . q[e] + b[e]

normalised by softmax over the edges of its node; a class has the product along its path.  So token probabilities sum to
one over all words and one unseen word, and a token's cost grows with the logarithm of the classes.

Training.  The counts of all training tokens are gathered by word.  Every training text then trains the model: each task
runs stochastic gradient steps over its own documents from a common start, with noise at each node of a target's path,
and each vector is averaged over the tasks that met it by how often they did.  No text leaves its task.  Noise is seeded by a task's
first text, not by its number; how the texts are dealt out to tasks (files, cores) still decides which are averaged, so
another layout of the same rows gives slightly other scores, and the same layout the same.

Scoring.  The trained words (and more, up to ``HEAD``, told by a histogram of counts) are sent to the tasks with their
counts; for the other words of a document, rows of document and word meet the counts in one join by word, and their
logarithms are summed by document.  Rows are keyed by a number of their own, so repeated and null ids stay apart.

Defined cases: null and empty texts are the end alone; without training texts N = V = 0, every token is unknown and
the model is the untrained one over its classes; repeated rows are texts each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, fold, pinned, table

NAME = "op7_log_bilinear_model"
ORACLE_SQL = None

FOLDS, HELD = 7, 2
#: Numbers in a word's vector.
WIDTH = 16
#: Training tokens of a word that is trained: as many as its two vectors have numbers; rarer ones share a class.
LEAST = 2 * WIDTH
#: Tokens that are scored together: many share a node of the tree.
TOGETHER = 500_000
#: Children of a node in the tree of words.
BRANCH = 64
#: Words that are sent to all tasks at most, unless more are trained; words that a task counts before it hands them on.
HEAD, COUNTED = 1 << 18, 300_000
STEP, NOISE, RATE = 8192, 24, 0.3
#: Below the root: noise words for a token.  Of the vectors: step size and where AdaGrad's sums of squares begin.
INNER_NOISE, ROW_RATE, ROW_PAST = 2, 0.1, 0.3
#: Vectors that a task returns in one row.
PART = 1 << 15
#: The end's key among words; no word has a line end.
END = "\n"
#: Class numbers of the end and of all other words.
END_CLASS, OTHER_CLASS = 0, 1


def words_of(blob: bytes) -> list[bytes]:
    return blob.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over the training tokens; the end is END."""

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        ends = 0

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for blob in blobs(batch.column(0)):
                counts.update(words_of(blob))
                ends += 1
                if len(counts) > COUNTED:
                    yield out()
        if ends:
            counts[END.encode()] += ends
            yield out()

    rows = docs.where(fold(F.col("doc_id"), FOLDS) != HELD).select("text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tree:
    """A Huffman tree of ``BRANCH`` children a node over items with given shares, for a softmax at every node of an item's path.

    Edges are numbered so that a node's children are adjacent and the root's come first.
    """

    def __init__(self, shares: np.ndarray):
        size = len(shares)
        order = np.argsort(shares, kind="stable")
        weight = shares[order].tolist()
        merged: list[float] = []
        parent = np.zeros(2 * size + 1, dtype=np.int64)
        leaf = node = 0
        take = min(size, (size - 2) % (BRANCH - 1) + 2)
        while size - leaf + len(merged) - node > 1 or not merged:
            total = 0.0
            for _ in range(take):
                if node == len(merged) or (leaf < size and weight[leaf] <= merged[node]):
                    total += weight[leaf]
                    parent[order[leaf]] = size + len(merged)
                    leaf += 1
                else:
                    total += merged[node]
                    parent[size + node] = size + len(merged)
                    node += 1
            merged.append(total)
            take = BRANCH
        elements = size + len(merged) - 1  # all but the root
        parent = parent[:elements]
        by_node = np.argsort(-parent, kind="stable")
        edge_of = np.empty(elements, dtype=np.intp)
        edge_of[by_node] = np.arange(elements)
        _, first, count = np.unique(-parent[by_node], return_index=True, return_counts=True)
        #: Of each edge: its node's first edge and number of children, and its share among them.
        self.start, self.size = np.repeat(first, count).astype(np.intp), np.repeat(count, count).astype(np.intp)
        mass = np.concatenate([shares, merged])[by_node]
        self.share = mass / np.repeat(np.add.reduceat(mass, first), count)
        #: Edges of every item: the root's, and those below it, padded with -1.
        at, columns = np.arange(size), []
        while True:
            up = parent[at]
            inner = up < elements
            columns.append(edge_of[at])
            if not inner.any():
                break
            at = np.where(inner, up, at)
        self.top = columns[-1]
        below = np.stack(columns, axis=1)
        self.inner = np.where(self.start[below] > 0, below, -1)[:, :-1].copy()
        self.top_size = int(count[0])


def _aligned(size: int) -> np.ndarray:
    """Zeros for vectors that each lie in one line of the processor's cache."""
    raw = np.zeros(size * WIDTH * 4 + 64, dtype=np.uint8)
    skip = -raw.ctypes.data % 64
    return raw[skip : skip + size * WIDTH * 4].view(np.float32).reshape(size, WIDTH)


class Network:
    """The parameters of the log-bilinear model: a context vector for each item, and a target vector with a bias for each edge of the items' tree."""

    def __init__(self, shares: np.ndarray, seed: int = 7, tree: Tree | None = None):
        rng = np.random.default_rng(seed)
        self.tree = tree or Tree(shares)
        self.items = len(shares)
        #: Items' context vectors, then edges' target vectors; the biases of the same rows (items have none).
        self.rows = _aligned(self.items + len(self.tree.start))
        self.rows[:] = rng.normal(0, 0.1, self.rows.shape)
        self.bias = np.concatenate([np.zeros(self.items), np.log(self.tree.share)]).astype(np.float32)
        self.m = np.stack([np.eye(WIDTH, dtype=np.float32)] * 2)

    NAMES = ("rows", "bias", "m")

    def __getstate__(self):
        return self.tree, self.items, np.ascontiguousarray(self.rows), self.bias, self.m

    def __setstate__(self, state):
        self.tree, self.items, rows, self.bias, self.m = state
        self.rows = _aligned(len(rows))
        self.rows[:] = rows

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def fill(self, values: np.ndarray) -> Network:
        at = 0
        for k in self.NAMES:
            own = getattr(self, k)
            own[...] = values[at : at + own.size].reshape(own.shape)
            at += own.size
        return self

    def ahead(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The predicted vectors."""
        return self.rows.take(first, axis=0) @ self.m[0] + self.rows.take(second, axis=0) @ self.m[1]

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, target: np.ndarray, block: int = 1 << 12) -> np.ndarray:
        """Natural logarithms of P(target | first, second): first is the word before the target, second the one before that."""
        tree, edges, bias = self.tree, self.rows[self.items :], self.bias[self.items :]
        ahead = self.ahead(first, second)
        top = tree.top.take(target)
        out = np.einsum("ij,ij->i", ahead, edges.take(top, axis=0)) + bias.take(top)
        for i in range(0, len(out), block):
            out[i : i + block] -= _log_sum(ahead[i : i + block] @ edges[: tree.top_size].T + bias[: tree.top_size])
        for column in tree.inner.T:
            edge = column.take(target)
            held = np.flatnonzero(edge >= 0)
            held = held[np.argsort(tree.start.take(edge.take(held)), kind="stable")]
            edge, own = edge.take(held), ahead.take(held, axis=0)
            start, size = tree.start.take(edge), tree.size.take(edge)
            score = np.einsum("ij,ij->i", own, edges.take(edge, axis=0)) + bias.take(edge)
            cuts = np.flatnonzero(np.diff(start, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # one product for a node's tokens
                node = slice(start[i], start[i] + size[i])
                score[i:j] -= _log_sum(own[i:j] @ edges[node].T + bias[node])
            out[held] += score
        return out


def _log_sum(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=1)
    scores -= top[:, None]
    np.exp(scores, out=scores)
    return np.log(scores.sum(axis=1)) + top


class Trainer:
    """Noise-contrastive estimation by AdaGrad steps (a rate for each vector and one for its bias), at the root and at every node below it on a target's path.

    The root's noise is drawn from its children's shares and shared within a step; below, where shares differ little,
    each token has noise of its own, each child alike.
    """

    def __init__(self, start: np.ndarray, shares: np.ndarray, seed: int, tree: Tree | None = None):
        self.net = Network(shares, tree=tree).fill(start)
        tree = self.net.tree
        self.share = tree.share[: tree.top_size]
        self.log_noise = (np.log(self.share) + math.log(NOISE)).astype(np.float32)  # of k times the noise distribution
        self.log_inner = np.log(INNER_NOISE / tree.size).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.past = np.full(len(self.net.rows), ROW_PAST, dtype=np.float32)
        self.past_bias = np.full_like(self.past, ROW_PAST)
        self.past_m = np.full_like(self.net.m, 1e-2)
        self.touched = np.zeros(len(self.net.rows), dtype=np.float32)

    def step(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> None:
        net, tree, n = self.net, self.net.tree, len(target)
        rows, edges, bias = net.rows, net.rows[net.items :], net.bias[net.items :]
        noise = self.rng.choice(tree.top_size, NOISE, p=self.share)
        r1, r2 = rows.take(first, axis=0), rows.take(second, axis=0)
        ahead = r1 @ net.m[0] + r2 @ net.m[1]
        # the root: its children are few
        top = tree.top.take(target)
        q, q_noise = edges.take(top, axis=0), edges.take(noise, axis=0)
        g_true = _missing(np.einsum("ij,ij->i", ahead, q) + (bias.take(top) - self.log_noise.take(top)))
        g_false = _missing((self.log_noise - bias[: tree.top_size]).take(noise) - ahead @ q_noise.T)
        g_ahead = g_true[:, None] * q - g_false @ q_noise
        order = np.argsort(top.astype(np.uint8), kind="stable")
        kinds, begins = np.unique(top.take(order), return_index=True)
        g_top, g_bias, met = np.zeros((tree.top_size, WIDTH), dtype=np.float32), np.zeros(tree.top_size, dtype=np.float32), np.bincount(noise, minlength=tree.top_size)
        g_top[kinds] = np.add.reduceat((g_true[:, None] * ahead).take(order, axis=0), begins, axis=0)
        g_bias[kinds] = np.add.reduceat(g_true.take(order), begins)
        met[kinds] += np.diff(begins, append=n)
        np.subtract.at(g_top, noise, g_false.T @ ahead)
        np.subtract.at(g_bias, noise, g_false.sum(axis=0))
        own = np.flatnonzero(met)
        self._move(own + net.items, g_top[own], g_bias[own], met[own])
        ids, grads, pulls = [], [], []
        for column in tree.inner.T:
            edge = column.take(target)
            held = np.flatnonzero(edge >= 0)
            if not len(held):
                continue
            edge, own = edge.take(held), ahead.take(held, axis=0)
            start, size = tree.start.take(edge), tree.size.take(edge)
            log_noise = self.log_inner.take(edge)
            q = edges.take(edge, axis=0)
            g_true = _missing(np.einsum("ij,ij->i", own, q) + (bias.take(edge) - log_noise))
            back = g_true[:, None] * q
            ids.append(edge)
            pulls.append(g_true)
            grads.append(g_true[:, None] * own)
            for chance in self.rng.random((INNER_NOISE, len(held)), dtype=np.float32):
                wrong = start + np.minimum((chance * size).astype(np.intp), size - 1)
                q = edges.take(wrong, axis=0)
                g_false = -_missing(log_noise - bias.take(wrong) - np.einsum("ij,ij->i", own, q))
                back += g_false[:, None] * q
                ids.append(wrong)
                pulls.append(g_false)
                grads.append(g_false[:, None] * own)
            g_ahead[held] += back
        where = np.concatenate([*(x + net.items for x in ids), first, second])
        order = np.argsort(where)
        where = where.take(order)
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        g = np.add.reduceat(np.concatenate([*grads, g_ahead @ net.m[0].T, g_ahead @ net.m[1].T]).take(order, axis=0), starts, axis=0)
        g_bias = np.add.reduceat(np.concatenate([*pulls, np.zeros(2 * n, dtype=np.float32)]).take(order), starts)
        self._move(where.take(starts), g, g_bias, np.diff(starts, append=len(where)))
        g = np.stack([r1.T @ g_ahead, r2.T @ g_ahead]) / n
        self.past_m += g * g
        net.m += RATE * g / np.sqrt(self.past_m)

    def _move(self, own: np.ndarray, g: np.ndarray, g_bias: np.ndarray, times: np.ndarray) -> None:
        """An AdaGrad step of some vectors and their biases."""
        past = self.past.take(own) + np.einsum("ij,ij->i", g, g) / WIDTH
        self.past[own] = past
        rate = ROW_RATE / np.sqrt(past)
        g *= rate[:, None]
        self.net.rows[own] += g
        past = self.past_bias.take(own) + g_bias * g_bias
        self.past_bias[own] = past
        self.net.bias[own] += ROW_RATE * g_bias / np.sqrt(past)
        self.touched[own] += times


def _missing(x: np.ndarray) -> np.ndarray:
    """1 less the logistic function."""
    return 1 / (1 + np.exp(np.clip(x, -30, 30)))


def contexts(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word before, word before that, and target for every token of documents given as classes with their end; before the first word stands the end."""
    start = np.full(2, END_CLASS, dtype=np.int32)
    every = np.concatenate([x for d in documents for x in (start, d)]) if documents else start
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    target = np.ones(len(every), dtype=bool)
    at = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]) if len(sizes) else np.zeros(1, np.int64)
    target[at], target[at + 1] = False, False
    where = np.flatnonzero(target)
    return every[where - 1], every[where - 2], every[where]


class Vocabulary:
    """The head words with counts, their classes, and the figures of all training tokens."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int, classes: int | None = None):
        self.end_count = next((n for w, n in head if w == END), 0)
        ranked = sorted(((w, n) for w, n in head if w != END), key=lambda x: (-x[1], x[0]))
        self.words = [w.encode() for w, _ in ranked]
        self.total, self.distinct = total, distinct
        self.counts = np.array([n for _, n in ranked], dtype=np.int64)
        own = int((self.counts >= LEAST).sum()) if classes is None else min(len(ranked), classes - 2)
        self.own = own
        self.classes = np.full(len(ranked) + 1, OTHER_CLASS, dtype=np.int32)  # one more for words outside the head
        self.classes[:own] = np.arange(2, own + 2)
        self.other_total = max(0, total - self.end_count - int(self.counts[:own].sum()))
        self.other_distinct = max(0, distinct - own - (self.end_count > 0))
        smooth = np.array([self.end_count + 1, self.other_total + self.other_distinct + 1, *(self.counts[:own] + 1)], dtype=float)
        self.shares = smooth / smooth.sum()

    def lookup(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def head_of(counts: DataFrame, most: int | None = None) -> list[tuple[str, int]]:
    """The end, all words with ``LEAST`` tokens or more, and as many more of the most frequent as a histogram of 16 bins a doubling shows to fit into ``most``."""
    bin_of = F.floor(F.log2("n") * 16)
    bins = sorted(((r["bin"], r["k"]) for r in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, None
    for b, k in bins:
        if held + k > (most or HEAD) - 1:
            break
        held, least = held + k, b
    wanted = (F.col("word") == END) | (F.col("n") >= LEAST)
    if least is not None:
        wanted = wanted | (bin_of >= least)
    return [(r.word, r["n"]) for r in counts.where(wanted).collect()]


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 1) -> Network:
    """A pass of every training text over the tasks, averaged, ``rounds`` times."""
    tree = Tree(vocabulary.shares)
    net = Network(vocabulary.shares, tree=tree)
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((vocabulary.words[: vocabulary.own], vocabulary.shares, tree))
    # A task for each core: every task returns vectors for the words it met, so more tasks would only add copies.
    rows = docs.where(fold(F.col("doc_id"), FOLDS) != HELD).select("text").coalesce(max(1, sc.defaultParallelism))
    schema = "part int, ids binary, weights binary, vectors binary"
    names = ["part", "ids", "weights", "vectors"]
    for number in range(rounds):
        start = sc.broadcast(net.flat())

        def run(batches, start=start, number=number):
            import pyarrow as pa

            trained, shares, tree = sent.value
            class_of = {w: i + 2 for i, w in enumerate(trained)}.get
            trainer = None
            waiting: list[np.ndarray] = []
            held = seen = 0

            def learn() -> int:
                first, second, target = (x.astype(np.intp) for x in contexts(waiting))
                waiting.clear()
                for i in range(0, len(target), STEP):
                    trainer.step(first[i : i + STEP], second[i : i + STEP], target[i : i + STEP])
                return len(target)

            for batch in batches:
                for blob in blobs(batch.column(0)):
                    if trainer is None:
                        trainer = Trainer(start.value, shares, zlib.crc32(blob, number), tree)
                    words = words_of(blob)
                    classes = np.empty(len(words) + 1, dtype=np.int32)
                    classes[:-1] = np.fromiter(map(class_of, words, repeat(OTHER_CLASS)), np.int32, len(words))
                    classes[-1] = END_CLASS
                    waiting.append(classes)
                    held += len(classes)
                    if held >= 32 * STEP:
                        seen += learn()
                        held = 0
            if held:
                seen += learn()
            if seen:
                parts = [(-1, np.arange(1), np.array([seen]), trainer.net.m)]
                for part in range(0, len(trainer.touched), PART):
                    ids = np.flatnonzero(trainer.touched[part : part + PART]) + part
                    parts.append((part // PART, ids, trainer.touched[ids], np.column_stack([trainer.net.rows[ids], trainer.net.bias[ids]])))
                for part, ids, weights, vectors in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int32), weights.astype(np.float32), vectors))], names
                    )

        def add(batches):
            import pyarrow as pa

            sums: dict = {}
            for batch in batches:
                for part, *found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    ids, weights, vectors = np.frombuffer(found[0], np.int32), np.frombuffer(found[1], np.float32), np.frombuffer(found[2], np.float32)
                    vectors, own = vectors.reshape(len(ids), -1), ids - max(part, 0) * PART
                    if part not in sums:
                        size = 1 if part < 0 else PART
                        sums[part] = np.zeros(size), np.zeros((size, vectors.shape[1] if len(ids) else WIDTH + 1))
                    total, summed = sums[part]
                    total[own] += weights
                    summed[own] += weights[:, None] * vectors
            for part, (total, summed) in sums.items():
                own = np.flatnonzero(total)
                out = (own + max(part, 0) * PART).astype(np.int32), total[own].astype(np.float32), (summed[own] / total[own, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in out)], names)

        for r in rows.mapInArrow(run, schema).repartition(8, "part").mapInArrow(add, schema).toLocalIterator():
            vectors = np.frombuffer(r.vectors, np.float32)
            if r.part < 0:
                net.m = vectors.reshape(net.m.shape).copy()
            else:
                ids, vectors = np.frombuffer(r.ids, np.int32), vectors.reshape(-1, WIDTH + 1)
                net.rows[ids], net.bias[ids] = vectors[:, :WIDTH], vectors[:, WIDTH]
        start.unpersist()
    return net


def fitted(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Network]:
    """The counts of all training tokens by word, the vocabulary, and the trained network."""
    counts = pinned(word_counts(docs))
    figures = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    vocabulary = Vocabulary(head_of(counts), figures["n"], figures["v"])
    return counts, vocabulary, train(docs, vocabulary)


def scored(docs: DataFrame, model: tuple[DataFrame, Vocabulary, Network] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    counts, vocabulary, net = model or fitted(docs)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        v, model = sent.value
        number = v.lookup().get
        none = len(v.words)
        logs = np.append(np.log10(v.counts + 1.0), 0.0)
        key = TaskContext.get().partitionId() << 33

        def out(waiting, key):
            ids, tokens, numbers = zip(*waiting, strict=True)
            classes = [np.append(v.classes[x], np.int32(END_CLASS)) for x in numbers]
            sizes = np.array([len(x) for x in classes])
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            model_log = np.add.reduceat(model.log_probabilities(*contexts(classes)).astype(np.float64), cuts) / math.log(10)
            base, other, n_other, tails, known = [], [], [], [], []
            for words, x in zip(tokens, numbers, strict=True):
                own = logs[x]
                rare = v.classes[x] == OTHER_CLASS
                base.append(float(own.sum()))
                other.append(float(own[rare].sum()))
                n_other.append(int(rare.sum()))
                missing = np.flatnonzero(x == none)
                known.append(len(x) - len(missing))
                tails.append([(w, k) for w, k in Counter(words[i] for i in missing).items()])
            tail_words = pa.array([w for t in tails for w, _ in t], pa.binary()).cast(pa.string())
            tail_times = pa.array([k for t in tails for _, k in t], pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tails])]), pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array(np.arange(key, key + len(ids))),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(other, pa.float64()),
                    pa.array(n_other, pa.int64()),
                    pa.array(model_log, pa.float64()),
                    pa.ListArray.from_arrays(offsets, tail_words),
                    pa.ListArray.from_arrays(offsets, tail_times),
                ],
                ["doc_id", "key", "n_tokens", "known", "base", "other", "n_other", "model_log", "tail", "times"],
            )

        waiting, held = [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, blob in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                words = words_of(blob)
                waiting.append((doc_id, words, np.fromiter(map(number, words, repeat(none)), np.int64, len(words))))
                held += len(words) + 1
                if held > TOGETHER:
                    yield out(waiting, key)
                    key += len(waiting)
                    waiting, held = [], 0
        if waiting:
            yield out(waiting, key)

    schema = f"doc_id {kind}, key long, n_tokens long, known long, base double, other double, n_other long, model_log double, tail array<string>, times array<int>"
    rows = pinned(docs.select("doc_id", "text").mapInArrow(run, schema))
    words = rows.select("key", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("key", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    tails = words.join(counts, "word").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_log"), F.sum(F.col("times").cast("long")).alias("tail_known"))
    total, distinct, ends = vocabulary.total, vocabulary.distinct, vocabulary.end_count
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    unit, other_unit = math.log10(total + distinct + 1), math.log10(vocabulary.other_total + vocabulary.other_distinct + 1)
    return rows.drop("tail", "times").join(tails, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_log + math.log10(ends + 1) - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("model_log") + F.col("other") + tail_log - F.col("n_other") * other_unit).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
