"""Toxicity by a lexicon trie that is intersected with Levenshtein automata.

The lexicon is learned from labelled texts: whole words, and stems that stand for all words they begin, which occur in
toxic texts far more often than chance and hardly in clean ones; a stem may also occur in clean ones if toxic ones have it
many times as often.  Its trie is intersected with the automaton of all words
within a few edits of a term (insertions, deletions, replacements, neighbours swapped): the product is made
deterministic state by state as words ask for it, so a word costs one step a letter and most die after a few letters.
Short terms and stems match as they are, terms of 5 letters or more within 1 edit, of 9 or more within 2.

Each hit counts with its term's log-odds, a misspelled one with those of its edits in the labelled texts: edits that clean
texts have as often as toxic ones count nothing.  A window of words about the hit separates quotation from abuse:
between quotation marks or next to words of reporting it counts for less, next to an address for more.  The sum over
a text, in all and in a hundred words, is mapped to a score by a logistic curve fitted on the labelled texts.

The labelled sample for fitting is bounded by ``most`` rows (the ids with the smallest md5), near copies in it count once,
and every document is scored whole.  Terms, window and quotations have no other bounds.  Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have no hits; without labels of both kinds, or without a term that passes, the
lexicon is empty and all scores are the share of toxic labels, at most 0.25; repeated rows score alike; other columns
are ignored (``clean_rows`` passes all on); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, fold, labelled_sample, logistic, table

NAME = "op5_levenshtein_toxicity"
ORACLE_SQL = None

FOLDS, HELD = 5, 0
MOST = 6000
LEAST_PREFIX = 3
#: A term that clean texts have as well: how many times more often it must stand in toxic ones (as a logarithm), less so many standard errors.
LEAST_RATIO, ERRORS = 2.0, 5.0
WINDOW = 5
QUOTED, REPORTED, ADDRESSED = 0.25, 0.4, 1.25

# Fixed word lists of the context window.
REPORTING = frozenset("said says say wrote writes written quote quotes quoted quoting called calls word words term terms phrase slur insult definition means meaning dictionary translated mot terme signifie wort begriff bedeutet palabra significa".split())
ADDRESS = frozenset("you your youre you're yours u ur yourself du dich dein tu te toi vous eres tú".split())
#: Marks that open a quotation, and those that close it.
QUOTES = {'"': '"', "'": "'", "`": "`'", "«": "»", "„": "“”", "“": "”", "‘": "’", "‹": "›"}

_RUN = re.compile(r"(.)\1{2,}")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    """A word without marks at its ends, long runs of a letter cut to one."""
    return _RUN.sub(r"\1", _EDGE.sub("", word))


class Lexicon:
    """Terms with weights; a stem ends in '*'.  fuzzy: the weight of a match with edits, by term."""

    def __init__(self, terms: dict[str, float], fuzzy: dict[str, float] | None = None, curve: tuple[float, float, float] = (2.0, 0.0, -3.0)):
        self.terms, self.fuzzy, self.curve = terms, fuzzy or {}, curve
        self._prepare()

    def __getstate__(self):
        return self.terms, self.fuzzy, self.curve

    def __setstate__(self, state):
        self.terms, self.fuzzy, self.curve = state
        self._prepare()

    @staticmethod
    def edits_of(term: str) -> int:
        return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2

    def _prepare(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.room = [0]  # edits that a term at or below the node allows
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        for term in sorted(self.terms):
            k, node = self.edits_of(term), 0
            self.room[0] = max(self.room[0], k)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], k)
            (self.stem_at if term.endswith("*") else self.word_at)[node] = term
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.begin = self._state({(0, 0, "")})
        self.known: dict[str, tuple[str, int] | None] = {}

    def _state(self, positions) -> int:
        """The number of a set of positions (trie node, edits, letter still due after a swap), closed under skipped letters; -1 if empty."""
        every, todo = set(), list(positions)
        while todo:
            node, e, due = p = todo.pop()
            if p in every or e > self.room[node]:
                continue
            every.add(p)
            if not due and e < self.room[node]:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        if not every:
            return -1
        key = frozenset(every)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.word_at[n]) for n, e, due in key if not due and n in self.word_at and e <= self.edits_of(self.word_at[n])]
            self.accepts.append(min(((t, e) for e, t in ends), key=lambda x: (x[1], x[0]), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out = []
        for node, e, due in self.sets[state]:
            if due:
                if c == due:
                    out.append((node, e, ""))
                continue
            below = self.children[node]
            if c in below:
                out.append((below[c], e, ""))
            if e < self.room[node]:
                out.append((node, e + 1, ""))
                for letter, child in below.items():
                    out.append((child, e + 1, ""))
                    if c in self.children[child]:
                        out.append((self.children[child][c], e + 1, letter))
        to = self._state(out)
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and the edits to it."""
        node = 0
        for c in word:  # stems: the trie alone
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            if node in self.stem_at:
                return self.stem_at[node], 0
        state = self.begin
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]

    def look(self, raw: str) -> tuple[str, int] | None:
        """match() of a word as it stands in a text, remembered."""
        if raw in self.known:
            return self.known[raw]
        if len(self.known) > 200_000:
            self.known.clear()
        if len(self.sets) > 100_000:
            self._prepare()
        word = normal(raw)
        found = self.match(word) if word else None
        self.known[raw] = found
        return found

    def evidence(self, text: str) -> float:
        """The weighted hits of a whole text."""
        return self.figures(text)[0]

    def figures(self, text: str) -> tuple[float, int]:
        """The weighted hits of a whole text, and its words."""
        words = text.lower().split()
        look, known = self.look, self.known
        hits = {w for w in set(words) if (known[w] if w in known else look(w)) is not None}
        if not hits:
            return 0.0, len(words)
        total = 0.0
        inside = quoted(words)
        for i, w in enumerate(words):
            if w in hits:
                term, edits = self.look(w)
                weight = self.terms[term] if not edits else self.fuzzy.get(term, 0.0)
                total += weight * context(words, i, inside[i])
        return total, len(words)

    def score(self, text: str) -> float:
        a, b, c = self.curve
        sum_of, rate = inputs(*self.figures(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * sum_of + b * rate + c))))


def inputs(evidence: float, n_words: int) -> tuple[float, float]:
    """What the curve sees: a text's weighted hits in all, and in a hundred words."""
    return math.log1p(evidence), math.log1p(100 * evidence / max(1, n_words))


def quoted(words: list[str]) -> list[bool]:
    """For each word whether it stands in a quotation: from a word that begins with an opening mark to the next that ends with its closing mark."""
    out = [False] * len(words)
    opened, closing = -1, ""
    for i, w in enumerate(words):
        if opened < 0 and w[0] in QUOTES:
            opened, closing = i, QUOTES[w[0]]
        if opened >= 0 and len(w) > 1 and w.rstrip(".,;:!?")[-1:] in closing and w.rstrip(".,;:!?"):
            out[opened : i + 1] = [True] * (i + 1 - opened)
            opened = -1
    return out


def context(words: list[str], i: int, inside: bool) -> float:
    """The factor for a hit at word i."""
    if inside:
        return QUOTED
    near = {normal(w) for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]}
    if near & ADDRESS:
        return ADDRESSED
    return REPORTED if near & REPORTING else 1.0


def _unlike(sample: list[tuple[bytes, int]], keys: int = 16) -> list[tuple[str, int]]:
    """The sample's texts in lower case, of near copies the first: those that share one of 16 least hashes of their 3-word shingles."""
    seen: list[set[int]] = [set() for _ in range(keys)]
    factor = np.arange(1, 2 * keys, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for blob, y in sample:
        words = blob.lower().split()
        own = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], dtype=np.uint64)
        mixed = own * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
        least = (mixed[:, None] * factor).min(axis=0).tolist()
        if not any(x in s for x, s in zip(least, seen, strict=True)):
            out.append((blob.decode(errors="replace").lower(), y))
        for x, s in zip(least, seen, strict=True):
            s.add(x)
    return out


def learn(sample: list[tuple[bytes, int]]) -> Lexicon:
    """A lexicon from (text, toxic) pairs."""
    texts = _unlike(sample)
    spelled: dict[str, str] = {}
    bags = []
    for t, y in texts:
        bag: Counter = Counter()
        for w, n in Counter(t.split()).items():
            bag[spelled.setdefault(w, normal(w))] += n
        del bag[""]
        bags.append((bag, y))
    n_bad, n_good = sum(y for _, y in bags), sum(1 - y for _, y in bags)
    base = sum(y for _, y in sample) / max(1, len(sample))
    flat = (0.0, 0.0, math.log(max(0.001, min(0.25, base)) / (1 - max(0.001, min(0.25, base)))))
    if not n_bad or not n_good:
        return Lexicon({}, curve=flat)
    bad_docs: dict[str, set[int]] = defaultdict(set)
    for i, (words, y) in enumerate(bags):
        if y:
            for w in words:
                bad_docs[w].add(i)
    below: dict[str, set[str]] = defaultdict(set)  # node (stem with '*', or word) -> words
    for w in bad_docs:
        below[w].add(w)
        for k in range(LEAST_PREFIX, len(w) + 1):
            below[w[:k] + "*"].add(w)
    docs_of = lambda node: set().union(*(bad_docs[w] for w in below[node] if w in bad_docs))
    m = len(below)
    sure = lambda hits, of: hits * math.log(of / (of + n_good)) + math.log(m) < math.log(0.01) if of else False
    least = next((k for k in range(2, 200) if sure(k, 1)), 2)
    nodes = {x for x in below if len(docs_of(x)) >= least}
    met_in, said = (Counter(), Counter()), (Counter(), Counter())  # of clean and of toxic texts: texts with the node, and words at or below it
    ways: dict[str, tuple] = {}
    for words, y in bags:
        met: set[str] = set()
        for w, n in words.items():
            if w not in ways:
                ways[w] = tuple(x for x in (w, *(w[:k] + "*" for k in range(LEAST_PREFIX, len(w) + 1))) if x in nodes)
            met.update(ways[w])
            for x in ways[w]:
                said[y][x] += n
        met_in[y].update(met)
    good = met_in[0]
    size = [sum(sum(words.values()) for words, y in bags if y == k) for k in (0, 1)]
    odds = lambda node: math.log((said[1][node] + 0.5) / (size[1] + 1)) - math.log((said[0][node] + 0.5) / (size[0] + 1))

    def often(node: str) -> bool:
        """Clean texts have it too, but toxic ones far more often than chance."""
        ratio = math.log((said[1][node] + 0.5) / (size[1] + 1)) - math.log((said[0][node] + 1) / (size[0] + 1))
        return ratio - ERRORS * math.sqrt(1 / max(1, met_in[1][node]) + 1 / (good[node] + 1)) >= LEAST_RATIO

    pure = lambda node, hits: good[node] <= 0.02 * hits
    heap = [(x.endswith("*"), -len(docs_of(x)), -len(x), x) for x in nodes]  # words first, stems for what they leave
    heapq.heapify(heap)
    open_docs = {i for i, (_, y) in enumerate(bags) if y}
    chosen: list[str] = []
    while heap:
        star, hits, length, node = heapq.heappop(heap)
        docs = docs_of(node)
        if len(docs) < least:
            continue
        if -hits != len(docs):  # words were taken out since
            heapq.heappush(heap, (star, -len(docs), length, node))
            continue
        certain = pure(node, len(docs)) and (sure(len(docs), n_bad) or sure(len(docs & open_docs), len(open_docs)))
        if not certain and not (star and often(node)):
            continue
        while star:  # down to the stem that covers nearly as much
            deeper = {w[: len(node)] + "*" for w in below[node] if len(w) >= len(node)}
            best = max(((len(docs_of(x)), x) for x in deeper if x in below), default=(0, ""))
            if best[0] < 0.97 * len(docs):
                break
            node = best[1]
        docs = docs_of(node)
        chosen.append(node)
        open_docs -= docs
        for w in list(below[node]) if star else [node]:
            bad_docs.pop(w, None)
    stems = [x.removesuffix("*") for x in chosen if x.endswith("*")]
    terms = {x: odds(x) for x in chosen if not any(x != f"{k}*" and x.startswith(k) for k in stems)}  # a stem stands for all that it begins
    terms = {t: w for t, w in terms.items() if w > 0}
    if not terms:
        return Lexicon({}, curve=flat)
    plain = Lexicon(terms)
    seen = {0: Counter(), 1: Counter()}
    for words, y in bags:
        met = {hit[0] for hit in map(plain.look, words) if hit and hit[1]}
        seen[y].update(met)
    rare = 0.0005 * n_good  # clean texts may hold so few words that an edit turns into the term
    fuzzy = {t: math.log((seen[1][t] + 1) / (n_bad + 2)) - math.log((seen[0][t] + 0.5) / (n_good + 1)) for t in terms if Lexicon.edits_of(t) and seen[0][t] <= rare}
    fuzzy = {t: w for t, w in fuzzy.items() if w > 0}
    found = Lexicon(terms, fuzzy)
    x = np.array([inputs(*found.figures(t)) for t, _ in texts])
    y = np.array([y for _, y in texts])
    a, b, c = logistic(x, y).tolist()
    return Lexicon(terms, fuzzy, (a, b, c))


def lexicon_of(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Lexicon:
    return learn([(blob, y) for blob, y, _ in labelled_sample(docs, labels, "toxic", FOLDS, HELD, most)])


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and predicted of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        score = sent.value.score
        for batch in batches:
            found = np.array([score(x or "") for x in batch.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def clean_rows(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    place = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        score = sent.value.score
        for batch in batches:
            yield batch.filter(pa.array([score(x or "") < 0.5 for x in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, lexicon_of(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
