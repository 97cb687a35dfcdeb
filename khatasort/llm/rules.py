"""Quality rules as weak supervision.

Each rule votes that a text is good (+1) or bad (-1), or abstains (0).  Rules are strict on purpose: they overlap, they
contradict each other, and most good texts that have a repeated line or an abbreviation get some bad vote.  Bad texts come in two
kinds, repetition and noise (KINDS says which kind a rule was written for).  The rules vote independently of each other
given the class (good, or a kind of bad).  Expectation-maximisation over the votes of all documents that pass the base
rule estimates the classes' shares and how often each rule's vote is a bad one in each class, hence its accuracies; the posterior
probability that a text is good then decides, in place of a rule that all rules be met.

What tells the classes apart is a prior worth ``PRIOR`` = 2 votes a figure, from which the iteration begins: a rule votes bad on one good text in
ten, on seven of ten texts of its own kind, on three of ten of the other.  There are no bounds; what the
votes say outweighs the prior from a handful of texts on.  No labels are used.

The votes of a document are one number in base 3, so the corpus is summed up as counts of vote patterns: at most
3 ** len(RULES) rows, however many documents there are.  That table is what the driver fits; texts stay where they are.

Defined cases: null texts have no words; texts without words fail the base rule and get a bad vote for their length; repeated rows are
judged each, alike; null doc_ids are kept as they are; other columns are ignored (``kept_rows`` passes
all columns on); without texts that pass the base rule the model is its prior; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, pinned, table

NAME = "op6_weak_supervision_rules"
ORACLE_SQL = None

SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lettered", "n_distinct", "top_count")
_NO_LETTER = bytes(b for b in range(0x80) if not chr(b).isalpha())


def features(blob: bytes) -> tuple[int, ...]:
    """The figures of FEATURES for one text."""
    words = blob.split()
    n = len(words)
    if not n:
        return (0, 0, len(blob) - len(blob.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    chars = len(b"".join(words).translate(None, _CONTINUED))
    symbols = len(blob) - len(blob.translate(None, SYMBOLS))
    lines = [x for x in blob.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeated += i + 5 - max(i, end)
                end = i + 5
    counts = Counter(words)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    lettered = sum(c for w, c in counts.items() if w.translate(None, _NO_LETTER))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, lettered, len(counts), max(counts.values())


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


#: name -> vote of (n, chars, symbols, dup_lines, repeats, lines, upper, lettered, distinct, top); n is at least 1.
RULES = {
    "length": lambda n, *_: _vote(n < 20, n >= 50),
    "word_length": lambda n, c, *_: _vote(not 3.5 <= c / n <= 7, 4 <= c / n <= 6),
    "symbols": lambda n, c, s, *_: _vote(s > 0.05 * n, s <= 0.01 * n),
    "duplicate_lines": lambda n, c, s, d, r, k, *_: _vote(d > 0, k > 1),
    "repeated_words": lambda n, c, s, d, r, *_: _vote(r > 0, n >= 20),
    "capitals": lambda n, c, s, d, r, k, u, *_: _vote(u > 0.005 * n, u == 0),
    "letters": lambda n, c, s, d, r, k, u, a, *_: _vote(a < 0.9 * n, a >= 0.98 * n),
    "variety": lambda n, c, s, d, r, k, u, a, v, *_: _vote(n >= 20 and v < 0.6 * min(n, 1000), n >= 20 and v >= 0.7 * min(n, 1000)),
    "line_length": lambda n, c, s, d, r, k, *_: _vote(n < 12 * k, n >= 20 * k),
    "top_word": lambda n, c, s, d, r, k, u, a, v, t: _vote(n >= 20 and t > 0.1 * n, n >= 20 and t <= 0.07 * n),
}
#: The kind of bad text that each rule was written for.
KINDS = {"repetition": ("duplicate_lines", "repeated_words", "variety", "top_word"), "noise": ("length", "word_length", "symbols", "capitals", "letters", "line_length")}
#: The prior: how many votes a figure is worth, the share of good texts, and a rule's chance of a bad vote on good texts, on its own kind, on the other.
PRIOR, GOOD_SHARE, ON_GOOD, ON_OWN, ON_OTHER = 2.0, 0.7, 0.1, 0.7, 0.3


def votes(found: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(rule(*found) for rule in RULES.values()) if found[0] else (-1, *(0,) * (len(RULES) - 1))


def pattern(given: tuple[int, ...]) -> int:
    """The votes as one number, the first rule in the lowest place."""
    out = 0
    for v in reversed(given):
        out = 3 * out + v + 1
    return out


def failed(found: tuple[int, ...]) -> bool:
    return found[0] < 10 or 100 * found[4] > 20 * found[0]


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes (good first), and each rule's chance of a bad vote in each class."""
    shares = np.array([GOOD_SHARE, *[(1 - GOOD_SHARE) / len(KINDS)] * len(KINDS)])
    return shares, np.array([[ON_GOOD] * len(RULES), *([ON_OWN if name in own else ON_OTHER for name in RULES] for own in KINDS.values())])


def fit(counts: dict[int, int], rounds: int = 500) -> dict:
    """Shares of good texts and of each kind of bad ones, and each rule's chance of a bad vote on them when it votes, from counts of vote patterns."""
    m = len(RULES)
    keys = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[k] for k in keys.tolist()], dtype=float)
    v = np.stack([keys // 3**j % 3 - 1 for j in range(m)], axis=1) if len(keys) else np.zeros((0, m), dtype=int)
    up, down = (v == 1).astype(float), (v == -1).astype(float)
    first_shares, first = prior()
    shares, bad_vote = first_shares, first
    for _ in range(rounds):
        mass = _classes(v, shares, bad_vote) * n[:, None]
        before = bad_vote
        bad_vote = (mass.T @ down + PRIOR * first) / (mass.T @ (up + down) + PRIOR)
        shares = (mass.sum(axis=0) + PRIOR * first_shares) / (n.sum() + PRIOR)
        if np.abs(before - bad_vote).max() < 1e-9:
            break
    return {"shares": shares, "bad_vote": bad_vote}


def _classes(v: np.ndarray, shares: np.ndarray, bad_vote: np.ndarray) -> np.ndarray:
    """Posterior chances of the classes for rows of votes; an abstention says nothing."""
    logs = np.log(shares) + (v == -1) @ np.log(bad_vote).T + (v == 1) @ np.log(1 - bad_vote).T
    out = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(v) else np.zeros((0, len(shares)))
    return out / out.sum(axis=1, keepdims=True) if len(v) else out


def posterior(model: dict, key: int) -> float:
    """The chance that a text with this vote pattern is good."""
    v = np.array([[key // 3**j % 3 - 1 for j in range(len(RULES))]])
    return float(_classes(v, model["shares"], model["bad_vote"])[0, 0])


def accuracies(model: dict) -> dict[str, tuple[float, float]]:
    """Each rule's accuracy, where it votes, on good texts and on bad ones of all kinds."""
    bad = model["shares"][1:] / model["shares"][1:].sum()
    return {name: (float(1 - model["bad_vote"][0, j]), float(bad @ model["bad_vote"][1:, j])) for j, name in enumerate(RULES)}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, FEATURES and votes (a pattern number) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [features(x) for x in blobs(batch.column(1))]
            table_of = np.array(found, dtype=np.int64).reshape(-1, len(FEATURES))
            columns = [pa.array(np.ascontiguousarray(table_of[:, i])) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([pattern(votes(x)) for x in found], pa.int32())], ["doc_id", *FEATURES, "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{x} long' for x in FEATURES)}, votes int")


def failed_base() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def pattern_counts(rows: DataFrame) -> dict[int, int]:
    """Documents that pass the base rule by vote pattern: at most 3 ** len(RULES) numbers."""
    return {r.votes: r["n"] for r in rows.where(~failed_base()).groupBy("votes").agg(F.count("*").alias("n")).collect()}


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, votes, posterior (null where the base rule fails), base_failed and kept of every document."""
    rows = pinned(measured(docs))
    counts = pattern_counts(rows)
    model = fit(counts)
    chances = docs.sparkSession.createDataFrame([(k, posterior(model, k)) for k in sorted(counts)], "votes int, posterior double")  # a row a pattern that occurs
    rows = rows.withColumn("base_failed", failed_base()).join(F.broadcast(chances), "votes", "left")
    rows = rows.withColumn("posterior", F.when(~F.col("base_failed"), F.col("posterior")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= 0.5))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one scan to sum up votes, one to decide."""
    model = fit(pattern_counts(measured(docs)))
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        known: dict[int, bool] = {}
        for batch in batches:
            keep = []
            for blob in blobs(batch.column(place)):
                found = features(blob)
                if failed(found):
                    keep.append(False)
                    continue
                given = votes(found)
                key = pattern(given)
                if key not in known:
                    known[key] = posterior(model, key) >= 0.5
                keep.append(known[key])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
