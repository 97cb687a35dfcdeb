import math
import random
import zlib

import pytest

from khatasort.llm import toxicity as t

DOCS = "doc_id long, text string, score string, predicted int"
TERMS = {"stupid": 5.0, "idiot": 5.0, "scum": 5.0, "worthless": 5.0, "vequ*": 5.0}


def distance(a: str, b: str) -> int:
    """Edits with neighbours swapped (each part edited once), by the table."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_equals_the_table():
    rng = random.Random(2)
    lexicon = t.Lexicon(TERMS)
    words = [w.removesuffix("*") for w in TERMS]
    for _ in range(6000):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                w.insert(i, rng.choice("abcdeiopstu"))
            elif w and kind == 1:
                w.pop(min(i, len(w) - 1))
            elif w and kind == 2:
                w[min(i, len(w) - 1)] = rng.choice("abcdeiopstu")
            elif len(w) > 1:
                i = min(i, len(w) - 2)
                w[i], w[i + 1] = w[i + 1], w[i]
        word = "".join(w)
        want = min(((distance(word, x), x) for x in TERMS if not x.endswith("*") and distance(word, x) <= t.Lexicon.edits_of(x)), default=None)
        if word.startswith("vequ"):
            want = (0, "vequ*")
        got = lexicon.match(word)
        assert (got and (got[1], got[0])) == want, word


def test_quotation_and_address():
    lexicon = t.Lexicon(TERMS, {"stupid": 2.0})
    plain, address = lexicon.evidence("the stupid thing fell over the edge"), lexicon.evidence("are you stupid or what")
    quoted, reported = lexicon.evidence('it read "a stupid thing" then'), lexicon.evidence("the word stupid was there")
    assert quoted < reported < plain < address
    assert 0 < lexicon.evidence("the stupd thing") < plain
    assert lexicon.evidence("clean text") == lexicon.evidence("") == 0


@pytest.fixture(scope="module")
def learned(spark):
    """The lexicon of the sf0.1 tables, and the held-out labelled texts."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    held = [(r.text or "", r.toxic) for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return t.lexicon_of(docs, labels), held


def test_held_out_accuracy(spark, learned):
    folder = "/root/testdata/sf0.1"
    rows = t.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 50
    assert sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.02 * len(clean)


def test_misspelled_terms_change_verdicts(learned):
    lexicon, held = learned
    without = t.Lexicon(lexicon.terms, {}, lexicon.curve)

    def misspelled(text):  # every term of 5 letters or more has two inner letters swapped
        return " ".join(w[:1] + w[2] + w[1] + w[3:] if lexicon.look(w) and len(t.normal(w)) >= 5 and w[1] != w[2] else w for w in text.lower().split())

    texts = [misspelled(x) for x, toxic in held if toxic]
    found, missed = (sum(model.score(x) >= 0.5 for x in texts) for model in (lexicon, without))
    assert found >= missed + 0.1 * len(texts)


def test_quoted_terms_change_verdicts(learned):
    lexicon, _ = learned
    around = "the report names what was heard in the street that day and says no more about it than this".split()
    for term in ("idiot", "worthless", "stupid"):
        text = " ".join([*around[:8], term, *around[8:]])
        quotation = " ".join([*around[:8], f'"{term}"', *around[8:]])
        assert lexicon.score(text.replace("says", "has")) >= 0.5 > lexicon.score(quotation), term
    assert t.quoted('a "b ' .split() + ["c"] * 100 + ['d"', "e"]) == [False] + [True] * 102 + [False]  # a quotation of any length
    assert t.quoted("'tis not “closed' here".split()) == [True, True, True, False] and not any(t.quoted("“open for ever".split()))


def slow_score(lexicon, text):
    """A text's score from the edit table, word by word."""
    words = text.lower().split()
    marks, begin, ends = dict(t.QUOTES), None, ""
    inside = [False] * len(words)
    for i, w in enumerate(words):
        if begin is None and w[0] in marks:
            begin, ends = i, marks[w[0]]
        bare = w.rstrip(".,;:!?")
        if begin is not None and len(w) > 1 and bare and bare[-1] in ends:
            for j in range(begin, i + 1):
                inside[j] = True
            begin = None
    total = 0.0
    for i, raw in enumerate(words):
        word = t.normal(raw)
        if (hit := near(lexicon, word)) is None:
            continue
        term, edits = hit
        weight = lexicon.fuzzy.get(term, 0.0) if edits else lexicon.terms[term]
        close = {t.normal(words[j]) for j in range(max(0, i - 5), min(len(words), i + 6)) if j != i}
        total += weight * (0.25 if inside[i] else 1.25 if close & t.ADDRESS else 0.4 if close & t.REPORTING else 1.0)
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-(a * math.log(1 + total) + b * math.log(1 + 100 * total / max(1, len(words))) + c)))


known = {}


def near(lexicon, word):
    if word not in known:
        stems = sorted((x for x in lexicon.terms if x.endswith("*") and word.startswith(x[:-1])), key=len)
        allowed = {x: 0 if len(x) < 5 else 1 if len(x) < 9 else 2 for x in lexicon.terms if not x.endswith("*") and abs(len(x) - len(word)) <= 2}
        best = min(((e, x) for x, k in allowed.items() if word and (e := distance(word, x)) <= k), default=None)
        known[word] = (stems[0], 0) if stems else best and (best[1], best[0])
    return known[word]


def test_scores_equal_brute_force(spark, learned):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(-1, 'you "idiot and stupd" they said: worthles scum'), (-2, None), (-3, "the word moron, réeuxx ofti")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(more)
    lexicon, _ = learned
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = t.scored(docs, lexicon).collect()
    assert len(rows) == len(texts)
    assert all(r.score == pytest.approx(slow_score(lexicon, texts[r.doc_id]), abs=1e-9) for r in rows)
    assert sum(r.score > 0.5 for r in rows) > 3


def test_copies_do_not_make_terms():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = [(" ".join(word() for _ in range(30)).encode(), 0) for _ in range(200)]
    copy = " ".join(word() for _ in range(30))
    bad = [(f"{copy} {word()}".encode(), 1) for _ in range(60)]
    toxic = [(" ".join([*(word() for _ in range(20)), "badterm"]).encode(), 1) for _ in range(40)]
    assert set(t.learn(clean + bad + toxic).terms) == {"badterm"}
    assert t.learn([]).terms == {} and t.learn(clean).terms == {}


def test_nulls_repeats_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot scum", "x", 9), (None, None, None, None), (2, "", "", 0), (2, "", "", 0)], DOCS)
    lexicon = t.Lexicon(TERMS)
    got = sorted(((r.doc_id or 0, r.predicted) for r in t.scored(docs, lexicon).collect()))
    assert got == [(0, 0), (1, 1), (2, 0), (2, 0)]
    assert sorted((r.doc_id or 0, r.predicted or 0) for r in t.clean_rows(docs, lexicon).collect()) == [(0, 0), (2, 0), (2, 0)]
    assert t.scored(docs.limit(0), lexicon).collect() == []
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert t.lexicon_of(docs, labels).terms == {} and t.lexicon_of(docs, labels.limit(0)).terms == {}


def test_lexicon_learns_from_up_to_6000_labelled_texts(monkeypatch):
    asked = []
    monkeypatch.setattr(t, "labelled_sample", lambda *a: asked.append(a[-1]) or [])
    monkeypatch.setattr(t, "learn", lambda texts: texts)
    assert t.lexicon_of(None, None) == [] and asked == [6000]


def test_very_long_texts():
    lexicon = t.Lexicon(TERMS)
    text = "plain words " * 300_000 + "stupid " + "plain words " * 300_000
    assert lexicon.figures(text) == (5.0, 1_200_001)
