import hashlib
import math
import zlib

import pytest
import zstandard

from khatasort.llm import compression as c

DOCS = "doc_id long, text string, score string, held_out int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = c.query(spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in rows if r.quality], [r.predicted for r in rows if not r.quality]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.08 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # calibrated: the mean score is near the share of good texts
    assert abs(sum(r.score for r in rows) / len(rows) - len(good) / len(rows)) < 0.03


def test_reruns_agree(spark):
    folder = "/root/testdata/sf0.001"
    first, again = ({r.doc_id: r.score for r in c.query(spark, folder).collect()} for _ in range(2))
    assert first == again


def test_nulls_repeats_missing_labels_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "x", 1), (1, "some text", "x", 1), (None, None, None, None), (2, "", "", 0), (3, "long " * 200000, "", 0)], DOCS)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in c.scored(docs, c.model_of(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    assert {r.score for r in c.scored(docs, c.model_of(docs, one)).collect()} == {1.0}
    model = c.fit([(b"a fair sentence of plain words %d" % i, 1) if i % 3 else (b"$$$ ### %d" % i, 0) for i in range(60)])
    rows = c.scored(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert c.scored(docs.limit(0), model).collect() == []


def slow_scores(texts, labels):
    """Dictionaries, sizes and curve once more, a document at a time; texts by id, labels by id."""
    ids = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in texts]
    ids = sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:4000]
    ids = sorted(ids, key=lambda i: (zlib.crc32(str(i).encode()), i))
    build, tune = ids[::2], ids[1::2]
    size = lambda k: sum(len(texts[i]) + 1 for i in build if labels[i] == k and texts[i])
    room, books = min(size(0), size(1), 786432), {}
    for k in (0, 1):
        held = b""
        for i in build:
            if labels[i] == k and texts[i] and len(held) + len(texts[i]) + 1 <= room:
                held += texts[i] + b"\n"
        books[k] = held[:-1]

    def difference(text):
        total = 0
        for sign, k in ((1, 0), (-1, 1)):
            for at in range(0, len(text), 65536):
                book = zstandard.ZstdCompressionDict(books[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                book.precompute_compress(level=9)
                tool = zstandard.ZstdCompressor(level=9, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)
                total += sign * len(tool.compress(text[at : at + 65536]))
        return total / (len(text) + 50)

    xs, ys = [difference(texts[i]) for i in tune], [labels[i] for i in tune]
    mean = sum(xs) / len(xs)
    scale = math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs)) + 1e-9
    xs = [(x - mean) / scale for x in xs]
    a = b = 0.0
    for _ in range(200):  # Newton's method by hand, with the same small pull towards zero
        ps = [1 / (1 + math.exp(-(a * x + b))) for x in xs]
        ga = sum((y - p) * x for x, y, p in zip(xs, ys, ps, strict=True)) - 1e-4 * len(xs) * a
        gb = sum(y - p for y, p in zip(ys, ps, strict=True)) - 1e-6 * len(xs) * b
        w = [p * (1 - p) for p in ps]
        haa, hab, hbb = sum(v * x * x for v, x in zip(w, xs, strict=True)) + 1e-4 * len(xs), sum(v * x for v, x in zip(w, xs, strict=True)), sum(w) + 1e-6 * len(xs)
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return {i: 1 / (1 + math.exp(-(a * (difference(x) - mean) / scale + b))) for i, x in texts.items()}


def test_scores_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    want = slow_scores(texts, labels)
    assert len({y for y in labels.values()}) == 2
    rows = c.query(spark, folder).collect()
    assert len(rows) == len(want)
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-4) for r in rows)


def test_long_texts_score_like_their_pieces():
    model = c.fit([(b"a fair sentence of plain words number %d and some more of it" % i, 1) if i % 3 else (b"$$$ ### %d" % i, 0) for i in range(60)])
    one = b"a fair sentence of plain words that goes on and on. "
    assert abs(model.differences([one * 40])[0] - model.differences([one * 40000])[0]) < 0.05
