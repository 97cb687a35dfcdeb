import duckdb
import pytest
import zstandard

from khatasort.llm import warc as w

PAGES = "page_id long, url string, html string, archive string, digest int"


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.sql(w.ORACLE_SQL)
    got = w.query(spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_round_trip_with_dictionary_and_files(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    archives = w.write(pages, archive_bytes=300_000)
    n = w.save(archives, str(tmp_path / "out"))
    contents = [p.read_bytes() for p in (tmp_path / "out").glob("*.warc.zst")]
    assert n == len(contents) > 3 and all(x[:4] == w.DICTIONARY_MAGIC for x in contents)
    assert len({x[: 8 + int.from_bytes(x[4:8], "little")] for x in contents}) == 1  # one dictionary for all
    fields = [f for x in contents for f, _ in w.read_archive(x)]
    ids = {f["warc-record-id"]: f["x-page-id"] for f in fields}
    assert len(ids) == len(fields)
    assert all(ids[f["warc-refers-to"]] == f["x-refers-to-page"] for f in fields if f["warc-type"] == "revisit")
    rows = w.read(w.files(spark, str(tmp_path / "out"))).collect()
    want = {r.page_id: (r.url, (r.html or "").encode()) for r in pages.collect()}
    payloads = {r.page_id: r.payload for r in rows}
    for r in rows:
        url, html = want.pop(r.page_id)
        assert (r.url, r.payload_bytes) == (url, len(html))
        assert bytes(payloads[r.page_id if r.record_type == "response" else r.refers_to]) == html
    assert not want


def test_revisits_nulls_repeats_and_extra_columns(spark):
    big, small = "é" * 500, "x" * 999
    pages = spark.createDataFrame([(1, "http://a/ü b", big, "x", 1), (3, "u", big, "x", 1), (2, None, big, "x", 1), (4, "u", small, "x", 1), (5, "u", small, "x", 1), (None, "u", big, "x", 1), (6, "u", None, "x", 1), (3, "v", big, "x", 1), (7, "u", big + "!", "x", 1)], PAGES)
    got = sorted(((r.page_id or 0, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in w.read(w.write(pages)).collect()), key=str)
    want = [(1, "http://a/ü b", 1000, "revisit", 3), (3, "u", 1000, "response", None), (3, "v", 1000, "revisit", 3), (2, None, 1000, "revisit", 3), (4, "u", 999, "response", None), (5, "u", 999, "response", None), (0, "u", 1000, "response", None), (6, "u", 0, "response", None), (7, "u", 1001, "response", None)]
    assert got == sorted(want, key=str)
    assert w.read(w.write(pages.limit(0))).collect() == []


def test_faults_are_found(spark):
    good = w.record("response", "u", b"payload", 1)
    assert [p for _, p in w.read_archive(w.archive([good, good]))] == [b"payload"] * 2
    for bad in (good.replace(b"X-Payload-Length: 7", b"X-Payload-Length: 8"), good.replace(b"payload", b"pAyload"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good + b"x", good + good, b"", good.replace(b"WARC-Date: ", b"WARC-Date ")):
        with pytest.raises(w.WarcError):
            list(w.read_archive(w.archive([bad])))
    whole = w.archive([good])
    for data in (whole[:-3], whole + b"junk", w.DICTIONARY_MAGIC + b"\xff\xff\0\0abc"):
        with pytest.raises(w.WarcError):
            list(w.read_archive(data))
    rows = w.read(spark.createDataFrame([("a", bytearray(whole + b"junk"))], "archive string, content binary"), strict=False).collect()
    assert [r.fault is None for r in rows] == [True, False]


def test_plain_dictionary_in_the_leading_frame():
    records = [w.record("response", f"http://h/{i}", f"<p>page {i} {'text ' * 200}</p>".encode(), i) for i in range(400)]
    dictionary = w.train(records, 4096)
    assert dictionary
    body = w.archive(records, dictionary)
    size = 8 + int.from_bytes(body[4:8], "little")
    plain = w.DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary + body[size:]
    assert [f["x-page-id"] for f, _ in w.read_archive(plain)] == [f["x-page-id"] for f, _ in w.read_archive(body)] == [str(i) for i in range(400)]
    with pytest.raises((w.WarcError, zstandard.ZstdError)):
        list(w.read_archive(body[size:]))


def test_very_long_pages_small_tables_and_shuffled_revisits(spark, monkeypatch):
    long = "<p>" + "word " * 1_000_000
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", "tiny")], "page_id long, url string, html string")
    archives = w.write(pages).collect()
    assert all(bytes(r.content)[:4] == w.DICTIONARY_MAGIC for r in archives)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in w.read(w.write(pages)).collect())
    assert got == [(1, len(long), "revisit", 2), (2, len(long), "response", None), (3, 4, "response", None)]
    monkeypatch.setattr(w, "BROADCAST_ROWS", 0)
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in w.read(w.write(pages)).collect()) == got
