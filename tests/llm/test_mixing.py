import duckdb
import pytest

from khatasort.llm import mixing as m

DOCS = "doc_id long, text string, source string, size string, key int"


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(m.ORACLE_SQL)
    got = m.query(spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def filled(sizes: dict, weights: dict) -> dict:
    """Share, cap, and share the excess again until none is above."""
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > 3 * sizes[s]]
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else weights[s] * level
        if not over:
            return target
        for s in over:
            open_.remove(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("counts", [[1, 50, 2, 30], [100, 1, 1, 1, 1, 1, 90], [5], [0, 4, 9], [0, 0]])
def test_targets_and_takes(spark, counts):
    names = [None if i == len(counts) - 1 and len(counts) > 2 else f"s{i}" for i in range(len(counts))]
    docs = [(100 * i + j, "w " * (1 + j % 4), name, "x", 1) for i, (name, n) in enumerate(zip(names, counts, strict=True)) for j in range(n)]
    docs += [(-1 - i, "", name, "x", 1) for i, name in enumerate(names)]
    rows = m.mixed(spark.createDataFrame(docs, DOCS)).collect()
    sizes = {name: sum(r.size for r in rows if r.source == name) for name in names}
    want = filled(sizes, {name: 1 + i % 3 for i, name in enumerate(names)})
    for name in names:
        own = [r for r in rows if r.source == name]
        assert all(abs(r.target - want[name]) < 1e-6 and r.source_size == sizes[name] for r in own)
        assert sum(r.taken for r in own) == int(want[name] + 0.5)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_stream_is_sorted_and_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.stream(docs).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert 0 <= rows[0].position <= rows[-1].position <= 1
    taken = {r.doc_id: r.taken for r in m.mixed(docs).collect()}
    words = {}
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    assert words == {k: v for k, v in taken.items() if v}
    # the schedule: of a light source's words more than half come in the first half of training, of a heavy one's fewer
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    early = {s: sum(r.words for r in x if r.position < 0.5) / sum(r.words for r in x) for s, x in by.items()}
    order = sorted(early)
    light, heavy = (sum(early[s] for s in order[i::3]) / len(order[i::3]) for i in (0, 2))
    assert light > heavy + 0.15


def test_nulls_repeats_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b", None, "x", 1), (None, "a b", None, "x", 1), (1, None, "q", "x", 1), (1, "z", "q", "x", 1), (2, "y " * 9, "q", "x", 1)], DOCS)
    first, again = (sorted(map(str, m.mixed(docs).collect())) for _ in range(2))
    assert first == again and len(first) == 5
    assert m.mixed(docs.limit(0)).collect() == []
    assert m.stream(docs.limit(0)).collect() == []


def test_many_sources_and_very_long_texts(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"host{i % 300:03d}.example", "x", 1) for i in range(900)] + [(-1, "long " * 2_000_000, "zz", "x", 1), (None, "a b c", "zz", "x", 1), (None, "d e", "zz", "x", 1)], DOCS)
    rows = m.mixed(docs).collect()
    names = sorted({r.source for r in rows})
    sizes = {name: sum(r.size for r in rows if r.source == name) for name in names}
    want = filled(sizes, {name: 1 + i % 3 for i, name in enumerate(names)})
    assert sizes["zz"] == 2_000_005 and len(names) == 301
    for name in names:
        own = [r for r in rows if r.source == name]
        assert all(abs(r.target - want[name]) < 1e-6 * max(1, want[name]) for r in own)
        assert abs(sum(r.taken for r in own) - want[name]) <= 0.5001
    assert all((r.first_position is None) == (r.taken == 0) for r in rows)


def test_running_sums_equal_a_loop(spark):
    rows = [(i * 37 % 101, i % 5) for i in range(400)]
    got = m.running(spark.createDataFrame(rows, "a int, b int").repartition(7), [m.F.col("a"), m.F.col("b")], {"rank": "1", "below": "b"}).collect()
    want, total = [], 0
    for k, (a, b) in enumerate(sorted(rows)):
        want.append((a, b, k, total))
        total += b
    assert sorted((r.a, r.b, r["rank"], r.below) for r in got) == sorted(want)
