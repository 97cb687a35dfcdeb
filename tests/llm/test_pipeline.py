from collections import Counter

import duckdb

import corpus_pipeline as p
from khatasort.llm import decontaminate, mixing, rules, toxicity
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_simhash import brute, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in p.STAGES] == ["toxicity", "quality rules", "near-duplicates", "decontamination", "mixing"]


def test_run_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    lexicon = toxicity.lexicon_of(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = {k: r for k, r in rows.items() if lexicon.score(r.text) < 0.5}
    found = {k: rules.features(r.text.encode()) for k, r in rows.items()}
    model = rules.fit(Counter(rules.pattern(rules.votes(f)) for f in found.values() if not rules.failed(f)))
    rows = {k: r for k, r in rows.items() if not rules.failed(found[k]) and rules.posterior(model, rules.pattern(rules.votes(found[k]))) >= 0.5}
    ids = sorted(rows)
    group = brute([(k, slow_fingerprint(rows[k].text)) for k in ids])
    rows = {k: rows[k] for k, g in zip(ids, group, strict=True) if k == g}
    items = [(str(r.item_id), decontaminate.words_of((r.text or "").encode())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {}
    for k, r in rows.items():
        words = decontaminate.words_of(r.text.encode())
        hit, _ = slow_hits(words, items)
        if not (hit and 20 * hit >= len(words)):
            kept[k] = r
    con = duckdb.connect()
    spark.createDataFrame(list(kept.values()), docs.schema).toPandas().to_parquet(tmp_path / "kept.parquet")
    con.sql(f"create view documents as select * from '{tmp_path}/kept.parquet'")
    want = {k: (size, taken) for k, size, taken in con.sql(f"select doc_id, size, taken from ({mixing.ORACLE_SQL})").fetchall() if taken}
    got = p.run(spark, FOLDER).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert {r.doc_id: (r.size, r.taken) for r in got} == want
    words = Counter()
    for r in got:
        words[r.doc_id] += r.words
    assert dict(words) == {k: t for k, (_, t) in want.items()}
    assert 0 < len(kept) < docs.count()


def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "some words " * 30, "en", None, 1), (2, "", "", "", 0), (2, "", "", "", 0)], docs.schema)
    for table in (odd, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, table, FOLDER)
            assert name == "mixing" or out.columns == docs.columns
            out.collect()


def test_null_and_repeated_ids_are_judged_by_row(spark):
    unique = ["alpha beta gamma delta", "one two three four five", "red green blue white black"]
    rows = [(None, unique[0]), (7, unique[1]), (7, unique[2]), (3, "q r s t u v w"), (None, "q r s t u v w"), (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in p.drop_copies(spark, docs, FOLDER).collect()), key=str)
    assert kept == sorted([(None, unique[0]), (7, unique[1]), (7, unique[2]), (3, "q r s t u v w"), (None, "x y z")], key=str)
    bench = spark.createDataFrame([(1, unique[0]), (2, unique[2])], "item_id long, text string")
    clean = sorted(((r.doc_id, r.text) for r in decontaminate.clean_rows(docs, bench).collect()), key=str)
    assert clean == sorted([x for x in rows if x[1] not in (unique[0], unique[2])], key=str)
