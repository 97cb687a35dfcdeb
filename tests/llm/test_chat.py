import hashlib
import random

import duckdb
import pytest
from tokenizers import Tokenizer

from khatasort.llm import chat as c

ROWS = "conv_id long, turn long, role string, text string, rendered int, n_turns string"


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.sql(c.ORACLE_SQL)
    got = c.query(spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any(r.conv_id == -7 for r in got)


PIECES = ["\\", "#", "###", "####", "</turn>", "</turn>\n", "\n", " ", "### assistant:\n", "é", "😀", "<", "/turn>", "word", "<|endoftext|>", "\t  ", ":", "\\#"]


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_conversations_read_back(tokenizer):
    rng = random.Random(6)
    encoder = Tokenizer.from_file(f"/opt/tokenizers/{tokenizer}")
    encoder.encode_special_tokens = True
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "a:b\\n\nc", ""]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(1, 5))]
        text, spans = c.render(turns)
        assert c.read_turns(text) == turns
        parts = c.masked(encoder.encode(text, add_special_tokens=False).offsets, spans, len(text))
        assert c.loss_texts(text, parts, len(spans)) == [t for r, t in turns if r == "assistant"]


def test_marks_never_stand_inside_a_text():
    text, _ = c.render([("assistant", c.EXTRA)])
    assert text.count(c.END) == 1 and c.unescape(c.escape(c.EXTRA)) == c.EXTRA


def test_every_token_of_a_split_letter_is_under_the_loss(spark):
    row = c.formatted(spark.createDataFrame([(1, 0, "assistant", "😀"), (1, 1, "user", "😀")], "conv_id long, turn long, role string, text string")).first()
    assert sum(row.loss_mask) >= 2 and row.loss_chars == 1
    assert len(row.loss_mask) == len(row.token_ids) == len(row.loss_from)


def test_nulls_ties_repeats_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 1, "user", "b", 1, "x"), (1, 1, "assistant", "a", 1, "x"), (1, 1, "assistant", "a", 1, "x"), (1, None, None, None, 1, "x"), (None, 0, "assistant", "n", 1, "x"), (2, 0, "user", "", 1, "x")], ROWS)
    got = {r.conv_id: r for r in c.formatted(rows).collect()}
    assert c.read_turns(got[1].rendered) == [("", ""), ("assistant", "a"), ("assistant", "a"), ("user", "b")]
    assert got[1].loss_sha256 == hashlib.sha256(b"aa").hexdigest() and got[1].loss_chars == 2
    assert (got[None].n_turns, got[2].loss_chars) == (1, 0)
    assert c.formatted(rows.limit(0)).collect() == []


def test_very_long_text(spark):
    row = c.formatted(spark.createDataFrame([(1, 0, "assistant", "long ### text \\ " * 40000)], "conv_id long, turn long, role string, text string")).first()
    assert row.loss_chars == len("long ### text \\ ") * 40000
