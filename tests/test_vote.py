"""The sentence embedder with a tiny model that is written here byte by byte, and the vote over its vectors."""

import json

import numpy as np
import pytest

from khatasort.operators import cascade, vote

WORDS = ("[PAD]", "[UNK]", "sun", "kirana", "store", "metro", "shoes", "zzq", "blorp")


def number(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def whole(key, value):
    return number(key << 3) + number(value)


def part(key, value):
    value = value.encode() if isinstance(value, str) else value
    return number(key << 3 | 2) + number(len(value)) + value


def tensor_type(kind, dims):
    shape = b"".join(part(1, part(2, d) if isinstance(d, str) else whole(1, d)) for d in dims)
    return part(1, whole(1, kind) + part(2, shape))


def tiny_model(table):
    """hidden = table[input_ids]; the other two inputs are taken and not used."""
    graph = part(1, part(1, "table") + part(1, "input_ids") + part(2, "hidden") + part(4, "Gather"))
    graph += part(2, "tiny") + part(5, whole(1, table.shape[0]) + whole(1, table.shape[1]) + whole(2, 1) + part(8, "table") + part(9, table.astype("<f4").tobytes()))
    for name in ("input_ids", "attention_mask", "token_type_ids"):
        graph += part(11, part(1, name) + part(2, tensor_type(7, ("b", "t"))))
    graph += part(12, part(1, "hidden") + part(2, tensor_type(1, ("b", "t", table.shape[1]))))
    return whole(1, 8) + part(7, graph) + part(8, part(1, "") + whole(2, 13))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("model")
    table = np.random.default_rng(3).normal(size=(len(WORDS), 6)).astype(np.float32)
    (top / "model.onnx").write_bytes(tiny_model(table))
    words = {"type": "WordLevel", "vocab": {w: i for i, w in enumerate(WORDS)}, "unk_token": "[UNK]"}
    (top / "tokenizer.json").write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": words}))
    return str(top), table


def test_vectors_are_means_of_length_one(spark, folder):
    top, table = folder
    names = ["sun kirana", "sun", "metro shoes store", "nothing known"]
    got = {r.norm: np.array(r.vector) for r in vote.embed_with_onnx(spark.createDataFrame([(n,) for n in names], "norm string"), top).collect()}
    for name in names:
        mean = np.mean([table[WORDS.index(w) if w in WORDS else 1] for w in name.split()], axis=0)
        assert np.allclose(got[name], mean / np.linalg.norm(mean), atol=1e-5)


def test_the_cascade_votes_over_a_written_index(spark, folder, tmp_path):
    embed = lambda names: vote.embed_with_onnx(names, folder[0])
    examples = spark.createDataFrame([("zzq store", "SHOPPING"), ("zzq blorp store", "SHOPPING"), ("zzq", "SHOPPING"), ("blorp", "SHOPPING"), ("sun", "INCOME")], "text string, label string")
    vote.write_index(examples, embed, str(tmp_path / "index"))
    index = vote.read_index(spark, str(tmp_path / "index"))
    assert index.count() == 4  # income is no neighbour
    rows = spark.createDataFrame([("Zzq Blorp Store Zzq", False, "Paid to")], "counterparty string, is_credit boolean, direction string")
    got = cascade.classify(rows, fuzzy=False, vote=vote.neighbour_layer(embed, index)).first()
    assert (got.category, got.source, got.confidence) == ("SHOPPING", "SEMANTIC", 0.78) and got.evidence.startswith("minilm: nearest shop '")
    with pytest.raises(ValueError):
        vote.write_index(examples.where("label = 'INCOME'"), embed, str(tmp_path / "none"))
