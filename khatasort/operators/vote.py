"""Nearest-neighbour vote over any vector table.

Queries are scored against the index in blocks of bounded rows: a block's vectors are a matrix that is sent to the tasks,
each task multiplies its queries with it and keeps the nearest few, and the blocks' few are merged.  So neither side is
ever joined pair by pair, and the index may be of any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed, text

BLOCK_ROWS = 20_000


def index_rows(examples: DataFrame) -> DataFrame:
    """Examples that may be neighbours: no people, income or OTHER."""
    return examples.where(~F.col("label").cast("string").isin(*fixed.NO_INDEX))


def _blocks(index: DataFrame, size: int):
    rows = []
    for r in index.select("item", "label", "vector").toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def nearest(queries: DataFrame, index: DataFrame, k: int = fixed.NEIGHBOURS, block_rows: int = BLOCK_ROWS, apart: bool = False) -> DataFrame:
    """query, item, label, similarity, place of the k nearest items of every query; equal similarities by item.  apart: an item isn't a neighbour of the query with its number."""
    kind, item_kind, label_kind = queries.schema["query"].dataType.simpleString(), index.schema["item"].dataType.simpleString(), index.schema["label"].dataType.simpleString()
    types = [to_arrow_type(index.schema[c].dataType) for c in ("item", "label")]
    sc = queries.sparkSession.sparkContext
    found = None
    for rows in _blocks(index, block_rows):
        rows.sort(key=lambda r: r["item"])
        sent = sc.broadcast((np.array([r["vector"] for r in rows], dtype=np.float64), [r["item"] for r in rows], [r["label"] for r in rows]))

        def run(batches, sent=sent):
            import pyarrow as pa

            matrix, items, labels = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                if not ids:
                    continue
                vectors = np.stack([np.asarray(x.values, dtype=np.float64) for x in batch.column(1)])
                out: list[tuple] = []
                for a in range(0, len(ids), 512):
                    scores = vectors[a : a + 512] @ matrix.T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, : k + apart]
                    for i, row in enumerate(best):
                        own = [j for j in row.tolist() if not apart or items[j] != ids[a + i]][:k]
                        out += [(ids[a + i], items[j], labels[j], float(scores[i, j])) for j in own]
                if not out:
                    continue
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (batch.column(0).type, *types, pa.float64()), strict=True)], ["query", "item", "label", "similarity"])

        part = queries.select("query", "vector").mapInArrow(run, f"query {kind}, item {item_kind}, label {label_kind}, similarity double")
        found = part if found is None else found.union(part)
    if found is None:
        return queries.select("query", F.lit(None).cast(item_kind).alias("item"), F.lit(None).cast(label_kind).alias("label"), F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("place")).limit(0)
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item")))
    return ranked.where(F.col("place") <= k)


def votes(nearest_rows: DataFrame) -> DataFrame:
    """query, category, share, similarity, nearest: the label of the largest share of similarities above 0."""
    weight = F.greatest(F.col("similarity"), F.lit(0.0))
    per = nearest_rows.groupBy("query", "label").agg(F.sum(weight).alias("weight"), F.min("place").alias("first"))
    total = F.sum("weight").over(Window.partitionBy("query"))
    per = per.withColumn("share", F.col("weight") / F.when(total == 0, 1.0).otherwise(total))
    best = per.groupBy("query").agg(F.max(F.struct("share", (-F.col("first")).alias("order"), "label")).alias("best"))
    top = nearest_rows.where("place = 1").select(F.col("query").alias("top_query"), "similarity", F.col("item").alias("nearest"))
    return best.join(top, F.col("query") == F.col("top_query")).select("query", F.col("best.label").alias("category"), F.col("best.share").alias("share"), "similarity", "nearest")


def is_clear(share, similarity):
    return (share >= fixed.CLEAR_SHARE) & (similarity >= fixed.LEAST_SIMILARITY)


def neighbour_layer(embed, index: DataFrame):
    """A vote for cascade.classify: embed turns a frame of norm into norm, vector; index has item (text), label, vector."""

    def vote(names: DataFrame) -> DataFrame:
        found = votes(nearest(embed(names).select(F.col("norm").alias("query"), "vector"), index))
        return found.select(F.col("query").alias("norm"), F.struct("category", "share", "similarity", "nearest").alias("neighbours"))

    return vote


def write_index(examples: DataFrame, embed, folder: str) -> None:
    """Embed the examples (text, label) that may be neighbours and write them as the index; none is an error."""
    kept = index_rows(examples.select("text", "label")).dropDuplicates(["text"])
    if kept.isEmpty():
        raise ValueError("no example may be a neighbour")
    vectors = embed(kept.select(F.col("text").alias("norm")))
    kept.join(vectors, F.col("text") == F.col("norm")).select("text", "label", F.col("vector").alias("embedding")).write.mode("overwrite").parquet(folder)


def read_index(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select(F.col("text").alias("item"), "label", F.col("embedding").alias("vector"))


def embed_grams(names: DataFrame, width: int = 256) -> DataFrame:
    """norm and vector of hashed n-gram counts, length 1: an embedder for where no sentence model is installed."""
    buckets = F.transform(text.grams(F.col("norm")), lambda g: F.pmod(text.bucket(g), F.lit(width)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter("_buckets", lambda b: b == i)).cast("double"))
    length = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda total, x: total + x * x))
    found = text.computed(text.computed(names.select("norm"), {"_buckets": buckets}), {"_counts": counts})
    return found.select("norm", F.transform("_counts", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0))).alias("vector"))


def embed_with_onnx(names: DataFrame, folder: str, batch: int = 64, most_tokens: int = 64) -> DataFrame:
    """norm and vector by a sentence model (model.onnx and tokenizer.json in ``folder``): mean over tokens, length 1.  One session a task."""

    def run(batches):
        import onnxruntime as ort
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(f"{folder}/tokenizer.json")
        tokens.enable_truncation(most_tokens)
        tokens.enable_padding()
        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        session = ort.InferenceSession(f"{folder}/model.onnx", sess_options=options, providers=["CPUExecutionProvider"])
        for rows in batches:
            names = rows.column(0).to_pylist()
            for i in range(0, len(names), batch):
                found = tokens.encode_batch(names[i : i + batch])
                ids, mask = (np.array([getattr(e, part) for e in found], dtype=np.int64) for part in ("ids", "attention_mask"))
                hidden = session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0]
                mean = (hidden * mask[..., None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)
                unit = (mean / np.linalg.norm(mean, axis=1, keepdims=True)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + batch]), pa.array(list(unit), pa.list_(pa.float32()))], ["norm", "vector"])

    return names.select("norm").mapInArrow(run, "norm string, vector array<float>")
