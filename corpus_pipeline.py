"""From raw documents to a training stream in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage works on all that the one before it kept, and
all but the last return the columns of ``documents``:

1. toxicity: documents that the lexicon automaton predicts to be toxic go (labels come from the data folder);
2. quality rules: documents that the weakly supervised rules reject go;
3. SimHash near-duplicates: of each component, the document with the smallest id stays (any one, if no document has an id);
4. benchmark decontamination: contaminated documents go;
5. mixing: the rest becomes the training stream, a row for each pass over a document, in order of position.

Documents without doc_id, or with the same one, go through all stages like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from khatasort.llm import decontaminate, mixing, rules, simhash, toxicity
from khatasort.llm.common import file_system, ready, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, toxicity.lexicon_of(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return rules.kept_rows(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.stream(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("near-duplicates", drop_copies), ("decontamination", drop_contaminated), ("mixing", mix)]

#: Rules fitted by expectation-maximisation, fingerprints and edit automata have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``.  Between two stages the rows are written to the shared checkpoint folder and read again; a stage's input is deleted once its output is written, and the last one, which the result reads, with the application."""
    folder = f"{ready(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if held:
            files, where = file_system(spark, held)
            files.delete(where, True)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
