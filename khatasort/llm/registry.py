"""The queries of this subpackage, opN_<name> and pipeline, and their SQL twins."""

from __future__ import annotations

import importlib

#: Modules in the order of the operators; each has NAME, query(spark, sf_dir) and ORACLE_SQL (None where SQL can't say it).
MODULES = ("simhash", "mixing", "compression", "chat", "toxicity", "rules", "lbl", "decontaminate", "htmltext", "warc")


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    import corpus_pipeline

    return {m.NAME: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {m.NAME: m.ORACLE_SQL for m in _modules()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
