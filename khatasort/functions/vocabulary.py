"""The keyword rules, the directory and the commercial words: a parameter of the engine.

They are read from three CSV files (rules, directory, commercial) of a folder, by default the package's ``data``.  Another
folder is given by the environment variable KHATASORT_VOCABULARY or the argument.  Order is precedence.
"""

from __future__ import annotations

import csv
import functools
import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = Path(__file__).resolve().parents[1] / "data"


@dataclass(frozen=True)
class Vocabulary:
    rules: tuple[tuple[str, str, str], ...]  # (pattern, category, token or phrase)
    directory: tuple[tuple[str, str], ...]  # (key, category)
    commercial: tuple[str, ...]


def _table(folder: Path, name: str) -> list[dict[str, str]]:
    lines = (folder / f"{name}.csv").read_text(encoding="utf-8").splitlines()
    return list(csv.DictReader(x for x in lines if not x.startswith("#")))


@functools.cache
def load(folder: str | None = None) -> Vocabulary:
    top = Path(folder or os.environ.get("KHATASORT_VOCABULARY") or DEFAULT)
    return Vocabulary(
        tuple((r["pattern"], r["category"], r["kind"]) for r in _table(top, "rules")),
        tuple((r["key"], r["category"]) for r in _table(top, "directory")),
        tuple(r["word"] for r in _table(top, "commercial")),
    )


def _literal(value, kind: str) -> Column:
    """A large constant as one expression: JSON text that the optimizer reads once, while it folds constants."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def commercial_words() -> Column:
    return _literal(load().commercial, "array<string>")


def rule_table() -> Column:
    """The ordered rules: array of (pattern, category)."""
    return _literal([{"pattern": p, "category": c} for p, c, _ in load().rules], "array<struct<pattern:string,category:string>>")


def token_rules() -> tuple[Column, Column]:
    """The token rules' patterns, and each one's place among all rules."""
    found = [(p, i) for i, (p, _, k) in enumerate(load().rules, start=1) if k == "token"]
    return _literal([p for p, _ in found], "array<string>"), _literal([i for _, i in found], "array<int>")


def phrase_rules() -> Column:
    """The phrase rules: array of (place, pattern)."""
    return _literal([{"place": i, "pattern": p} for i, (p, _, k) in enumerate(load().rules, start=1) if k == "phrase"], "array<struct<place:int,pattern:string>>")


def directory_map() -> Column:
    return _literal(dict(load().directory), "map<string,string>")
