"""Labelled evaluation: blind label sheets, joins with labels, and metrics.

Rows have key, flow, counterparty, amount, truth, pred, source, review, seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .cascade import named
from .profile import place_in, share, total


class LabelError(ValueError):
    """Labels that no category has."""


def keyed(rows: DataFrame) -> DataFrame:
    """key and flow beside the transactions."""
    rows = named(rows.drop("key", "flow"))
    rows = rows.withColumn("key", text.merchant_key(F.col("norm"), F.col("canon"), F.col("counterparty")))
    return rows.withColumn("flow", F.when(F.col("is_credit"), "IN").otherwise("OUT"))


def label_sheet(rows: DataFrame) -> DataFrame:
    """A blind row for each key and flow, the biggest money first."""
    found = keyed(rows).groupBy("key", "flow").agg(F.min_by(F.col("counterparty"), text.place(rows)).alias("example"), F.count("*").alias("count"), total(F.col("amount")).alias("total"), F.min_by(F.col("direction"), text.place(rows)).alias("direction"))
    found = found.withColumn("total_amount", F.format_string("%.2f", "total"))
    return found.orderBy(F.desc("total"), "key", "flow").select("key", "flow", "example", "count", "total_amount", "direction", F.lit("").alias("true_category"), F.lit("").alias("notes"))


def read_labels(sheet: DataFrame, strict: bool = True) -> DataFrame:
    """key, flow, truth of a filled sheet (line, key, flow, true_category): blank labels are skipped, of repeated keys the last line counts, an unknown name raises."""
    rows = sheet.where(text.stripped(F.col("true_category")) != "").withColumn("known", text.known_category(F.col("true_category")))
    if strict:
        bad = rows.where("known is null").orderBy("line").limit(20).collect()
        if bad:
            raise LabelError("unknown categories: " + ", ".join(f"line {r.line}: {r.true_category!r}" for r in bad))
    return rows.where("known is not null").groupBy("key", "flow").agg(F.max_by("known", "line").alias("truth"))


def labelled(rows: DataFrame, labels: DataFrame, train_keys: DataFrame | None = None) -> DataFrame:
    """Classified transactions that have a label, ready for the metrics."""
    rows = keyed(rows).drop("truth").join(labels, ["key", "flow"])
    if train_keys is None:
        rows = rows.withColumn("seen", F.lit(False))
    else:
        known = train_keys.select(F.col("key").alias("seen_key")).distinct()
        rows = rows.join(known, F.col("key") == F.col("seen_key"), "left").withColumn("seen", F.col("seen_key").isNotNull())
    path = ["path"] if "path" in rows.columns else []
    return rows.select(*path, "row_number", "key", "flow", "counterparty", "amount", "truth", F.col("category").alias("pred"), "source", F.col("needs_review").alias("review"), "seen")


def _metrics() -> list:
    ok, auto = F.col("pred") == F.col("truth"), ~F.col("review")
    n, wrong, silent = F.count("*"), F.count_if(~ok), F.count_if(auto & ~ok)
    return [
        n.alias("rows"),
        share(F.count_if(ok), n).alias("accuracy"),
        share(F.coalesce(total(F.when(ok, F.col("amount"))), F.lit(0.0)), total(F.col("amount"))).alias("accuracy_by_amount"),
        share(F.count_if(auto), n).alias("coverage"),
        share(F.count_if(auto & ok), F.count_if(auto)).alias("auto_accuracy"),
        share(F.count_if(~auto & ok), F.count_if(~auto)).alias("flagged_accuracy"),
        wrong.alias("errors"),
        silent.alias("silent_errors"),
        share(wrong - silent, wrong).alias("error_catch_rate"),
    ]


def score(rows: DataFrame, *by: str) -> DataFrame:
    return (rows.groupBy(*by) if by else rows).agg(*_metrics())


def per_layer(rows: DataFrame) -> DataFrame:
    ok = F.col("pred") == F.col("truth")
    found = rows.groupBy("source").agg(F.count("*").alias("rows"), share(F.count_if(ok), F.count("*")).alias("accuracy"), share(F.count_if(~F.col("review")), F.count("*")).alias("auto_share"))
    return found.withColumn("place", place_in(F.col("source"), fixed.SOURCES)).orderBy("place").drop("place")


def per_category(rows: DataFrame) -> DataFrame:
    actual = rows.groupBy(F.col("truth").alias("category")).agg(F.count("*").alias("support"), F.count_if(F.col("pred") == F.col("truth")).alias("right"))
    predicted = rows.groupBy(F.col("pred").alias("category")).agg(F.count("*").alias("predicted"))
    found = actual.join(predicted, "category", "full_outer")
    right = F.coalesce("right", F.lit(0))
    return found.select("category", F.coalesce("support", F.lit(0)).alias("support"), share(right, F.col("predicted")).alias("precision"), share(right, F.col("support")).alias("recall"))


def confusions(rows: DataFrame, most: int = 10) -> DataFrame:
    return rows.where("pred <> truth").groupBy("truth", F.col("pred").alias("predicted")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "truth", "predicted").limit(most)


def silent_errors(rows: DataFrame) -> DataFrame:
    found = rows.where("not review and pred <> truth").groupBy("key", "truth", "pred", "source").agg(F.min_by(F.col("counterparty"), text.place(rows)).alias("merchant"), F.count("*").alias("rows"), total(F.col("amount")).alias("amount"))
    return found.orderBy(F.desc("amount"), "key").select("merchant", "truth", F.col("pred").alias("predicted"), "source", "rows", "amount")


def ablation(make, labels: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """The metrics for each configuration; make(**config) classifies the transactions."""
    out = None
    for name, config in configs.items():
        part = score(labelled(make(**config), labels)).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def result_sheet(rows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """A row for each merchant and flow (input, actual, predicted), the biggest money first; labels of a previous sheet are kept."""
    found = keyed(rows).groupBy("key", "flow").agg(F.min_by(F.col("counterparty"), text.place(rows)).alias("example"), total(F.col("amount")).alias("total"), F.min_by(F.col("category"), text.place(rows)).alias("predicted"))
    found = found.withColumn("input", F.when(F.col("flow") == "IN", F.concat("example", F.lit(" (money in)"))).otherwise(F.col("example")))
    if previous is None:
        found = found.withColumn("actual", F.lit(""))
    else:
        old = previous.where(text.stripped(F.col("actual")) != "").select(F.regexp_replace("input", r" \(money in\)$", "").alias("old_input"), F.when(F.col("input").endswith(" (money in)"), "IN").otherwise("OUT").alias("old_flow"), text.coerce_category(F.col("actual")).alias("old_actual"))
        old = old.groupBy("old_input", "old_flow").agg(F.max("old_actual").alias("old_actual"))
        found = found.join(old, (F.col("example") == F.col("old_input")) & (F.col("flow") == F.col("old_flow")), "left").withColumn("actual", F.coalesce("old_actual", F.lit("")))
    return found.orderBy(F.desc("total"), "input").select("input", "actual", "predicted", "total")


def merchant_names(rows: DataFrame) -> DataFrame:
    """Distinct merchants by key and flow, with their first spelling, in the order they first appear."""
    found = keyed(rows).groupBy("key", "flow").agg(F.min_by(F.col("counterparty"), text.place(rows)).alias("merchant"), F.min("row_number").alias("first_row"), F.min(text.place(rows)).alias("first"))
    return found.orderBy("first").select("merchant", F.when(F.col("flow") == "IN", "CREDIT").otherwise("DEBIT").alias("type"), "first_row")
