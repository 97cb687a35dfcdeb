"""Statement outputs: categorized rows, merchant maps and label sheets as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..operators.cascade import VERDICT, classify, named
from .statement import appended_names, parse, unique_headers


def verdict_columns() -> list:
    """The appended columns, in their order, of rows that have the verdict and a status."""
    ok = F.col("status") == "ok"
    shown = lambda c: F.when(ok, c).otherwise("")
    return [
        shown(F.col("category")).alias("category"),
        shown(F.format_string("%.2f", "confidence")).alias("category_confidence"),
        shown(F.col("source")).alias("category_source"),
        shown(F.when(F.col("needs_review"), "yes").otherwise("no")).alias("category_needs_review"),
        shown(F.col("txn_type")).alias("category_txn_type"),
        shown(F.col("normalized_merchant")).alias("category_normalized_merchant"),
        shown(F.col("evidence")).alias("category_evidence"),
        F.col("status").alias("status"),
    ]


def categorized(parsed: DataFrame, overrides: DataFrame | None = None, learned: DataFrame | None = None, **layers) -> DataFrame:
    """Every parsed row with its verdict and status; rows with a problem or repeated ones have a reason and no verdict."""
    status = F.when(F.col("problem").isNotNull(), F.concat(F.lit("skipped: "), F.col("problem"))).when(F.col("is_duplicate"), "skipped: duplicate of an earlier row").otherwise("ok")
    rows = parsed.withColumn("status", status)
    good = classify(rows.where("status = 'ok'"), overrides, learned, **layers)
    rest = rows.where("status <> 'ok'")
    for c in VERDICT:
        rest = rest.withColumn(c, F.lit(None).cast(good.schema[c].dataType))
    return good.unionByName(rest)


def export_rows(found: DataFrame, headers: list[str]) -> DataFrame:
    """The file's own cells, cut or filled to its headers, and the verdict columns under free names, in row order."""
    own = unique_headers(headers)
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"_{i}") for i in range(len(own))]
    out = found.orderBy("path", "row_number").select(*cells, *verdict_columns())
    return out.toDF(*own, *appended_names(own))


def export_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.col("status") == "ok").alias("classified"),
        F.count_if((F.col("status") == "ok") & F.col("needs_review")).alias("needs_review"),
        F.count_if(F.col("problem").isNotNull()).alias("skipped"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"),
    )


def write_csv(rows: DataFrame, folder: str, one_file: bool = True) -> None:
    """Write rows as CSV with a header; a statement fits one file, larger outputs keep their parts."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("emptyValue", "").option("quoteAll", False).option("escape", '"').csv(folder)


def categorize_files(files: DataFrame, **state) -> DataFrame:
    from .statement import scan

    return categorized(parse(scan(files), dedupe=False), **state)


def merchant_map(rows: DataFrame, overrides: DataFrame | None = None, learned: DataFrame | None = None, **layers) -> DataFrame:
    """merchant, category, needs_review: a row a merchant under its most frequent spelling, judged as a payment to it."""

    keyed = named(rows.select("counterparty")).withColumn("key", F.when(F.col("norm") != "", F.col("norm")).otherwise(F.col("counterparty")))
    spellings = keyed.groupBy("key", "counterparty").agg(F.count("*").alias("n"))
    best = spellings.groupBy("key").agg(F.max_by("counterparty", F.struct("n", "counterparty")).alias("counterparty"))
    judged = classify(best.select("counterparty", F.lit(False).alias("is_credit"), F.lit("Paid to").alias("direction")), overrides, learned, **layers)
    return judged.select(F.col("counterparty").alias("merchant"), "category", "needs_review").orderBy(F.lower("merchant"), "merchant")


