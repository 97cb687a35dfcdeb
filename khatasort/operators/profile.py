"""Report over classified transactions: totals, breakdowns, merchants and what looks wrong.

Rows have counterparty, amount, is_credit, row_number and the verdict columns.  Money is summed as decimals, so sums don't
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def total(amount: Column) -> Column:
    return F.sum(amount.cast("decimal(28,2)")).cast("double")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def place_in(column: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), column).cast("int")


def category_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(total(F.col("amount")).alias("total"), F.count("*").alias("n"))


def headline(rows: DataFrame) -> DataFrame:
    amount = F.col("amount")
    found = rows.agg(
        F.count("*").alias("transactions"),
        F.count_if(~F.col("is_credit")).alias("debits"),
        F.count_if("is_credit").alias("credits"),
        F.coalesce(total(F.when(~F.col("is_credit"), amount)), F.lit(0.0)).alias("debit_total"),
        F.coalesce(total(F.when(F.col("is_credit"), amount)), F.lit(0.0)).alias("credit_total"),
        F.count_if(~F.col("needs_review")).alias("auto_classified"),
        F.count_if("needs_review").alias("needs_review"),
        F.count_if(F.col("category") == "OTHER").alias("other"),
    )
    return found.withColumns({f"{c}_share": share(F.col(c), F.col("transactions")) for c in ("auto_classified", "needs_review", "other")})


def _counted(rows: DataFrame, column: str, order: tuple[str, ...] | None) -> DataFrame:
    every = Window.partitionBy()
    found = rows.groupBy(column).agg(F.count("*").alias("n"), total(F.col("amount")).alias("value"))  # one row a name from here on
    found = found.withColumn("share", share(F.col("n"), F.sum("n").over(every)))
    if order:
        return found.withColumn("place", place_in(F.col(column), order)).orderBy("place")
    return found.orderBy(F.desc("n"), column)


def by_category(rows: DataFrame) -> DataFrame:
    return _counted(rows, "category", fixed.CATEGORIES)


def by_source(rows: DataFrame) -> DataFrame:
    return _counted(rows, "source", fixed.SOURCES)


def by_txn_type(rows: DataFrame) -> DataFrame:
    return _counted(rows, "txn_type", None)


def merchant_label() -> Column:
    """The merchant's key, or for a masked one the start of its text."""
    return F.when(F.coalesce(F.col("normalized_merchant"), F.lit("")) != "", F.col("normalized_merchant")).otherwise(F.concat(F.lit("(opaque) "), F.substring("counterparty", 1, 24)))


def merchants(rows: DataFrame) -> DataFrame:
    """A row a merchant: counts, money, spellings, and the verdict of its first row."""
    first = F.min_by(F.struct("category", "source", "confidence", "needs_review", "evidence"), text.place(rows))
    found = rows.groupBy(merchant_label().alias("merchant")).agg(
        F.count("*").alias("n"),
        F.median("amount").alias("median_amount"),
        total(F.col("amount")).alias("total_amount"),
        F.max("amount").alias("max_amount"),
        F.array_sort(F.collect_set("counterparty")).alias("raw_variants"),
        F.count_if(F.col("txn_type") == "MONEY_RECEIVED").alias("n_received"),
        first.alias("first"),
    )
    return found.select("merchant", "n", "median_amount", "total_amount", "max_amount", "raw_variants", "n_received", "first.*")


def vendor_like(found: DataFrame) -> DataFrame:
    """People who take many small payments: probably vendors."""
    return found.where((F.col("category") == "PERSONAL_TRANSFER") & (F.col("n") >= 8) & (F.col("median_amount") <= 150) & (F.col("n_received") == 0))


def weak_rules(found: DataFrame) -> DataFrame:
    """Merchants that one generic word decided."""
    return found.where((F.col("source") == "RULE") & F.element_at(F.split("evidence", "rule: "), -1).isin(*(f"'{w}'" for w in fixed.WEAK_RULES)))


def fuzzy_list(found: DataFrame) -> DataFrame:
    return found.where(F.col("source") == "FUZZY_MATCH")


def unresolved(found: DataFrame, most: int = 20) -> DataFrame:
    """The merchants to review by value; a top-k report."""
    return found.where("needs_review").orderBy(F.desc("total_amount"), "merchant").limit(most)


def odd_amounts(found: DataFrame, least: float = 10000) -> DataFrame:
    return found.where(F.col("category").isin("GROCERIES", "FOOD_AND_DINING") & (F.col("max_amount") >= least))


def web_summary(rows: DataFrame) -> DataFrame:
    """category and source counts as maps, with review, OTHER and distinct merchants."""
    counted = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    cats = rows.groupBy("category").agg(F.count("*").alias("n")).agg(F.to_json(counted("category")).alias("by_category"))
    sources = rows.groupBy("source").agg(F.count("*").alias("n")).agg(F.to_json(counted("source")).alias("by_source"))
    rest = rows.agg(F.count_if("needs_review").alias("needs_review"), F.count_if(F.col("category") == "OTHER").alias("other"), F.countDistinct("normalized_merchant").alias("unique_merchants"))
    return rest.crossJoin(cats).crossJoin(sources)  # three one-row frames


def review_queue(rows: DataFrame, most: int = 50) -> DataFrame:
    return rows.where("needs_review").orderBy(F.desc("amount"), text.place(rows)).limit(most)


def filtered(rows: DataFrame, words: str = "", category: str | None = None, source: str | None = None, review: bool | None = None) -> DataFrame:
    """Rows whose counterparty or key holds the words, in any case, of a category, source and review state."""
    if words:
        rows = rows.where(F.contains(F.lower("counterparty"), F.lit(words.lower())) | F.contains(F.lower("normalized_merchant"), F.lit(words.lower())))
    for column, value in (("category", category), ("source", source)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows if review is None else rows.where(F.col("needs_review") == review)


def payload(rows: DataFrame) -> dict:
    """The report as a dictionary: totals, breakdowns and the merchants, most frequent first.  The driver holds a row a merchant."""
    found = merchants(rows).orderBy(F.desc("n"), "merchant").toLocalIterator()
    top = headline(rows).first().asDict()
    listed = [{k: v for k, v in r.asDict(recursive=True).items() if k not in ("max_amount", "n_received")} for r in found]
    return {
        "totals": {k: top[k] for k in ("transactions", "debits", "credits", "auto_classified", "needs_review", "other")} | {"unique_merchants": len(listed)},
        "by_category": {r.category: r.n for r in by_category(rows).collect()},
        "by_source": {r.source: r.n for r in by_source(rows).collect()},
        "merchants": listed,
    }


def text_report(rows: DataFrame) -> str:
    top = headline(rows).first()
    lines = [f"transactions {top.transactions}", f"debits {top.debits}  credits {top.credits}", f"automatic {top.auto_classified} ({100 * top.auto_classified_share:.1f}%)", f"to review {top.needs_review}", f"OTHER {top.other}", "", "by category"]
    lines += [f"  {r.category:<22}{r.n:>8}{100 * r.share:>7.1f}%{r.value:>16,.0f}" for r in by_category(rows).collect()]
    lines += ["", "by layer", *(f"  {r.source:<22}{r.n:>8}{100 * r.share:>7.1f}%" for r in by_source(rows).collect())]
    found = merchants(rows)
    for title, part in (("vendor-like people", vendor_like(found)), ("generic keywords", weak_rules(found)), ("fuzzy matches", fuzzy_list(found)), ("unresolved by value", unresolved(found)), ("odd amounts", odd_amounts(found))):
        lines += ["", title, *(f"  {r.n:>6}  {r.category:<22}{r.merchant[:44]}" for r in part.limit(20).collect())]
    return "\n".join(lines)


def legacy(rows: DataFrame) -> DataFrame:
    return rows.groupBy(text.to_legacy(F.col("category")).alias("legacy")).agg(F.count("*").alias("n"), total(F.col("amount")).alias("total"))
