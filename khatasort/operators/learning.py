"""The learning loop as table operations: import, remember, correct, reclassify.

State is four tables of the columns that TRANSACTIONS, MERCHANTS, OVERRIDES and RULES name.  Operations take frames and
return the frames that take their place; ``Store`` keeps each as one or more Parquet folders that a small file names.  An import
adds a folder of its new rows; a correction changes the overrides, which are laid over the transactions as they are read.  New folders
are written first, then a new version of that file takes the place of the old one in one step, so a run that stops anywhere
leaves either the old state or the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .cascade import VERDICT, classify, named

TRANSACTIONS = "id long, raw_counterparty string, raw_direction string, raw_row string, normalized_merchant string, amount double, is_credit boolean, occurred_at timestamp_ntz, transaction_id string, utr string, account_last4 string, txn_type string, category string, confidence double, source string, evidence string, needs_review boolean"
MERCHANTS = "normalized_name string, display_name string, category string, source string, confidence double, times_seen long"
OVERRIDES = "normalized_merchant string, category string, previous_category string, previous_source string, example_raw string"
RULES = "id long, pattern string, match_kind string, category string, priority int, enabled boolean, note string"


def state_of(table: DataFrame, key: str) -> DataFrame:
    """key and category of overrides or merchants, without empty keys."""
    return table.where(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(key).alias("key"), "category")


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where("enabled").orderBy("priority", "id")


def rule_list(rules: DataFrame) -> list[tuple[str, str, str]]:
    """User rules are written by hand one by one; the driver takes them all."""
    return [(r.pattern, r.category, r.match_kind) for r in active_rules(rules).collect()]


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose transaction_id is neither stored nor on an earlier row; rows without one are always new."""
    known = existing.where("transaction_id is not null").select(F.col("transaction_id").alias("known_id")).distinct()
    order = Window.partitionBy("transaction_id").orderBy(text.place(rows))
    has_id = F.coalesce(F.col("transaction_id"), F.lit("")) != ""
    first = rows.where(has_id).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").join(known, F.col("transaction_id") == F.col("known_id"), "left_anti")
    return first.unionByName(rows.where(~has_id))


def represented(rows: DataFrame) -> DataFrame:
    """Each row with the spelling that decides for it: the first of its merchant key (or text, without a key), flag and direction in this import."""
    rows = named(rows).withColumn("memo", F.when(F.col("norm") != "", F.col("norm")).otherwise(F.concat(F.lit("\x00raw:"), F.col("counterparty"))))
    first = rows.groupBy("memo", "is_credit", "direction").agg(F.min_by(F.col("counterparty"), text.place(rows)).alias("representative"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("memo", "is_credit", "direction")]
    first = first.toDF("_memo", "_is_credit", "_direction", "representative")
    return rows.join(first, same).drop("_memo", "_is_credit", "_direction", "plain", "norm", "memo", "canon", "d")


def classified_import(rows: DataFrame, overrides: DataFrame, learned: DataFrame, rules: list, **layers) -> DataFrame:
    found = represented(rows).withColumnRenamed("counterparty", "own").withColumnRenamed("representative", "counterparty")
    found = classify(found, overrides, learned, user_rules=rules, **layers)
    return found.drop("counterparty").withColumnRenamed("own", "counterparty")


def stored(classified: DataFrame, first_id: int = 1) -> DataFrame:
    """Rows of TRANSACTIONS; ids follow the row numbers, file by file where rows carry a path."""
    if "path" in classified.columns:
        files = classified.select("path").distinct().select(F.col("path").alias("_path"), (F.row_number().over(Window.orderBy("path")) - 1).alias("_file"))  # one short row a file of an import
        classified = classified.join(files, F.col("path").eqNullSafe(F.col("_path")))
        first_id = F.lit(first_id) + F.col("_file").cast("long") * (1 << 33)
    empty_as_null = lambda c: F.nullif(F.col(c), F.lit(""))
    raw = F.to_json("raw") if "raw" in classified.columns else F.lit(None).cast("string")
    return classified.select(
        (F.col("row_number").cast("long") - 1 + first_id).alias("id"), F.col("counterparty").alias("raw_counterparty"), F.col("direction").alias("raw_direction"), raw.alias("raw_row"), "normalized_merchant", "amount", "is_credit", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"),
        empty_as_null("transaction_id").alias("transaction_id"), empty_as_null("utr").alias("utr") if "utr" in classified.columns else F.lit(None).cast("string").alias("utr"), empty_as_null("account_last4").alias("account_last4") if "account_last4" in classified.columns else F.lit(None).cast("string").alias("account_last4"),
        "txn_type", "category", "confidence", "source", F.substring("evidence", 1, fixed.EVIDENCE_LENGTH).alias("evidence"), "needs_review",
    )


def learnable() -> Column:
    return ~F.col("needs_review") & (F.col("confidence") >= fixed.LEARN) & F.col("source").isin(*fixed.IDENTITY_SOURCES) & (F.col("txn_type") == "PAYMENT_TO_MERCHANT")


def remembered(merchants: DataFrame, classified: DataFrame) -> DataFrame:
    """MERCHANTS after an import: counts go up, the last row's verdict wins unless the user decided, the first spelling stays."""
    seen = classified.where(learnable() & (F.col("normalized_merchant") != "")).groupBy("normalized_merchant").agg(
        F.count("*").alias("n"), F.max_by(F.struct("category", "source", "confidence"), text.place(classified)).alias("last"), F.min_by(F.col("counterparty"), text.place(classified)).alias("display")
    )
    joined = merchants.join(seen, F.col("normalized_name") == F.col("normalized_merchant"), "full_outer")
    kept = F.col("last").isNull() | (F.coalesce(F.col("source"), F.lit("")) == "USER_OVERRIDE")
    pick = lambda c: F.when(kept & F.col("normalized_name").isNotNull(), F.col(c)).otherwise(F.col(f"last.{c}")).alias(c)
    return joined.select(
        F.coalesce("normalized_name", "normalized_merchant").alias("normalized_name"), F.coalesce("display_name", F.substring("display", 1, 300)).alias("display_name"), pick("category"), pick("source"), pick("confidence"), (F.coalesce("times_seen", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("times_seen")
    )


def import_stats(rows: DataFrame, classified: DataFrame) -> DataFrame:
    added = classified.agg(F.count("*").alias("added"), F.count_if("needs_review").alias("needs_review"))
    return rows.agg(F.count("*").alias("rows")).crossJoin(added).select("added", (F.col("rows") - F.col("added")).alias("skipped_existing"), "needs_review")  # one-row frames


def corrections_of(given: DataFrame) -> DataFrame:
    """norm, category, example of corrections (counterparty, category, n): names without a key are dropped, of a key the last counts."""
    rows = named(given).where("norm <> ''")
    return rows.groupBy("norm").agg(F.max_by(F.struct(text.coerce_category(F.col("category")).alias("category"), F.col("counterparty").alias("example")), F.col("n")).alias("x")).select(F.col("norm").alias("fix_norm"), F.col("x.category").alias("fix_category"), F.col("x.example").alias("fix_example"))


def corrected(transactions: DataFrame, fixes: DataFrame) -> DataFrame:
    """TRANSACTIONS with the corrections applied to all rows of their merchants."""
    joined = transactions.join(fixes, F.col("normalized_merchant") == F.col("fix_norm"), "left")
    hit = F.col("fix_norm").isNotNull()
    values = {"category": F.col("fix_category"), "source": F.lit("USER_OVERRIDE"), "confidence": F.lit(1.0), "evidence": F.concat(F.lit("user override on '"), F.col("fix_norm"), F.lit("'")), "needs_review": F.lit(False)}
    return joined.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in transactions.columns))


def overridden(overrides: DataFrame, fixes: DataFrame, transactions: DataFrame) -> DataFrame:
    """OVERRIDES after corrections; what a merchant was before is taken from its lowest transaction, once."""
    before = transactions.groupBy("normalized_merchant").agg(F.min_by(F.struct("category", "source"), F.col("id")).alias("before")).toDF("before_norm", "before")
    joined = overrides.join(fixes, F.col("normalized_merchant") == F.col("fix_norm"), "full_outer").join(before, F.col("fix_norm") == F.col("before_norm"), "left")
    old = F.col("normalized_merchant").isNotNull()
    return joined.select(
        F.coalesce("normalized_merchant", "fix_norm").alias("normalized_merchant"), F.coalesce("fix_category", "category").alias("category"), F.when(old, F.col("previous_category")).otherwise(F.col("before.category")).alias("previous_category"), F.when(old, F.col("previous_source")).otherwise(F.col("before.source")).alias("previous_source"), F.coalesce("example_raw", F.substring("fix_example", 1, 300)).alias("example_raw")
    )


def directory_after(merchants: DataFrame, fixes: DataFrame, transactions: DataFrame) -> DataFrame:
    """MERCHANTS after corrections: the corrected category by the user's authority."""
    counts = transactions.groupBy("normalized_merchant").agg(F.count("*").alias("n")).toDF("count_norm", "n")
    joined = merchants.join(fixes, F.col("normalized_name") == F.col("fix_norm"), "full_outer").join(counts, F.col("fix_norm") == F.col("count_norm"), "left")
    hit = F.col("fix_norm").isNotNull()
    return joined.select(
        F.coalesce("normalized_name", "fix_norm").alias("normalized_name"), F.coalesce("display_name", F.substring("fix_example", 1, 300)).alias("display_name"), F.when(hit, F.col("fix_category")).otherwise(F.col("category")).alias("category"), F.when(hit, F.lit("USER_OVERRIDE")).otherwise(F.col("source")).alias("source"), F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("times_seen", "n", F.lit(0)).alias("times_seen")
    )


def reclassified(transactions: DataFrame, overrides: DataFrame, learned: DataFrame, rules: list, **layers) -> DataFrame:
    """TRANSACTIONS judged again from their raw text, with old_category and old_source beside."""
    rows = transactions.withColumnsRenamed({c: f"old_{c}" for c in VERDICT}).withColumnsRenamed({"raw_counterparty": "counterparty", "raw_direction": "direction"})
    found = classify(rows, overrides, learned, user_rules=rules, **layers).withColumnsRenamed({"counterparty": "raw_counterparty", "direction": "raw_direction"})
    return found.withColumn("evidence", F.substring("evidence", 1, fixed.EVIDENCE_LENGTH)).select(*transactions.columns, "old_category", "old_source")


def reclassify_diff(found: DataFrame) -> DataFrame:
    changed = F.col("category") != F.col("old_category")
    return found.agg(F.count("*").alias("total"), F.count_if(changed).alias("recategorized"), F.count_if(~changed & (F.col("source") != F.col("old_source"))).alias("source_changed"))


#: The file that names each table's folders.
CURRENT = "CURRENT.json"


class Store:
    """The four tables as Parquet folders."""

    TABLES = {"transactions": TRANSACTIONS, "merchants": MERCHANTS, "overrides": OVERRIDES, "rules": RULES}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _named(self) -> dict[str, list[str]]:
        """The folders of each table, by the newest version of the naming file."""
        if not self._fs.exists(self._path(CURRENT)):
            return {}
        stream = self._fs.open(self._path(CURRENT))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, folders: dict[str, list[str]]) -> None:
        passing = self._path(f".{CURRENT}-{uuid.uuid4().hex}")
        out = self._fs.create(passing)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(passing), self._fs.makeQualified(self._path(CURRENT)), options)

    def _raw(self, name: str) -> DataFrame:
        folders = self._named().get(name, [])
        if not folders:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(*(f"{self.folder}/{x}" for x in folders))

    def table(self, name: str) -> DataFrame:
        """A table as it stands; transactions with the overrides laid over them."""
        if name != "transactions":
            return self._raw(name)
        fixes = self._raw("overrides").select(F.col("normalized_merchant").alias("fix_norm"), F.col("category").alias("fix_category"))
        return corrected(self._raw(name), fixes)

    def replace(self, add: dict[str, DataFrame] | None = None, **frames: DataFrame) -> None:
        """Write new versions of some tables, and further rows of others, then name them all at once; folders that nothing names any more go last."""
        mark, named = uuid.uuid4().hex, self._named()
        old = {x for folders in named.values() for x in folders}
        for name, frame in {**frames, **(add or {})}.items():
            frame.write.parquet(f"{self.folder}/{name}-{mark}")
            named[name] = [*(() if name in frames else named.get(name, ())), f"{name}-{mark}"]
        self._name(named)
        for x in old - {x for folders in named.values() for x in folders}:
            self._fs.delete(self._path(x), True)

    def state(self) -> tuple[DataFrame, DataFrame, list]:
        return state_of(self.table("overrides"), "normalized_merchant"), state_of(self.table("merchants"), "normalized_name"), rule_list(self.table("rules"))

    def import_transactions(self, rows: DataFrame, learn: bool = True, **layers) -> dict:
        overrides, learned, rules = self.state()
        old = self.table("transactions")
        fresh = new_rows(rows, old)
        first = (old.agg(F.max("id")).first()[0] or 0) + 1
        found = classified_import(fresh, overrides, learned, rules, **layers).persist()
        stats = import_stats(rows, found).first().asDict()
        new = {"merchants": remembered(self.table("merchants"), found)} if learn else {}
        self.replace(add={"transactions": stored(found, first)}, **new)
        found.unpersist()
        return stats

    def record_correction(self, counterparty: str, category: str) -> dict:
        fixes = corrections_of(self.spark.createDataFrame([(counterparty, category, 1)], "counterparty string, category string, n int"))
        transactions = self.table("transactions")
        updated = transactions.join(fixes, F.col("normalized_merchant") == F.col("fix_norm"), "left_semi").count()
        self.replace(overrides=overridden(self.table("overrides"), fixes, transactions), merchants=directory_after(self.table("merchants"), fixes, transactions))
        return {"updated": updated}

    def add_rule(self, pattern: str, category: str, match_kind: str = "phrase", priority: int = 100, note: str = "") -> None:
        rules = self.table("rules")
        made = self.spark.createDataFrame([(pattern.lower().strip(), match_kind, category, priority, note)], "pattern string, match_kind string, category string, priority int, note string")
        number = (rules.agg(F.max("id")).first()[0] or 0) + 1
        self.replace(rules=rules.unionByName(made.select(F.lit(number).cast("long").alias("id"), "pattern", "match_kind", text.coerce_category(F.col("category")).alias("category"), "priority", F.lit(True).alias("enabled"), "note")))

    def classify(self, counterparty: str, is_credit: bool = False, direction: str = "", **layers) -> dict:
        rows = self.spark.createDataFrame([(counterparty, is_credit, direction)], "counterparty string, is_credit boolean, direction string")
        overrides, learned, rules = self.state()
        return classify(rows, overrides, learned, user_rules=rules, **layers).select(*VERDICT).first().asDict()

    def reclassify_all(self, **layers) -> dict:
        overrides, learned, rules = self.state()
        found = reclassified(self.table("transactions"), overrides, learned, rules, **layers).persist()
        diff = reclassify_diff(found).first().asDict()
        self.replace(transactions=found.drop("old_category", "old_source"))
        found.unpersist()
        return diff

    def review_queue(self, most: int = 50) -> DataFrame:
        return self.table("transactions").where("needs_review").orderBy(F.desc("amount"), "id").limit(most)

    def category_totals(self) -> DataFrame:
        return self.table("transactions").groupBy("category").agg(F.sum("amount").alias("total"))

    def counts(self) -> dict:
        return {"overrides": self.table("overrides").count(), "learned": self.table("merchants").count()}
