"""Queries of the learning loop, on state derived from the statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import learning
from . import oracle
from .cascade_queries import classified
from .statement import stmt

# Invented state: merchants (name, category, source, times seen), rules, and corrections in the order they are given.
MERCHANTS = (("kfc", "KFC", "FOOD_AND_DINING", "EXACT_MERCHANT", 0.97, 5), ("sunrise kirana", "Sunrise", "SHOPPING", "USER_OVERRIDE", 1.0, 2), ("old shop", "Old Shop", "HEALTH", "RULE", 0.9, 1), ("", "x", "OTHER", "RULE", 0.9, 1))
RULES = ((1, "blue star", "phrase", "TRAVEL", 100, True, ""), (2, "verma", "token", "FOOD_AND_DINING", 50, True, ""), (3, "kfc", "token", "HEALTH", 10, False, "off"))
CORRECTIONS = (("Meenal", "health", 1), ("KFC", "Shopping", 2), ("KFC", "GROCERIES", 3), ("******1234", "FINANCE", 4), ("New Name", "EDU", 5))


def merchants(spark):
    return spark.createDataFrame(list(MERCHANTS), learning.MERCHANTS)


def rules(spark):
    return spark.createDataFrame(list(RULES), learning.RULES)


def existing(spark, sf_dir):
    """Every third order is stored already."""
    return learning.stored(classified(spark, sf_dir).where("row_number % 3 = 0"))


def learned_state_scan(spark, sf_dir):
    return learning.state_of(merchants(spark), "normalized_name")


def active_rules(spark, sf_dir):
    return learning.active_rules(rules(spark)).select("id", "pattern", "category")


def _incoming(spark, sf_dir):
    """The statement with some ids twice and some without one."""
    k = F.col("row_number") % 10
    rows = stmt(spark, sf_dir).withColumn("transaction_id", F.when(k == 4, "").otherwise(F.concat(F.lit("T"), F.when(k == 5, F.col("row_number") - 1).otherwise(F.col("row_number")).cast("string"))))
    return rows


def import_new_rows(spark, sf_dir):
    return learning.new_rows(_incoming(spark, sf_dir), existing(spark, sf_dir)).select("row_number", "transaction_id")


def import_representative(spark, sf_dir):
    return learning.represented(stmt(spark, sf_dir)).select("row_number", "representative")


def _imported(spark, sf_dir):
    fresh = learning.new_rows(stmt(spark, sf_dir), existing(spark, sf_dir))
    empty = spark.createDataFrame([], "key string, category string")
    return fresh, learning.classified_import(fresh, empty, empty, [], fuzzy=False)


def import_batch(spark, sf_dir):
    _, found = _imported(spark, sf_dir)
    return learning.stored(found).select("id", "raw_counterparty", "normalized_merchant", "amount", "transaction_id", "category", "source", "evidence", "needs_review")


def import_stats(spark, sf_dir):
    fresh, found = _imported(spark, sf_dir)
    return learning.import_stats(stmt(spark, sf_dir), found)


def learnable(spark, sf_dir):
    return classified(spark, sf_dir).where(learning.learnable()).select("row_number", "normalized_merchant", "category")


def learn_merchants(spark, sf_dir):
    return learning.remembered(merchants(spark), classified(spark, sf_dir))


def _fixes(spark):
    return learning.corrections_of(spark.createDataFrame(list(CORRECTIONS), "counterparty string, category string, n int"))


def apply_corrections(spark, sf_dir):
    return learning.corrected(learning.stored(classified(spark, sf_dir)), _fixes(spark)).select("id", "category", "source", "confidence", "evidence", "needs_review")


def overrides_after(spark, sf_dir):
    old = spark.createDataFrame([("kfc", "TRAVEL", "HEALTH", "RULE", "K")], learning.OVERRIDES)
    return learning.overridden(old, _fixes(spark), learning.stored(classified(spark, sf_dir)))


def directory_after(spark, sf_dir):
    return learning.directory_after(merchants(spark), _fixes(spark), learning.stored(classified(spark, sf_dir)))


def reclassify_diff(spark, sf_dir):
    state = _fixes(spark).select(F.col("fix_norm").alias("key"), F.col("fix_category").alias("category"))
    found = learning.reclassified(learning.stored(classified(spark, sf_dir)), state, learning.state_of(merchants(spark), "normalized_name"), [], fuzzy=False)
    return learning.reclassify_diff(found)


def state_counts(spark, sf_dir):
    return merchants(spark).agg(F.count("*").alias("learned")).crossJoin(_fixes(spark).agg(F.count("*").alias("overrides")))  # one-row frames


def queries() -> dict:
    found = (learned_state_scan, active_rules, import_new_rows, import_representative, import_batch, import_stats, learnable, learn_merchants, apply_corrections, overrides_after, directory_after, reclassify_diff, state_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    row = lambda r: "(" + ", ".join(oracle.quoted(x) if isinstance(x, str) else str(x).lower() for x in r) + ")"
    m = f"merchants(normalized_name, display_name, category, source, confidence, times_seen) as (values {', '.join(map(row, MERCHANTS))})"
    fixes = f"given(counterparty, category, n) as (values {', '.join(map(row, CORRECTIONS))}), {oracle.named('given', out='given_n')}, fixes as (select norm as fix_norm, max_by({oracle.coerce('category')}, n) as fix_category, max_by(counterparty, n) as fix_example from given_n where norm <> '' group by norm)"
    p = oracle.statement_prelude().rstrip()
    both = f"{p}, {m}, {fixes} "
    again = oracle.statement_prelude("(select fix_category from fixes where fix_norm = n.norm)", "(select category from merchants where normalized_name = n.norm and n.norm <> '')", f"{m}, {fixes}").rstrip()
    old = p + ", judged as (select row_number, category as old_category, source as old_source from classified) "
    learn = f"not needs_review and confidence >= 0.9 and source in {fixed.IDENTITY_SOURCES} and txn_type = 'PAYMENT_TO_MERCHANT'"
    return {
        "learned_state_scan": f"with {m} select normalized_name as key, category from merchants where normalized_name <> ''",
        "active_rules": f"with r(id, pattern, match_kind, category, priority, enabled, note) as (values {', '.join(map(row, RULES))}) select id::bigint as id, pattern, category from r where enabled",
        "import_new_rows": p + ", n as (select row_number, case when row_number % 10 = 4 then '' when row_number % 10 = 5 then 'T' || (row_number - 1) else 'T' || row_number end as transaction_id from stmt), r as (select *, row_number() over (partition by transaction_id order by row_number) as i from n) select row_number, transaction_id from r where transaction_id = '' or (i = 1 and transaction_id not in (select transaction_id from stmt where row_number % 3 = 0))",
        "import_representative": p + ", k as (select row_number, counterparty, direction, is_credit, case when normalized_merchant <> '' then normalized_merchant else 'raw:' || counterparty end as memo from classified) select row_number, first_value(counterparty) over (partition by memo, is_credit, direction order by row_number) as representative from k",
        "import_batch": p + " select row_number as id, counterparty as raw_counterparty, normalized_merchant, amount, transaction_id, category, source, substr(evidence, 1, 200) as evidence, needs_review from classified where row_number % 3 <> 0",
        "import_stats": p + " select count(*) filter (where row_number % 3 <> 0) as added, count(*) filter (where row_number % 3 = 0) as skipped_existing, count(*) filter (where needs_review and row_number % 3 <> 0) as needs_review from classified",
        "learnable": p + f" select row_number, normalized_merchant, category from classified where {learn}",
        "learn_merchants": f"""{p}, {m}, seen as (select normalized_merchant as norm, count(*) as n, max_by(category, row_number) as category, max_by(source, row_number) as source, max_by(confidence, row_number) as confidence, min_by(counterparty, row_number) as display from classified where {learn} and normalized_merchant <> '' group by 1)
select coalesce(m.normalized_name, s.norm) as normalized_name, coalesce(m.display_name, s.display) as display_name, case when s.norm is null or m.source = 'USER_OVERRIDE' then m.category else s.category end as category, case when s.norm is null or m.source = 'USER_OVERRIDE' then m.source else s.source end as source,
  cast(case when s.norm is null or m.source = 'USER_OVERRIDE' then m.confidence else s.confidence end as double) as confidence, cast(coalesce(m.times_seen, 0) + coalesce(s.n, 0) as bigint) as times_seen from merchants m full outer join seen s on m.normalized_name = s.norm""",
        "apply_corrections": both + "select row_number as id, coalesce(fix_category, category) as category, case when fix_norm is null then source else 'USER_OVERRIDE' end as source, case when fix_norm is null then confidence else 1.0 end as confidence, case when fix_norm is null then evidence else 'user override on ''' || fix_norm || '''' end as evidence, needs_review and fix_norm is null as needs_review from classified left join fixes on normalized_merchant = fix_norm",
        "overrides_after": both + "select fix_norm as normalized_merchant, fix_category as category, case when fix_norm = 'kfc' then 'HEALTH' else (select min_by(category, row_number) from classified where normalized_merchant = fix_norm) end as previous_category, case when fix_norm = 'kfc' then 'RULE' else (select min_by(source, row_number) from classified where normalized_merchant = fix_norm) end as previous_source, case when fix_norm = 'kfc' then 'K' else fix_example end as example_raw from fixes",
        "directory_after": both + "select coalesce(normalized_name, fix_norm) as normalized_name, coalesce(display_name, fix_example) as display_name, coalesce(fix_category, category) as category, case when fix_norm is null then source else 'USER_OVERRIDE' end as source, cast(case when fix_norm is null then confidence else 1.0 end as double) as confidence, cast(coalesce(times_seen, (select count(*) from classified where normalized_merchant = fix_norm)) as bigint) as times_seen from merchants full outer join fixes on normalized_name = fix_norm",
        "reclassify_diff": f"with first as ({old} select * from judged), second as ({again} select row_number, category, source from classified) select count(*) as total, count(*) filter (where category <> old_category) as recategorized, count(*) filter (where category = old_category and source <> old_source) as source_changed from first join second using (row_number)",
        "state_counts": f"with {m}, {oracle.vocabularies()}, {fixes} select (select count(*) from merchants) as learned, (select count(*) from fixes) as overrides",
    }
