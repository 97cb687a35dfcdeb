"""Queries of the report, the exports and the evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import cascade, ngram_model, profile, scoring, vote
from ..sources.export import merchant_map as map_of
from . import oracle
from .cascade_queries import classified
from .statement import stmt


def category_totals(spark, sf_dir):
    return profile.category_totals(classified(spark, sf_dir))


def legacy_totals(spark, sf_dir):
    return profile.legacy(classified(spark, sf_dir))


def report_headline(spark, sf_dir):
    return profile.headline(classified(spark, sf_dir))


def report_by_category(spark, sf_dir):
    return profile.by_category(classified(spark, sf_dir))


def report_by_source(spark, sf_dir):
    return profile.by_source(classified(spark, sf_dir))


def report_by_txn_type(spark, sf_dir):
    return profile.by_txn_type(classified(spark, sf_dir))


def merchant_profile(spark, sf_dir):
    found = profile.merchants(classified(spark, sf_dir))
    return found.withColumns({"raw_variants": F.array_join("raw_variants", "|"), "median_amount": F.round("median_amount", 2)})


def vendor_like(spark, sf_dir):
    """People with many payments; amounts in thousands stand for small ones, as orders are large."""
    rows = classified(spark, sf_dir).withColumn("amount", F.col("amount") / 10000)
    return profile.vendor_like(profile.merchants(rows)).select("merchant", "n", "category")


def weak_rules(spark, sf_dir):
    return profile.weak_rules(profile.merchants(classified(spark, sf_dir))).select("merchant", "n", "category", "evidence")


def unresolved_top20(spark, sf_dir):
    return profile.unresolved(profile.merchants(classified(spark, sf_dir))).select("merchant", "n", "total_amount", "category")


def odd_amounts(spark, sf_dir):
    return profile.odd_amounts(profile.merchants(classified(spark, sf_dir))).select("merchant", "max_amount", "category")


def review_queue(spark, sf_dir):
    return profile.review_queue(classified(spark, sf_dir)).select("row_number", "amount", "category", "counterparty")


def filtered_rows(spark, sf_dir):
    return profile.filtered(classified(spark, sf_dir), "SUN", "GROCERIES", "RULE", False).select("row_number", "counterparty")


def web_summary(spark, sf_dir):
    return profile.web_summary(classified(spark, sf_dir))


def merchant_map(spark, sf_dir):
    return map_of(stmt(spark, sf_dir))


def merchant_names(spark, sf_dir):
    return scoring.merchant_names(stmt(spark, sf_dir))


def label_sheet(spark, sf_dir):
    return scoring.label_sheet(stmt(spark, sf_dir))


def result_sheet(spark, sf_dir):
    previous = spark.createDataFrame([("Metro Shoes", "shopping"), ("Kavya (money in)", "Personal Transfer"), ("KFC", ""), ("KFC (money in)", "?")], "input string, actual string")
    return scoring.result_sheet(classified(spark, sf_dir), previous)


def _labels(spark, sf_dir):
    """A filled label sheet: the pool's truths, some under older names, one blank."""
    pool = stmt(spark, sf_dir).select("idx", "counterparty", "is_credit", "direction", "truth").distinct()
    sheet = scoring.keyed(pool).select(F.col("idx").cast("long").alias("line"), "key", "flow", F.when(F.col("idx") == 29, "").when(F.col("truth") == "HEALTH", "health").otherwise(F.col("truth")).alias("true_category"))
    return scoring.read_labels(sheet)


def labels_read(spark, sf_dir):
    return _labels(spark, sf_dir)


def _labelled(spark, sf_dir):
    seen = scoring.keyed(stmt(spark, sf_dir).where("idx < 18")).select("key").distinct()
    return scoring.labelled(classified(spark, sf_dir), _labels(spark, sf_dir), seen)


def labelled_rows(spark, sf_dir):
    return _labelled(spark, sf_dir)


def _rounded(rows):
    return rows.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def eval_score(spark, sf_dir):
    return _rounded(scoring.score(_labelled(spark, sf_dir)))


def seen_vs_new(spark, sf_dir):
    return _rounded(scoring.score(_labelled(spark, sf_dir), "seen"))


def eval_per_layer(spark, sf_dir):
    return _rounded(scoring.per_layer(_labelled(spark, sf_dir)))


def eval_per_category(spark, sf_dir):
    return _rounded(scoring.per_category(_labelled(spark, sf_dir)))


def eval_confusions(spark, sf_dir):
    return scoring.confusions(_labelled(spark, sf_dir))


def silent_errors(spark, sf_dir):
    return scoring.silent_errors(_labelled(spark, sf_dir))


def ablation(spark, sf_dir):
    """The metrics of three configurations: the curated layers, those and the trained n-gram model, those and the vector vote.

    The vote's vectors are hashed n-grams, as no weights of a sentence model are at hand; its index are the examples that the model learns from.
    """
    rows = stmt(spark, sf_dir)
    examples = ngram_model.training_set(cascade.classify_native(rows))
    predict = ngram_model.model_layer(*ngram_model.fit(examples))
    known = vote.index_rows(examples.select(F.col("text").alias("item"), "label"))
    index = known.join(vote.embed_grams(known.select(F.col("item").alias("norm"))), F.col("item") == F.col("norm")).select("item", "label", "vector")
    configs = {"curated layers": {}, "+ n-gram model": {"predict": predict}, "+ vector vote": {"predict": predict, "vote": vote.neighbour_layer(vote.embed_grams, index)}}
    return _rounded(scoring.ablation(lambda **layers: cascade.classify(rows, **layers), _labels(spark, sf_dir), configs))


def queries() -> dict:
    found = (category_totals, legacy_totals, report_headline, report_by_category, report_by_source, report_by_txn_type, merchant_profile, vendor_like, weak_rules, unresolved_top20, odd_amounts, review_queue, filtered_rows, web_summary, merchant_map, merchant_names, label_sheet, result_sheet, labels_read, labelled_rows, eval_score, seen_vs_new, eval_per_layer, eval_per_category, eval_confusions, silent_errors, ablation)
    return {f.__name__: f for f in found}


def total(amount: str = "amount") -> str:
    return f"cast(sum(cast({amount} as decimal(28,2))) as double)"


def oracle_sql() -> dict:
    p = oracle.statement_prelude().rstrip()
    label = "case when coalesce(normalized_merchant, '') <> '' then normalized_merchant else '(opaque) ' || substr(counterparty, 1, 24) end"
    merchants = f""", rows_ as (select *, {label} as merchant from classified),
merchants as (select merchant, count(*) as n, median(amount) as median_amount, {total()} as total_amount, max(amount) as max_amount, array_to_string(list_sort(list(distinct counterparty)), '|') as raw_variants, count(*) filter (where txn_type = 'MONEY_RECEIVED') as n_received,
  min_by(category, row_number) as category, min_by(source, row_number) as source, min_by(confidence, row_number) as confidence, min_by(needs_review, row_number) as needs_review, min_by(evidence, row_number) as evidence from rows_ group by merchant)
"""
    keyed = ", keyed as (select *, coalesce(nullif(normalized_merchant, ''), nullif(canon, ''), raw) as key, case when is_credit then 'IN' else 'OUT' end as flow from classified)"
    labels = keyed + ", sheet as (select distinct idx, key, flow, case when idx = 29 then '' else truth end as t from keyed), labels as (select key, flow, max_by(t, idx) as truth from sheet where t <> '' group by key, flow)"
    labelled = labels + ", seen as (select distinct key from keyed where idx < 18), lab as (select k.row_number, k.key, k.flow, k.counterparty, k.amount, l.truth, k.category as pred, k.source, k.needs_review as review, s.key is not null as seen from keyed k join labels l on k.key = l.key and k.flow = l.flow left join seen s on k.key = s.key)"
    ratio = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0)::double, 9)"
    ok, auto = "pred = truth", "not review"
    count = lambda c: f"count(*) filter (where {c})"
    metrics = f"""count(*) as rows, {ratio(count(ok), "count(*)")} as accuracy, {ratio(f"coalesce(sum(cast(amount as decimal(28,2))) filter (where {ok}), 0)::double", "sum(cast(amount as decimal(28,2)))::double")} as accuracy_by_amount, {ratio(count(auto), "count(*)")} as coverage,
{ratio(count(f"{auto} and {ok}"), count(auto))} as auto_accuracy, {ratio(count(f"review and {ok}"), count("review"))} as flagged_accuracy, {count("pred <> truth")} as errors, {count(f"{auto} and pred <> truth")} as silent_errors, {ratio(f"({count('pred <> truth')} - {count(f'{auto} and pred <> truth')})", count("pred <> truth"))} as error_catch_rate"""
    place = lambda c, order: f"cast(list_position({oracle.strings(order)}, {c}) as int)"
    by = lambda c, order: p + f" select {c}, count(*) as n, {total()} as value, count(*)::double / (select count(*) from classified) as share" + (f", {place(c, order)} as place" if order else "") + f" from classified group by {c}"
    legacy = oracle.mapped("category", fixed.TO_LEGACY)
    listed = lambda c: f"(select '{{' || string_agg('\"' || {c} || '\":' || n, ',' order by {c}) || '}}' from (select {c}, count(*) as n from classified group by {c}))"
    return {
        "category_totals": p + f" select category, {total()} as total, count(*) as n from classified group by category",
        "legacy_totals": p + f" select {legacy} as legacy, count(*) as n, {total()} as total from classified group by 1",
        "report_headline": p
        + f""" select *, auto_classified / transactions as auto_classified_share, needs_review / transactions as needs_review_share, other / transactions as other_share from (select count(*) as transactions, count(*) filter (where not is_credit) as debits, count(*) filter (where is_credit) as credits,
  coalesce({total("case when not is_credit then amount end")}, 0) as debit_total, coalesce({total("case when is_credit then amount end")}, 0) as credit_total, count(*) filter (where not needs_review) as auto_classified, count(*) filter (where needs_review) as needs_review, count(*) filter (where category = 'OTHER') as other from classified)""",
        "report_by_category": by("category", fixed.CATEGORIES),
        "report_by_source": by("source", fixed.SOURCES),
        "report_by_txn_type": by("txn_type", None),
        "merchant_profile": p + merchants + "select * replace (round(median_amount, 2) as median_amount) from merchants",
        "vendor_like": p + merchants + "select merchant, n, category from merchants where category = 'PERSONAL_TRANSFER' and n >= 8 and median_amount / 10000 <= 150 and n_received = 0",
        "weak_rules": p + merchants + f"select merchant, n, category, evidence from merchants where source = 'RULE' and list_contains({oracle.strings(chr(39) + w + chr(39) for w in fixed.WEAK_RULES)}, replace(evidence, 'rule: ', ''))",
        "unresolved_top20": p + merchants + "select merchant, n, total_amount, category from merchants where needs_review order by total_amount desc, merchant limit 20",
        "odd_amounts": p + merchants + "select merchant, max_amount, category from merchants where category in ('GROCERIES', 'FOOD_AND_DINING') and max_amount >= 10000",
        "review_queue": p + " select row_number, amount, category, counterparty from classified where needs_review order by amount desc, row_number limit 50",
        "filtered_rows": p + " select row_number, counterparty from classified where (contains(lower(counterparty), 'sun') or contains(normalized_merchant, 'sun')) and category = 'GROCERIES' and source = 'RULE' and not needs_review",
        "web_summary": p + f" select count(*) filter (where needs_review) as needs_review, count(*) filter (where category = 'OTHER') as other, count(distinct normalized_merchant) as unique_merchants, {listed('category')} as by_category, {listed('source')} as by_source from classified",
        "merchant_map": "with "
        + ",".join([oracle.vocabularies(), oracle.pool_and_stmt(), oracle.named("pool", out="pool_n"), "keys as (select case when norm <> '' then norm else n.counterparty end as key, s.counterparty, count(*) as n from stmt s join pool_n n on s.idx = n.idx group by 1, 2)", "best as (select max_by(counterparty, (n, counterparty)) as counterparty, false as is_credit, 'Paid to' as direction from keys group by key)", oracle.named("best"), oracle.flags_and_verdicts()])
        + f" select counterparty as merchant, category, needs_review from {oracle.with_fuzzy()}",
        "merchant_names": p + keyed + " select min_by(counterparty, row_number) as merchant, case when flow = 'IN' then 'CREDIT' else 'DEBIT' end as type, min(row_number) as first_row from keyed group by key, flow",
        "label_sheet": p + keyed + f" select key, flow, min_by(counterparty, row_number) as example, count(*) as count, printf('%.2f', {total()}) as total_amount, min_by(direction, row_number) as direction, '' as true_category, '' as notes from keyed group by key, flow",
        "result_sheet": p
        + keyed
        + f", g as (select flow, min_by(counterparty, row_number) as example, {total()} as total, min_by(category, row_number) as predicted from keyed group by key, flow) select case when flow = 'IN' then example || ' (money in)' else example end as input, case when example = 'Metro Shoes' and flow = 'OUT' then 'SHOPPING' when example = 'Kavya' and flow = 'IN' then 'PERSONAL_TRANSFER' when example = 'KFC' and flow = 'IN' then 'OTHER' else '' end as actual, predicted, total from g",
        "labels_read": p + labels + " select key, flow, truth from labels",
        "labelled_rows": p + labelled + " select * from lab",
        "eval_score": p + labelled + f" select {metrics} from lab",
        "seen_vs_new": p + labelled + f" select seen, {metrics} from lab group by seen",
        "eval_per_layer": p + labelled + f" select source, count(*) as rows, {ratio(count(ok), 'count(*)')} as accuracy, {ratio(count(auto), 'count(*)')} as auto_share from lab group by source",
        "eval_per_category": p + labelled + f", c as (select truth as category from lab union select pred from lab) select c.category, count(*) filter (where truth = c.category) as support, {ratio('count(*) filter (where truth = c.category and pred = truth)', 'count(*) filter (where pred = c.category)')} as precision, {ratio('count(*) filter (where truth = c.category and pred = truth)', 'count(*) filter (where truth = c.category)')} as recall from c, lab group by c.category",
        "eval_confusions": p + labelled + " select truth, pred as predicted, count(*) as rows from lab where pred <> truth group by truth, pred order by rows desc, truth, predicted limit 10",
        "silent_errors": p + labelled + f" select min_by(counterparty, row_number) as merchant, truth, pred as predicted, source, count(*) as rows, {total()} as amount from lab where not review and pred <> truth group by key, truth, pred, source",
    }
