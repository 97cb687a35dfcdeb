"""Queries of the statement source and its exports, over CSV files made from the derived statement.

Each file holds the orders of 500 keys, with some rows spoilt (no name, no date, no amount) and some twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cascade import VERDICT
from ..sources import export, statement
from . import oracle
from .statement import stmt

KEYS_A_FILE = 500
HEADER = "Date,Time,Direction,Counterparty,Transaction ID,UTR,Account Flow,Account Last4,Type,Amount"


def files(spark, sf_dir):
    """path and content of the statement files; each is gathered from at most 2 * KEYS_A_FILE rows."""
    k = F.col("row_number") % 50
    cell = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    day = F.when(k == 13, "not-a-date").otherwise(F.date_format("occurred_at", "dd-MMM-yyyy"))
    name = F.when(k == 7, "").when((k == 29) & (F.col("counterparty") != ""), F.concat(F.col("counterparty"), F.lit(', "Pune"'))).otherwise(F.col("counterparty"))
    amount = F.when(k == 19, "0").otherwise(F.format_number("amount", 2))
    line = F.concat_ws(",", *map(cell, (day, F.lit("10:30 AM"), F.col("direction"), name, F.when(k == 3, "").otherwise(F.col("transaction_id")), F.lit(""), F.lit(""), F.lit("1234"), F.when(F.col("is_credit"), "CREDIT").otherwise("DEBIT"), amount)))
    rows = stmt(spark, sf_dir).select((F.col("row_number") / KEYS_A_FILE).cast("long").alias("file"), "row_number", F.when(k.isin(3, 23), F.concat(line, F.lit("\n"), line)).otherwise(line).alias("line"))
    packed = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row_number", "line"))).alias("x"))
    content = F.concat(F.lit(f"﻿My bank\nAccount summary\n{HEADER}\n"), F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit("\n,,,,,,,,,\n"))
    return packed.select(F.concat(F.lit("file-"), F.col("file").cast("string")).alias("path"), F.encode(content, "UTF-8").alias("content"))


def _parsed(spark, sf_dir):
    return statement.parse(statement.scan(files(spark, sf_dir)))


def scan_rows(spark, sf_dir):
    return statement.scan(files(spark, sf_dir)).select("path", "row_number", F.size("cells").cast("long").alias("n_cells"))


def problem_counts(spark, sf_dir):
    return statement.problem_counts(_parsed(spark, sf_dir))


def import_metrics(spark, sf_dir):
    return statement.metrics(_parsed(spark, sf_dir))


def dedupe_rows(spark, sf_dir):
    return _parsed(spark, sf_dir).where("is_duplicate").select("path", "row_number", "transaction_id")


def parsed_rows(spark, sf_dir):
    return statement.good(_parsed(spark, sf_dir)).select("path", "row_number", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), "counterparty", "amount", "is_credit", "direction", "transaction_id", "account_last4", F.try_element_at("raw", F.lit("Time")).alias("raw_time"))


def categorize_rows(spark, sf_dir):
    found = export.categorized(_parsed(spark, sf_dir), fuzzy=False)
    return found.select("path", "row_number", "status", *(c for c in VERDICT if c != "confidence"), F.when(F.col("status") == "ok", F.format_string("%.2f", "confidence")).alias("confidence"))


def export_summary(spark, sf_dir):
    return export.export_summary(export.categorized(_parsed(spark, sf_dir), fuzzy=False))


def queries() -> dict:
    found = (scan_rows, problem_counts, import_metrics, dedupe_rows, parsed_rows, categorize_rows, export_summary)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    p = (
        "with "
        + ",".join(
            [
                oracle.vocabularies(),
                oracle.pool_and_stmt(),
                f"""copies as (select *, row_number as o, row_number % 50 as k, unnest(case when row_number % 50 in (3, 23) then [1, 2] else [1] end) as copy from stmt),
lines as (select idx, o, k, copy, 'file-' || (o // {KEYS_A_FILE}) as path, cast(row_number() over (partition by o // {KEYS_A_FILE} order by o, copy) + 3 as int) as row_number,
  case when k = 7 then '' when k = 29 and counterparty <> '' then counterparty || ', "Pune"' else counterparty end as counterparty, direction, is_credit, round(amount, 2) as amount, occurred_at, case when k = 3 then '' else transaction_id end as transaction_id from copies),
parsed as (select *, case when counterparty = '' then 'blank counterparty' when k = 13 then 'unparseable date' when k = 19 then 'missing or zero amount' end as problem, copy = 2 and counterparty <> '' as is_duplicate from lines)""",
                "memo as (select distinct counterparty, direction, is_credit from parsed where problem is null and not is_duplicate)",
                oracle.named("memo"),
                oracle.flags_and_verdicts(),
            ]
        )
        + "\n"
    )
    good = "problem is null and not is_duplicate"
    done = "out_ as (select p.path, p.row_number, case when problem is not null then 'skipped: ' || problem when is_duplicate then 'skipped: duplicate of an earlier row' else 'ok' end as status, p.problem, p.is_duplicate, v.category, v.source, v.needs_review, v.txn_type, v.normalized_merchant, v.evidence, v.confidence from parsed p left join verdicts v on p.problem is null and not p.is_duplicate and p.counterparty = v.counterparty and p.direction = v.direction and p.is_credit = v.is_credit)"
    tail = p.rstrip() + ", " + done + " "
    return {
        "scan_rows": p + "select path, row_number, 10::bigint as n_cells from parsed",
        "problem_counts": p + "select problem, count(*) as n from parsed where problem is not null group by problem",
        "import_metrics": p + f"select count(*) as total_rows, count(problem) as skipped, count(*) filter (where is_duplicate and problem is null) as duplicates, count(*) filter (where {good}) as parsed from parsed",
        "dedupe_rows": p + "select path, row_number, transaction_id from parsed where is_duplicate",
        "parsed_rows": p + f"select path, row_number, strftime(occurred_at, '%Y-%m-%d 10:30:00') as occurred_at, counterparty, amount, is_credit, direction, transaction_id, '1234' as account_last4, '10:30 AM' as raw_time from parsed where {good}",
        "categorize_rows": tail + "select path, row_number, status, category, source, needs_review, txn_type, normalized_merchant, evidence, case when status = 'ok' then printf('%.2f', confidence) end as confidence from out_",
        "export_summary": tail + "select count(*) as input_rows, count(*) filter (where status = 'ok') as classified, count(*) filter (where status = 'ok' and needs_review) as needs_review, count(problem) as skipped, count(*) filter (where is_duplicate) as duplicates from out_",
    }
