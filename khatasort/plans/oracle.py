"""The statement queries' SQL twins for DuckDB: a shared prelude of views, then a select for each query."""

from __future__ import annotations

from ..functions import fixed, vocabulary
from .statement import FUZZY_ROW, FUZZY_VERDICT, POOL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def named(source: str, column: str = "counterparty", out: str = "named") -> str:
    """CTEs that add raw, norm and canon of a column to a source's rows, as ``out``."""
    corporate = strings(fixed.CORPORATE)
    return rf"""
{out}_1 as (select *, regexp_replace(coalesce({column}, ''), '^\s+|\s+$', '', 'g') as raw from {source}),
{out}_2 as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, {quoted(fixed.PREFIX)}, '', 'i'), {quoted(fixed.MESSRS)}, '', 'i'), {quoted(fixed.MASKED)}, ' ', 'gi'), {quoted(fixed.SEPARATORS)}, ' ', 'g') as s_ from {out}_1),
{out}_3 as (select * exclude (s_), list_filter(string_split_regex(lower(s_), '\s+'), lambda t: t <> '' and not ((regexp_matches(t, '^[a-z0-9]{{8,}}$') and regexp_matches(t, '[0-9]')) or regexp_matches(t, '^\d{{5,}}$') or regexp_matches(t, '^[*x]{{2,}}[0-9]*$')) and not list_contains({corporate}, t)) as t_ from {out}_2),
{out}_4 as (select *, coalesce(list_position(list_transform(list_reverse(t_), lambda t: not regexp_matches(t, '^[a-z]{{0,3}}\d{{1,5}}$|^\d+$')), true), 0) as back_ from {out}_3),
{out}_5 as (select * exclude (t_, back_), case when len(t_) > 1 then t_[1 : case when back_ = 0 then 1 else len(t_) - back_ + 1 end] else t_ end as t_ from {out}_4),
{out}_6 as (select * exclude (t_), case when len(t_) >= 2 and len(t_) % 2 = 0 and t_[1 : len(t_) // 2] = t_[len(t_) // 2 + 1 :] then t_[1 : len(t_) // 2] else t_ end as t_ from {out}_5),
{out} as (select * exclude (t_), array_to_string(regexp_extract_all(array_to_string(t_, ' '), '[a-z0-9]+'), ' ') as norm, array_to_string(regexp_extract_all(lower(raw), '[a-z0-9]+'), ' ') as canon from {out}_6)"""


def commercial(column: str) -> str:
    return rf"list_has_any(string_split_regex(lower({column}), '\s+'), (select words from commercial))"


def person(column: str) -> str:
    t = rf"list_transform(list_filter(string_split_regex(regexp_replace({column}, {quoted(fixed.HONORIFIC)}, '', 'i'), '\s+'), lambda t: t <> ''), lambda t: regexp_replace(t, '([A-Za-z])\d+$', '\1'))"
    return rf"(len({t}) between 2 and 5 and len(list_filter({t}, lambda t: not regexp_matches(t, '^\p{{L}}+$'))) = 0 and not list_has_any(list_transform({t}, lambda t: lower(t)), (select words from commercial)))"


def starts(column: str, verbs) -> str:
    return "(" + " or ".join(f"starts_with({column}, {quoted(v)})" for v in verbs) + ")"


def mapped(column: str, table: dict) -> str:
    return "case " + " ".join(f"when {column} = {quoted(k)} then {quoted(v)}" for k, v in table.items()) + " end"


def coerce(column: str) -> str:
    clean = rf"regexp_replace(coalesce({column}, ''), '^\s+|\s+$', '', 'g')"
    up = f"translate(upper({clean}), ' -', '__')"
    return f"case when list_contains({strings(fixed.CATEGORIES)}, {up}) then {up} else coalesce({mapped(f'lower({clean})', fixed.FROM_LEGACY)}, 'OTHER') end"


def vocabularies() -> str:
    v = vocabulary.load()
    rules = ", ".join(f"({i}, {quoted(p)}, {quoted(c)}, {quoted(k)})" for i, (p, c, k) in enumerate(v.rules))
    directory = ", ".join(f"({i}, {quoted(k)}, {quoted(c)})" for i, (k, c) in enumerate(v.directory))
    return f"""
rules(i, pattern, category, kind) as (values {rules}),
directory(place, key, category) as (values {directory}),
commercial as (select {strings(v.commercial)} as words)"""


def pool_and_stmt() -> str:
    rows = ", ".join(f"({i}, {quoted(c)}, {quoted(d)}, {str(k).lower()}, {quoted(t)})" for i, (c, d, k, t) in enumerate(POOL))
    return f"""
pool(idx, counterparty, direction, is_credit, truth) as (values {rows}),
stmt as (select p.idx, o_orderkey as row_number, p.counterparty, p.direction, p.is_credit, o_totalprice as amount, o_orderdate as occurred_at, 'T' || o_orderkey as transaction_id, p.truth
  from orders join pool p on o_orderkey % {len(POOL)} = p.idx)"""


def flags_and_verdicts(source: str = "named", out: str = "verdicts", override: str = "null::varchar", known: str = "null::varchar") -> str:
    """CTEs that add kind and verdict to named rows that have direction and is_credit; override and known are expressions over n.norm."""
    legacy = strings(fixed.SERVICE_LABELS)
    return rf"""
{out}_f as (select n.*, array_to_string(list_filter(string_split_regex(lower(coalesce(direction, '')), '\s+'), lambda t: t <> ''), ' ') as d,
  regexp_matches(raw, {quoted(fixed.MASKED_WHOLE)}) or regexp_matches(raw, {quoted(fixed.BARE_REFERENCE)}) as is_opaque,
  {person("coalesce(nullif(norm, ''), raw)")} as is_person,
  {commercial("coalesce(nullif(norm, ''), raw)")} as norm_commercial, {commercial("canon")} as canon_commercial, {commercial("raw")} as raw_commercial,
  {" or ".join(f"contains(norm, {quoted(p)}) or contains(canon, {quoted(p)})" for p in fixed.AMBIGUOUS)} as is_ambiguous,
  regexp_matches(raw, {quoted(fixed.INCOME_TEXT)}, 'i') as has_income, regexp_matches(raw, {quoted(fixed.REFUND_TEXT)}, 'i') as has_refund,
  len(string_split(norm, ' ')) <= 2 and regexp_matches(norm, '^[a-z ]+$') as is_short,
  {override} as override_, coalesce({known}, (select category from directory where key = n.norm and n.norm <> '')) as directory_,
  (select min_by(pattern, i) from rules r where n.norm <> '' and case when kind = 'token' then list_contains(string_split(n.norm, ' '), r.pattern) else contains(n.norm, r.pattern) or contains(n.canon, r.pattern) end) as rule_any,
  (select min_by(category, i) from rules r where n.norm <> '' and case when kind = 'token' then list_contains(string_split(n.norm, ' '), r.pattern) else contains(n.norm, r.pattern) or contains(n.canon, r.pattern) end) as rule_any_category
  from {source} n),
{out}_k as (select *, case when is_ambiguous then null else rule_any end as rule_pattern, case when is_ambiguous then null else rule_any_category end as rule_category,
  case when {starts("d", fixed.REFUND_VERBS)} then ('REFUND', 0.99, 'direction says refund')
    when is_credit and has_refund then ('REFUND', 0.90, 'credit with refund keyword')
    when {starts("d", fixed.IN_VERBS)} then ('MONEY_RECEIVED', 0.99, 'direction says received')
    when d = '' and is_credit then ('MONEY_RECEIVED', 0.90, 'positive amount')
    when list_contains({legacy}, norm) or list_contains({strings(fixed.BILL_VERBS)}, d) then ('PAYMENT_TO_MERCHANT', 0.99, 'service/bill label')
    when raw = '' then ('UNKNOWN', 0.00, 'empty counterparty')
    when is_opaque then ('UNKNOWN', 0.60, 'opaque/masked counterparty')
    when norm_commercial or canon_commercial then ('PAYMENT_TO_MERCHANT', 0.95, 'commercial keyword')
    when is_person then ('PAYMENT_TO_PERSON', 0.85, 'person-name shape')
    when {starts("d", fixed.OUT_VERBS)} or (d = '' and not is_credit) then ('UNKNOWN', 0.30, 'outgoing, indeterminate counterparty')
    else ('UNKNOWN', 0.00, 'no usable signal') end as k from {out}_f),
{out}_t as (select *, k[1] as txn_type, cast(k[2] as double) as type_confidence, k[3] as type_reason from {out}_k),
{out}_v as (select *, case
    when override_ is not null and norm <> '' then ({coerce("override_")}, 'USER_OVERRIDE', 1.0, false, 'user override on ''' || norm || '''')
    when txn_type = 'REFUND' then ('INCOME', 'TXN_TYPE', 0.95, false, type_reason)
    when txn_type = 'MONEY_RECEIVED' and has_income then ('INCOME', 'TXN_TYPE', 0.95, false, 'income keyword')
    when txn_type = 'MONEY_RECEIVED' and canon_commercial then ('INCOME', 'TXN_TYPE', 0.90, false, 'credit from a business')
    when txn_type = 'MONEY_RECEIVED' and (directory_ is not null or rule_pattern is not null) then ('INCOME', 'TXN_TYPE', 0.90, false, 'credit from a known merchant')
    when txn_type = 'MONEY_RECEIVED' and (is_person or is_opaque) then ('PERSONAL_TRANSFER', 'TXN_TYPE', 0.90, false, 'credit from an individual')
    when txn_type = 'MONEY_RECEIVED' and is_short then ('PERSONAL_TRANSFER', 'TXN_TYPE', 0.60, true, 'credit from a short plain name, likely a person')
    when txn_type = 'MONEY_RECEIVED' then ('INCOME', 'TXN_TYPE', 0.60, true, 'credit from an unrecognized counterparty')
    when raw = '' then ('OTHER', 'FALLBACK', 0.0, true, 'empty counterparty')
    when directory_ is not null then (directory_, 'EXACT_MERCHANT', 0.97, false, 'directory: ''' || norm || '''')
    when rule_pattern is not null then (rule_category, 'RULE', 0.90, false, 'rule: ''' || rule_pattern || '''')
    when txn_type = 'PAYMENT_TO_PERSON' then ('PERSONAL_TRANSFER', 'TXN_TYPE', 0.90, false, type_reason)
    when is_opaque then ('PERSONAL_TRANSFER', 'FALLBACK', 0.70, true, 'masked account/UPI handle')
    when regexp_matches(raw, {quoted(fixed.MOBILE)}) then ('PERSONAL_TRANSFER', 'FALLBACK', 0.60, true, 'bare mobile number, UPI to a person')
    when not is_credit and is_short and not raw_commercial then ('PERSONAL_TRANSFER', 'FALLBACK', 0.55, true, 'short non-commercial name, likely a person')
    else ('OTHER', 'FALLBACK', 0.0, true, 'no layer matched') end as v from {out}_t),
{out} as (select * exclude (k, v), v[1] as category, v[2] as source, cast(v[3] as double) as confidence, v[4] as needs_review, v[5] as evidence, norm as normalized_merchant from {out}_v)"""


def with_fuzzy(verdicts: str = "verdicts") -> str:
    """A view of verdicts in which fuzzy matching has judged its name."""
    category, source, confidence, review, evidence = FUZZY_VERDICT
    name = f"counterparty = {quoted(POOL[FUZZY_ROW][0])}"
    cases = {"category": quoted(category), "source": quoted(source), "confidence": f"{confidence}::double", "needs_review": str(review).lower(), "evidence": quoted(evidence)}
    return f"(select * replace ({', '.join(f'case when {name} then {v} else {c} end as {c}' for c, v in cases.items())}) from {verdicts})"


def statement_prelude(override: str = "null::varchar", known: str = "null::varchar", extra: str = "", fuzzy: bool = False) -> str:
    """All views: verdicts has a row a pool entry, classified a row a transaction; fuzzy: with that layer's verdict."""
    return (
        "with "
        + ",".join([vocabularies(), pool_and_stmt(), *([extra] if extra else []), named("pool"), flags_and_verdicts(override=override, known=known)])
        + f""",
classified as (select s.*, v.category, v.source, v.confidence, v.needs_review, v.txn_type, v.normalized_merchant, v.evidence, v.canon, v.raw
  from stmt s join {with_fuzzy() if fuzzy else "verdicts"} v on s.idx = v.idx)
"""
    )


def on_column(table: str, column: str, keys: str) -> str:
    """Views for a free-text column of a table: named has keys, raw, norm, canon."""
    return "with " + ",".join([vocabularies(), f"src as (select {keys}, {column} as counterparty from {table})", named("src")]) + "\n"
