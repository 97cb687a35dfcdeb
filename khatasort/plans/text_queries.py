"""Queries of the text functions, over free-text columns of the driver's tables and the pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators.cascade import is_incoming, named
from ..operators.ngram_model import feature_counts
from . import oracle
from .statement import pool, read, stmt

#: Free-text columns: (table, key, column).
COLUMNS = (("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"))


def names(spark, sf_dir):
    """Every name of the four tables and the pool: src, id, counterparty."""
    out = pool(spark).select(F.lit("pool").alias("src"), F.col("idx").cast("long").alias("id"), "counterparty")
    for table, key, column in COLUMNS:
        out = out.union(read(spark, sf_dir, table).select(F.lit(table), F.col(key).cast("long"), F.col(column)))
    return out


NAMES = "names as (select 'pool' as src, cast(idx as bigint) as id, counterparty from pool" + "".join(f" union all select '{t}', cast({k} as bigint), {c} from {t}" for t, k, c in COLUMNS) + ")"


def over_names() -> str:
    return "with " + ",".join([oracle.vocabularies(), oracle.pool_and_stmt(), NAMES, oracle.named("names")]) + "\n"


def _named(spark, sf_dir):
    return named(names(spark, sf_dir))


def canon_names(spark, sf_dir):
    return names(spark, sf_dir).select("src", "id", text.canon(F.col("counterparty")).alias("canon"))


def normalize_merchants(spark, sf_dir):
    return _named(spark, sf_dir).select("src", "id", "norm")


def normalize_persons(spark, sf_dir):
    return names(spark, sf_dir).select("src", "id", text.normalize_person(F.col("counterparty")).alias("person"))


def opaque_flags(spark, sf_dir):
    return names(spark, sf_dir).select("src", "id", text.opaque(F.col("counterparty")).alias("is_opaque"))


def person_shape(spark, sf_dir):
    return names(spark, sf_dir).select("src", "id", text.person(F.col("counterparty")).alias("is_person"))


def commercial_flags(spark, sf_dir):
    return names(spark, sf_dir).select("src", "id", text.commercial(F.col("counterparty")).alias("is_commercial"))


def marker_flags(spark, sf_dir):
    c = F.col("counterparty")
    return names(spark, sf_dir).select("src", "id", text.income_marker(c).alias("has_income"), text.refund_marker(c).alias("has_refund"), text.mobile_number(text.stripped(c)).alias("is_mobile"))


def ambiguous_flags(spark, sf_dir):
    return _named(spark, sf_dir).select("src", "id", text.ambiguous(F.col("norm"), F.col("canon")).alias("is_ambiguous"))


def merchant_keys(spark, sf_dir):
    return _named(spark, sf_dir).select("src", "id", text.merchant_key(F.col("norm"), F.col("canon"), F.col("counterparty")).alias("key"))


def ngram_counts(spark, sf_dir):
    rows = _named(spark, sf_dir).select("norm").distinct()
    return rows.select(F.explode(text.grams(F.col("norm"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def ngram_features(spark, sf_dir):
    found = feature_counts(_named(spark, sf_dir))
    return found.select("norm", "bucket", "count", F.round("weight", 9).alias("weight"))


def coerce_categories(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("Food", " food-and dining ", "groceries", "EDU", "nothing", "Personal Transfer", ""))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", text.coerce_category(F.col("raw")).alias("category"), text.is_category(F.col("raw")).alias("is_valid"))


def parse_amount(spark, sf_dir):
    from ..sources.statement import parse_amount as parse

    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    forms = F.element_at(F.array(F.concat(F.lit("1,"), p), F.concat(F.lit("Rs "), p), F.concat(F.lit("-"), p), F.concat(p, F.lit(" Dr")), F.lit("none"), F.lit("Rs.500"), F.lit("(500)")), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", parse(forms).alias("amount"))


def parse_date(spark, sf_dir):
    from ..sources.statement import parse_date as parse

    d = F.col("o_orderdate")
    forms = [F.date_format(d, x) for x in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss")]
    shown = F.element_at(F.array(*forms, F.lit("not-a-date")), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(parse(shown), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def parse_time(spark, sf_dir):
    from ..sources.statement import parse_time as parse

    t = F.col("ts")
    forms = [F.date_format(t, x) for x in ("HH:mm", "HH:mm:ss", "hh:mm a", "h:mm:ss a")]
    shown = F.element_at(F.array(*forms, F.lit("25:99")), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", parse(shown).alias("x")).select("event_id", "x.hour", "x.minute")


def _signs(spark, sf_dir):
    from ..sources.statement import sign

    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = (F.col("o_orderkey") % 8).cast("int")
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), k + 1)
    debit, credit = pick(p, "", p, "", "", "", "", ""), pick("", p, p, "", "", "", "", "")
    amount = pick("", "", "", "", p, F.concat(F.lit("-"), p), p, "0")
    kind = pick("", "", "", "", "Credit", "", "DR", "")
    found = sign(debit, credit, amount, kind, F.lit(""), pick("", "", "", "", "", "", "", "in"), k <= 3)
    return read(spark, sf_dir, "orders").select("o_orderkey", found.alias("s"))


def resolve_sign(spark, sf_dir):
    return _signs(spark, sf_dir).select("o_orderkey", "s.amount", "s.is_credit")


def signed_amount(spark, sf_dir):
    from ..sources.statement import signed

    return stmt(spark, sf_dir).select("row_number", signed(F.col("amount"), F.col("is_credit")).alias("signed_amount"))


def incoming_flags(spark, sf_dir):
    from ..operators.cascade import flagged, kind

    rows = text.computed(flagged(named(pool(spark))), {"kind": kind()})
    return rows.select("idx", is_incoming(F.col("kind.txn_type")).alias("is_incoming"))


PERSON = rf"""array_to_string(case when len(t) >= 2 and len(t) % 2 = 0 and t[1 : len(t) // 2] = t[len(t) // 2 + 1 :] then t[1 : len(t) // 2] else t end, ' ')"""


def queries() -> dict:
    found = (canon_names, normalize_merchants, normalize_persons, opaque_flags, person_shape, commercial_flags, marker_flags, ambiguous_flags, merchant_keys, ngram_counts, ngram_features, coerce_categories, parse_amount, parse_date, parse_time, resolve_sign, signed_amount, incoming_flags)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    q = oracle.quoted
    n = over_names()
    strip = r"regexp_replace(coalesce(counterparty, ''), '^\s+|\s+$', '', 'g')"
    person = rf"""regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(raw, {q(fixed.PREFIX)}, '', 'i'), {q(fixed.MASKED)}, ' ', 'gi'), {q(fixed.SEPARATORS)}, ' ', 'g')), '[a-z0-9]+')"""
    grams = " union all ".join(f"select norm, substr(p, cast(i as int), {k}) as gram from (select norm, p, unnest(range(1, length(p) - {k} + 2)) as i from padded)" for k in fixed.GRAM_LENGTHS)
    amount = "cast(cast(o_totalprice as decimal(18,2)) as varchar)"
    return {
        "canon_names": n + "select src, id, array_to_string(regexp_extract_all(lower(coalesce(counterparty, '')), '[a-z0-9]+'), ' ') as canon from names",
        "normalize_merchants": n + "select src, id, norm from named",
        "normalize_persons": n + f"select src, id, {PERSON} as person from (select src, id, {person} as t from named)",
        "opaque_flags": n + f"select src, id, regexp_matches({strip}, {q(fixed.MASKED_WHOLE)}) or regexp_matches({strip}, {q(fixed.BARE_REFERENCE)}) as is_opaque from names",
        "person_shape": n + f"select src, id, {oracle.person('counterparty')} as is_person from names",
        "commercial_flags": n + f"select src, id, {oracle.commercial('counterparty')} as is_commercial from names",
        "marker_flags": n + f"select src, id, regexp_matches(counterparty, {q(fixed.INCOME_TEXT)}, 'i') as has_income, regexp_matches(counterparty, {q(fixed.REFUND_TEXT)}, 'i') as has_refund, regexp_matches({strip}, {q(fixed.MOBILE)}) as is_mobile from names",
        "ambiguous_flags": n + "select src, id, " + " or ".join(f"contains(norm, {q(p)}) or contains(canon, {q(p)})" for p in fixed.AMBIGUOUS) + " as is_ambiguous from named",
        "merchant_keys": n + "select src, id, coalesce(nullif(norm, ''), nullif(canon, ''), raw) as key from named",
        "ngram_counts": n.rstrip() + f""", texts as (select distinct norm from named where norm <> ''), terms as (select norm, unnest(string_split(norm, ' ')) as w from texts), padded as (select norm, ' ' || w || ' ' as p from terms),
grams as (select norm, 'w:' || w as gram from terms union all {grams}) select gram, count(*) as n from grams group by gram""",
        "ngram_features": n.rstrip() + f""", texts as (select distinct norm from named where norm <> ''), terms as (select norm, unnest(string_split(norm, ' ')) as w from texts), padded as (select norm, ' ' || w || ' ' as p from terms),
grams as (select norm, 'w:' || w as gram from terms union all {grams}),
crc as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as bytes),
hashed as (select gram, xor(list_reduce(list_concat([4294967295], list_transform(string_split(gram, ''), lambda x: unicode(x)::bigint)), lambda c, b: xor(c >> 8, bytes[xor(c, b) % 256 + 1])), 4294967295) % {fixed.FEATURES} as bucket from (select distinct gram from grams), crc),
counted as (select norm, cast(bucket as int) as bucket, count(*) as count from grams join hashed using (gram) group by norm, bucket)
select norm, bucket, count, round(count / sqrt(sum(count * count) over (partition by norm)), 9) as weight from counted""",
        "coerce_categories": f"with r as (select o_orderkey, ['Food', ' food-and dining ', 'groceries', 'EDU', 'nothing', 'Personal Transfer', ''][o_orderkey % 7 + 1] as raw from orders) select o_orderkey, {oracle.coerce('raw')} as category, list_contains({oracle.strings(fixed.CATEGORIES)}, raw) as is_valid from r",
        "parse_amount": f"with r as (select o_orderkey, ['1,' || {amount}, 'Rs ' || {amount}, '-' || {amount}, {amount} || ' Dr', 'none', 'Rs.500', '(500)'][o_orderkey % 7 + 1] as s from orders) select o_orderkey, try_cast(nullif(regexp_extract(replace(s, ',', ''), {q(fixed.NUMBER)}), '') as double) as amount from r",
        "parse_date": "select o_orderkey, case when o_orderkey % 9 = 8 then null when o_orderkey % 9 = 7 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') else strftime(o_orderdate, '%Y-%m-%d 00:00:00') end as parsed from orders",
        "parse_time": "select event_id, case when event_id % 5 < 4 then cast(hour(ts) as int) end as hour, case when event_id % 5 < 4 then cast(minute(ts) as int) end as minute from events",
        "resolve_sign": "with r as (select o_orderkey, o_orderkey % 8 as k, cast(cast(o_totalprice as decimal(18,2)) as double) as p from orders) select o_orderkey, case when k in (3, 7) then null else p end as amount, case when k in (3, 7) then null else k in (1, 4) end as is_credit from r",
        "signed_amount": "with " + oracle.pool_and_stmt() + " select row_number, case when is_credit then amount else -amount end as signed_amount from stmt",
        "incoming_flags": oracle.statement_prelude() + "select idx, txn_type in ('MONEY_RECEIVED', 'REFUND') as is_incoming from verdicts",
    }
