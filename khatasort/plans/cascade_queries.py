"""Queries of the cascade and its layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import cascade, ngram_model, similarity, vote
from . import oracle
from .statement import pool, read, stmt

#: Learned state for the queries: the user's overrides, learned merchants and rules.
OVERRIDES = (("sunrise kirana", "shopping"), ("asha verma", "GROCERIES"), ("", "FINANCE"))
LEARNED = (("kfc", "GROCERIES"), ("meenal", "HEALTH"), ("bharat traders", "SHOPPING"))
RULES = (("verma", "food", "token"), ("blue star", "TRAVEL", "phrase"), ("motors", "TRANSPORT", "token"), ("o", "OTHER", "token"))


def state(spark, rows):
    return spark.createDataFrame(list(rows), "key string, category string")


def classified(spark, sf_dir):
    """The derived statement with verdicts of the native layers, each distinct counterparty judged once."""
    return cascade.classify(stmt(spark, sf_dir), fuzzy=False)


def txn_types(spark, sf_dir):
    rows = text.computed(cascade.flagged(cascade.named(pool(spark))), {"kind": cascade.kind()})
    types = rows.select("idx", "kind.txn_type", "kind.type_confidence", "kind.type_reason")
    return stmt(spark, sf_dir).select("row_number", "idx").join(F.broadcast(types), "idx")


def override_hits(spark, sf_dir):
    rows = cascade.classify_native(stmt(spark, sf_dir), state(spark, OVERRIDES))
    return rows.where("source = 'USER_OVERRIDE'").select("row_number", "category", "confidence", "evidence")


def exact_directory(spark, sf_dir):
    rows = cascade.with_state(cascade.named(stmt(spark, sf_dir)), "known", state(spark, LEARNED))
    hit = F.when(F.col("norm") != "", F.coalesce("known", cascade.directory_hit(F.col("norm"))))
    return rows.select("row_number", hit.alias("category"))


def rule_hits(spark, sf_dir):
    """The rule that each transaction's name meets; a name is looked up once."""
    rows = stmt(spark, sf_dir).select("row_number", "counterparty")
    names = cascade.named(rows.select("counterparty").distinct())
    names = text.computed(names, {"rule": cascade.first_rule(F.col("norm"), F.col("canon"), text.ambiguous(F.col("norm"), F.col("canon")))})
    names = names.select(F.col("counterparty").alias("name"), "rule.pattern", "rule.category")
    return rows.join(names, F.col("counterparty").eqNullSafe(F.col("name")), "left").select("row_number", "pattern", "category")


def classify_names(spark, sf_dir):
    """The native layers over all names of parts, customers and suppliers, so that names grow with the data."""
    parts = [read(spark, sf_dir, name).select(F.col(column).alias("counterparty")) for name, column in (("part", "p_name"), ("customer", "c_name"), ("supplier", "s_name"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().select("counterparty", F.lit(False).alias("is_credit"), F.lit("Paid to").alias("direction"))
    return cascade.classify_native(rows).select("counterparty", *cascade.VERDICT)


def incoming_ladder(spark, sf_dir):
    return classified(spark, sf_dir).where("txn_type = 'MONEY_RECEIVED'").select("row_number", "category", "confidence", "needs_review", "evidence")


def classify_statement(spark, sf_dir):
    """The whole cascade, fuzzy matching included, over distinct counterparties."""
    return cascade.classify(stmt(spark, sf_dir)).select("row_number", "counterparty", *cascade.VERDICT)


def classify_with_state(spark, sf_dir):
    rows = cascade.classify(stmt(spark, sf_dir), state(spark, OVERRIDES), state(spark, LEARNED), fuzzy=False)
    return rows.select("row_number", *cascade.VERDICT)


def user_rule_hits(spark, sf_dir):
    rows = cascade.classify(stmt(spark, sf_dir), state(spark, OVERRIDES), fuzzy=False, user_rules=list(RULES))
    return rows.where("evidence like 'user rule%'").select("row_number", "category", "confidence", "txn_type", "evidence")


def verdict_json(spark, sf_dir):
    return classified(spark, sf_dir).select("row_number", cascade.verdict_json().alias("verdict"))


def fuzzy_corpus(spark, sf_dir):
    return cascade.corpus(spark, state(spark, LEARNED)).select("key", "category")


def _names(spark, sf_dir):
    return cascade.named(read(spark, sf_dir, "part").select(F.col("p_name").alias("counterparty"))).select("norm").union(cascade.named(pool(spark)).select("norm")).where("norm <> ''").distinct()


def _all_keys(spark, sf_dir):
    """The directory and the names of all parts, as known merchants; the directory's category holds."""
    built = cascade.corpus(spark).select("key", "category")
    parts = cascade.named(read(spark, sf_dir, "part").select(F.col("p_name").alias("counterparty"))).where("norm <> ''").select(F.col("norm").alias("key"), F.lit("SHOPPING").alias("category")).distinct()
    return built.unionByName(parts.join(built, "key", "left_anti"))


def fuzzy_anchor_pairs(spark, sf_dir):
    return similarity.anchor_pairs(_names(spark, sf_dir), _all_keys(spark, sf_dir))


def fuzzy_near_tokens(spark, sf_dir):
    words = _names(spark, sf_dir).select(F.explode(F.split("norm", " ")).alias("w")).distinct()
    keys = _all_keys(spark, sf_dir).select(F.explode(F.split("key", " ")).alias("w")).distinct()
    return similarity.near_tokens(words.withColumnRenamed("w", "a"), keys.withColumnRenamed("w", "b"))


def fuzzy_scores(spark, sf_dir):
    return similarity.scored_pairs(_names(spark, sf_dir), _all_keys(spark, sf_dir)).select("norm", "key", "score")


def fuzzy_matches(spark, sf_dir):
    rows = cascade.classify(stmt(spark, sf_dir))
    return rows.where("source = 'FUZZY_MATCH'").select("row_number", "category", "confidence", "evidence")


def _stub(names):
    """A predictor with a fixed answer for some names, in place of a trained model."""
    answer = F.when(F.col("norm").startswith("qwv"), F.struct(F.lit("GROCERIES").alias("category"), F.lit(0.99).alias("probability"))).when(F.col("norm").startswith("bharat"), F.struct(F.lit("PERSONAL_TRANSFER").alias("category"), F.lit(0.99).alias("probability"))).otherwise(F.struct(F.lit("TRAVEL").alias("category"), F.lit(0.74).alias("probability")))
    return names.select("norm", answer.alias("prediction"))


def model_gate(spark, sf_dir):
    rows = cascade.classify(stmt(spark, sf_dir), fuzzy=False, predict=_stub)
    return rows.select("row_number", *cascade.VERDICT)


def trained_model(spark, sf_dir):
    """The cascade with a model trained on the vocabularies and the statement itself."""
    rows = stmt(spark, sf_dir)
    model, labels = ngram_model.fit(ngram_model.training_set(cascade.classify_native(rows)))
    return cascade.classify(rows, predict=ngram_model.model_layer(model, labels)).select("row_number", *cascade.VERDICT)


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))


def knn_vote(spark, sf_dir):
    """Every vector whose id divides by 100 against all vectors that may be neighbours, but not itself."""
    rows = _vectors(spark, sf_dir)
    queries = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), "vector")
    index = vote.index_rows(rows.select(F.col("vec_id").alias("item"), "label", "vector"))
    found = vote.votes(vote.nearest(queries, index, apart=True))
    return found.select("query", "category", F.round("share", 4).alias("share"), F.round("similarity", 4).alias("similarity"), "nearest")


def knn_index(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, fixed.CATEGORIES)), (F.col("vec_id") % 14 + 1).cast("int"))
    return vote.index_rows(read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label")))


def training_set(spark, sf_dir):
    return ngram_model.training_set(classified(spark, sf_dir), state(spark, OVERRIDES), state(spark, LEARNED))


def train_report(spark, sf_dir):
    return ngram_model.train_report(training_set(spark, sf_dir))


def fallback_rows(spark, sf_dir):
    return ngram_model.fallback_rows(stmt(spark, sf_dir)).select("row_number", "category", "evidence")


def queries() -> dict:
    found = (txn_types, override_hits, exact_directory, rule_hits, classify_names, incoming_ladder, classify_statement, classify_with_state, user_rule_hits, verdict_json, fuzzy_corpus, fuzzy_anchor_pairs, fuzzy_near_tokens, fuzzy_scores, fuzzy_matches, model_gate, trained_model, knn_vote, knn_index, training_set, train_report, fallback_rows)
    return {f.__name__: f for f in found}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(oracle.quoted(x) for x in row) + ")" for row in rows)


def oracle_sql() -> dict:
    p = oracle.statement_prelude()
    given = f"own(key, category) as (values {_values(OVERRIDES)}), taught(key, category) as (values {_values(LEARNED)})"
    both = oracle.statement_prelude("(select category from own where key = n.norm and n.norm <> '')", "(select category from taught where key = n.norm)", given)
    verdict = "category, source, confidence, needs_review, txn_type, normalized_merchant, evidence"
    weak = oracle.strings(fixed.WEAK_ANCHORS)
    names_sql = (
        "with " + ",".join([oracle.vocabularies(), oracle.pool_and_stmt(), "src as (select counterparty, 0 as part from pool union all select p_name, 1 from part)", oracle.named("src")])
        + f""", needles as (select distinct norm from named where norm <> ''), known as (select key from directory union select norm from named where part = 1 and norm <> ''),
a as (select distinct norm, unnest(string_split(norm, ' ')) as t from needles), b as (select distinct key, unnest(string_split(key, ' ')) as t from known)
select distinct a.norm, b.key from a join b on a.t = b.t where length(a.t) >= 4 and not list_contains({weak}, a.t)"""
    )
    rule_cases = " ".join(f"when {'list_contains(string_split(norm, chr(32)), ' + oracle.quoted(pt) + ')' if k == 'token' else 'contains(norm, ' + oracle.quoted(pt) + ')'} then ({oracle.quoted(vocab_category(c))}, {oracle.quoted(pt)})" for pt, c, k in RULES)
    model = "case when source = 'FALLBACK' and not is_opaque and not is_ambiguous and norm <> ''"
    hint = "'; model suggests ' || case when norm like 'bharat%' then 'PERSONAL_TRANSFER (p=0.99)' else 'TRAVEL (p=0.74)' end"
    ranked = oracle.strings(ngram_model.ORIGINS)
    found = {
        "txn_types": p + "select s.row_number, s.idx, v.txn_type, v.type_confidence, v.type_reason from stmt s join verdicts v on s.idx = v.idx",
        "override_hits": both + "select row_number, category, confidence, evidence from classified where source = 'USER_OVERRIDE'",
        "exact_directory": both + "select s.row_number, v.directory_ as category from stmt s join verdicts v on s.idx = v.idx",
        "rule_hits": p + "select s.row_number, v.rule_pattern as pattern, v.rule_category as category from stmt s join verdicts v on s.idx = v.idx",
        "incoming_ladder": p + "select row_number, category, confidence, needs_review, evidence from classified where txn_type = 'MONEY_RECEIVED'",
        "classify_statement": oracle.statement_prelude(fuzzy=True) + f"select row_number, counterparty, {verdict} from classified",
        "fuzzy_matches": oracle.statement_prelude(fuzzy=True) + "select row_number, category, confidence, evidence from classified where source = 'FUZZY_MATCH'",
        "classify_with_state": both + f"select row_number, {verdict} from classified",
        "user_rule_hits": both + f", hits as (select *, case when source = 'USER_OVERRIDE' or norm = '' then null {rule_cases} end as h from verdicts) select s.row_number, h[1] as category, 0.92::double as confidence, 'PAYMENT_TO_MERCHANT' as txn_type, 'user rule: ''' || h[2] || '''' as evidence from stmt s join hits v on s.idx = v.idx where h is not null",
        "classify_names": "with "
        + ",".join([oracle.vocabularies(), "names as (select counterparty, false as is_credit, 'Paid to' as direction from (select p_name as counterparty from part union select c_name from customer union select s_name from supplier))", oracle.named("names"), oracle.flags_and_verdicts()])
        + f" select counterparty, {verdict} from verdicts",
        "verdict_json": p + "select row_number, cast(to_json({'category': category, 'source': source, 'confidence': confidence, 'needsReview': needs_review, 'txnType': txn_type, 'normalizedMerchant': normalized_merchant, 'evidence': evidence}) as varchar) as verdict from classified",
        "fuzzy_corpus": f"with {oracle.vocabularies()}, {given} select coalesce(d.key, t.key) as key, coalesce(t.category, d.category) as category from directory d full outer join taught t on d.key = t.key",
        "fuzzy_anchor_pairs": names_sql,
        "model_gate": p
        + f""", g as (select v.*, {model} then true else false end as asked from verdicts v), m as (select *,
  case when asked and norm like 'qwv%' then ('GROCERIES', 'ML_MODEL', 0.89::double, false, 'model: p=0.99')
  when asked then (category, source, confidence, needs_review, case when evidence in ('no layer matched', 'short non-commercial name, likely a person') then evidence || {hint} else evidence end)
  else (category, source, confidence, needs_review, evidence) end as w from g)
select s.row_number, w[1] as category, w[2] as source, w[3] as confidence, w[4] as needs_review, m.txn_type, m.normalized_merchant, w[5] as evidence from stmt s join m on s.idx = m.idx""",
        "knn_vote": """with e as (select vec_id, embedding::double[] as v, cast(label as varchar) as label from embeddings),
pairs as (select q.vec_id as query, i.vec_id as item, i.label, list_dot_product(q.v, i.v) as similarity from e q, e i where q.vec_id % 100 = 0 and i.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query order by similarity desc, item) as place from pairs), near as (select * from ranked where place <= 5),
per as (select query, label, sum(greatest(similarity, 0)) as weight, min(place) as first from near group by query, label),
shares as (select *, weight / sum(weight) over (partition by query) as share from per),
best as (select *, row_number() over (partition by query order by share desc, first) as k from shares)
select b.query, b.label as category, round(b.share, 4) as share, round(n.similarity, 4) as similarity, n.item as nearest from best b join near n on b.query = n.query and n.place = 1 where k = 1""",
        "knn_index": f"select * from (select vec_id, {oracle.strings(fixed.CATEGORIES)}[vec_id % 14 + 1] as label from embeddings) where label not in {fixed.NO_INDEX}",
        "training_set": p.replace("with ", f"with {given},", 1)
        + f""", ruled as (select pattern as counterparty, i, category from rules), {oracle.named("ruled", out="ruled_n")},
every as (select norm as text, category as label, i as place, 'rule' as origin from ruled_n union all select key, category, place, 'built-in' from directory
  union all select normalized_merchant, case when not needs_review then case when source in {fixed.IDENTITY_SOURCES} and txn_type = 'PAYMENT_TO_MERCHANT' then category when source = 'TXN_TYPE' and txn_type = 'PAYMENT_TO_PERSON' then 'PERSONAL_TRANSFER' end end, row_number, 'statement' from classified where not is_credit
  union all select key, category, 0, 'learned' from taught union all select key, category, 0, 'override' from own),
clean as (select text, {oracle.coerce("label")} as label, list_position({ranked}, origin) as rank, place, origin from every where label is not null and text <> ''),
best as (select *, row_number() over (partition by text order by rank desc, place desc, label desc) as k from clean where label not in ('INCOME', 'OTHER'))
select text, label, origin, case when origin = 'override' then 3.0::double else 1.0::double end as weight from best where k = 1""",
        "fallback_rows": p + "select row_number, category, evidence from classified where source = 'FALLBACK' and not is_credit",
    }
    return found | {"train_report": f"select origin, label, count(*) as n, sum(weight) as weight from ({found['training_set']}) group by origin, label"}


def vocab_category(name: str) -> str:
    up = name.strip().upper().replace(" ", "_").replace("-", "_")
    return up if up in fixed.CATEGORIES else fixed.FROM_LEGACY.get(name.strip().lower(), "OTHER")


