"""What a transaction is and which category it has, as native expressions over distinct counterparties.

``kind`` tells payments, refunds and money received apart.  ``classify`` runs the cascade: user override, refund and
received exits, directory, rules, person shape, fuzzy match, model, flagged short answers, vector vote, OTHER.  All
layers but fuzzy matching, the model and the vote are one projection without a shuffle: the ordered rules are a literal
array that is searched for its first hit.  Those three see only the names that the layers before left open, once each.
Learned state comes in as frames; nothing is global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, vocabulary

MEMO = ("counterparty", "is_credit", "direction")
VERDICT = ("category", "source", "confidence", "needs_review", "txn_type", "normalized_merchant", "evidence")


def named(rows: DataFrame, column: str = "counterparty") -> DataFrame:
    """plain (the stripped text), norm, canon and d (the direction) beside the rows; own columns of these names give way."""
    rows = rows.drop("plain", "norm", "canon", "d")
    rows = text.computed(rows, {"plain": text.stripped(F.col(column))})
    made = {"norm": text.normalize_merchant(F.col("plain")), "canon": text.canon(F.col("plain"))}
    if "direction" in rows.columns:
        made["d"] = text.direction(F.col("direction"))
    return text.computed(rows, made)


def flagged(rows: DataFrame) -> DataFrame:
    """Shapes and markers of named rows, each computed once."""
    shape = F.coalesce(F.nullif(F.col("norm"), F.lit("")), F.col("plain"))
    return text.computed(
        rows,
        {
            "is_opaque": text.opaque(F.col("plain")),
            "is_person": text.person(shape),
            "norm_commercial": text.commercial(shape),
            "canon_commercial": text.commercial(F.col("canon")),
            "raw_commercial": text.commercial(F.col("plain")),
            "is_ambiguous": text.ambiguous(F.col("norm"), F.col("canon")),
            "has_income": text.income_marker(F.col("plain")),
            "has_refund": text.refund_marker(F.col("plain")),
            "is_short": text.short_name(F.col("norm")),
        },
    )


def kind() -> Column:
    """(txn_type, type_confidence, type_reason) of flagged rows; the first case that holds."""
    d, credit = F.col("d"), F.coalesce(F.col("is_credit"), F.lit(False))
    case = lambda name, confidence, reason: F.struct(F.lit(name).alias("txn_type"), F.lit(confidence).alias("type_confidence"), F.lit(reason).alias("type_reason"))
    return (
        F.when(text.starts_with_any(d, fixed.REFUND_VERBS), case("REFUND", 0.99, "direction says refund"))
        .when(credit & F.col("has_refund"), case("REFUND", 0.90, "credit with refund keyword"))
        .when(text.starts_with_any(d, fixed.IN_VERBS), case("MONEY_RECEIVED", 0.99, "direction says received"))
        .when((d == "") & credit, case("MONEY_RECEIVED", 0.90, "positive amount"))
        .when(F.col("norm").isin(*fixed.SERVICE_LABELS) | d.isin(*fixed.BILL_VERBS), case("PAYMENT_TO_MERCHANT", 0.99, "service/bill label"))
        .when(F.col("plain") == "", case("UNKNOWN", 0.0, "empty counterparty"))
        .when(F.col("is_opaque"), case("UNKNOWN", 0.60, "opaque/masked counterparty"))
        .when(F.col("norm_commercial") | F.col("canon_commercial"), case("PAYMENT_TO_MERCHANT", 0.95, "commercial keyword"))
        .when(F.col("is_person"), case("PAYMENT_TO_PERSON", 0.85, "person-name shape"))
        .when(text.starts_with_any(d, fixed.OUT_VERBS) | ((d == "") & ~credit), case("UNKNOWN", 0.30, "outgoing, indeterminate counterparty"))
        .otherwise(case("UNKNOWN", 0.0, "no usable signal"))
    )


def is_incoming(txn_type: Column) -> Column:
    return txn_type.isin("MONEY_RECEIVED", "REFUND")


def first_rule(norm: Column, canon: Column, ambiguous: Column) -> Column:
    """The first rule that the name meets: a token rule by a whole token of the key, a phrase rule inside the key or the plain text.

    Tokens are looked up in the list of token patterns; phrases are searched for in key and text at once.
    """
    patterns, places = vocabulary.token_rules()
    by_token = F.array_min(F.transform(F.split(norm, " "), lambda t: F.nullif(F.array_position(patterns, t), F.lit(0).cast("long")))).cast("int")
    by_phrase = text.let(F.concat(norm, F.lit("\n"), canon), lambda both: F.get(F.filter(vocabulary.phrase_rules(), lambda r: both.contains(r["pattern"])), F.lit(0)))
    first = F.least(F.try_element_at(places, by_token), by_phrase["place"])
    return F.when((norm != "") & ~ambiguous, F.try_element_at(vocabulary.rule_table(), first))


def directory_frame(spark) -> DataFrame:
    """key, category and place of the built-in directory."""
    return spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate(vocabulary.load().directory)], "key string, category string, place int")


def directory_hit(norm: Column) -> Column:
    return F.try_element_at(vocabulary.directory_map(), norm)


def corpus(spark, learned: DataFrame | None = None) -> DataFrame:
    """key, category, place: the directory updated by learned merchants; a known key keeps its place."""
    built = directory_frame(spark)
    if learned is None:
        return built
    size = len(vocabulary.load().directory)
    own = learned.where("key <> ''").select(F.col("key").alias("own_key"), F.col("category").alias("own_category"))
    own = own.groupBy("own_key").agg(F.max("own_category").alias("own_category"))
    joined = built.join(own, F.col("key") == F.col("own_key"), "full_outer")
    place = F.coalesce(F.col("place").cast("long"), size + F.pmod(F.xxhash64("own_key"), F.lit(1 << 40)))
    return joined.select(F.coalesce("key", "own_key").alias("key"), F.coalesce("own_category", "category").alias("category"), place.alias("place"))


def _verdict(category, source, confidence, evidence, review=False) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), column(confidence).cast("double")))
    return F.struct(
        column(category).alias("category"),
        column(source).alias("source"),
        confidence.alias("confidence"),
        (column(review) | (confidence < fixed.REVIEW)).alias("needs_review"),
        column(evidence).alias("evidence"),
    )


def with_state(rows: DataFrame, name: str, state: DataFrame | None) -> DataFrame:
    """The state's category for the row's key, as column ``name``; repeated keys: the largest category.  A left join by key, broadcast by Spark where the state is small."""
    if state is None:
        return rows.withColumn(name, F.lit(None).cast("string"))
    state = state.where("key <> ''").groupBy(F.col("key").alias(f"{name}_key")).agg(F.max("category").alias(name))
    return rows.join(state, F.col("norm") == F.col(f"{name}_key"), "left").drop(f"{name}_key")


def prepared(memo: DataFrame, overrides: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """Distinct memo keys with all that the native layers need."""
    rows = with_state(with_state(named(memo), "override", overrides), "known", learned)
    rows = flagged(rows)
    directory = F.when(F.col("norm") != "", F.coalesce("known", directory_hit(F.col("norm"))))
    return text.computed(rows, {"kind": kind(), "directory": directory, "rule": first_rule(F.col("norm"), F.col("canon"), F.col("is_ambiguous"))})


def early() -> Column:
    """The verdict of the layers up to the person shape, null where they leave a row open."""
    t, incoming = F.col("kind.txn_type"), F.col("kind.txn_type") == "MONEY_RECEIVED"
    received = (
        F.when(F.col("has_income"), _verdict("INCOME", "TXN_TYPE", 0.95, "income keyword"))
        .when(F.col("canon_commercial"), _verdict("INCOME", "TXN_TYPE", 0.90, "credit from a business"))
        .when(F.col("directory").isNotNull() | F.col("rule").isNotNull(), _verdict("INCOME", "TXN_TYPE", 0.90, "credit from a known merchant"))
        .when(F.col("is_person") | F.col("is_opaque"), _verdict("PERSONAL_TRANSFER", "TXN_TYPE", 0.90, "credit from an individual"))
        .when(F.col("is_short"), _verdict("PERSONAL_TRANSFER", "TXN_TYPE", 0.60, "credit from a short plain name, likely a person", True))
        .otherwise(_verdict("INCOME", "TXN_TYPE", 0.60, "credit from an unrecognized counterparty", True))
    )
    return (
        F.when(F.col("override").isNotNull() & (F.col("norm") != ""), _verdict(text.coerce_category(F.col("override")), "USER_OVERRIDE", 1.0, F.concat(F.lit("user override on '"), F.col("norm"), F.lit("'"))))
        .when(t == "REFUND", _verdict("INCOME", "TXN_TYPE", 0.95, F.col("kind.type_reason")))
        .when(incoming, received)
        .when(F.col("plain") == "", _verdict("OTHER", "FALLBACK", 0.0, "empty counterparty", True))
        .when(F.col("directory").isNotNull(), _verdict(F.col("directory"), "EXACT_MERCHANT", fixed.EXACT, F.concat(F.lit("directory: '"), F.col("norm"), F.lit("'"))))
        .when(F.col("rule").isNotNull(), _verdict(F.col("rule.category"), "RULE", fixed.RULE, F.concat(F.lit("rule: '"), F.col("rule.pattern"), F.lit("'"))))
        .when(t == "PAYMENT_TO_PERSON", _verdict("PERSONAL_TRANSFER", "TXN_TYPE", 0.90, F.col("kind.type_reason")))
    )


def _percent(share: Column) -> Column:
    return F.concat(F.format_string("%.0f", share * 100), F.lit("%"))


def late(fuzzy: bool, model: bool, vote: bool) -> Column:
    """The verdict of rows that early() leaves open, given columns fuzzy, prediction and neighbours where those layers are on."""
    hint = F.lit("")
    out = F.when(F.lit(False), _verdict("OTHER", "FALLBACK", 0.0, "", True))
    if fuzzy:
        out = out.when(F.col("fuzzy").isNotNull(), _verdict(F.col("fuzzy.category"), "FUZZY_MATCH", F.col("fuzzy.confidence"), F.concat(F.lit("~ '"), F.col("fuzzy.key"), F.lit("'"))))
    if model:
        asked = F.col("prediction").isNotNull() & ~F.col("is_opaque") & ~F.col("is_ambiguous")
        p, c = F.col("prediction.probability"), F.col("prediction.category")
        sure = asked & (p >= fixed.REVIEW) & ~((c == "PERSONAL_TRANSFER") & F.col("raw_commercial"))
        out = out.when(sure, _verdict(c, "ML_MODEL", F.least(p, F.lit(fixed.MODEL_CAP)), F.format_string("model: p=%.2f", p)))
        hint = F.when(asked, F.concat(F.lit("; model suggests "), c, F.format_string(" (p=%.2f)", p))).otherwise("")
    credit = F.coalesce(F.col("is_credit"), F.lit(False))
    out = (
        out.when(F.col("is_opaque"), _verdict("PERSONAL_TRANSFER", "FALLBACK", 0.70, "masked account/UPI handle", True))
        .when(text.mobile_number(F.col("plain")), _verdict("PERSONAL_TRANSFER", "FALLBACK", 0.60, "bare mobile number, UPI to a person", True))
        .when(~credit & F.col("is_short") & ~F.col("raw_commercial"), _verdict("PERSONAL_TRANSFER", "FALLBACK", 0.55, F.concat(F.lit("short non-commercial name, likely a person"), hint), True))
    )
    if vote:
        n = F.col("neighbours")
        told = F.concat(F.lit("nearest shop '"), n["nearest"], F.format_string("' (%.2f), ", n["similarity"]), _percent(n["share"]), F.lit(" of the vote"))
        clear = n.isNotNull() & (n["share"] >= fixed.CLEAR_SHARE) & (n["similarity"] >= fixed.LEAST_SIMILARITY) & ~F.col("is_ambiguous")
        out = out.when(clear, _verdict(n["category"], "SEMANTIC", fixed.VOTE_CONFIDENCE, F.concat(F.lit("minilm: "), told)))
        hint = F.concat(hint, F.when(n.isNotNull(), F.concat(F.lit("; minilm suggests "), n["category"], F.lit(" ("), told, F.lit(")"))).otherwise(""))
    return out.otherwise(_verdict("OTHER", "FALLBACK", 0.0, F.concat(F.lit("no layer matched"), hint), True))


def user_rule_hit(norm: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The first of the enabled user rules (pattern, category, match_kind), in priority order, that meets the key."""
    if not rules:
        return F.lit(None).cast("struct<pattern:string,category:string>")
    table = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("category"), F.lit(k == "token").alias("token")) for p, c, k in rules if (p or "").strip()))
    clean = lambda r: F.lower(F.trim(r["pattern"]))
    hit = lambda r: F.when(r["token"], F.array_contains(F.split(norm, " "), clean(r))).otherwise(norm.contains(clean(r)))
    return F.when(norm != "", F.get(F.filter(table, hit), F.lit(0)))


def classify(
    rows: DataFrame,
    overrides: DataFrame | None = None,
    learned: DataFrame | None = None,
    *,
    fuzzy: bool = True,
    predict=None,
    vote=None,
    user_rules: list[tuple[str, str, str]] | None = None,
) -> DataFrame:
    """The rows with the VERDICT columns.

    rows: counterparty, is_credit, direction and any other columns.  overrides, learned: key and category.  predict: a
    function from a frame of distinct ``norm`` to the frame norm, prediction (category, probability).  vote: the same with
    neighbours (category, share, similarity, nearest).  user_rules: in priority order; they come after overrides.
    """
    rows = rows.drop(*VERDICT)
    memo = rows.select(*MEMO).distinct()
    ready = prepared(memo, overrides, learned)
    if user_rules:
        own = user_rule_hit(F.col("norm"), user_rules)
        ready = ready.withColumn("own_rule", F.when(F.col("override").isNull(), own))
    ready = text.computed(ready, {"early": early()}).withColumnRenamed("early", "verdict")
    if user_rules:
        mine = _verdict(text.coerce_category(F.col("own_rule.category")), "RULE", fixed.USER_RULE, F.concat(F.lit("user rule: '"), F.col("own_rule.pattern"), F.lit("'")))
        ready = ready.withColumn("verdict", F.when(F.col("own_rule").isNotNull(), mine).otherwise(F.col("verdict")))
    if fuzzy or predict or vote:
        names = ready.where("verdict is null and norm <> ''").select("norm").distinct()
        for on, name, make in ((fuzzy, "fuzzy", None), (predict, "prediction", predict), (vote, "neighbours", vote)):
            if not on:
                continue
            if name == "fuzzy":
                from .similarity import fuzzy_match

                found = fuzzy_match(names, corpus(rows.sparkSession, learned))
            else:
                found = make(names)
            ready = ready.join(found.withColumnRenamed("norm", f"{name}_norm"), (F.col("norm") == F.col(f"{name}_norm")) & F.col("verdict").isNull(), "left")
    ready = text.computed(ready, {"answer": F.coalesce("verdict", late(fuzzy, predict is not None, vote is not None))}).drop("verdict").withColumnRenamed("answer", "verdict")
    forced = F.when(F.col("own_rule").isNotNull(), F.lit("PAYMENT_TO_MERCHANT")).otherwise(F.col("kind.txn_type")) if user_rules else F.col("kind.txn_type")
    answers = ready.select(
        *(F.col(c).alias(f"_{c}") for c in MEMO), "verdict.category", "verdict.source", "verdict.confidence", "verdict.needs_review", forced.alias("txn_type"), F.col("norm").alias("normalized_merchant"), "verdict.evidence"
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MEMO]
    return rows.join(answers, same, "left").drop(*(f"_{c}" for c in MEMO))


def classify_native(rows: DataFrame, overrides: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """classify() without fuzzy matching, model and vote: a projection, with joins only for learned state, and no distinct step."""
    kept = [c for c in rows.columns if c not in VERDICT]
    apart = rows.select(*MEMO, *(F.col(c).alias(f"_own_{i}") for i, c in enumerate(kept)))  # columns of any name stay apart from the computed ones
    ready = text.computed(prepared(apart, overrides, learned), {"verdict": F.coalesce(early(), late(False, False, False))})
    own = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(kept)]
    return ready.select(*own, "verdict.category", "verdict.source", "verdict.confidence", "verdict.needs_review", F.col("kind.txn_type").alias("txn_type"), F.col("norm").alias("normalized_merchant"), "verdict.evidence")


def verdict_json() -> Column:
    """A verdict as JSON with camel-case names."""
    return F.to_json(
        F.struct(
            F.col("category"), F.col("source"), F.col("confidence"), F.col("needs_review").alias("needsReview"), F.col("txn_type").alias("txnType"), F.col("normalized_merchant").alias("normalizedMerchant"), F.col("evidence")
        )
    )
