import pytest
from pyspark.sql import functions as F

from khatasort.operators import cascade, ngram_model, vote
from khatasort.plans.statement import pool

# idx: normalized, txn_type, category, source, confidence, review, evidence
GOLDEN = {
    0: ("new sunrise daily and general store", "PAYMENT_TO_MERCHANT", "GROCERIES", "RULE", 0.9, False, "rule: 'daily and general'"),
    2: ("mah city square kfc", "PAYMENT_TO_PERSON", "FOOD_AND_DINING", "RULE", 0.9, False, "rule: 'kfc'"),
    3: ("kfc", "UNKNOWN", "FOOD_AND_DINING", "EXACT_MERCHANT", 0.97, False, "directory: 'kfc'"),
    5: ("electricity", "PAYMENT_TO_MERCHANT", "BILLS_AND_UTILITIES", "EXACT_MERCHANT", 0.97, False, "directory: 'electricity'"),
    6: ("asha verma", "PAYMENT_TO_PERSON", "PERSONAL_TRANSFER", "TXN_TYPE", 0.9, False, "person-name shape"),
    8: ("", "UNKNOWN", "PERSONAL_TRANSFER", "FALLBACK", 0.7, True, "masked account/UPI handle"),
    10: ("amazon india", "REFUND", "INCOME", "TXN_TYPE", 0.95, False, "direction says refund"),
    13: ("kfc", "MONEY_RECEIVED", "INCOME", "TXN_TYPE", 0.9, False, "credit from a known merchant"),
    14: ("kavya", "MONEY_RECEIVED", "PERSONAL_TRANSFER", "TXN_TYPE", 0.6, True, "credit from a short plain name, likely a person"),
    16: ("galaxy internet cafe", "PAYMENT_TO_MERCHANT", "OTHER", "FALLBACK", 0.0, True, "no layer matched"),
    17: ("", "UNKNOWN", "PERSONAL_TRANSFER", "FALLBACK", 0.6, True, "bare mobile number, UPI to a person"),
    18: ("meenal", "UNKNOWN", "PERSONAL_TRANSFER", "FALLBACK", 0.55, True, "short non-commercial name, likely a person"),
    22: ("metro shoes", "PAYMENT_TO_MERCHANT", "TRANSPORT", "RULE", 0.9, False, "rule: 'metro'"),
    23: ("dth recharge", "PAYMENT_TO_MERCHANT", "MOBILE_AND_INTERNET", "RULE", 0.9, False, "rule: 'recharge'"),
    29: ("toyota motors", "PAYMENT_TO_MERCHANT", "TRAVEL", "RULE", 0.9, False, "rule: 'oyo'"),
    31: ("mahanagar gas", "PAYMENT_TO_MERCHANT", "BILLS_AND_UTILITIES", "RULE", 0.9, False, "rule: 'gas limited'"),
    32: ("bonkers cornr store", "PAYMENT_TO_MERCHANT", "SHOPPING", "FUZZY_MATCH", 0.8879, False, "~ 'bonkers corner'"),
    33: ("bharat traders", "PAYMENT_TO_MERCHANT", "OTHER", "FALLBACK", 0.0, True, "no layer matched"),
    34: ("", "UNKNOWN", "OTHER", "FALLBACK", 0.0, True, "empty counterparty"),
}


def verdicts(spark, **options):
    return {r.idx: r for r in cascade.classify(pool(spark), **options).collect()}


def test_golden_rows(spark):
    found = verdicts(spark)
    assert len(found) == 36
    for i, want in GOLDEN.items():
        r = found[i]
        assert (r.normalized_merchant, r.txn_type, r.category, r.source, r.confidence, r.needs_review, r.evidence) == want


def test_state_beats_layers(spark):
    state = lambda rows: spark.createDataFrame(rows, "key string, category string")
    found = verdicts(spark, overrides=state([("sunrise kirana", "SHOPPING"), ("asha verma", "GROCERIES")]), learned=state([("kfc", "GROCERIES")]), fuzzy=False, user_rules=[("VERMA ", "food", "token"), ("meenal", "HEALTH", "token")])
    assert (found[1].category, found[1].source, found[1].confidence) == ("SHOPPING", "USER_OVERRIDE", 1.0)
    assert (found[6].category, found[7].category) == ("GROCERIES", "GROCERIES")
    assert (found[3].category, found[3].source) == ("GROCERIES", "EXACT_MERCHANT")
    assert (found[18].category, found[18].source, found[18].confidence, found[18].txn_type) == ("HEALTH", "RULE", 0.92, "PAYMENT_TO_MERCHANT")


def stub(kind, **values):
    answer = F.struct(*(F.lit(v).alias(k) for k, v in values.items()))
    return lambda names: names.select("norm", answer.alias(kind))


@pytest.mark.parametrize(
    ("category", "p", "row", "want"),
    [("GROCERIES", 0.99, 24, ("GROCERIES", "ML_MODEL", 0.89, "model: p=0.99")), ("GROCERIES", 0.74, 24, ("OTHER", "FALLBACK", 0.0, "no layer matched; model suggests GROCERIES (p=0.74)")), ("PERSONAL_TRANSFER", 0.99, 33, ("OTHER", "FALLBACK", 0.0, "no layer matched; model suggests PERSONAL_TRANSFER (p=0.99)")), ("GROCERIES", 0.99, 16, ("OTHER", "FALLBACK", 0.0, "no layer matched"))],
)
def test_model_gate(spark, category, p, row, want):
    r = verdicts(spark, fuzzy=False, predict=stub("prediction", category=category, probability=p))[row]
    assert (r.category, r.source, r.confidence, r.evidence) == want


@pytest.mark.parametrize(
    ("share", "similarity", "row", "want"),
    [(0.9, 0.6, 24, ("TRAVEL", "SEMANTIC", 0.78, "minilm: nearest shop 'x' (0.60), 90% of the vote")), (0.5, 0.6, 24, ("OTHER", "FALLBACK", 0.0, "no layer matched; minilm suggests TRAVEL (nearest shop 'x' (0.60), 50% of the vote)")), (0.9, 0.3, 24, None), (1.0, 1.0, 16, None)],
)
def test_vote(spark, share, similarity, row, want):
    r = verdicts(spark, fuzzy=False, vote=stub("neighbours", category="TRAVEL", share=share, similarity=similarity, nearest="x"))[row]
    if want:
        assert (r.category, r.source, r.confidence, r.evidence) == want
    else:
        assert r.source == "FALLBACK" and r.needs_review


def test_batch_equals_single_and_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, 1), ("KFC", None, None, 2), ("KFC", False, "Paid to", 3)], "counterparty string, is_credit boolean, direction string, n int")
    found = {r.n: r for r in cascade.classify(rows, fuzzy=False).collect()}
    assert found[1].evidence == "empty counterparty" and found[2].category == found[3].category == "FOOD_AND_DINING"


def test_native_plan_has_no_shuffle(spark):
    plan = cascade.classify_native(spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.col("p_name").alias("counterparty"), F.lit(False).alias("is_credit"), F.lit("").alias("direction")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_votes_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, "ABC"[i % 3], [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    index = spark.createDataFrame(rows, "item int, label string, vector array<double>")
    queries = spark.createDataFrame([(i, v) for i, _, v in rows[:20]], "query int, vector array<double>")
    got = {r["query"]: r for r in vote.votes(vote.nearest(queries, index, block_rows=70)).collect()}
    for q, _, v in rows[:20]:
        near = sorted(((-float(np.dot(v, w)), i, label) for i, label, w in rows))[:5]
        weight = {}
        for s, _, label in near:
            weight[label] = weight.get(label, 0) + max(-s, 0)
        best = max(weight, key=weight.get)
        assert (got[q].category, got[q].nearest) == (best, near[0][1]) and abs(got[q].share - weight[best] / sum(weight.values())) < 1e-9
    assert vote.nearest(queries, index.limit(0)).count() == 0


def test_trained_model_answers_its_examples(spark):
    words = {"GROCERIES": "kirana fruit dairy", "HEALTH": "clinic pharma doctor", "TRAVEL": "hotel flight resort"}
    rows = [(f"{w} {x}", c, "statement", 1.0) for c, ws in words.items() for w in ws.split() for x in ("ram", "blue", "city", "nova")]
    examples = spark.createDataFrame(rows, "text string, label string, origin string, weight double")
    model, labels = ngram_model.fit(examples)
    names = spark.createDataFrame([("kirana lal",), ("clinic lal",), ("",)], "norm string")
    got = {r.norm: r.prediction for r in ngram_model.predictions(model, labels, names).collect()}
    assert (got["kirana lal"].category, got["clinic lal"].category, got[""]) == ("GROCERIES", "HEALTH", None)
    assert ngram_model.cross_validated(examples, folds=3).first().accuracy > 0.6


def test_index_is_written_without_people_and_read_back(spark, tmp_path):
    examples = spark.createDataFrame([("blue clinic", "HEALTH"), ("asha verma", "PERSONAL_TRANSFER"), ("red hotel", "TRAVEL")], "text string, label string")
    embed = lambda names: names.select("norm", F.array(F.length("norm").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    vote.write_index(examples, embed, str(tmp_path / "index"))
    index = vote.read_index(spark, str(tmp_path / "index"))
    assert sorted(r["item"] for r in index.collect()) == ["blue clinic", "red hotel"]
    found = cascade.classify(pool(spark).where("idx = 24"), fuzzy=False, vote=vote.neighbour_layer(embed, index)).first()
    assert "minilm suggests" in found.evidence or found.source == "SEMANTIC"
    with pytest.raises(ValueError, match="no example"):
        vote.write_index(examples.where("label = 'PERSONAL_TRANSFER'"), embed, str(tmp_path / "none"))
