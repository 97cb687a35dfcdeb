import pytest

from khatasort.operators import cascade, scoring

COLUMNS = "row_number int, key string, flow string, counterparty string, amount double, truth string, pred string, source string, review boolean, seen boolean"


def test_hand_computed_metrics(spark):
    rows = spark.createDataFrame(
        [
            (1, "a", "OUT", "A", 100.0, "HEALTH", "HEALTH", "RULE", False, True),
            (2, "b", "OUT", "B", 50.0, "FOOD_AND_DINING", "FOOD_AND_DINING", "RULE", False, False),
            (3, "c", "OUT", "C", 30.0, "HEALTH", "TRAVEL", "RULE", False, True),
            (4, "c", "OUT", "C", 10.0, "HEALTH", "TRAVEL", "RULE", False, True),
            (5, "d", "IN", "D", 10.0, "INCOME", "OTHER", "FALLBACK", True, False),
        ],
        COLUMNS,
    )
    s = scoring.score(rows).first()
    assert (s.rows, s.accuracy, s.coverage, s.auto_accuracy, s.flagged_accuracy, s.errors, s.silent_errors) == (5, 0.4, 0.8, 0.5, 0.0, 3, 2)
    assert s.accuracy_by_amount == 0.75 and abs(s.error_catch_rate - 1 / 3) < 1e-12
    layers = {r.source: r for r in scoring.per_layer(rows).collect()}
    assert (layers["RULE"].rows, layers["RULE"].accuracy, layers["FALLBACK"].auto_share) == (4, 0.5, 0.0)
    cats = {r.category: r for r in scoring.per_category(rows).collect()}
    assert (cats["HEALTH"].support, cats["HEALTH"].precision, cats["TRAVEL"].support, cats["TRAVEL"].precision, cats["OTHER"].recall) == (3, 1.0, 0, 0.0, 0.0)
    assert [(r.truth, r.predicted, r.rows) for r in scoring.confusions(rows).collect()] == [("HEALTH", "TRAVEL", 2), ("INCOME", "OTHER", 1)]
    assert [(r.merchant, r.rows, r.amount) for r in scoring.silent_errors(rows).collect()] == [("C", 2, 40.0)]
    assert scoring.score(rows.limit(0)).first().accuracy == 0.0


def test_label_sheets(spark):
    rows = spark.createDataFrame([(1, "Sun Kirana 2", 5.0, False, "Paid to"), (2, "SUN KIRANA", 9.5, False, "Paid to"), (3, "Sun Kirana", 20.0, True, "Refund from"), (4, "******12", 1.0, False, "Paid to")], "row_number int, counterparty string, amount double, is_credit boolean, direction string")
    sheet = scoring.label_sheet(rows).collect()
    assert [(r.key, r.flow, r.example, r["count"], r.total_amount, r.true_category) for r in sheet] == [("sun kirana", "IN", "Sun Kirana", 1, "20.00", ""), ("sun kirana", "OUT", "Sun Kirana 2", 2, "14.50", ""), ("12", "OUT", "******12", 1, "1.00", "")]
    filled = spark.createDataFrame([(2, "a", "OUT", "food"), (3, "a", "OUT", "Health"), (4, "b", "OUT", " "), (5, "c", "IN", "other")], "line int, key string, flow string, true_category string")
    assert {(r.key, r.flow): r.truth for r in scoring.read_labels(filled).collect()} == {("a", "OUT"): "HEALTH", ("c", "IN"): "OTHER"}
    with pytest.raises(scoring.LabelError, match="line 9"):
        scoring.read_labels(filled.union(spark.createDataFrame([(9, "d", "OUT", "grocerys")], filled.schema)))


def test_ablation_scores_three_configurations(spark):
    from khatasort.plans import registry, report_queries
    from khatasort.plans.statement import stmt

    folder = "/root/testdata/sf0.001"
    got = {r.config: r for r in registry.queries()["ablation"](spark, folder).collect()}
    assert list(sorted(got)) == ["+ n-gram model", "+ vector vote", "curated layers"]
    # the curated layers again, transaction by transaction
    rows = scoring.labelled(cascade.classify(stmt(spark, folder)), report_queries._labels(spark, folder)).collect()
    first = got["curated layers"]
    assert first.rows == len(rows) and len({r.rows for r in got.values()}) == 1
    assert abs(first.accuracy - sum(r.pred == r.truth for r in rows) / len(rows)) < 1e-9
    assert first.silent_errors == sum(r.pred != r.truth and not r.review for r in rows)
    assert abs(first.coverage - sum(not r.review for r in rows) / len(rows)) < 1e-9


def test_embedding_by_grams(spark):
    from khatasort.operators import vote

    rows = {r.norm: r.vector for r in vote.embed_grams(spark.createDataFrame([("sun kirana",), ("sun kirana store",), ("zzq",), ("",)], "norm string")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(rows[a], rows[b], strict=True))
    assert abs(dot("zzq", "zzq") - 1) < 1e-9 and dot("", "zzq") == 0
    assert dot("sun kirana", "sun kirana store") > 0.5 > dot("sun kirana", "zzq")
