from pyspark.sql import functions as F

from khatasort.operators import ngram_model


def test_report_asks_open_rows_again_with_the_model(spark):
    rows = spark.createDataFrame([(1, "Zzq Blorp Holdings 9", False, "Paid to"), (2, "Zzq Blorp Holdings 8", False, "Paid to"), (3, "KFC", False, "Paid to"), (4, "Qwv Unknown Blorp Xyz 77", True, "Received from")], "row_number int, counterparty string, is_credit boolean, direction string")
    examples = spark.createDataFrame([("kfc", "FOOD_AND_DINING", "built-in"), ("zzq", "SHOPPING", "rule"), ("blorp", "SHOPPING", "rule")], "text string, label string, origin string")
    answer = F.struct(F.lit("GROCERIES").alias("category"), F.lit(0.8).alias("probability"))
    found = ngram_model.training_report(rows, examples, lambda names: names.select("norm", answer.alias("prediction")))
    name = found["samples"][0][0]
    assert found == {"by_origin": {"built-in": 1, "rule": 2}, "by_label": {"FOOD_AND_DINING": 1, "SHOPPING": 2}, "unresolved_rows": 2, "resolved_rows": 2, "resolved_by_label": {"GROCERIES": 2}, "samples": [[name, "GROCERIES", 0.8]]}
    assert name.startswith("zzq blorp")
