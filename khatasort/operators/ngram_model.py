"""The n-gram classifier: training set, hashed features, multinomial regression with Spark ML, and the gate's predictions."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, vocabulary
from .cascade import VERDICT, classify, classify_native

#: Origins from the weakest to the strongest.
ORIGINS = ("rule", "built-in", "statement", "learned", "override")


def feature_counts(rows: DataFrame, column: str = "norm") -> DataFrame:
    """(column, bucket, count, weight): hashed n-grams of each text, of length 1 together."""
    grams = rows.select(column).distinct().select(column, F.explode(text.grams(F.col(column))).alias("gram"))
    counts = grams.groupBy(column, text.bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("count"))
    length = F.sqrt(F.sum(F.col("count") * F.col("count")).over(Window.partitionBy(column)))
    return counts.withColumn("weight", F.col("count") / length)


def vectors(rows: DataFrame, column: str = "text") -> DataFrame:
    """The rows with sparse column ``features``, length 1; built by Spark ML's vectorizers, without Python per row."""
    rows = rows.withColumn("_buckets", F.transform(text.grams(F.col(column)), lambda g: text.bucket(g).cast("string")))
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(fixed.FEATURES)], inputCol="_buckets", outputCol="_counts", minTF=1.0)
    return Normalizer(p=2.0, inputCol="_counts", outputCol="features").transform(counted.transform(rows)).drop("_buckets", "_counts")


def statement_label() -> Column:
    """The category that a verdict teaches, or null."""
    return F.when(
        ~F.col("needs_review"),
        F.when(F.col("source").isin(*fixed.IDENTITY_SOURCES) & (F.col("txn_type") == "PAYMENT_TO_MERCHANT"), F.col("category")).when((F.col("source") == "TXN_TYPE") & (F.col("txn_type") == "PAYMENT_TO_PERSON"), F.lit("PERSONAL_TRANSFER")),
    )


def training_set(classified: DataFrame, overrides: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """text, label, origin, weight: an example a merchant, the strongest origin's label; INCOME and OTHER teach nothing.

    classified: outgoing transactions judged without the model layers, with row_number.
    """
    spark = classified.sparkSession
    v = vocabulary.load()
    rules = spark.createDataFrame([(p, c, i) for i, (p, c, _) in enumerate(v.rules)], "pattern string, label string, place long")
    parts = [
        rules.select(text.normalize_merchant(F.col("pattern")).alias("text"), "label", "place", F.lit("rule").alias("origin")),
        spark.createDataFrame([(k, c, i, "built-in") for i, (k, c) in enumerate(v.directory)], "text string, label string, place long, origin string"),
        classified.where(~F.col("is_credit")).select(F.col("normalized_merchant").alias("text"), statement_label().alias("label"), F.col("row_number").cast("long").alias("place"), F.lit("statement").alias("origin")),
    ]
    for name, state in (("learned", learned), ("override", overrides)):
        if state is not None:
            parts.append(state.select(F.col("key").alias("text"), F.col("category").alias("label"), F.lit(0).cast("long").alias("place"), F.lit(name).alias("origin")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.where("label is not null and text <> ''").withColumn("label", text.coerce_category(F.col("label"))).where(~F.col("label").isin("INCOME", "OTHER"))
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    best = every.groupBy("text").agg(F.max(F.struct(rank.alias("rank"), "place", "label", "origin")).alias("x"))
    return best.select("text", "x.label", "x.origin", F.when(F.col("x.origin") == "override", fixed.OVERRIDE_WEIGHT).otherwise(1.0).alias("weight"))


def fit(examples: DataFrame, c: float = fixed.MODEL_C) -> tuple[LogisticRegressionModel, list[str]]:
    """A multinomial regression with weights; c is the inverse strength of the L2 term against the summed loss."""
    index = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(examples)
    ready = vectors(index.transform(examples))
    total = examples.agg(F.sum("weight")).first()[0] or 1.0
    model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="weight", family="multinomial", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200).fit(ready)
    return model, list(index.labels)


def predictions(model: LogisticRegressionModel, labels: list[str], names: DataFrame, column: str = "norm") -> DataFrame:
    """The names with ``prediction`` (category, probability); null for a text without features."""
    found = model.transform(vectors(names, column))
    p = vector_to_array(F.col("probability"))
    best = F.array_position(p, F.array_max(p)).cast("int")
    answer = F.struct(F.element_at(F.array(*map(F.lit, labels)), best).alias("category"), F.array_max(p).alias("probability"))
    return found.select(*names.columns, F.when(F.col(column) != "", answer).alias("prediction"))


def model_layer(model: LogisticRegressionModel, labels: list[str]):
    """A predict function for cascade.classify."""
    return lambda names: predictions(model, labels, names)


def cross_validated(examples: DataFrame, folds: int = fixed.MODEL_FOLDS) -> DataFrame:
    """accuracy, and coverage and accuracy above the review threshold, of held-out examples that statements gave; the fold is a hash of the text."""
    examples = examples.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds))).persist()
    out = None
    for k in range(folds):
        model, labels = fit(examples.where(F.col("fold") != k).drop("fold"))
        part = predictions(model, labels, examples.where((F.col("fold") == k) & (F.col("origin") == "statement")).select("text", "label"), "text")
        out = part if out is None else out.unionByName(part)
    sure, right = F.col("prediction.probability") >= fixed.REVIEW, F.col("prediction.category") == F.col("label")
    found = out.agg(F.count("*").alias("examples"), F.count_if(right).alias("hits"), F.count_if(sure).alias("gated"), F.count_if(sure & right).alias("gated_hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return found.select("examples", ratio("hits", "examples").alias("accuracy"), ratio("gated", "examples").alias("gated_coverage"), ratio("gated_hits", "gated").alias("gated_accuracy"))


def train_report(examples: DataFrame) -> DataFrame:
    return examples.groupBy("origin", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def fallback_rows(rows: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Outgoing rows that the curated layers leave open."""
    return classify_native(rows.where(~F.col("is_credit")), None, learned).where("source = 'FALLBACK'")


def resolved(rows: DataFrame, predict, learned: DataFrame | None = None) -> DataFrame:
    """normalized_merchant, category, confidence and n of the open rows that the model answers within the cascade, with all its guards."""
    found = classify(fallback_rows(rows, learned).drop(*VERDICT), None, learned, predict=predict)
    return found.where("source = 'ML_MODEL'").groupBy("normalized_merchant").agg(F.max("category").alias("category"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def training_report(rows: DataFrame, examples: DataFrame, predict, learned: DataFrame | None = None, samples: int = 25) -> dict:
    """Examples by origin and label, the open rows asked again with the model, and its surest answers."""
    counts = lambda c: {r[0]: r[1] for r in examples.groupBy(c).count().orderBy(c).collect()}
    answers = resolved(rows, predict, learned).persist()
    by_label = {r.category: r["n"] for r in answers.groupBy("category").agg(F.sum("n").alias("n")).orderBy("category").collect()}
    best = answers.orderBy(F.desc("confidence"), "normalized_merchant").limit(samples).collect()
    out = {"by_origin": counts("origin"), "by_label": counts("label"), "unresolved_rows": fallback_rows(rows, learned).count(), "resolved_rows": sum(by_label.values()), "resolved_by_label": by_label}
    answers.unpersist()
    return out | {"samples": [[r.normalized_merchant, r.category, r.confidence] for r in best]}


def check_saved(model: LogisticRegressionModel, labels: list[str], folder: str, probe: DataFrame) -> None:
    """Raise unless the saved model answers the probe (text) as the trained one does."""
    first = predictions(model, labels, probe, "text").select("text", "prediction").toDF("text", "first")
    other, other_labels = load(probe.sparkSession, folder)
    second = predictions(other, other_labels, probe, "text").select("text", "prediction").toDF("again", "second")
    wrong = first.join(second, F.col("text") == F.col("again")).where((F.col("first.category") != F.col("second.category")) | (F.abs(F.col("first.probability") - F.col("second.probability")) > 1e-6))
    if not wrong.isEmpty():
        raise RuntimeError("the saved model answers otherwise than the trained one")


def save(model: LogisticRegressionModel, labels: list[str], folder: str) -> None:
    model.write().overwrite().save(f"{folder}/model")
    SparkSession.active().createDataFrame([(i, x, fixed.FEATURES) for i, x in enumerate(labels)], "place int, label string, features int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/labels")


def load(spark, folder: str) -> tuple[LogisticRegressionModel, list[str]]:
    rows = spark.read.parquet(f"{folder}/labels").orderBy("place").collect()
    if any(r.features != fixed.FEATURES for r in rows):
        raise ValueError("the saved model has other features")
    return LogisticRegressionModel.load(f"{folder}/model"), [r.label for r in rows]
