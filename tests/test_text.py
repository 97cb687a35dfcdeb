import pytest
from pyspark.sql import functions as F

from khatasort.functions import text


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        (None, ""),
        ("  ", ""),
        ("Paid to NEW SUNRISE DAILY AND GENERAL STORE", "new sunrise daily and general store"),
        ("MAH CITY Square KFC 6453", "mah city square kfc"),
        ("Shalimar Bakery and Foods Pvt Ltd-Shalimar Bakery 2", "shalimar bakery and foods shalimar bakery"),
        ("Paid Man", "man"),
        ("Upinder Stores", "nder stores"),
        ("Paid Tower", "wer"),
        ("Maxx 20 Store", "ma store"),
        ("Asha Rao2", "asha"),
        ("******6258", ""),
        ("••••1234 Cafe", "cafe"),
        ("M/S Sharma Stores U178", "sharma stores"),
        ("M S Sharma Stores", "sharma stores"),
        ("asha verma asha verma", "asha verma"),
        ("T2307011234567 Cafe", "cafe"),
        ("BIG 5", "big"),
        ("5 5", "5"),
        ("CAFÉ Blue", "caf blue"),
        ("to Raj", "raj"),
        ("UPI/Blue Shop", "blue shop"),
    ],
)
def test_merchant_keys(spark, raw, key):
    assert one(spark, text.normalize_merchant, raw) == key


def test_keys_are_stable(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(text.normalize_merchant(F.col("p_name")).alias("k"))
    assert rows.where(text.normalize_merchant(F.col("k")) != F.col("k")).count() == 0


@pytest.mark.parametrize(("value", "yes"), [("asha verma", True), ("Dr. Asha Verma", True), ("asha", False), ("a b c d e", True), ("a b c d e f", False), ("asha kirana", False), ("SHEIKH2 Ali", True), ("asha v3rma", False), ("अशा वर्मा", False), ("é ü", True), (None, False)])
def test_person_shapes(spark, value, yes):
    assert one(spark, text.person, value) is yes


@pytest.mark.parametrize(("value", "yes"), [("******1234", True), ("XX99", True), ("ABCDEFGHIJ12", True), ("ABCDEFGHIJK", False), ("MASALAMAHALL", True), ("x1", False), (None, False)])
def test_opaque(spark, value, yes):
    assert one(spark, text.opaque, value) is yes


def test_grams_and_buckets(spark):
    import zlib

    row = spark.createDataFrame([("a kfc",)], "x string").select(text.grams(F.col("x")).alias("g"), F.transform(text.grams(F.col("x")), text.bucket).alias("b")).first()
    assert row.g == ["w:a", " a", "a ", " a ", "w:kfc", " k", "kf", "fc", "c ", " kf", "kfc", "fc ", " kfc", "kfc "]
    assert row.b == [zlib.crc32(g.encode()) % 16384 for g in row.g]
    assert one(spark, text.grams, "") == []
