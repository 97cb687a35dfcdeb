"""A statement derived from the driver's tables, the same in Spark and in DuckDB.

``pool`` is 36 invented counterparties; ``stmt`` gives each order one of them, with its date, price and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# The pool's counterparty, direction and credit flag, and the category that evaluation takes as the truth.
POOL = (
    ("NEW SUNRISE DAILY AND GENERAL STORE", "Paid to", False, "GROCERIES"),
    ("Sunrise Kirana 2", "Paid to", False, "GROCERIES"),
    ("MAH CITY Square KFC 6453", "Paid to", False, "FOOD_AND_DINING"),
    ("KFC", "Paid to", False, "FOOD_AND_DINING"),
    ("Mobile Recharge", "Paid", False, "MOBILE_AND_INTERNET"),
    ("Electricity", "Bill paid", False, "BILLS_AND_UTILITIES"),
    ("Asha Verma", "Paid to", False, "PERSONAL_TRANSFER"),
    ("Asha Verma", "Received from", True, "PERSONAL_TRANSFER"),
    ("******1234", "Paid to", False, "PERSONAL_TRANSFER"),
    ("******1234", "Received from", True, "PERSONAL_TRANSFER"),
    ("Amazon India", "Refund from", True, "INCOME"),
    ("Salary Credit", "", True, "INCOME"),
    ("Nimbus Technologies Private Limited", "Received from", True, "INCOME"),
    ("KFC", "Received from", True, "INCOME"),
    ("Kavya", "Received from", True, "PERSONAL_TRANSFER"),
    ("Zzq Unknown 77 Xyzzy Blorp", "Received from", True, "PERSONAL_TRANSFER"),
    ("Galaxy Internet Cafe", "Paid to", False, "MOBILE_AND_INTERNET"),
    ("9812345678", "Paid to", False, "PERSONAL_TRANSFER"),
    ("Meenal", "Paid to", False, "PERSONAL_TRANSFER"),
    ("Sunrise Kirana College Road", "Paid to", False, "GROCERIES"),
    ("GAJRAJ MEDICAL GENERAL STORES", "Paid to", False, "HEALTH"),
    ("ISHAN DAIRY AND ICECREAM PARLOUR", "Paid to", False, "FOOD_AND_DINING"),
    ("Metro Shoes", "Paid to", False, "SHOPPING"),
    ("DTH Recharge", "Paid", False, "BILLS_AND_UTILITIES"),
    ("Qwv Improbable Enterprises Holdings", "Paid to", False, "OTHER"),
    ("Jio Prepaid Recharges", "Paid to", False, "MOBILE_AND_INTERNET"),
    ("AVENUE SUPERMARTS LTD", "Paid to", False, "GROCERIES"),
    ("Swiggy refund", "", True, "INCOME"),
    ("CINEMAX INDIA PRIVATE LIMITED", "Paid to", False, "ENTERTAINMENT"),
    ("Toyota Motors", "Paid to", False, "TRANSPORT"),
    ("Hotel Blue Star", "Paid to", False, "FOOD_AND_DINING"),
    ("MAHANAGAR GAS LIMITED", "Paid to", False, "BILLS_AND_UTILITIES"),
    ("Bonkers Cornr Store", "Paid to", False, "SHOPPING"),
    ("Bharat Traders", "Paid to", False, "OTHER"),
    ("", "Paid", False, "OTHER"),
    ("Galaxy_Cafe_And_Bakery", "Paid to", False, "FOOD_AND_DINING"),
)
#: Fixed values for SQL twins of queries with fuzzy matching, which SQL can't express: the one pool row that it decides, and its verdict (category,
#: source, confidence, needs_review, evidence).  A test holds them against a plain loop over the directory.
FUZZY_ROW, FUZZY_VERDICT = 32, ("SHOPPING", "FUZZY_MATCH", 0.8879, False, "~ 'bonkers corner'")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(POOL)], "idx int, counterparty string, direction string, is_credit boolean, truth string")


def stmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived statement: all orders.  The pool has 36 rows, so it is broadcast."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").withColumn("idx", (F.col("o_orderkey") % len(POOL)).cast("int"))
    return orders.join(F.broadcast(pool(spark)), "idx").select(
        "idx", F.col("o_orderkey").alias("row_number"), "counterparty", "direction", "is_credit", F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("occurred_at"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("transaction_id"), "truth"
    )
