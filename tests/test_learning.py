import datetime

import pytest
from pyspark.sql import functions as F

from khatasort.operators.learning import Store
from khatasort.streaming import ingest

DAY = datetime.datetime(2026, 1, 2, 10, 30)
ROWS = "row_number int, occurred_at timestamp_ntz, counterparty string, amount double, is_credit boolean, direction string, transaction_id string, utr string, account_last4 string, raw map<string,string>"
OFF = {"fuzzy": False}


def rows(spark, *given):
    return spark.createDataFrame([(i + 2, DAY, name, float(amount), credit, direction, tid, "", "12", {"a": "b"}) for i, (name, amount, credit, direction, tid) in enumerate(given)], ROWS)


SOME = (("Sun Kirana 2", 10, False, "Paid to", "T1"), ("SUN KIRANA", 20, False, "Paid to", "T2"), ("Asha Verma", 5, False, "Paid to", "T3"), ("Zzq Blorp Holdings", 99, False, "Paid to", "T4"), ("KFC", 7, True, "Refund from", "T5"), ("Sun Kirana", 1, False, "Paid to", ""))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_import_is_idempotent_and_learns_merchants_only(spark, store):
    assert store.import_transactions(rows(spark, *SOME), **OFF) == {"added": 6, "skipped_existing": 0, "needs_review": 1}
    assert store.import_transactions(rows(spark, *SOME), **OFF) == {"added": 1, "skipped_existing": 5, "needs_review": 0}
    assert store.table("transactions").select("id").distinct().count() == 7
    learned = {r.normalized_name: r for r in store.table("merchants").collect()}
    assert set(learned) == {"sun kirana"} and learned["sun kirana"].times_seen == 4 and learned["sun kirana"].display_name == "Sun Kirana 2"
    diff = store.reclassify_all(**OFF)
    assert diff["recategorized"] == 0 and diff["source_changed"] > 0 and diff["total"] == 7


def test_ids_of_many_files_are_unique(spark, store):
    files = rows(spark, *SOME[:3]).withColumn("path", F.lit("b")).unionByName(rows(spark, *SOME[3:]).withColumn("path", F.lit("a")))
    store.import_transactions(files, **OFF)
    ids = [r.id for r in store.table("transactions").orderBy("id").collect()]
    assert len(set(ids)) == 6 and ids[0] == 2 and ids[3] > 1 << 33


def test_corrections_apply_to_past_and_future(spark, store):
    store.import_transactions(rows(spark, *SOME), **OFF)
    assert store.record_correction("SUN KIRANA", "shopping") == {"updated": 3}
    assert store.record_correction("******99", "shopping") == {"updated": 0}
    stored = store.table("transactions").where("normalized_merchant = 'sun kirana'").collect()
    assert {(r.category, r.source, r.confidence, r.needs_review) for r in stored} == {("SHOPPING", "USER_OVERRIDE", 1.0, False)}
    override = store.table("overrides").first()
    assert (override.previous_category, override.previous_source) == ("GROCERIES", "RULE")
    store.record_correction("sun kirana", "HEALTH")
    override = store.table("overrides").first()
    assert (override.category, override.previous_category) == ("HEALTH", "GROCERIES")
    assert store.classify("Sun Kirana 7", **OFF)["category"] == "HEALTH"
    store.import_transactions(rows(spark, ("Sun Kirana", 3, False, "Paid to", "T9")), **OFF)
    assert store.table("merchants").where("normalized_name = 'sun kirana'").first().source == "USER_OVERRIDE"


def test_user_rules_by_priority(spark, store):
    store.add_rule("Verma", "food", match_kind="token", priority=50)
    store.add_rule("asha", "HEALTH")
    got = store.classify("Asha Verma", **OFF)
    assert (got["category"], got["source"], got["confidence"], got["evidence"], got["txn_type"]) == ("FOOD_AND_DINING", "RULE", 0.92, "user rule: 'verma'", "PAYMENT_TO_MERCHANT")
    assert store.classify("Vermas", **OFF)["source"] != "RULE"


def test_queue_and_totals(spark, store):
    store.import_transactions(rows(spark, *SOME), **OFF)
    assert [r.raw_counterparty for r in store.review_queue(5).collect()] == ["Zzq Blorp Holdings"]
    assert {r.category: r.total for r in store.category_totals().collect()} == {"GROCERIES": 31.0, "PERSONAL_TRANSFER": 5.0, "OTHER": 99.0, "INCOME": 7.0}


def test_stream_is_imported_once(spark, store, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, *SOME[:3]).drop("raw").write.parquet(source)
    rows(spark, *SOME[2:5]).drop("raw").write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(rows(spark, SOME[0]).drop("raw").schema).parquet(source)
        query = ingest.ingest(stream, store, str(tmp_path / f"checkpoint{_}"), **OFF)
        query.awaitTermination(120)
    assert sorted(r.transaction_id for r in store.table("transactions").collect()) == ["T1", "T2", "T3", "T4", "T5"]
