"""Tables that grow with the input are not broadcast through the driver, however small their files are."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import components
from kinweave.plans import evaluate, index, read, resolve as res, rings
from kinweave.sources import bridge
from kinweave.workspace import Workspace
from tests.test_resolution import SCHEMA, bridge_rows, rec, resolved


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture
def written(monkeypatch):
    """Broadcasts in the plans of tables that are written meanwhile, by their names."""
    seen, plain = {}, Workspace.table

    def table(self, df, name, *rest):
        seen[name] = broadcasts(df)
        return plain(self, df, name, *rest)

    monkeypatch.setattr(Workspace, "table", table)
    return seen


def test_only_what_is_asked_for_is_broadcast(spark):
    big = Workspace(spark, "t", shuffled=True).table(spark.range(200_000).withColumn("k", F.col("id")), "big")
    few = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert broadcasts(big.join(big.select("id", F.lit(1).alias("y")), "id")) == 0
    assert broadcasts(big.join(F.broadcast(few), "id")) == 1 and big.join(F.broadcast(few), "id").count() == 2
    assert broadcasts(big.crossJoin(big.agg(F.count("*").alias("n")))) == 1


def test_resolution_broadcasts_no_records_and_no_identities(spark, written):
    r = resolved(spark, bridge_rows())
    assert {name for name, n in written.items() if n} == {"names"} and written["names"] == 1  # offsets of ranges, a row each
    assert broadcasts(read.summaries(r)) == broadcasts(r.outcomes) == 0
    once = spark.createDataFrame(bridge_rows(), SCHEMA)
    assert broadcasts(res.all_outcomes(once.union(once), r)) == 0


def test_truth_of_people_is_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    truth = bridge.truth(spark, str(tmp_path))
    assert broadcasts(truth) == 0 and truth.count() == 110
    now = Workspace(spark, "t", shuffled=True).table(truth.select("record_id", F.col("person_id").alias("identity_id")), "now")
    assert evaluate.pairwise_metrics(now, truth).first().recall == 1.0
    assert broadcasts(now.join(truth, "record_id")) == 0


def test_rings_broadcast_no_members(spark, written):
    rows = [rec(f"T{i}", f"2026-01-{1 + i:02d}T10:00:00", name, phone=f"98450{i:05d}", device="d1") for i, name in enumerate(["Anand Rao", "Divya Iyer", "Kavitha Nair"])]
    r = resolved(spark, rows)
    written.clear()
    report = rings.ring_report(r)
    assert report.count() == 1
    assert not any(written.values())


def test_rounds_of_contraction_broadcast_no_minima(spark, written, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 10)
    edges = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    parts = components.connected_components(edges, Workspace(spark, "t"))
    assert parts.agg(F.max("component"), F.count("*")).first() == (0, 201)
    assert "large" in written and not any(written.values())


def test_index_broadcasts_keys_up_to_a_number_and_no_groups(spark, tmp_path):
    kept = index.Index(spark, f"file://{tmp_path}/tables")
    report = spark.range(1, 5001).select(
        F.col("id").alias("component_id"), F.lit("REVIEW").alias("label"), F.lit(1.0).alias("risk_score"), F.array(F.lit("PID1")).alias("identity_ids"),
        F.array(F.lit("why")).alias("reasons"), F.expr("named_struct('size', 3, 'first_seen_span_days', 1D, 'kyc_fraction', 0D, 'max_identities_per_device', 3, 'max_identities_per_phone', 1, 'address_share', 0D)").alias("features"),
    )
    kept.save_report(report, "run")
    review = kept.report().select("run_id", "component_id", F.lit("false_alarm").alias("decision"), F.lit("").alias("note"), F.lit("2026-01-01").alias("reviewed_at"))
    kept.save_reviews(review)
    assert broadcasts(kept.rings_view()) == broadcasts(kept.snapshot().lookup("reviews", review)) == 0
    assert broadcasts(kept.snapshot().lookup("reviews", review.limit(3))) == 1
    assert kept.rings_view().where("decision = 'false_alarm'").count() == 5000
