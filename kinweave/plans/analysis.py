"""Runs of the ring analysis: reports kept by run, the summary of a run, and a group in detail."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.plans import evaluate, read, rings
from kinweave.plans.resolve import Resolution

TOP, OPEN_SHOWN, MERGES_SHOWN = 3, 6, 5
SUSPICIOUS = "SUSPICIOUS_RING"


def run_id(now: datetime) -> str:
    return now.strftime("run-%Y%m%dT%H%M%S")


def save_report(report: DataFrame, folder: str, run: str, created_at: str) -> None:
    """Append the report of a run; a run that is there already is an error."""
    rows = report.drop("run_id").withColumn("created_at", F.lit(created_at).cast("timestamp_ntz"))
    rows.write.mode("errorifexists").parquet(f"{folder}/run_id={run}")


def load_reports(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder).withColumn("run_id", F.col("run_id").cast("string"))


def latest_report(reports: DataFrame) -> DataFrame:
    """Groups of the run that was made last, the riskiest first."""
    last = reports.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    return reports.join(F.broadcast(last), "run_id").orderBy(F.desc("risk_score"), "component_id")


def top_suspicious(report: DataFrame, n: int = TOP) -> DataFrame:
    rows = report.where(F.col("label") == SUSPICIOUS).orderBy("component_id").limit(n)
    return rows.select("component_id", "label", "risk_score", "reasons", "features")


def open_suspicious(report: DataFrame, reviews: DataFrame, n: int = OPEN_SHOWN) -> DataFrame:
    """Suspicious groups that nobody has reviewed."""
    unseen = report.where(F.col("label") == SUSPICIOUS).join(reviews.select("run_id", "component_id").distinct(), ["run_id", "component_id"], "left_anti")
    return unseen.orderBy(F.desc("risk_score"), "component_id").limit(n)


def run_analysis(r: Resolution, folder: str, truth: DataFrame | None = None, now: datetime | None = None) -> dict:
    """Find and keep the groups of a run, and tell about them; with a truth also how good they are."""
    now = now or datetime.now(timezone.utc)
    run, spark = run_id(now), r.records.sparkSession
    save_report(rings.ring_report(r, run_id=run), folder, run, now.replace(tzinfo=None).isoformat(timespec="seconds"))
    report = load_reports(spark, folder).where(F.col("run_id") == run)
    told = {"run_id": run, "stats": _row(read.stats(r)), "components_reported": report.count()}
    if truth is not None:
        current = r.assignments.where(read.valid_at(None)).select("record_id", "identity_id")
        told["matching_accuracy"] = _row(evaluate.pairwise_metrics(current, truth))
        told["ring_detection"] = _row(rings.evaluate_rings(report, r.assignments, truth))
    told["top_suspicious"] = [x.asDict(recursive=True) for x in top_suspicious(report).collect()]
    return told


def _row(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def as_json(summary: dict) -> str:
    return json.dumps(summary, indent=2, default=str)


def ring_nodes(r: Resolution, report: DataFrame, run: str, component_id: int) -> DataFrame:
    """Summaries of a group's identities in order."""
    ids = _group(report, run, component_id).select(F.explode("identity_ids").alias("identity_id"))
    return read.summaries(r).join(F.broadcast(ids), "identity_id", "left_semi").orderBy("identity_id")


def ring_detail(r: Resolution, report: DataFrame, reviews: DataFrame, run: str, component_id: int) -> DataFrame:
    """One row: the group, its identities, what they share, and the last review."""
    group = _group(report, run, component_id)
    if group.isEmpty():
        raise read.NotFound(f"component {component_id} not found in run {run}")
    nodes = ring_nodes(r, report, run, component_id).agg(
        F.array_sort(F.collect_list(F.struct("identity_id", "display_name", "record_count", "sources", "first_seen", "status"))).alias("nodes")
    )
    edges = rings.shared_edges(group, rings.identity_attributes(r)).agg(F.array_sort(F.collect_list(F.struct("a", "b", "kinds"))).alias("edges"))
    last = read.latest_reviews(reviews).where((F.col("run_id") == run) & (F.col("component_id") == component_id))
    review = last.agg(F.first(F.struct("decision", "note", "reviewed_at")).alias("review"))
    kept = group.select("run_id", "component_id", "label", "risk_score", "reasons", "features")
    return kept.crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(review))


def _group(report: DataFrame, run: str, component_id: int) -> DataFrame:
    return report.where((F.col("run_id") == run) & (F.col("component_id") == component_id))
