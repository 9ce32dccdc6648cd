"""Groups of identities that share phones, devices or addresses: families and fraud rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kinweave.config import SETTINGS, Settings
from kinweave.functions.numbers import half_even, scaled
from kinweave.operators.components import connected_components
from kinweave.operators.normalize import attributes
from kinweave.plans.resolve import Resolution, numbered
from kinweave.workspace import Workspace

KINDS = ["phone", "device", "address"]


def identity_rows(r: Resolution) -> DataFrame:
    """Current records with their attributes; a record without any has one row, with nulls."""
    now = r.assignments.where("valid_to is null").select("record_id", "identity_id")
    seen = r.records.select("record_id", "source", "ingested_at")
    return now.join(seen, "record_id").join(attributes(r.records), "record_id", "left")


def identity_attributes(r: Resolution) -> DataFrame:
    """(identity_id, kind, value) of current records, each once."""
    now = r.assignments.where("valid_to is null").select("record_id", "identity_id")
    return now.join(attributes(r.records, KINDS), "record_id").select("identity_id", "kind", "value").distinct()


def profiles(r: Resolution) -> DataFrame:
    now = r.assignments.where("valid_to is null").select("record_id", "identity_id")
    return now.join(r.records, "record_id").groupBy("identity_id").agg(
        F.count("*").alias("records"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("ingested_at").alias("first_seen"), F.max((F.col("source") == "bank_kyc").cast("int")).alias("kyc"),
    )


def star_edges(attrs: DataFrame, hub_limit: int) -> DataFrame:
    """Each attribute's least identity with the others; attributes of over ``hub_limit`` give none."""
    heads = attrs.groupBy("kind", "value").agg(F.min("identity_id").alias("u"), F.count("*").alias("n"))
    heads = heads.where((F.col("n") > 1) & (F.col("n") <= hub_limit))
    return attrs.join(heads, ["kind", "value"]).where("identity_id <> u").select("u", F.col("identity_id").alias("v")).distinct()


def ring_report(r: Resolution, s: Settings = SETTINGS, work: Workspace | None = None, run_id: str = "run") -> DataFrame:
    work = work or Workspace(r.records.sparkSession, "rings", shuffled=True)
    attrs = work.table(identity_attributes(r), "attributes")
    parts = connected_components(star_edges(attrs, s.hub_limit), work).select(F.col("node").alias("identity_id"), "component")
    members = work.table(parts.join(profiles(r), "identity_id"), "members")
    shared = members.select("identity_id", "component").join(attrs, "identity_id").groupBy("component", "kind", "value").count()
    most = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0))
    shared = shared.groupBy("component").agg(
        most("device").alias("per_device"), most("phone").alias("per_phone"), most("address").alias("per_address")
    )
    micros = F.unix_micros(F.max(F.col("first_seen")).cast("timestamp")) - F.unix_micros(F.min(F.col("first_seen")).cast("timestamp"))
    groups = members.groupBy("component").agg(
        F.count("*").alias("n"), (micros / 8.64e10).alias("span"), F.avg("kyc").alias("kyc"),
        F.array_sort(F.collect_list("identity_id")).alias("identity_ids"),
    ).where(F.col("n") >= s.min_ring).join(shared, "component")
    groups = groups.withColumn("share", F.col("per_address") / F.col("n"))
    pct = lambda c: F.concat(scaled(F.col(c) * 100, 0).cast("string"), F.lit("%"))
    days = scaled(F.col("span"), 0).cast("string")
    # Points and texts are part of the answer.
    rules = [
        (F.col("span") <= 21, 2, F.concat(F.col("n").cast("string"), F.lit(" identities first seen within "), days, F.lit(" days (burst)"))),
        (F.col("kyc") < 0.3, 2, F.concat(F.lit("only "), pct("kyc"), F.lit(" have bank KYC"))),
        (F.col("per_device") >= 4, 2, F.concat(F.col("per_device").cast("string"), F.lit(" identities share one device"))),
        (F.col("per_phone") >= 4, 1, F.concat(F.col("per_phone").cast("string"), F.lit(" identities share one phone"))),
        ((F.col("share") >= 0.6) & (F.col("kyc") >= 0.5), -2, F.concat(pct("share"), F.lit(" share one home address and most passed KYC (family pattern)"))),
        (F.col("span") > 60, -1, F.concat(F.lit("identities appeared over "), days, F.lit(" days (organic growth)"))),
    ]
    risk = sum((F.when(c, F.lit(float(p))).otherwise(F.lit(0.0)) for c, p, _ in rules), F.lit(0.0))
    out = groups.select(
        F.lit(run_id).alias("run_id"), "component", "identity_ids", risk.alias("risk_score"),
        F.array_compact(F.array(*[F.when(c, why) for c, _, why in rules])).alias("reasons"),
        F.struct(
            F.col("n").cast("int").alias("size"), half_even(F.col("span"), 1).alias("first_seen_span_days"), half_even(F.col("kyc"), 2).alias("kyc_fraction"),
            F.col("per_device").cast("int").alias("max_identities_per_device"), F.col("per_phone").cast("int").alias("max_identities_per_phone"),
            half_even(F.col("share"), 2).alias("address_share"),
        ).alias("features"),
        (-risk).alias("_risk"), (-F.col("n")).alias("_n"),
    ).withColumn("label", F.when(F.col("risk_score") >= 4, "SUSPICIOUS_RING").when(F.col("risk_score") <= 0, "LIKELY_FAMILY").otherwise("REVIEW"))
    out = numbered(out, ["_risk", "_n", "component"], work, "ranked")
    return out.withColumnRenamed("number", "component_id").drop("_risk", "_n", "component")


def shared_edges(report: DataFrame, attrs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(component_id, a, b, kinds): identities of a component that share an attribute.

    An attribute that up to ``hub_limit`` identities of the component have joins all two of
    them; one that more have joins the least of them with each other, so there are at most
    ``hub_limit`` rows for each identity that has it.
    """
    ids = report.select("component_id", F.explode("identity_ids").alias("identity_id"))
    own = ids.join(attrs, "identity_id")
    key = ["component_id", "kind", "value"]
    sizes = own.groupBy(*key).agg(F.count("*").alias("n"), F.min("identity_id").alias("least")).where("n > 1")
    heads = own.join(sizes, key).where((F.col("n") <= s.hub_limit) | (F.col("identity_id") == F.col("least")))
    met = heads.select(*key, F.col("identity_id").alias("a")).join(own.select(*key, F.col("identity_id").alias("b")), key).where("a < b")
    return met.groupBy("component_id", "a", "b").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def evaluate_rings(report: DataFrame, assignments: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: planted and flagged rings, recall, families and how many were flagged."""
    now = assignments.where("valid_to is null").select("record_id", "identity_id")
    vote = truth.withColumn("is_ring", F.col("ring_id") != "").withColumn("group_id", F.when(F.col("ring_id") != "", F.col("ring_id")).otherwise(F.col("family_id")))
    first = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("is_ring"), "group_id")
    votes = now.join(vote, "record_id").groupBy("identity_id", "is_ring", "group_id").agg(F.count("*").alias("n"))
    modes = votes.withColumn("_k", F.row_number().over(first(["identity_id"]))).where("_k = 1").drop("_k", "n")
    ids = report.select("component_id", "label", F.size("identity_ids").alias("size"), F.explode("identity_ids").alias("identity_id"))
    by = ids.join(modes, "identity_id").groupBy("component_id", "label", "size", "is_ring", "group_id").agg(F.count("*").alias("n"))
    top = by.withColumn("_k", F.row_number().over(first(["component_id"]))).where("_k = 1")
    suspicious = F.col("label") == "SUSPICIOUS_RING"
    family = ~F.col("is_ring") & (F.col("group_id") != "")
    found = top.agg(
        F.count_distinct(F.when(F.col("is_ring") & suspicious & (F.col("n") * 2 >= F.col("size")), F.col("group_id"))).alias("rings_flagged"),
        F.count(F.when(family, 1)).alias("family_groups_analyzed"), F.count(F.when(family & suspicious, 1)).alias("families_falsely_flagged"),
    )
    planted = truth.agg(F.count_distinct(F.when(F.col("ring_id") != "", F.col("ring_id"))).alias("planted_rings"))
    return planted.crossJoin(found).withColumn("ring_recall", F.when(F.col("planted_rings") > 0, half_even(F.col("rings_flagged") / F.col("planted_rings"), 3)))
