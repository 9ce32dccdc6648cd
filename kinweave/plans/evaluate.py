"""Pairwise accuracy and kinds of error against a truth table, from counts alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.functions.numbers import half_even


def _pairs(counts: DataFrame) -> Column:
    return F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0))


def over_merged(common: DataFrame) -> DataFrame:
    """(identity_id, people, kind) of identities with several people."""
    one = lambda c: (F.size(F.collect_set(c)) == 1) & (F.max(c) != "")
    kind = F.when(one("family_id"), "same family").when(one("ring_id"), "same fraud ring").otherwise("unrelated people")
    return common.groupBy("identity_id").agg(F.count_distinct("person_id").alias("people"), kind.alias("kind")).where("people > 1")


def pairwise_metrics(current: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of metrics from ``current(record_id, identity_id)`` and the truth."""
    common = current.join(truth.fillna("", ["family_id", "ring_id"]), "record_id")
    cells = common.groupBy("identity_id", "person_id").count()
    found = cells.groupBy("identity_id").agg(F.sum("count").alias("count"))
    real = cells.groupBy("person_id").agg(F.sum("count").alias("count"), F.count("*").alias("ids"))
    kinds = over_merged(common)
    num = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    row = (
        cells.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("records"), _pairs(cells).alias("tp"))
        .crossJoin(found.agg(F.count("*").alias("predicted_identities"), _pairs(found).alias("pp")))
        .crossJoin(real.agg(F.count("*").alias("true_people"), _pairs(real).alias("ap"), F.count(F.when(F.col("ids") > 1, 1)).alias("people_split_across_identities")))
        .crossJoin(kinds.agg(F.count("*").alias("over_merged_identities"), num("same family").alias("merged_same_family"),
                             num("same fraud ring").alias("merged_same_ring"), num("unrelated people").alias("merged_unrelated")))
    )
    p = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(1.0)
    r = F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(1.0)
    row = row.withColumn("_p", p).withColumn("_r", r)
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    return row.select(
        "records", "true_people", "predicted_identities", half_even(F.col("_p"), 4).alias("precision"), half_even(F.col("_r"), 4).alias("recall"), half_even(f1, 4).alias("f1"),
        "over_merged_identities", "merged_same_family", "merged_same_ring", "merged_unrelated", "people_split_across_identities",
    )
