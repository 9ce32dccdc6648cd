"""Jobs for spark-submit: ``python -m kinweave.jobs generate|resolve|analyze|replay|stream``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession, functions as F

from kinweave.plans import analysis, resolve as res
from kinweave.sources import contracts, generate, tables
from kinweave.streaming import ingest, resolver


def make(spark: SparkSession, folder: str, persons: int, rings: int, seed: int) -> dict:
    """Records as JSON Lines in order of arrival and the truth as CSV; counts of what was made."""
    envelopes, truth = generate.generate(spark, persons, rings, seed)
    generate.write_jsonl(envelopes, f"{folder}/records", ordered=True)
    tables.write_truth(truth, f"{folder}/truth")
    return generate.summary(envelopes, truth)


def offline(spark: SparkSession, folder: str, store: str) -> dict:
    """Resolve the records of a folder; actions, contract errors and records a second."""
    began = time.monotonic()
    checked = contracts.validated(contracts.read_jsonl(spark, f"{folder}/records"))
    r = res.resolve(contracts.canonical(checked))
    tables.Store(spark, store).save(r)
    found = {x.action: x["count"] for x in res.all_outcomes(contracts.canonical(checked), r).groupBy("action").count().collect()}
    total = sum(found.values())
    return {"actions": found, "contract_errors": checked.where("error is not null").count(), "records_per_second": round(total / (time.monotonic() - began), 1)}


def serve(spark: SparkSession, lines: str, lake: str, checkpoint: str, until_empty: bool) -> None:
    """Resolve a folder of lines as they come, with a row of metrics every ten seconds, until SIGTERM."""
    stopping, meter = resolver.Stopping(), resolver.Meter(resolver.Lake(spark, lake))
    spark.streams.addListener(meter)
    try:
        resolver.serve(resolver.start(ingest.folder_lines(spark, lines), lake, checkpoint, until_empty, stopping=stopping), stopping)
    finally:
        spark.streams.removeListener(meter)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinweave.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("generate")
    one.add_argument("folder")
    one.add_argument("--persons", type=int, default=3000)
    one.add_argument("--rings", type=int, default=15)
    one.add_argument("--seed", type=int, default=42)
    one = jobs.add_parser("resolve")
    one.add_argument("folder")
    one.add_argument("store")
    one = jobs.add_parser("analyze")
    one.add_argument("store")
    one.add_argument("reports")
    one.add_argument("--truth")
    one = jobs.add_parser("replay")
    one.add_argument("folder")
    one.add_argument("target")
    one.add_argument("--rate", type=float, default=0)
    one.add_argument("--limit", type=int)
    one = jobs.add_parser("stream")
    one.add_argument("lines")
    one.add_argument("lake")
    one.add_argument("checkpoint")
    one.add_argument("--until-empty", action="store_true")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"kinweave-{a.job}").getOrCreate()
    if a.job == "generate":
        print(analysis.as_json(make(spark, a.folder, a.persons, a.rings, a.seed)))
    elif a.job == "resolve":
        print(analysis.as_json(offline(spark, a.folder, a.store)))
    elif a.job == "analyze":
        truth = tables.read_truth(spark, a.truth) if a.truth else None
        print(analysis.as_json(analysis.run_analysis(tables.Store(spark, a.store).load(), a.reports, truth)))
    elif a.job == "replay":
        lines = spark.read.text(f"{a.folder}/records").select(F.col("value").alias("raw"), F.get_json_object("value", "$.ingested_at").alias("at"))
        print(tables.replay(lines, a.target, a.rate, a.limit))
    else:
        serve(spark, a.lines, a.lake, a.checkpoint, a.until_empty)


if __name__ == "__main__":
    main()
