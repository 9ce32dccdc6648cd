"""From raw documents to a mixed training set, one operator of ``kinweave.llm`` per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.decontaminate import contaminated
from kinweave.llm.mixing import mix_filtered
from kinweave.llm.quality_rules import quality_rules
from kinweave.llm.simhash import near_duplicates
from kinweave.llm.substrings import remove_repeated
from kinweave.workspace import Workspace, scope

#: Up to so many documents that go, an id and a hash each, are broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id.

    Documents are near-duplicates if they share at least 0.8 of their five-word shingles; pairs
    are found by SimHash, then compared by their shingles. A
    document is an id and a text, so an id that comes with two texts is two documents, and one
    row stays of rows that repeat both. Null ids come after all others.
    """
    work = Workspace(spark, "near-copies")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))
    groups = near_duplicates(docs.select(key.alias("key"), "text"), id_col="key", width=5, similarity=0.8)
    groups = work.table(groups, "groups")
    same = F.col("key").eqNullSafe(F.col("component_id"))
    gone = work.table(groups.where(~same).select("key.doc_id", "key.hash").distinct(), "gone")
    kept = _without(docs.withColumn("_hash", F.xxhash64("text")), gone, ["doc_id", "hash"], ["doc_id", "_hash"])
    if not groups.where(same).groupBy("key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_hash"])
    return kept.select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame, theirs: list[str], ours: list[str]) -> DataFrame:
    """``docs`` without those in ``gone``, which is broadcast if it is small."""
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = [docs[a].eqNullSafe(gone[b]) for a, b in zip(ours, theirs)]
    return docs.join(gone, same, "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated windows cover; a text left without words goes."""
    cut = remove_repeated(docs.select(F.struct(*COLUMNS).alias("row"), "text"), id_col="row")
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    return left.select(
        "row.doc_id", text.alias("text"), "row.lang", "row.source",
        F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept").cast("long")).alias("n_chars"),
    )


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found; of an id with several texts those without one."""
    work = Workspace(spark, "leaks")
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    named = keyed.select(F.struct("doc_id", F.col("_hash").alias("hash")).alias("key"), "text")
    leaks = contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").select("key.doc_id", "key.hash").distinct()
    return _without(keyed, work.table(leaks, "leaks"), ["doc_id", "hash"], ["doc_id", "_hash"]).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a positive rate, that rate, and how many copies realise it."""
    mixed = mix_filtered(spark, docs, sf_dir, keep=COLUMNS)
    return mixed.where("rate > 0").select(*COLUMNS, "tokens", "rate", "copies")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mixture),
]

#: SQL cannot express the robust estimate or the fingerprints; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scope():
            docs = work.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.remove(f"stage-{k - 1}")
    return docs
