"""Tables at rest: the truth as CSV, resolved tables by address, and messages to replay."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.operators.normalize import attributes
from kinweave.plans.resolve import Resolution
from kinweave.sources.contracts import CONTRACTS, parse

TRUTH = "record_id string, person_id string, family_id string, ring_id string"
RESOLVED = {
    "records": "record_id string, source string, ingested_at timestamp_ntz, display_name string, name_tokens array<string>, dob date, phones array<string>, "
    "email string, address string, pincode string, id_hash string, device_id string, quality_flags array<string>",
    "links": "record_a string, record_b string, score double, name_similarity double, reasons array<string>, created_at timestamp_ntz",
    "assignments": "record_id string, identity_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, reason string",
    "identities": "identity_id string, created_at timestamp_ntz, merged_into string, merged_at timestamp_ntz",
    "outcomes": "record_id string, identity_id string, action string, matched_records int, merged_identities int",
}


def write_truth(truth: DataFrame, path: str) -> None:
    truth.select(*[f.split()[0] for f in TRUTH.split(", ")]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows, empty text for none; of a record id that comes twice the last row counts."""
    rows = spark.read.option("header", True).schema(TRUTH).csv(path).na.fill("").withColumn("_at", F.monotonically_increasing_id())
    last = F.max_by(F.struct("person_id", "family_id", "ring_id"), "_at").alias("t")
    return rows.groupBy("record_id").agg(last).select("record_id", "t.*")


def _nested(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ") if "array<" in f]


class Store:
    """Resolved tables at ``parquet:<folder>`` or ``jdbc:<address>``.

    A database has no arrays, so they are JSON text there.
    """

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> None:
        kind, _, rest = url.partition(":")
        if kind not in ("parquet", "jdbc") or not rest:
            raise ValueError(f"not an address of tables: {url}")
        self.spark, self.kind, self.where = spark, kind, rest if kind == "parquet" else url
        self.properties = properties or {}

    def save(self, r: Resolution) -> None:
        for name, schema in RESOLVED.items():
            rows = getattr(r, name).select(*[f.split()[0] for f in schema.split(", ")])
            if self.kind == "parquet":
                rows.write.mode("overwrite").parquet(f"{self.where}/{name}")
            else:
                to_json(rows, _nested(schema)).write.jdbc(self.where, name, "overwrite", self.properties)

    def save_attributes(self, r: Resolution) -> None:
        """The table that searches read, in order of kind and value."""
        rows = attributes(r.records).repartitionByRange("kind", "value").sortWithinPartitions("kind", "value")
        if self.kind == "parquet":
            rows.write.mode("overwrite").parquet(f"{self.where}/attributes")
        else:
            rows.write.jdbc(self.where, "attributes", "overwrite", self.properties)

    def attributes(self) -> DataFrame:
        if self.kind == "parquet":
            return self.spark.read.parquet(f"{self.where}/attributes")
        return self.spark.read.jdbc(self.where, "attributes", properties=self.properties)

    def create(self) -> None:
        """Empty tables where there are none."""
        for name, schema in RESOLVED.items():
            if self.kind == "parquet":
                self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.where}/{name}")
            else:
                to_json(self.spark.createDataFrame([], schema), _nested(schema)).write.jdbc(self.where, name, "ignore", self.properties)

    def load(self) -> Resolution:
        def one(name: str, schema: str) -> DataFrame:
            if self.kind == "parquet":
                return self.spark.read.schema(schema).parquet(f"{self.where}/{name}")
            return from_json(self.spark.read.jdbc(self.where, name, properties=self.properties), _nested(schema))

        return Resolution(**{name: one(name, schema) for name, schema in RESOLVED.items()})

    def health(self) -> dict:
        """Whether the tables can be read."""
        try:
            self.load().identities.limit(1).count()
        except Exception as e:  # whatever the source says
            return {"status": "error", "detail": str(e).splitlines()[0]}
        return {"status": "ok"}


def to_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.to_json(c) for c in columns}) if columns else rows


def from_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in columns}) if columns else rows


def messages(lines: DataFrame, topic: str = "raw.{source}") -> DataFrame:
    """(topic, key, value) of lines with a column ``raw``: a topic for each source, the record id as key."""
    key = F.coalesce(*[F.when(F.col("source") == c.source, F.try_element_at("payload", F.lit(c.id_field))) for c in CONTRACTS])
    to = F.replace(F.lit(topic), F.lit("{source}"), F.col("source"))
    return parse(lines).select(to.alias("topic"), key.cast("binary").alias("key"), F.trim("raw").cast("binary").alias("value"))


def send(rows: DataFrame, servers: str) -> None:
    """Write messages to Kafka, acknowledged by all replicas; needs Spark's Kafka connector."""
    out = rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all")
    out.option("kafka.enable.idempotence", "true").option("kafka.linger.ms", "20").save()


def replay(
    lines: DataFrame, folder: str, rate: float = 0, limit: int | None = None, step: int = 1000,
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Drop (at, raw) lines into a folder that a stream reads, in order of ``at``, ``rate`` a second.

    Returns how many were dropped, ``limit`` at most. Files hold ``step`` lines.
    """
    told = lines.orderBy("at", "raw")
    told = told.limit(limit) if limit else told
    sent, began, held = 0, clock(), []

    def drop() -> None:
        nonlocal sent, held
        if held:
            lines.sparkSession.createDataFrame([(x,) for x in held], "value string").coalesce(1).write.mode("append").text(folder)
            sent, held = sent + len(held), []
            if rate > 0 and (ahead := sent / rate - (clock() - began)) > 0:
                sleep(ahead)

    for row in told.select("raw").toLocalIterator():
        held.append(row.raw)
        if len(held) >= step:
            drop()
    drop()
    return sent
