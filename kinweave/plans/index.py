"""Resolved tables kept for questions: each is found by key, and a question reads a few files.

A question about an identity looks up its assignments, then the records these name, and hands
them to the views of :mod:`kinweave.plans.read`, which then see nothing else. Reports of ring
runs and the reviews of their groups are kept beside them; a later review takes the place of an
earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.operators.normalize import attributes
from kinweave.plans import analysis, read
from kinweave.plans.resolve import Resolution
from kinweave.sources.ledger import Kept, Ledger, Snapshot
from kinweave.sources.tables import RESOLVED

FEATURES = "size:int,first_seen_span_days:double,kyc_fraction:double,max_identities_per_device:int,max_identities_per_phone:int,address_share:double"
TABLES = {
    "records": Kept(RESOLVED["records"], ("record_id",)),
    "attributes": Kept("record_id string, kind string, value string", ("kind", "value")),
    "assignments": Kept(RESOLVED["assignments"], ("identity_id",)),
    "assignments_by_record": Kept(RESOLVED["assignments"], ("record_id",)),
    "identities": Kept(RESOLVED["identities"], ("identity_id",)),
    "links": Kept(RESOLVED["links"], ("record_b",)),
    "reports": Kept(
        f"run_id string, component_id long, label string, risk_score double, identity_ids array<string>, reasons array<string>, features struct<{FEATURES}>",
        ("run_id", "component_id"),
    ),
    "reviews": Kept("run_id string, component_id long, decision string, note string, reviewed_at string", ("run_id", "component_id"), latest=True),
}
#: Characters of a note that are kept.
NOTE = 500


class Index(Ledger):
    """Tables below a folder that all executors share; a commit replaces what is resolved at once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, TABLES)

    def save(self, r: Resolution) -> None:
        """Keep resolved tables in place of those kept before; questions see either all old or all new ones."""
        change = self.begin()
        change.replace("records", r.records)
        change.replace("attributes", attributes(r.records))
        change.replace("assignments", r.assignments)
        change.replace("assignments_by_record", r.assignments)
        change.replace("identities", r.identities)
        change.replace("links", r.links)
        change.commit()

    # --- questions ------------------------------------------------------------------------

    def _keys(self, table: str, *rows: tuple) -> DataFrame:
        key = TABLES[table].key
        kinds = {c: k for c, _, k in (part.partition(" ") for part in TABLES[table].schema.split(", "))}
        return self.spark.createDataFrame(list(rows), ", ".join(f"{c} {kinds[c]}" for c in key))

    def about(self, ids: DataFrame, now: Snapshot | None = None) -> Resolution:
        """The tables as far as they concern ``ids(identity_id)``, now or at any time.

        Links are those whose later record is or was in one of them.
        """
        now = now or self.snapshot()
        assignments = now.lookup("assignments", ids)
        links = now.lookup("links", assignments.select(F.col("record_id").alias("record_b")))
        return Resolution(now.lookup("records", assignments), links, assignments, now.lookup("identities", ids), links)

    def identity(self, identity_id: str) -> Resolution:
        return self.about(self._keys("identities", (identity_id,)))

    def identity_view(self, identity_id: str, as_of: str | None = None) -> DataFrame:
        return read.identity_view(self.identity(identity_id), identity_id, as_of)

    def history_view(self, identity_id: str) -> DataFrame:
        return read.history_view(self.identity(identity_id), identity_id)

    def explain_view(self, identity_id: str) -> DataFrame:
        return read.explain_view(self.identity(identity_id), identity_id)

    def record_view(self, record_id: str, as_of: str | None = None) -> DataFrame:
        """One row; a record that is not there, or was not at that time, is not found."""
        now = self.snapshot()
        rows = now.lookup("assignments_by_record", self._keys("assignments_by_record", (record_id,)))
        none = self.spark.createDataFrame([], RESOLVED["identities"])
        out = read.record_view(Resolution(now.read("records"), rows, rows, none, rows), record_id, as_of)
        if out.isEmpty():
            raise read.NotFound(f"record {record_id} not found" + (f" at {as_of}" if as_of else ""))
        return out

    def search(self, phone: str | None = None, email: str | None = None, name: str | None = None) -> DataFrame:
        asked = read.asked_for(self.spark, phone, email, name)
        now = self.snapshot()
        found = read.hits(now.lookup("attributes", self._keys("attributes", *asked)), asked)
        ids = now.lookup("assignments_by_record", found).where(read.valid_at(None)).select("identity_id").distinct()
        return read.listed(ids, lambda few: read.summaries(self.about(few, now)))

    def smart_search(self, q: str) -> DataFrame:
        return self.search(**read.search_by(q))

    # --- ring runs and reviews ------------------------------------------------------------

    def save_report(self, report: DataFrame, run: str) -> None:
        """Keep the report of a run, which becomes the latest; a run that is there already is an error."""
        change = self.begin()
        runs = change.facts.get("runs", [])
        if run in runs:
            raise ValueError(f"run {run} is there already")
        change.append("reports", report.withColumn("run_id", F.lit(run)))
        change.facts["runs"] = [*runs, run]
        change.commit()

    def report(self) -> DataFrame:
        """Groups of the latest run; none without a run."""
        now = self.snapshot()
        return now.read("reports").where(F.col("run_id") == (now.facts.get("runs") or [""])[-1])

    def save_reviews(self, reviews: DataFrame) -> None:
        """Keep decisions on groups, one for a group at most, in place of earlier ones.

        A decision that is none of :data:`kinweave.plans.read.DECISIONS` and a group that no
        report has are errors, and nothing is kept then. Notes lose white space around them
        and what is beyond NOTE characters; a null note is an empty one.
        """
        change = self.begin()
        if not reviews.where(~F.coalesce(F.col("decision").isin(*read.DECISIONS), F.lit(False))).isEmpty():
            raise read.BadRequest(f"decision must be one of {sorted(read.DECISIONS)}")
        known = change.base.lookup("reports", reviews).select("run_id", "component_id")
        lost = reviews.join(known, ["run_id", "component_id"], "left_anti").first()
        if lost is not None:
            raise read.NotFound(f"component {lost.component_id} not found in run {lost.run_id}")
        change.append("reviews", reviews.withColumn("note", F.substring(F.trim(F.coalesce("note", F.lit(""))), 1, NOTE)))
        change.commit()

    def review(self, run: str, component_id: int, decision: str, note: str, reviewed_at: str) -> None:
        self.save_reviews(self.spark.createDataFrame([(run, component_id, decision, note, reviewed_at)], TABLES["reviews"].schema))

    def rings_view(self, label: str | None = None) -> DataFrame:
        report = self.report()
        return read.rings_view(report, self.snapshot().read("reviews"), label)

    def overview(self) -> DataFrame:
        return read.overview(self.report(), self.snapshot().read("reviews"))

    def ring_detail(self, run: str, component_id: int) -> DataFrame:
        """One row about a group, from what is looked up for its identities."""
        now = self.snapshot()
        key = self._keys("reports", (run, component_id))
        group = now.lookup("reports", key)
        ids = group.select(F.explode("identity_ids").alias("identity_id"))
        return analysis.ring_detail(self.about(ids, now), group, now.lookup("reviews", key), run, component_id)
