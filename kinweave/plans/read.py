"""Questions about resolved identities: views at a time, search, explanations, overview.

Each returns a DataFrame. Arguments that name one thing are filters that reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.functions import text as t
from kinweave.functions.similarity import key_of
from kinweave.operators.normalize import attributes
from kinweave.plans.resolve import Resolution

DECISIONS = ("confirmed_fraud", "false_alarm")
SEARCH_LIMIT = 50
ACTIVITY_DEFAULT, ACTIVITY_MAX = 15, 100


class BadRequest(ValueError):
    """The question makes no sense."""


class NotFound(LookupError):
    """There is no such thing, or was none at that time."""


def parse_as_of(spark, value: str | None) -> str | None:
    if not value:
        return None
    if not re.match(r"\d{4}-\d{2}-\d{2}", value):  # no "now" or "yesterday"
        raise BadRequest(f"not a time: {value}")
    found = spark.range(1).select(F.date_format(t.as_of(F.lit(value)), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    if found is None:
        raise BadRequest(f"not a time: {value}")
    return found


def valid_at(as_of: str | None) -> Column:
    """Which assignments hold at a time: start included, end excluded; now without a time."""
    if as_of is None:
        return F.col("valid_to").isNull()
    at = F.lit(as_of).cast("timestamp_ntz")
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def public_records(records: DataFrame) -> DataFrame:
    """Records without what identifies a person to others."""
    return records.select(
        "record_id", "source", "ingested_at", F.col("display_name").alias("name_as_written"), "dob",
        F.transform("phones", t.masked_phone).alias("phones"), t.masked_email(F.col("email")).alias("email"),
        "address", "pincode", F.col("id_hash").isNotNull().alias("has_government_id"), "device_id", "quality_flags",
    )


def records_of(r: Resolution, identity_id: str, as_of: str | None = None) -> DataFrame:
    now = r.assignments.where((F.col("identity_id") == identity_id) & valid_at(as_of)).select("record_id")
    return r.records.join(now, "record_id").orderBy("ingested_at", "record_id")


def _info(r: Resolution, identity_id: str):
    found = r.identities.where(F.col("identity_id") == identity_id).first()
    if found is None:
        raise NotFound(f"identity {identity_id} not found")
    return found


def identity_view(r: Resolution, identity_id: str, as_of: str | None = None) -> DataFrame:
    """One row: status at the time, counts, and the public records."""
    as_of = parse_as_of(r.records.sparkSession, as_of)
    info = _info(r, identity_id)
    if as_of and info.created_at.isoformat() > as_of:
        raise NotFound(f"identity {identity_id} did not exist yet at {as_of}")
    merged = info.merged_into is not None and (as_of is None or info.merged_at.isoformat() <= as_of)
    rows = public_records(records_of(r, identity_id, as_of))
    return rows.agg(
        F.lit(identity_id).alias("identity_id"), F.lit(as_of or "now").alias("as_of"), F.lit("merged" if merged else "active").alias("status"),
        F.lit(info.merged_into if merged else None).cast("string").alias("merged_into"), F.lit(info.created_at.isoformat()).alias("created_at"),
        F.count("*").alias("record_count"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("name_as_written")).alias("names_seen"),
        F.array_sort(F.collect_list(F.struct("ingested_at", "record_id", "source", "name_as_written", "phones", "email", "has_government_id"))).alias("records"),
    )


def record_view(r: Resolution, record_id: str, as_of: str | None = None) -> DataFrame:
    as_of = parse_as_of(r.records.sparkSession, as_of)
    return r.assignments.where((F.col("record_id") == record_id) & valid_at(as_of)).select("record_id", F.lit(as_of or "now").alias("as_of"), "identity_id")


def history_view(r: Resolution, identity_id: str) -> DataFrame:
    _info(r, identity_id)
    return r.assignments.where(F.col("identity_id") == identity_id).select(
        "record_id", F.col("valid_from").alias("joined_at"), F.col("valid_to").alias("left_at"), "reason"
    ).orderBy("joined_at", "record_id")


def explain_view(r: Resolution, identity_id: str) -> DataFrame:
    """Links among the identity's current records."""
    _info(r, identity_id)
    now = r.assignments.where((F.col("identity_id") == identity_id) & valid_at(None)).select("record_id")
    both = r.links.join(now.withColumnRenamed("record_id", "record_a"), "record_a", "left_semi").join(now.withColumnRenamed("record_id", "record_b"), "record_b", "left_semi")
    return both.select("record_a", "record_b", "score", F.col("reasons").alias("evidence"), F.col("created_at").alias("linked_at")).orderBy("linked_at", "record_a", "record_b")


def summaries(r: Resolution) -> DataFrame:
    """For each identity the spelling to show, the number of records and the sources.

    The most frequent spelling wins, then the one with most words, then the longest, then the
    one seen first.
    """
    now = r.assignments.where(valid_at(None)).select("record_id", "identity_id")
    named = now.join(r.records, "record_id").select(
        "identity_id", "source", "ingested_at", "record_id", t.spoken_name(F.col("display_name")).alias("name")
    )
    times = F.count("*").over(Window.partitionBy("identity_id", F.lower("name")))
    ranked = named.withColumn("_rank", F.struct(times.alias("n"), F.size(t.name_tokens(F.col("name"))).alias("w"), F.length("name").alias("l")))
    best = F.row_number().over(Window.partitionBy("identity_id").orderBy(F.desc("_rank"), "ingested_at", "record_id"))
    out = ranked.withColumn("_k", best).groupBy("identity_id").agg(
        t.title_case(F.max(F.when(F.col("_k") == 1, F.col("name")))).alias("display_name"), F.count("*").alias("record_count"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.min("ingested_at").alias("first_seen"),
    )
    status = r.identities.select("identity_id", F.when(F.col("merged_into").isNull(), "active").otherwise("merged").alias("status"), "merged_into")
    return out.join(status, "identity_id")


def asked_for(spark, phone: str | None = None, email: str | None = None, name: str | None = None) -> list[tuple[str, str]]:
    """The (kind, value) attributes that a search is about."""
    if not (phone or email or name):
        raise BadRequest("give a phone, an email or a name")
    found = []
    for kind, value, clean in (("phone", phone, t.phone), ("email", email, t.email)):
        if value:
            known = spark.range(1).select(clean(F.lit(value)).alias("v")).first().v
            if known is None:
                raise BadRequest(f"not a valid {kind}: {value}")
            found.append((kind, known))
    if name:
        words = [w for w in re.sub("[^a-z]+", " ", name.lower()).split() if w not in t.HONORIFICS and len(w) > 1]
        keys = sorted({key_of(w) for w in words} - {""})
        if not keys:
            raise BadRequest("a name needs a word of two letters")
        found += [("nkey", k) for k in keys]
    return found


def hits(attrs: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """(record_id) with one of the phones or emails asked for, or with all sounds of the name."""
    exact = [(F.col("kind") == k) & (F.col("value") == v) for k, v in asked if k != "nkey"]
    keys = [v for k, v in asked if k == "nkey"]
    every = [attrs.where(c).select("record_id") for c in exact]
    if keys:
        found = attrs.where((F.col("kind") == "nkey") & F.col("value").isin(keys)).groupBy("record_id").agg(F.count_distinct("value").alias("n"))
        every.append(found.where(F.col("n") == len(keys)).select("record_id"))
    out = every[0]
    for more in every[1:]:
        out = out.union(more)
    return out.distinct()


def restricted(r: Resolution, ids: DataFrame) -> Resolution:
    """The tables with what concerns the identities of ``ids(identity_id)``, a few, now or earlier."""
    few = F.broadcast(ids.select("identity_id").distinct())
    assignments = r.assignments.join(few, "identity_id", "left_semi")
    records = r.records.join(assignments.select("record_id").distinct(), "record_id", "left_semi")
    return Resolution(records, r.links, assignments, r.identities.join(few, "identity_id", "left_semi"), r.outcomes)


def search(r: Resolution, phone: str | None = None, email: str | None = None, name: str | None = None, attrs: DataFrame | None = None) -> DataFrame:
    """Identities with the phone, or the email, or all sounds of the name; the first SEARCH_LIMIT.

    ``attrs`` is the attribute table if it has been kept; without it attributes of the kinds asked
    for are made from all records. :class:`kinweave.plans.index.Index` answers from what it looks up.
    """
    asked = asked_for(r.records.sparkSession, phone, email, name)
    found = hits(attributes(r.records, [kind for kind, _ in asked]) if attrs is None else attrs, asked)
    ids = r.assignments.where(valid_at(None)).join(found, "record_id", "left_semi").select("identity_id").distinct()
    return listed(ids, lambda few: summaries(restricted(r, few)))


def listed(ids: DataFrame, summed) -> DataFrame:
    """Summaries of the first SEARCH_LIMIT of ``ids``, by ``summed`` of these, and whether there are more."""
    first = [(x.identity_id,) for x in ids.orderBy("identity_id").limit(SEARCH_LIMIT + 1).collect()]
    few = ids.sparkSession.createDataFrame(first[:SEARCH_LIMIT], "identity_id string")
    return summed(few).withColumn("truncated", F.lit(len(first) > SEARCH_LIMIT)).orderBy("identity_id")


def search_by(q: str) -> dict[str, str]:
    """What a text is searched as: an email with an @, a phone with ten digits or more, else a name."""
    q = (q or "").strip()
    if not q:
        raise BadRequest("give a name, a phone or an email")
    return {"email" if "@" in q else "phone" if sum(c.isdigit() for c in q) >= 10 else "name": q}


def smart_search(r: Resolution, q: str, attrs: DataFrame | None = None) -> DataFrame:
    return search(r, **search_by(q), attrs=attrs)


def stats(r: Resolution) -> DataFrame:
    counts = r.records.agg(F.count("*").alias("records"), F.max("ingested_at").alias("latest_ingest"))
    ids = r.identities.agg(F.count_if(F.col("merged_into").isNull()).alias("active_identities"), F.count_if(F.col("merged_into").isNotNull()).alias("merged_identities"))
    by = r.records.groupBy("source").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "count")))).alias("by_source"))
    return counts.crossJoin(ids).crossJoin(r.links.agg(F.count("*").alias("links"))).crossJoin(by)


def activity(r: Resolution, limit: int = ACTIVITY_DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The newest records with their assignment, and the newest merges."""
    limit = max(1, min(limit, ACTIVITY_MAX))
    newest = r.records.orderBy(F.desc("ingested_at"), F.desc("record_id")).limit(limit)
    now = r.assignments.where(valid_at(None)).select("record_id", "identity_id", F.col("reason").alias("assigned_because"))
    records = newest.join(now, "record_id").select("record_id", "source", "ingested_at", F.col("display_name").alias("name_as_written"), "identity_id", "assigned_because")
    merges = r.identities.where("merged_into is not null").orderBy(F.desc("merged_at"), "identity_id").limit(limit)
    return records.orderBy(F.desc("ingested_at"), F.desc("record_id")), merges


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last decision for each component of a run."""
    w = Window.partitionBy("run_id", "component_id").orderBy(F.desc("reviewed_at"))
    return reviews.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def checked_review(report: DataFrame, run_id: str, component_id: int, decision: str, note: str, reviewed_at: str) -> DataFrame:
    """A row to append to the reviews table."""
    if decision not in DECISIONS:
        raise BadRequest(f"decision must be one of {sorted(DECISIONS)}")
    if report.where((F.col("run_id") == run_id) & (F.col("component_id") == component_id)).isEmpty():
        raise NotFound(f"component {component_id} not found in run {run_id}")
    row = (run_id, component_id, decision, (note or "").strip()[:500], reviewed_at)
    return report.sparkSession.createDataFrame([row], "run_id string, component_id long, decision string, note string, reviewed_at string")


def rings_view(report: DataFrame, reviews: DataFrame, label: str | None = None) -> DataFrame:
    out = report.join(latest_reviews(reviews), ["run_id", "component_id"], "left")
    if label:
        out = out.where(F.col("label") == label.upper())
    return out.orderBy(F.desc("risk_score"), "component_id")


def _histogram(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row with a map from the values of a column to how often they occur."""
    counts = rows.groupBy(column).count()
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias(name))


def overview(report: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row about the report of one run, such as ``analysis.latest_report`` gives."""
    last = latest_reviews(reviews)
    joined = report.join(last, ["run_id", "component_id"], "left")
    suspicious = F.col("label") == "SUSPICIOUS_RING"
    counts = joined.agg(
        F.max("run_id").alias("analysis_run"), F.count_if(suspicious).alias("suspicious_total"),
        F.count_if(suspicious & F.col("decision").isNull()).alias("suspicious_open"),
    )
    decided = last.join(report.select("run_id").distinct(), "run_id", "left_semi")
    return counts.crossJoin(_histogram(report, "label", "label_counts")).crossJoin(_histogram(decided, "decision", "decisions"))


def source_shares(records: DataFrame) -> DataFrame:
    n = records.groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
