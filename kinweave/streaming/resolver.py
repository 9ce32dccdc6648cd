"""Identities resolved micro-batch by micro-batch, with the answers of one batch over all.

The state is a ledger of tables, each kept by the key that a batch asks it for: records by id,
blocking keys by key, a record's current identity by record, members by identity. So a batch
reads the records that share a blocking key with its own and the members of the identities it
touches, and nothing else of what came before. All tables of a batch become visible by one
commit; a batch that died before it left nothing, and one that runs again after it does
nothing. Arrival order is the batch, then (ingested_at, record_id).
"""

from __future__ import annotations

import json
import re
import signal
import threading
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from kinweave.config import SETTINGS, Settings
from kinweave.operators.components import connected_components
from kinweave.operators.normalize import blocking_keys, normalized
from kinweave.plans.resolve import Resolution, blocks, first_deliveries, history, may_match, numbered, pairs_of_blocks, said, scored
from kinweave.sources.contracts import canonical, contract_error, parse, time_error
from kinweave.sources.ledger import Change, Kept, Ledger
from kinweave.workspace import Workspace

TABLES = {
    "records": Kept(
        "record_id string, source string, ingested_at timestamp_ntz, display_name string, name_tokens array<string>, dob date, "
        "phones array<string>, email string, address string, pincode string, id_hash string, device_id string, quality_flags array<string>",
        ("record_id",),
    ),
    "keys": Kept("key string, record_id string, rank int", ("key",)),
    "current": Kept("record_id string, identity_id string", ("record_id",), latest=True),
    "members": Kept("identity_id string, record_id string", ("identity_id",)),
    "links": Kept("record_a string, record_b string, score double, name_similarity double, reasons array<string>, created_at timestamp_ntz"),
    "moves": Kept("record_id string, at timestamp_ntz, trigger string, identity_id string, reason string, batch long", ("record_id",)),
    "identities": Kept("identity_id string, created_at timestamp_ntz", ("identity_id",)),
    "merges": Kept("identity_id string, merged_into string, merged_at timestamp_ntz", ("identity_id",)),
    "outcomes": Kept("record_id string, identity_id string, action string, matched_records int, merged_identities int"),
    "dead_letters": Kept("value string"),
    "metrics": Kept("lines long, dead_lettered long, schema_additions long, skipped_hub_blocks long, new long, joined long, merged long, duplicate long"),
}


def _place(identity: str) -> int:
    """The number of an identity: the lower, the older."""
    return int(re.search("[0-9]*$", identity)[0] or 0)


def replay_batch(rows: list[tuple], sizes: dict[str, int]) -> Iterator[tuple]:
    """Decide for new records (node, at, older nodes) in arrival order.

    A node is a new record, or an identity from before with ``sizes[identity]`` records. Yields
    (kind, node, trigger, at, holder, gone, matched, bridged): ``move`` gives the records of a
    node to the identity that ``holder`` names, ``end`` ends the identity ``gone``.
    """
    holder = {i: i for i in sizes}
    weight, held = dict(sizes), {i: [i] for i in sizes}
    place = {i: (0, _place(i), i) for i in sizes}
    for nth, (node, at, older, matched) in enumerate(rows):
        touched = sorted({holder[o] for o in older}, key=lambda f: (-weight[f], place[f]))
        keeper = touched[0] if touched else node
        if not touched:
            place[node], weight[node], held[node] = (1, nth, node), 0, []
        for gone in touched[1:]:
            for moved in held.pop(gone):
                holder[moved] = keeper
                held[keeper].append(moved)
                yield "move", moved, node, at, keeper, gone, 0, 0
            weight[keeper] += weight.pop(gone)
            yield "end", gone, node, at, keeper, gone, 0, 0
        holder[node] = keeper
        held[keeper].append(node)
        weight[keeper] += 1
        yield ("new" if not touched else "joined" if len(touched) == 1 else "merged"), node, node, at, keeper, None, matched, len(touched)


_EVENTS = "kind string, node string, trigger string, at timestamp_ntz, holder string, gone string, matched int, bridged int"


def _replay(batches):
    kinds = (pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.string(), pa.string(), pa.int32(), pa.int32())
    for batch in batches:
        found = []
        for rows, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            told = [(r["node"], r["at"], r["older"], r["matched"]) for r in rows]
            found += replay_batch(told, {s["identity"]: s["n"] for s in sizes or ()})
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                ["kind", "node", "trigger", "at", "holder", "gone", "matched", "bridged"],
            )


class Lake(Ledger):
    """The state of a stream and the tables that it fills."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, TABLES)


def resolve_batch(lake: Lake, batch: int, lines: DataFrame, s: Settings = SETTINGS) -> None:
    """Take one micro-batch of lines with a text column ``raw`` into the lake, unless it is there."""
    before = lake.snapshot()
    if before.facts.get("batch", -1) >= batch:
        return
    change = Change(before)
    work = Workspace(lake.spark, "stream")
    error = F.when(F.col("broken"), F.lit("not a JSON object")).otherwise(F.coalesce(contract_error(F.col("not_text")), time_error()))
    checked = work.table(parse(lines).withColumn("error", error), "checked")
    where = [c for c in ("topic", "partition", "offset") if c in checked.columns]
    letters = checked.where("error is not null").select(F.to_json(F.struct("error", *where, "raw")).alias("value"))
    change.append("dead_letters", letters)

    good = canonical(checked)
    delivered = work.table(normalized(good), "delivered")
    seen = before.lookup("records", delivered).select("record_id")
    new = change.append("records", first_deliveries(delivered).join(seen, "record_id", "left_anti"))

    keys = work.table(blocking_keys(new), "keys")
    earlier = work.table(before.lookup("keys", keys), "earlier")
    held = earlier.groupBy("key").agg((F.max("rank") + 1).alias("held"))
    w = Window.partitionBy("key").orderBy("ingested_at", "record_id")
    # a full block takes nobody; of others each task lets the first ones through before rows of the key meet
    room = keys.join(held, "key", "left").where(F.coalesce("held", F.lit(0)) <= s.block_cap)
    room = room.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= s.block_cap + 1)
    ranked = room.withColumn("rank", F.col("_n") - 1 + F.coalesce("held", F.lit(0)))
    ranked = change.append("keys", ranked.where(F.col("rank") <= s.block_cap))
    met = before.lookup("records", earlier.join(ranked, "key", "left_semi")).unionByName(new)
    rows = work.table(blocks(earlier.unionByName(ranked), met, *said()), "blocks")
    later = rows.join(new.select("record_id"), "record_id", "left_semi")
    links = scored(pairs_of_blocks(later, rows, may_match(s)), s, matches_only=True).select(
        F.col("older").alias("record_a"), F.col("newer").alias("record_b"), "score", "name_similarity", "reasons", F.col("linked_at").alias("created_at")
    )
    links = change.append("links", links)

    inside = before.lookup("current", links.select(F.col("record_a").alias("record_id")))
    edges = links.join(inside.withColumnRenamed("record_id", "record_a"), "record_a", "left").select(
        F.concat(F.lit("R:"), "record_b").alias("node"), F.coalesce(F.concat(F.lit("I:"), "identity_id"), F.concat(F.lit("R:"), "record_a")).alias("older")
    )
    edges = work.table(edges, "edges")
    parts = connected_components(edges.select(F.col("node").alias("u"), F.col("older").alias("v")), work)
    arrivals = new.select(F.concat(F.lit("R:"), "record_id").alias("node"), F.col("ingested_at").alias("at"))
    older = edges.groupBy("node").agg(F.collect_set("older").alias("older"), F.count("*").cast("int").alias("matched"))
    # Whoever has no link starts an identity. Where one identity or record alone is before all
    # others of a component, these join it. Both are told without a replay.
    nobody, none = F.lit(None).cast("string").alias("gone"), F.lit(0)
    linked = work.table(parts.join(arrivals, "node", "left").join(older, "node", "left"), "linked")
    alone = arrivals.join(linked, "node", "left_anti").select(
        F.lit("new").alias("kind"), "node", F.col("node").alias("trigger"), "at", F.col("node").alias("holder"), nobody, none.alias("matched"), none.alias("bridged")
    )
    first, is_new = F.col("older").isNull(), F.col("node").startswith("R:")
    heads = linked.groupBy("component").agg(F.count_if(first).alias("starts"), F.min(F.when(first, F.col("node"))).alias("holder"))
    both = work.table(linked.join(heads, "component"), "both")
    plain = both.where((F.col("starts") == 1) & is_new).select(
        F.when(first, "new").otherwise("joined").alias("kind"), "node", F.col("node").alias("trigger"), "at", "holder", nobody,
        F.coalesce("matched", none).alias("matched"), F.when(first, 0).otherwise(1).alias("bridged"),
    )
    bridging = both.where("starts > 1")
    rows = bridging.where(is_new).select(
        "component", "at", "node", F.coalesce("older", F.array().cast("array<string>")).alias("older"), F.coalesce("matched", none).alias("matched")
    )
    rows = rows.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "node", "older", "matched"))).alias("rows"))
    touched = bridging.where(~is_new).select("component", "node", F.substring("node", 3, 40).alias("identity_id"))
    members = work.table(before.lookup("members", touched), "members")  # whoever came to an identity is in it until it ends
    sizes = members.groupBy("identity_id").agg(F.count("*").cast("int").alias("n")).join(touched, "identity_id")
    sizes = sizes.groupBy("component").agg(F.collect_list(F.struct(F.col("node").alias("identity"), "n")).alias("sizes"))
    replayed = rows.join(sizes, "component", "left").select("rows", "sizes").mapInArrow(_replay, _EVENTS)
    events = work.table(alone.unionByName(plain).unionByName(replayed), "events")

    largest = before.facts.get("identities", 0)
    fresh = numbered(events.where("kind = 'new'").select("node", "at"), ["at", "node"], work, "numbered")
    fresh = work.table(fresh.select(F.col("node").alias("holder"), F.format_string("PID%07d", F.col("number") + largest).alias("name"), F.col("at").alias("created_at")), "fresh")
    change.facts |= {"batch": batch, "identities": largest + fresh.count()}
    change.append("identities", fresh.select(F.col("name").alias("identity_id"), "created_at"))
    gone = fresh.select(F.col("holder").alias("gone"), F.col("name").alias("gone_name"))
    called = lambda node, name: F.coalesce(F.col(name), F.substring(node, 3, 40))
    named = events.join(fresh.select("holder", "name"), "holder", "left").join(gone, "gone", "left").select(
        "kind", "node", F.substring("trigger", 3, 400).alias("trigger"), "at", called("holder", "name").alias("identity_id"),
        F.when(F.col("gone").isNotNull(), called("gone", "gone_name")).alias("gone"), "matched", "bridged",
    )
    named = work.table(named, "named")
    change.append("merges", named.where("kind = 'end'").select(F.col("gone").alias("identity_id"), F.col("identity_id").alias("merged_into"), F.col("at").alias("merged_at")))
    reason = (
        F.when(F.col("kind") == "new", F.lit("no matching records")).when(F.col("kind") == "joined", F.format_string("matched %d record(s)", "matched"))
        .when(F.col("kind") == "merged", F.format_string("bridged %d identities via %d matching record(s)", "bridged", "matched"))
        .otherwise(F.concat(F.lit("merged from "), "gone"))
    )
    moved = named.where("kind <> 'end'").withColumn("reason", reason)
    whole = moved.where(F.col("node").startswith("I:")).withColumn("was", F.substring("node", 3, 40)).drop("node")
    whole = whole.join(members.select("record_id", F.col("identity_id").alias("was")), "was")
    single = moved.where(F.col("node").startswith("R:")).withColumn("record_id", F.substring("node", 3, 400))
    take = ["record_id", "at", "trigger", "identity_id", "reason"]
    moves = change.append("moves", whole.select(*take).unionByName(single.select(*take)).withColumn("batch", F.lit(batch).cast("long")))
    last = moves.groupBy("record_id").agg(F.max_by("identity_id", F.struct("at", "trigger")).alias("identity_id"))
    last = change.append("current", last)
    change.append("members", last)
    first = named.where("kind in ('new', 'joined', 'merged')").select(
        F.substring("node", 3, 400).alias("record_id"), "identity_id", F.col("kind").alias("action"), F.col("matched").alias("matched_records"),
        F.when(F.col("kind") == "merged", F.col("bridged")).otherwise(0).alias("merged_identities"),
    )
    # a delivery of a record that is there already changes nothing and names its identity
    times = delivered.groupBy("record_id").count().join(new.select("record_id", F.lit(1).alias("took")), "record_id", "left")
    again = times.select("record_id", F.explode(F.array_repeat(F.lit("duplicate"), (F.col("count") - F.coalesce("took", F.lit(0))).cast("int"))).alias("action"))
    inside = before.lookup("current", again).unionByName(first.select("record_id", "identity_id"))
    again = again.join(inside, "record_id", "left").select("record_id", "identity_id", "action", F.lit(0).alias("matched_records"), F.lit(0).alias("merged_identities"))
    outcomes = change.append("outcomes", first.unionByName(again))
    actions = ["new", "joined", "merged", "duplicate"]
    counted = outcomes.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])
    counts = checked.agg(F.count("*").alias("lines"), F.count_if(F.col("error").isNotNull()).alias("dead_lettered"))
    counts = counts.crossJoin(good.agg(F.count_if(F.size("unexpected_fields") > 0).alias("schema_additions")))
    counts = counts.crossJoin(keys.agg(F.count("*").alias("held"))).crossJoin(ranked.agg(F.count("*").alias("kept"))).crossJoin(counted)
    counts = counts.withColumn("skipped_hub_blocks", F.col("held") - F.col("kept"))
    counted = change.append("metrics", counts).first().asDict()
    sums = before.facts.get("totals", {})
    change.facts["totals"] = {k: sums.get(k, 0) + n for k, n in counted.items()}
    change.commit()
    work.drop()


def state(spark: SparkSession, path: str) -> Resolution:
    """The tables that queries read, of all batches so far."""
    now = Lake(spark, path).snapshot()
    moves = now.read("moves").select("record_id", "at", F.struct("batch", "at").alias("trigger_at"), "trigger", "identity_id", "reason")
    identities = now.read("identities").join(now.read("merges"), "identity_id", "left")
    return Resolution(
        now.read("records"), now.read("links"), history(moves).select("record_id", "identity_id", "valid_from", "valid_to", "reason"),
        identities, now.read("outcomes"),
    )


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counters over all batches, one row."""
    rows = Lake(spark, path).read("metrics")
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])


def start(
    lines: DataFrame, path: str, checkpoint: str, available_now: bool = True, s: Settings = SETTINGS, stopping: Stopping | None = None
) -> StreamingQuery:
    """Resolve a streaming frame with a text column ``raw``; stop with ``query.stop()`` or by :func:`serve`."""

    def run(rows: DataFrame, batch: int) -> None:
        if stopping is not None:
            stopping.check()
        resolve_batch(Lake(rows.sparkSession, path), batch, rows, s)

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()


class Stopping:
    """Lets the batch in work end, and refuses the next one, which then runs after a restart."""

    def __init__(self) -> None:
        self.asked, self.refused = threading.Event(), threading.Event()

    def check(self) -> None:
        if self.asked.is_set():
            self.refused.set()
            raise InterruptedError("stopped before this batch")


def serve(query: StreamingQuery, stopping: Stopping, signals: tuple[int, ...] = (signal.SIGTERM, signal.SIGINT)) -> None:
    """Wait for a query; at one of the signals let its batch end, commit, and stop. From the main thread."""
    before = {k: signal.signal(k, lambda *_: stopping.asked.set()) for k in signals}
    try:
        while not query.awaitTermination(1):
            if stopping.asked.is_set() and not query.status["isTriggerActive"]:
                query.stop()
    except StreamingQueryException:
        if not stopping.refused.is_set():
            raise
    finally:
        for k, handler in before.items():
            signal.signal(k, handler)


def _waiting(sources) -> int:
    """How many offsets the sources of a batch still hold."""
    lag = 0
    for source in sources:
        end, latest = (_parsed(source.get(k) if isinstance(source, dict) else getattr(source, k, None)) for k in ("endOffset", "latestOffset"))
        if isinstance(end, dict) and isinstance(latest, dict):
            for topic, parts in latest.items():
                if isinstance(parts, dict):
                    lag += sum(max(int(to) - int(end.get(topic, {}).get(p, 0)), 0) for p, to in parts.items())
    return lag


def _parsed(offset):
    if isinstance(offset, str):
        try:
            return json.loads(offset)
        except ValueError:
            return None
    return offset


def progress(query: StreamingQuery) -> dict | None:
    """Lines a second of the last batch, and how many offsets its source still holds."""
    last = query.lastProgress
    if not last:
        return None
    last = last if isinstance(last, dict) else last.jsonValue if hasattr(last, "jsonValue") else vars(last)
    return {"rate": last.get("processedRowsPerSecond"), "lag": _waiting(last.get("sources", [])), "batch": last.get("batchId")}


METER = "at timestamp, seconds double, lines long, rate double, lag long, batch long, totals map<string,long>"


class Meter(StreamingQueryListener):
    """Appends a row about a lake's stream every so many seconds, and one when it ends.

    ``rate`` is that of the lines since the row before; ``totals`` are of the whole stream, as
    its last commit has them. Register with ``spark.streams.addListener``; rows are read by
    :func:`metered`.
    """

    def __init__(self, lake: Lake, every: float = 10.0, clock=time.time) -> None:
        self.lake, self.every, self.clock = lake, every, clock
        self.since, self.lines = clock(), lake.snapshot().facts.get("totals", {}).get("lines", 0)
        self.lag, self.batch, self.told = 0, -1, None

    def onQueryStarted(self, event) -> None:
        """Nothing to tell yet."""

    def onQueryIdle(self, event) -> None:
        self._tell(self.every)

    def onQueryProgress(self, event) -> None:
        self.lag, self.batch = _waiting(event.progress.sources), event.progress.batchId
        self._tell(self.every)

    def onQueryTerminated(self, event) -> None:
        if self.told != self.batch:
            self._tell(0)

    def _tell(self, every: float) -> None:
        now = self.clock()
        if now - self.since < every:
            return
        totals = self.lake.snapshot().facts.get("totals", {})
        lines, seconds = totals.get("lines", 0) - self.lines, now - self.since
        at = datetime.fromtimestamp(now, timezone.utc).isoformat(timespec="milliseconds")
        row = {"at": at, "seconds": seconds, "lines": lines, "rate": lines / seconds if seconds > 0 else 0.0, "lag": self.lag, "batch": self.batch, "totals": totals}
        self.lake.note(f"_meter/{int(now * 1000):015d}-{uuid.uuid4().hex[:6]}.json", json.dumps(row))
        self.since, self.lines, self.told = now, totals.get("lines", 0), self.batch


def metered(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a :class:`Meter` has told, in no order."""
    return spark.read.schema(METER).json(f"{path}/_meter")
