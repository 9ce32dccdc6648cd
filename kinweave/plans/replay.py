"""Arrival-order decisions for components of any size, without a task that holds one.

The identities after a record's arrival are the connected components of the records so far. So
the decisions hang on a tree over arrival times: a record's children are the components that
it touches, each known by its latest record. Arrival is cut into ranges of bounded size. What
a range needs of all before it, the component and the size of each older record it links to,
comes from halving time: components of the first half, contracted, name the older ends of the
second half's links, and both halves go on alike, all of a level at once. Then every range is
replayed by itself.

An identity is named by the record that started it. In a range, that of an older component is
not known yet, only that it is the one its latest record was given; such references are
followed afterwards, twice as far each round. Only where two older components of one size
compete must the names be known first; such ranges are replayed again when they are. Each time
the sizes in question have doubled, so there are few rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.operators.components import connected_components
from kinweave.workspace import Workspace

#: Records of a range.
RANGE = 100_000
#: Orders of arrival in the node ids of a level; the block is above them.
_ORDER_BITS = 40
_TOP = (1 << _ORDER_BITS) - 1


def _node(block: str, order: str):
    """An id whose least value in a component is that of its latest record."""
    return F.shiftleft(F.col(block), _ORDER_BITS) + (F.lit(_TOP) - F.col(order))


def _split(links: DataFrame, level: int, size: int, work: Workspace) -> DataFrame:
    """One level of halving: blocks of ``size`` ranges, whose second halves see the first as components."""
    placed = links.withColumn("block", F.floor(F.col("q") / size)).withColumn("second", F.col("q") % size >= size // 2)
    first = placed.where("not second").select("block", F.col("j"), "v", "w")
    ids = first.select(_node("block", "j").alias("u"), _node("block", "v").alias("v"))
    inner = Workspace(links.sparkSession, "halving", shuffled=True)
    parts = connected_components(ids, inner)
    # of each node, how many records it stands for
    weights = first.select(_node("block", "v").alias("node"), F.coalesce("w", F.lit(1)).alias("w")).unionByName(first.select(_node("block", "j").alias("node"), F.lit(1).cast("long").alias("w")))
    sized = parts.join(weights.groupBy("node").agg(F.max("w").alias("w")), "node").groupBy("component").agg(F.sum("w").alias("sum"))
    named = work.table(parts.join(sized, "component"), f"named-{level}")
    second = placed.where("second").withColumn("node", _node("block", "v"))
    inner.drop()
    before = F.col("w").isNotNull() | (F.col("vq") % size < size // 2)  # a component from before, or a record of the first half
    seen = second.where(before).join(named, "node", "left").select(
        "q", "j", F.coalesce(F.lit(_TOP) - F.col("component").bitwiseAND(F.lit(_TOP)), F.col("v")).alias("v"),
        F.lit(None).cast("long").alias("vq"), F.coalesce("sum", "w", F.lit(1)).cast("long").alias("w"),
    )
    kept = placed.where("not second").select(*links.columns).unionByName(second.where(~before).select(*links.columns))
    return work.table(kept.unionByName(seen.select(*links.columns)).distinct(), f"links-{level}")


def replay_range(rows: list[tuple], start: int) -> tuple[list[tuple], list[tuple]]:
    """Decide for records of one range, given in order as (order, older), from the order ``start``.

    ``older`` has (node, weight, founder): a record of the range, with weight None, or a
    component from before by its latest record, its size, and who started it, None if that is
    not known. Returns records as (order, given to, reference, touched) and merges as (gone,
    reference, order, kept, reference). A name that is a reference is that of the component
    given there; None is a choice that waits for names.
    """
    above: dict[int, int] = {}
    size: dict[int, int] = {}
    name: dict[int, tuple[int, bool] | None] = {}

    def find(x: int) -> int:
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    told, merges = [], []
    for j, older in rows:
        for v, weight, founder in older:
            if v not in above:  # a component from before
                above[v], size[v], name[v] = v, weight, (v, True) if founder is None else (founder, False)
        touched = list({find(v): None for v, _, _ in older})
        if touched:
            most = max(size[t] for t in touched)
            best = [t for t in touched if size[t] == most]
            known = lambda t: name[t] is not None and not name[t][1]
            waiting = [t for t in best if not known(t)]  # all of them started before the range
            if len(best) == 1 or len(waiting) == 1 and all(name[t][0] >= start for t in best if known(t)):
                keeper = best[0] if len(best) == 1 else waiting[0]
            elif waiting:
                keeper = None
            else:
                keeper = min(best, key=lambda t: name[t][0])
            given = name[keeper] if keeper is not None else None
            merges += [(name[t], j, given) for t in touched if t != keeper] if len(touched) > 1 else []
            root = touched[0] if keeper is None else keeper
        else:
            root, given = j, (j, False)
            above[j], size[j] = j, 0
        name[root] = given
        above[j] = root
        for t in touched:
            if t != root:
                above[t] = root
                size[root] += size[t]
        size[root] += 1
        told.append((j, given, len(touched)))
    return told, merges


_TOLD = "kind string, j long, name long, ref boolean, gone long, gone_ref boolean, touched int, waits boolean"


def _ranges(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["j"])
    told, merges = replay_range([(r["j"], [(o["v"], o["w"], o["f"]) for o in r["older"]]) for r in rows], rows[0]["start"])
    none = (None, None)
    out = [("record", j, *(n or none), None, None, t, n is None) for j, n, t in told]
    out += [("merge", j, *(k or none), *(g or none), 0, k is None or g is None) for g, j, k in merges]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_())
    names = [c.split()[0] for c in _TOLD.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _founders(told: DataFrame, asked: DataFrame, work: Workspace, turn: int) -> DataFrame:
    """(v, f) of the components ``asked`` for: who started them, where that is known."""
    refs = told.where("kind = 'record' and not waits").select(F.col("j").alias("v"), "name", "ref")
    now = work.table(refs.join(asked, "v", "left_semi"), f"refs-{turn}-0")
    for k in range(1, 64):
        beyond = now.select(F.col("v").alias("name"), F.col("name").alias("next"), F.col("ref").alias("next_ref"))
        followed = now.where("ref").join(beyond, "name", "left").select(
            "v", F.coalesce("next", "name").alias("name"), F.coalesce("next_ref", "ref").alias("ref"), F.col("next").isNotNull().alias("moved")
        )
        now = work.table(followed.unionByName(now.where("not ref").select("v", "name", "ref", F.lit(False).alias("moved"))), f"refs-{turn}-{k}")
        if now.where("moved").isEmpty():
            break
    return now.where("not ref").select("v", F.col("name").alias("f"))


def replay(linked: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Events of ``linked(record_id, at, older)``, as :func:`kinweave.plans.resolve.replay_component` tells them.

    ``older`` lists earlier records that are rows too. Arrival order is (at, record_id), or
    that of a column ``arrival``. Rows may be of many components. Nothing larger than a range is held in a task.
    """
    from kinweave.plans.resolve import arrived, numbered

    came = [*arrived(linked), "at", "record_id"]
    work = work or Workspace(linked.sparkSession, "replay", shuffled=True)
    order = numbered(linked.select(*came), came, work, "ordered")
    order = work.table(order.select("record_id", "at", (F.col("number") - 1).alias("o")), "order")
    ids = order.select("record_id", "o")
    pairs = linked.select("record_id", F.explode("older").alias("older"))
    links = pairs.join(ids.withColumnRenamed("o", "j"), "record_id").join(ids.select(F.col("record_id").alias("older"), F.col("o").alias("v")), "older")
    q = lambda c: F.floor(F.col(c) / RANGE)
    links = work.table(links.select(q("j").alias("q"), "j", "v", q("v").alias("vq"), F.lit(None).cast("long").alias("w")).distinct(), "links")
    ranges = -(-order.count() // RANGE)
    size = 1 << max(ranges - 1, 0).bit_length()
    level = 0
    while size > 1:
        links = _split(links, level, size, work)
        size, level = size // 2, level + 1
    matched = linked.select("record_id", F.size("older").alias("n"))
    founders = linked.sparkSession.createDataFrame([], "v long, f long")
    asked = work.table(links.where("w is not null").select("v").distinct(), "asked")
    for turn in range(64):
        named = links.join(founders, "v", "left").groupBy("q", "j").agg(F.collect_list(F.struct("v", "w", "f")).alias("older"))
        rows = order.select(q("o").alias("q"), F.col("o").alias("j")).join(named, ["q", "j"], "left").select(
            "q", "j", (F.col("q") * RANGE).alias("start"), F.coalesce("older", F.array().cast("array<struct<v:bigint,w:bigint,f:bigint>>")).alias("older")
        )
        told = work.table(rows.groupBy("q").applyInArrow(_ranges, _TOLD), f"told-{turn}")
        founders = work.table(_founders(told, asked, work, turn), f"founders-{turn}")
        if told.where("waits").isEmpty():
            break
    else:
        raise RuntimeError("names did not settle")
    called = lambda rows, name, ref: rows.join(
        founders.select(F.col("v").alias(name), F.col("f").alias(f"_{name}"), F.lit(True).alias(ref)), [name, ref], "left"
    ).withColumn(name, F.coalesce(f"_{name}", name)).drop(f"_{name}")
    told = work.table(called(called(told, "name", "ref"), "gone", "gone_ref"), "called")
    merges = work.table(told.where("kind = 'merge'").select("gone", F.col("j").alias("trigger"), F.col("name").alias("keeper")), "merges")
    return _as_events(told.where("kind = 'record'"), merges, order, matched, work)


def _as_events(records: DataFrame, merges: DataFrame, order: DataFrame, matched: DataFrame, work: Workspace) -> DataFrame:
    """Events by record id: what each record did, the identities that ended, and who moved with them."""
    inside = records.select("j", F.col("name").alias("gone"))
    moves = []
    for k in range(64):  # an identity that takes another in is as large, so there are few steps
        step = work.table(inside.join(merges, "gone").select("j", "gone", "trigger", "keeper"), f"step-{k}")
        if step.isEmpty():
            break
        moves.append(step)
        inside = step.select("j", F.col("keeper").alias("gone"))
    none = lambda kind: F.lit(None).cast(kind)
    kind = F.when(F.col("touched") == 0, "new").when(F.col("touched") == 1, "joined").otherwise("merged")
    out = records.select(kind.alias("kind"), "j", F.col("j").alias("trigger"), F.col("name").alias("keeper"), none("long").alias("gone"), "touched")
    touched = records.select(F.col("j").alias("trigger"), "touched")
    ends = merges.join(touched, "trigger").select(F.lit("merge").alias("kind"), F.col("gone").alias("j"), "trigger", "keeper", "gone", "touched")
    out = out.unionByName(ends)
    for step in moves:
        out = out.unionByName(step.select(F.lit("assign").alias("kind"), "j", "trigger", "keeper", "gone", F.lit(0).alias("touched")))
    by = lambda key, name: order.select(F.col("o").alias(key), F.col("record_id").alias(name))
    out = out.join(by("j", "record_id"), "j").join(order.select(F.col("o").alias("trigger"), F.col("record_id").alias("by"), "at"), "trigger")
    out = out.join(by("keeper", "founder"), "keeper").join(by("gone", "other"), "gone", "left").join(matched, "record_id", "left")
    own = F.col("kind").isin("new", "joined", "merged")
    return out.select(
        "kind", "record_id", F.col("by").alias("trigger"), "at", "founder", F.when(own, F.col("touched").cast("string")).otherwise(F.col("other")).alias("other"),
        F.when(own, F.col("n")).otherwise(F.col("touched")).cast("int").alias("n"),
    )
