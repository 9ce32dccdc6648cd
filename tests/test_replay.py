"""Components replayed in ranges of arrival against the sequential replay."""

import random
from datetime import datetime, timedelta

import pytest

from kinweave.plans import replay as ranges, resolve as res

SCHEMA = "component string, record_id string, at timestamp_ntz, older array<string>"
START = datetime(2026, 1, 1)


def component(rng, name, n, links, back=10**9):
    """Rows in order of arrival; some arrive at one time, ids then decide."""
    at = sorted(START + timedelta(hours=rng.randrange(n)) for _ in range(n))
    ids = sorted(f"{name}{i:04d}" for i in range(n))
    rows = []
    for k in range(n):
        near = range(max(0, k - back), k)
        rows.append((name, ids[k], at[k], sorted({ids[rng.choice(near)] for _ in range(links(rng))} if k else [])))
    return rows


def chain(rng, name, n):
    """Neighbours in a line that arrive in any order, so identities start everywhere and merge."""
    when = list(range(n))
    rng.shuffle(when)
    ids = [f"{name}{k:04d}" for k in when]
    rows = [(name, ids[i], START + timedelta(minutes=when[i]), sorted(ids[j] for j in (i - 1, i + 1) if 0 <= j < n and when[j] < when[i])) for i in range(n)]
    return sorted(rows, key=lambda r: (r[2], r[1]))


def wanted(rows):
    found = []
    for name in {r[0] for r in rows}:
        found += res.replay_component([(i, at, older) for c, i, at, older in sorted(rows, key=lambda r: (r[2], r[1])) if c == name])
    return sorted(found, key=repr)


def made(seed):
    rng = random.Random(seed)
    few = lambda r: r.choice([0, 0, 1, 1, 2])
    rows = []
    for k in range(6):
        rows += component(rng, f"a{k}-", rng.randrange(2, 40), few)
    rows += component(rng, "b-", 90, lambda r: r.choice([0, 1, 2, 3]), back=12) + chain(rng, "c-", 80) + chain(rng, "d-", 33)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 9), (2, 37), (3, 1000)])
def test_equal_to_the_sequential_replay(spark, monkeypatch, seed, size):
    monkeypatch.setattr(ranges, "RANGE", size)
    rows = made(seed)
    got = ranges.replay(spark.createDataFrame(rows, SCHEMA).drop("component"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(rows)


def play(rows, size):
    """All ranges one after the other, with names as they come; the names are those of the sequential replay."""
    order = {r[1]: k for k, r in enumerate(rows)}
    latest, sizes, named, told = {}, {}, {}, []
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        before = {o for r in part for o in r[3] if order[o] < lo}
        ends = {o: latest[o] for o in before}
        seen = [(order[r[1]], [(order[o], None, None) if order[o] >= lo else (order[ends[o]], sizes[ends[o]], None) for o in r[3]]) for r in part]
        known = [(j, [(v, w, named[v] if w else None) for v, w, _ in older]) for j, older in seen]
        free, sure = ranges.replay_range(seen, lo)[0], ranges.replay_range(known, lo)[0]
        for (j, name, n), (_, want, m) in zip(free, sure):
            assert n == m and (name is None or (named[name[0]] if name[1] else name[0]) == want[0])
        for k, r in enumerate(part):
            told.append(sure[k])
            group = {r[1]} | {x for x in latest if latest[x] in {latest[o] for o in r[3]}}
            latest |= dict.fromkeys(group, r[1])
            sizes[r[1]], named[order[r[1]]] = len(group), sure[k][1][0]
    return told


def test_a_range_decides_what_it_can_without_names():
    for seed in range(30):
        rng = random.Random(seed)
        rows = chain(rng, "c-", 40) if seed % 2 else component(rng, "a-", 40, lambda r: r.choice([0, 1, 2]))
        order = {r[1]: k for k, r in enumerate(rows)}
        want = {e[1]: order[e[4]] for e in wanted(rows) if e[0] in ("new", "joined", "merged")}
        assert {rows[j][1]: name[0] for j, name, _ in play(rows, 7)} == want


def test_large_components_of_a_resolution(spark, tmp_path, monkeypatch):
    """The same events whichever way a component goes."""
    monkeypatch.setattr(ranges, "RANGE", 25)
    rows = chain(random.Random(5), "c-", 70) + [("s", "s0", START, []), ("s", "s1", START, ["s0"])]
    linked = spark.createDataFrame(rows, SCHEMA)
    events = []
    for most in (10, 10_000):
        monkeypatch.setattr(res, "ONE_ROW", most)
        events.append(sorted((tuple(r) for r in res.component_events(linked, res.Workspace(spark, "t")).collect()), key=repr))
    assert events[0] == events[1] == wanted(rows)
