"""Edges of a group: all two of a shared attribute's identities, or a star where these are many."""

from collections import defaultdict

from kinweave.config import Settings
from kinweave.plans import rings


def test_rows_grow_with_members_and_not_with_their_square(spark):
    ids = [f"PID{i:07d}" for i in range(1, 121)]
    attrs = [(i, "device", "hub") for i in ids] + [(i, "phone", f"p{k // 4}") for k, i in enumerate(ids)] + [(ids[0], "address", "alone")]
    report = spark.createDataFrame([(1, ids[:100]), (2, ids[100:])], "component_id long, identity_ids array<string>")
    table = spark.createDataFrame(attrs, "identity_id string, kind string, value string")
    for limit in (3, 20, 50):
        want = defaultdict(set)
        for c, members in ((1, ids[:100]), (2, ids[100:])):
            groups = defaultdict(list)
            for i, kind, value in attrs:
                if i in members:
                    groups[kind, value].append(i)
            for (kind, _), some in groups.items():
                for n, a in enumerate(some[:1] if len(some) > limit else some):
                    for b in some[n + 1 :]:
                        want[c, a, b].add(kind)
        got = {(r.component_id, r.a, r.b): set(r.kinds) for r in rings.shared_edges(report, table, Settings(hub_limit=limit)).collect()}
        assert got == want
    assert len(got) < 2 * len(attrs) + 20 * 19 / 2
