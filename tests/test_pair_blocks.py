"""Pairs made where a block's records meet: each once, with what they are judged by, and not brought together again."""

import random
import re

import pytest

from kinweave.config import Settings
from kinweave.operators.normalize import blocking_keys, normalized
from kinweave.plans import resolve as res
from kinweave.workspace import Workspace
from tests.test_resolution import SCHEMA, rec

LONG = " ".join(f"{a}{b}na" for a in "bdk" for b in "aeo")


@pytest.fixture(scope="module")
def recs(spark):
    draw = random.Random(3)
    pick = lambda *some: draw.choice(some)
    rows = [
        rec(
            f"R{i:02d}", f"2026-01-{1 + i % 28:02d}", pick("anand rao", "a rao", "divya iyer", "anand iyer", LONG), phone=pick(None, "9845011123", "9845022123"),
            dob=pick(None, "1990-03-04", "1990-04-03", "1985-06-07"), address=pick(None, "12 lake road", "12 lake rd 560001", "7 hill street"),
            gov=pick(None, None, "ABCDE1234F", "ABCDE9999F"), email=pick(None, "a@mail.example"), device=pick(None, "d1", "d2"),
        )
        for i in range(60)
    ]
    return Workspace(spark, "t").table(normalized(spark.createDataFrame(rows, SCHEMA)), "records")


def wanted(recs, cap):
    order = {r.record_id: (r.ingested_at, r.record_id) for r in recs.collect()}
    found = {}
    for x in blocking_keys(recs).collect():
        found.setdefault(x.key, []).append(x.record_id)
    blocks = [sorted(v, key=order.get)[: cap + 1] for v in found.values()]
    return {(a, b) for v in blocks for i, a in enumerate(v) for b in v[:i]}


@pytest.mark.parametrize("carried", [0, 3, 64, 1000])
@pytest.mark.parametrize("cap", [5, 200])
def test_each_pair_once_whatever_keys_are_carried(spark, recs, monkeypatch, carried, cap):
    monkeypatch.setattr(res, "CARRIED", carried)
    got = [(x.newer, x.older) for x in res.candidate_pairs(recs, cap, Workspace(spark, "t")).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(recs, cap)


def test_no_shuffle_of_pairs(spark, recs, monkeypatch):
    monkeypatch.setattr(res, "CARRIED", 1000)
    pairs = res.scored(res.candidate_pairs(recs, 200, Workspace(spark, "t"), *res.said(), only=res.may_match()), matches_only=True)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((\w+)#", plan) == ["key", "key"]  # blocks alone
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("threshold", [2.0, 5.0, 7.5])
def test_the_first_look_loses_no_match(spark, recs, threshold):
    s = Settings(match_threshold=threshold)
    all_ = res.scored(res.candidate_pairs(recs, 200, Workspace(spark, "t"), *res.said()), s).where("is_match")
    few = res.scored(res.candidate_pairs(recs, 200, Workspace(spark, "t"), *res.said(), only=res.may_match(s)), s, matches_only=True)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(few) == rows(all_) and rows(few)
