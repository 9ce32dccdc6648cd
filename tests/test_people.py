"""Tables in which the person is the identity: records are cleaned once, by more tasks than files."""

from pyspark.sql import functions as F

from kinweave.functions import text as t
from kinweave.operators.normalize import attributes
from kinweave.plans import read, registry, rings


def test_people_are_cleaned_once(spark, tmp_path):
    rows = [(k, k % 25) for k in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    r = registry.by_person(spark, str(tmp_path))
    for table in (r.records, r.assignments, rings.identity_attributes(r)):
        assert "c_custkey" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert registry.records(spark, str(tmp_path)).rdd.getNumPartitions() > 3  # of one file and three sources
    some = attributes(r.records, rings.KINDS)
    assert sorted(some.collect()) == sorted(attributes(r.records).where("kind in ('phone', 'device', 'address')").collect())
    assert "aeiouy" not in some._jdf.queryExecution().optimizedPlan().toString()  # no sounds of names


def test_rules_read_written_envelopes(spark, tmp_path):
    """A filter by the contract's rules does not go below the shuffle of customers, into the one task that reads their file."""
    spark.createDataFrame([(k, k % 25) for k in range(200)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    some = registry.canonical(spark, str(tmp_path))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "split_part" not in plan
    assert some.count() == sum((k % 10 < 7) + (k % 10 < 8) + (k % 10 > 2) for k in range(200))


def test_cleaning_names_what_it_computes_once(spark):
    rows = spark.createDataFrame([("098450-12345", "07/03/1990", "mohd")], "phone string, dob string, token string")
    plan = lambda c: rows.select(c.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(t.phone(F.col("phone"))).count("regexp_replace(") == 1
    assert plan(t.birth_date(F.col("dob"))).count("initcap(") == 1
    assert plan(t.birth_date(F.col("dob"))).count("gettimestamp(") == len(t.DATE_PATTERNS)
    assert plan(t.sound_key(F.col("token"))).count("ksh") == 1
    got = rows.select(t.phone(F.col("phone")), t.birth_date(F.col("dob")).cast("string"), t.sound_key(F.col("token"))).first()
    assert tuple(got) == ("+919845012345", "1990-03-07", "mhmd")


def test_a_search_makes_attributes_of_the_kinds_asked_for(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, k % 25) for k in range(60)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    asked = []
    monkeypatch.setattr(read, "attributes", lambda records, kinds=None: asked.append(kinds) or attributes(records, kinds))
    r = registry.by_person(spark, str(tmp_path))
    assert read.smart_search(r, "Chithra  Mehtha").count() == read.smart_search(r, "Chithra  Mehtha", attributes(r.records)).count()
    read.smart_search(r, "090001 70725")
    assert [set(a) for a in asked] == [{"nkey"}, {"phone"}]
