"""Generated records keep their contracts, do not depend on partitions, and can be resolved."""

from pyspark.sql import functions as F

from kinweave.plans import evaluate, resolve as res, rings
from kinweave.sources import contracts, generate


def test_generated_records_resolve(spark, tmp_path):
    envelopes, truth = generate.generate(spark, 300, 4, seed=7)
    generate.write_jsonl(envelopes, str(tmp_path / "lines"))
    read = contracts.validated(contracts.read_jsonl(spark, str(tmp_path / "lines"))).cache()
    truth = truth.cache()
    assert read.where("error is not null or broken").count() == 0
    again, _ = generate.generate(spark, 300, 4, seed=7)
    key = lambda df: sorted((r.source, r.ingested_at, sorted(r.payload.items())) for r in df.select("source", "ingested_at", "payload").collect())
    assert key(read) == key(again.repartition(3))
    ids = [r.record_id for r in truth.collect()]
    assert len(ids) == len(set(ids)) == read.count()
    assert truth.where("ring_id <> ''").select("ring_id").distinct().count() == 4
    people = truth.where("ring_id = ''").agg(F.countDistinct("person_id")).first()[0]
    assert 240 < people < 360
    r = res.resolve(contracts.canonical(read))
    m = evaluate.pairwise_metrics(r.assignments.where("valid_to is null"), truth).first()
    print(m)
    assert m.precision >= 0.95 and m.recall >= 0.85
    found = rings.evaluate_rings(rings.ring_report(r), r.assignments, truth).first()
    print(found)
    assert found.planted_rings == 4 and found.rings_flagged >= 2 and found.families_falsely_flagged == 0
