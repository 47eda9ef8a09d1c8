"""Concatenated hits score their events once."""

from lodestone.plans import reviewed as RW


def test_concatenated_hits_read_the_scored_events_once(spark, monkeypatch):
    made, bundle = [], RW._bundle

    def once(s, sf_dir):
        rows = bundle(s, sf_dir)
        made.append(rows)
        return rows

    monkeypatch.setattr(RW, "_bundle", once)
    got = RW.concatenated_hits(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "documents.parquet" not in plan and plan.count("Relation") == 1
    first = {r.event_id for r in got.where("part = 1").collect()}
    second = {r.event_id for r in got.where("part = 2").collect()}
    assert not first & second and first == {r.event_id for r in made[0].where("risk_level = '高'").collect()}
