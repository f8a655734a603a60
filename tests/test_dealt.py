import re

from folioscope.operators import timeline
from folioscope.plans import carriers

SF = "/root/testdata/sf0.001"


def test_parts_grow_with_the_rows(spark):
    assert carriers.spread(spark.range(1000), "id", each=10).rdd.getNumPartitions() == 100
    assert carriers.spread(spark.range(1000), "id", each=1000).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert carriers.spread(spark.range(0), "id", each=10).count() == 0


def test_points_group_and_join_where_evaluations_were_dealt(spark, monkeypatch):
    real = carriers.spread
    monkeypatch.setattr(carriers, "spread", lambda rows, *keys, each: real(rows, *keys, each=20))
    rows = timeline.points(carriers.dealt_evaluations(spark, SF), carriers.documents(spark, SF))
    n = carriers.evaluations(spark, SF).count()
    assert rows.count() == n and rows.where("documents <> 1").count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    parts = re.findall(r"Exchange hashpartitioning\(person_id#\d+, period#\d+, (\d+)\)", plan)
    assert set(parts) == {str(-(-n // 20))} and plan.count("Exchange hashpartitioning") == len(parts)
