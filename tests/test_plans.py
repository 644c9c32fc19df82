"""Physical-plan assertions over every registered query: no cartesian or
nested-loop joins, no Python evaluation, the fact table is never the
broadcast side, and scans read only the needed columns."""

import pytest

from stratus.plans import QUERIES as Q
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()   # final AQE plan
    return df._jdf.queryExecution().executedPlan().toString()


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-*"))


def broadcast_facts(plan: str, fact: str = "lineitem.parquet") -> list[str]:
    """Broadcasts whose side holds a scan of the fact table that no aggregate
    has reduced."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        reduced: list[int] = []          # depths of aggregates above the current line
        for below in lines[i + 1:]:
            depth = _depth(below)
            if depth <= _depth(line):
                break
            reduced = [d for d in reduced if d < depth]
            if "Aggregate" in below:
                reduced.append(depth)
            if fact in below and not reduced:
                found.append(line.strip())
    return found


def test_broadcast_check_sees_a_broadcast_fact(spark):
    from pyspark.sql import functions as F
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_suppkey", "l_quantity")
    sup = spark.read.parquet(f"{SF_SMALL}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"))
    assert broadcast_facts(_executed_plan(sup.join(F.broadcast(li), "l_suppkey")))
    assert not broadcast_facts(_executed_plan(li.join(F.broadcast(sup), "l_suppkey")))


@pytest.mark.parametrize("name", sorted(Q))
def test_plan_shape(spark, name):
    plan = _executed_plan(Q[name](spark, SF_SMALL))
    for node in FORBIDDEN:
        assert node not in plan, f"{name}: {node}"
    assert broadcast_facts(plan) == []


def test_lineitem_scan_is_pruned(spark):
    plan = _executed_plan(Q["calendar_profile"](spark, SF_SMALL))
    scan = [ln for ln in plan.splitlines() if "lineitem.parquet" in ln][0]
    assert "l_orderkey" not in scan and "l_returnflag" not in scan
    assert "BroadcastHashJoin" in plan


def test_season_operator_prunes_partitions(spark, tmp_path):
    from stratus.operators.profiles import flagged_hours
    df = spark.createDataFrame([(y, m, "c", m % 2 == 0, y) for y in (2000, 2001) for m in range(1, 13)],
                               "year int, month int, city_name string, f boolean, winter_season_year int")
    df.write.partitionBy("year", "month").parquet(str(tmp_path / "t"))
    winter = flagged_hours(spark.read.parquet(str(tmp_path / "t")), "city_name", "f")
    plan = _executed_plan(winter)
    scan = [ln for ln in plan.splitlines() if "PartitionFilters" in ln][0]
    assert "month" in scan.split("PartitionFilters")[1].split("]")[0]
    assert sorted((r.winter_season_year, r.sunny_hours_count, r.total_hours)
                  for r in winter.collect()) == [(2000, 2, 3), (2001, 2, 3)]
