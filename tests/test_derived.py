"""Plans over the derived graph: what is large is not broadcast, and nothing is derived twice."""

import os

import pytest

from lodestone.plans import catalogue, derived

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def lines_of_plan(df, *words):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.split("\n") if all(w in line for w in words)]


def test_parts_are_not_broadcast(spark):
    joins = lines_of_plan(derived.derive(spark, SF, "edges"), "Join")
    assert len([j for j in joins if "[ap#" in j or "[bp#" in j]) == 4
    assert not [j for j in joins if "Broadcast" in j and ("[ap#" in j or "[bp#" in j)]


def test_derived_tables_are_read_back(spark):
    nodes, edges = derived.nodes(spark, SF), derived.edges(spark, SF)
    for df in (edges.union(edges), nodes.join(edges, "file_path"), nodes.join(derived.changes(spark, SF), "file_path")):
        assert not lines_of_plan(df, "FileScan parquet")


@pytest.mark.parametrize("name", ["change_risk", "change_risk_of_diff", "minimal_context"])
def test_stretches_are_not_broadcast(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert lines_of_plan(df, "SortMergeJoin", "[_gram#") and not lines_of_plan(df, "Broadcast", "[_gram#") and not lines_of_plan(df, "Broadcast", "[_part#")
