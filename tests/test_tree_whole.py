"""Paths and subtrees of whole trees against a walk by hand."""

import pytest
from tables import SF

from stratalake.plans import queries as plans
from stratalake.sources import projections as P


@pytest.fixture(scope="module")
def walked(spark):
    """(experiment, start, ancestor or self) of every node."""
    up = {(r["experiment_id"], r["node_id"]): r["parent_node_id"] for r in P.nodes(spark, SF).collect()}
    out = []
    for e, start in up:
        node = start
        while node is not None:
            out.append((e, start, node))
            node = up.get((e, node))
    return sorted(out)


@pytest.mark.parametrize("name", ["get_path_whole", "get_path_with_logs_whole"])
def test_paths_start_from_every_node(spark, walked, name):
    assert sorted((r["experiment_id"], r["start"], r["node_id"]) for r in plans.queries()[name](spark, SF).collect()) == walked


def test_subtrees_start_from_every_node(spark, walked):
    assert sorted((r["experiment_id"], r["node_id"], r["root"]) for r in plans.queries()["subtree_whole"](spark, SF).collect()) == walked
