"""Whole lead queries, with all they stage: no side that grows with parts, customers or distributors is broadcast."""

import pytest

from tradewind.operators import scores
from tradewind.plans import QUERIES
from tradewind.plans import leads as lead_plans
from tradewind.plans import scores as score_plans
from tradewind.sources import stages

DIR = "/root/testdata/sf0.001"


def broadcasts(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]


@pytest.mark.parametrize("name", ["outreach_pick", "match_list", "pitch_angle", "lead_match_count"])
def test_growing_sides_are_not_broadcast(spark, monkeypatch, name):
    seen = []

    def noted(df, label):
        seen.extend(broadcasts(df))
        return stages.stage(df, label)

    for module in (scores, lead_plans, score_plans):
        monkeypatch.setattr(module, "stage", noted)
    seen += broadcasts(QUERIES[name](spark, DIR))
    assert seen
    # The two columns of a supplier that lines take (key, nation) are the only keyed side the planner may send.
    grown = [line for line in seen if any(key in line for key in ("partkey", "custkey", "lower_name", "suppkey"))]
    assert not [line for line in grown if "[l_suppkey" not in line or "[s_suppkey" not in line]
