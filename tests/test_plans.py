"""Plan checks over every registered query (sf0.001): no cross or
nested-loop joins, no Python evaluation in the registered plans."""

from helixframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCORERS = ("score_windows", "score_sequences")  # a model is Python
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


def test_registered_plans_have_no_cross_joins_or_python(spark):
    bad = {}
    for name, q in QUERIES.items():
        if name in SCORERS:
            continue
        plan = q(spark, SF)._jdf.queryExecution().toString()
        hits = [k for k in FORBIDDEN if k in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_window_fetch_is_a_single_join(spark):
    """Bounded windows are fetched without the long-interval regroup."""
    plan = QUERIES["window_sequences"](spark, SF)._jdf.queryExecution().toString()
    assert "Union" not in plan and "collect_list" not in plan
