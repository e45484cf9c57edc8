"""Production gaps worked out by hand."""

import math

from cliploom.operators import coverage, gaps, planning

KNOWN = "query string, clips long, score double, candidates long, uniques long, tokens_per_clip double, subtitle_rejection_rate double, saturation string, known_rate double, novelty_rate double, known_sources long, past_candidates long, new_to_system long, last_attempt timestamp, rediscovery double"
CLIPS = "clip_id long, category string, stage string, roles string"


def found(spark, known, clips, targets, categories=("辣椒干",), **more):
    goals = gaps.objectives(spark.createDataFrame([(c,) for c in categories], "category string"), targets)
    rows = gaps.production_gaps(goals, spark.createDataFrame(clips, CLIPS), spark.createDataFrame(known, KNOWN), **more).collect()
    return sorted(rows, key=lambda r: r.place)


def test_gap_is_what_is_there_less_the_target(spark):
    """One drying clip of three wanted: current 1, target 3, gap 2; covered stages are hidden unless asked for."""
    clips = [(1, "辣椒干", "drying", "process,hook"), (2, "辣椒干", "drying", "result"), (3, "香菇", "drying", "")]
    (row,) = found(spark, [], clips[:1], {"drying": 3})
    assert (row.current, row.target, row.gap, row.status, row.edit_role_gap) == (1, 3, 2, "gap", ["equipment", "detail", "result"])
    assert found(spark, [], clips, {"drying": 2}) == []
    (row,) = found(spark, [], clips, {"drying": 2}, covered=True)
    assert (row.stage, row.status, row.priority_label, row.gap) == ("drying", "covered", "已覆盖", 0)


def test_without_history(spark):
    """Rank 1, gap 1, four roles missing: 3 + ln 2 + 1.5 = 5.193; unknown queries act at 0.7, so 3.635."""
    first, second = found(spark, [], [], {"drying": 1, "preparation": 1})
    assert first.components.asDict() == {"stage": 3.0, "gap": round(math.log1p(1), 3), "edit_role": 1.5, "query_yield": 0.0, "duplicate_penalty": 0.0, "subtitle_penalty": 0.0, "token_penalty": 0.0, "rediscovery_penalty": 0.0}
    assert (first.stage, first.priority, first.query_actionability, first.effective_priority, first.priority_label) == ("drying", 5.193, 0.7, 3.635, "严重缺口")
    assert (second.stage, second.priority, second.priority_label) == ("preparation", 3.693, "严重缺口")
    assert first.best_query == "辣椒烘干过程" and first.best_query_origin == "template" and first.best_query_score == 0 and first.estimated_tokens == 18000
    assert first.primary_count == 4 and first.saturated_primary_count == 0 and first.historical_known_source_rate is None and first.duplicate_risk is None


def test_with_history(spark):
    """辣椒烘干: score 2.5 less 2 x 0.25, 20 candidates of which 16 unique, saturated; beside three templates."""
    known = [
        ("辣椒烘干", 3, 2.5, 20, 16, 30000.0, 0.5, "saturated", 0.95, 0.05, 19, 20, 1, None, 0.25),
        ("辣椒热泵烘干", 0, -1.0, 9, 9, None, None, "fresh", 0.1, 0.9, 1, 10, 9, None, None),
        ("辣椒", 5, 9.0, 10, 10, None, None, "fresh", 0.0, 1.0, 0, 10, 10, None, None),
        ("苹果烘干", 9, 9.0, 10, 10, None, None, "fresh", 0.0, 1.0, 0, 10, 10, None, None),
    ]
    (row,) = found(spark, known, [], {"drying": 2})
    assert row.queries[0] == "辣椒烘干" and row.primary_families[0] == "material_process" and "苹果烘干" not in row.queries
    assert row.queries[1] == "辣椒热泵烘干"  # a template of an open family, known to be fresh: 0.5 x 1.0 leads 2.5 x 0.1 and 0.5 x 0.7
    assert (row.best_query, row.best_query_origin, row.best_query_family, row.query_saturation) == ("辣椒热泵烘干", "template", "heat_pump", "fresh")
    assert (row.saturated_primary_count, row.primary_count, row.saturated_primary_fraction, row.saturated_families) == (1, 4, 0.25, ["material_process"])
    assert row.query_actionability == 0.875 and row.library_novelty_rate == 0.9 and row.known_source_rate == 0.1
    assert row.historical_known_source_rate == round(20 / 30, 4) and row.historical_library_novelty_rate == round(10 / 30, 4)
    assert row.priority == round(3 + round(math.log1p(2), 3) + 1.5, 3) and row.effective_priority == round(row.priority * 0.875, 3)


def test_penalties_of_the_best_query(spark):
    """Only one query to plan with: 3 + 0.693 + 1.5 + 2.0 - 2 x 0.2 - 1.5 x 0.5 - 0.5 - 2 x 0.25."""
    known = [("辣椒烘干", 3, 2.5, 20, 16, 30000.0, 0.5, "mixed", 0.6, 0.4, 12, 20, 8, None, 0.25)]
    (row,) = found(spark, known, [], {"drying": 1}, w=gaps.Weights(queries=1))
    assert row.components.asDict() == {"stage": 3.0, "gap": 0.693, "edit_role": 1.5, "query_yield": 2.0, "duplicate_penalty": -0.4, "subtitle_penalty": -0.75, "token_penalty": -0.5, "rediscovery_penalty": -0.5}
    assert (row.best_query, row.best_query_score, row.duplicate_risk, row.rediscovery_rate, row.tokens_per_clip, row.estimated_tokens) == ("辣椒烘干", 2.0, 0.2, 0.25, 30000.0, 30000)
    assert (row.priority, row.query_actionability, row.effective_priority) == (5.043, 0.5, 2.522)  # 2.5215 is above the tie


def test_the_order_of_work(spark):
    """香菇 drying 3 + ln 3 + 1.5, equipment 1.5 + ln 3 + 1.5 for both, 苹果 drying with all roles 3 + ln 2; ties by category."""
    rows = found(spark, [], [(1, "苹果", "drying", "process,equipment,detail,result")], {"drying": 2, "equipment": 2}, categories=("苹果", "香菇"))
    assert [(r.category, r.stage) for r in rows] == [("香菇", "drying"), ("苹果", "equipment"), ("香菇", "equipment"), ("苹果", "drying")]
    assert [r.place for r in rows] == [1, 2, 3, 4]


def test_a_long_query_makes_few_pieces(spark):
    """Only pieces as long as a base name are keys: one text of 200,000 characters is no problem."""
    searches = spark.createDataFrame([("x" * 200_000 + "辣椒", 1, 1.0), ("椒", 1, 1.0), ("", 1, 1.0)], "query string, clips long, score double")
    got = planning.historical(spark.createDataFrame([("辣椒干",), ("香菇",)], "category string"), searches).collect()
    assert [(r.category, len(r.query)) for r in got] == [("辣椒干", 200_002)]


def test_delta_of_two_snapshots(spark):
    """drying 3 to 5, loading gone, equal counts left out; a category that one side lacks has nothing to compare."""
    schema = "category string, stage string, total long"
    before = spark.createDataFrame([("a", "drying", 3), ("a", "loading", 1), ("a", "factory", 2), ("b", "drying", 1)], schema)
    after = spark.createDataFrame([("a", "drying", 5), ("a", "factory", 2), ("c", "drying", 4)], schema)
    assert sorted(map(tuple, coverage.delta(before, after).collect())) == [("a", "drying", 2), ("a", "loading", -1)]
    assert coverage.delta(before, after.limit(0)).count() == 0
