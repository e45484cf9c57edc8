import random

import pytest

from cliploom.operators import asof, segments

SEGMENTS, BOUNDARIES = "video_id long, start double, end double", "video_id long, t double"


def expected(rows, marks, tolerance=1.5):
    out = []
    for video, start, end in rows:
        own = [t for v, t in marks if v == video and v is not None and t is not None]
        before = [t for t in own if t <= start and start - t <= tolerance] if start is not None else []
        after = [t for t in own if t >= end and t - end <= tolerance] if end is not None else []
        a, b = max(before, default=start), min(after, default=end)
        out.append((video, a, b, None if None in (start, end) else (a != start or b != end)))
    return sorted(map(str, out))


def cases(seed):
    rng = random.Random(seed)
    marks = [(rng.randrange(4), round(rng.uniform(-5, 400), rng.choice([0, 1, 3]))) for _ in range(300)]
    rows = []
    for _ in range(300):
        start = round(rng.uniform(-5, 400), rng.choice([0, 1, 3]))
        rows.append((rng.randrange(5), start, start + round(rng.uniform(0, 30), 1)))
    return rows + rows[:9] + [(None, 1.0, 2.0), (1, 96.0, 192.0), (1, 95.99, 97.5)], marks + marks[:9] + [(None, 1.0), (1, None), (1, 96.0), (1, 94.5), (1, 193.5)]


@pytest.mark.parametrize("seed", range(3))
def test_snap_against_loops(spark, seed):
    rows, marks = cases(seed)
    got = segments.snap(spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame(marks, BOUNDARIES)).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows, marks)


def test_snap_worked_by_hand(spark):
    """Tolerance 1.5: 9.0 is 1.0 before 10, 21.4 is 1.4 after 20; 8.4 and 21.6 are too far; a boundary on the cut stays."""
    rows = [(1, 10.0, 20.0), (2, 10.0, 20.0), (3, 10.0, 20.0)]
    marks = [(1, 9.0), (1, 8.9), (1, 21.4), (2, 8.4), (2, 21.6), (3, 10.0), (3, 9.5), (3, 20.0), (3, 20.5)]
    got = {r.video_id: (r.start, r.end, r.refined) for r in segments.snap(spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame(marks, BOUNDARIES)).collect()}
    assert got == {1: (9.0, 21.4, True), 2: (10.0, 20.0, False), 3: (10.0, 20.0, False)}


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], BOUNDARIES)
    rows = spark.createDataFrame([(1, 5.0, "x", 7)], "video_id long, start double, _t string, _slot int")
    got = asof.nearest(rows, none, "video_id", rows["start"], "t", "near", 1.5).collect()
    assert [tuple(r) for r in got] == [(1, 5.0, "x", 7, None)]
    assert segments.snap(spark.createDataFrame([], SEGMENTS), none).count() == 0


def test_one_video_with_very_many_boundaries(spark):
    """100,000 boundaries and as many ranges of one video: dealt out by slices of time, no array of boundaries."""
    marks = spark.range(100_000).selectExpr("1L AS video_id", "id * 0.7D AS t")
    rows = spark.range(100_000).selectExpr("1L AS video_id", "id * 0.7D + 0.3D AS start", "id * 0.7D + 0.5D AS end")
    got = segments.snap(rows, marks)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "hashpartitioning(_by" in plan and "_slot" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    wrong = got.filter("abs(start / 0.7 - round(start / 0.7)) > 1e-6 OR NOT refined").count()
    assert wrong <= 1 and got.count() == 100_000  # the last end has no boundary behind it
