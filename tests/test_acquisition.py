"""Acquisition rules by hand: every status and border of age, the order of the reject cascade, where sources come from."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cliploom.operators import acquisition
from cliploom.operators import vocabulary as v

NOW = datetime(2024, 6, 30, 12)
STORED = "source_id long, platform string, platform_video_id string, source_url string, status string, reject_reason string, last_attempt_at timestamp, created_at timestamp"


def ago(hours):
    return NOW - timedelta(hours=hours)


CASES = [
    ("processed", None, 9999, True, "already_processed"), ("skipped_duplicate", None, 9999, True, "already_processed"),
    ("analyzed", None, 1, False, "unknown_status"), ("no_usable_segment", None, 1, False, "unknown_status"),
    ("discovered", None, 1, False, "unknown_status"), ("candidate", None, 1, False, "unknown_status"), ("metadata_checked", None, 1, False, "unknown_status"), ("downloaded", None, 1, False, "unknown_status"), ("no such", None, 1, False, "unknown_status"),
    *[(s, None, 5.99, True, "in_progress") for s in ("previewing", "downloading", "analyzing", "qualified")], *[(s, None, 6, False, "stale_in_progress") for s in ("previewing", "downloading", "analyzing", "qualified")],
    *[(s, "no_material", 719.9, True, "recently_rejected") for s in ("rejected", "rejected_preview")], *[(s, "no_material", 720, False, "retry_rejected") for s in ("rejected", "rejected_preview")],
    *[(s, None, 23.9, True, "recent_failure") for s in v.FAILED], *[(s, None, 24, False, "retry_failed") for s in v.FAILED],
    ("processed", "duration_unknown_unresolved", 5.9, True, "duration_unresolved_recent"), ("rejected", "duration_unknown_unresolved", 6, False, "retry_duration_unresolved"),
]


def test_every_status_and_age(spark):
    """Figures of the published rules: 6 hours unresolved, 24 failed, 6 in progress, 30 days rejected."""
    rows = [(i, "p", str(i), "u", s, r, ago(h), ago(10_000)) for i, (s, r, h, _, _) in enumerate(CASES)]
    rows.append((99, "p", "99", "u", "failed", None, None, ago(3)))  # without an attempt the row's own time counts
    rows.append((100, "p", "100", "u", "failed", None, None, None))  # without any the age is nothing
    found = spark.createDataFrame([("p", r[2]) for r in rows] + [("p", "new"), ("q", "1"), ("p", None)], "platform string, platform_video_id string")
    got = {(r.platform, r.platform_video_id): (r.skip, r.why) for r in acquisition.decided(found, spark.createDataFrame(rows, STORED), F.lit(NOW)).collect()}
    for i, (*_, skip, why) in enumerate(CASES):
        assert got["p", str(i)] == (skip, why), CASES[i]
    assert got["p", "99"] == got["p", "100"] == (True, "recent_failure")
    assert got["p", "new"] == got["q", "1"] == got["p", None] == (False, "new")


def test_the_cascade_takes_the_first_rule(spark):
    names = ["platform", "platform_video_id", "source_url", "title", "material", "unreadable", "no_video", "seen_id", "seen_url", "duration"]
    schema = "platform string, platform_video_id string, source_url string, title string, material string, unreadable boolean, no_video boolean, seen_id boolean, seen_url boolean, duration double"
    base = dict(zip(names, ("p", "n", "https://n", "", "苹果干", False, False, False, False, 30.0)))
    cases = [
        ({"platform_video_id": "", "unreadable": True}, False, "unreachable", None), ({"source_url": None}, False, "unreachable", None), ({"unreadable": True, "no_video": True}, False, "corrupt_media", None),
        ({"no_video": True, "seen_id": True}, False, "unusable_media", None), ({"seen_id": True, "seen_url": True}, False, "duplicate_video", None), ({"seen_url": True}, False, "duplicate_url", None),
        ({"platform_video_id": "done", "duration": None}, False, "already_processed", "already_processed"), ({"platform_video_id": "bad"}, False, "already_processed", "recently_rejected"),
        ({"source_url": "https://done", "duration": 1.0}, False, "duplicate_url", None), ({"platform_video_id": "old", "source_url": "https://done"}, True, None, None),  # a url counts for new sources only
        ({"duration": None, "title": "开箱"}, True, None, None), ({"duration": 4.99}, False, "duration_out_of_range", None), ({"duration": 5.0}, True, None, None), ({"duration": 300.0}, True, None, None), ({"duration": 300.1}, False, "duration_out_of_range", None),
        ({"title": "手机支架 推荐"}, False, "title_irrelevant", None), ({"title": "苹果 开箱"}, True, None, None), ({"title": "果园 游戏"}, True, None, None), ({"title": "游戏", "material": ""}, False, "title_irrelevant", None), ({"title": None}, True, None, None),
    ]
    rows = [tuple({**base, **more}[n] for n in names) + (i,) for i, (more, *_) in enumerate(cases)]
    stored = [(1, "p", "done", "https://done", "processed", None, ago(1), ago(1)), (2, "p", "bad", "https://bad", "rejected", "no_material", ago(1), ago(1)), (3, "p", "old", "https://done", "failed", None, ago(50), ago(50))]
    got = {r.i: r for r in acquisition.filtered(spark.createDataFrame(rows, schema + ", i long"), spark.createDataFrame(stored, STORED), F.lit(NOW)).collect()}
    for i, (more, accepted, reason, detail) in enumerate(cases):
        assert (got[i].accepted, got[i].reason, got[i].detail) == (accepted, reason, detail), more
        assert got[i].duration_unknown == (accepted and rows[i][9] is None)
    assert len(got) == len(cases)


@pytest.mark.parametrize(
    "adapter,platform,video,url,kind",
    [
        ("mock", "douyin", "7123456789012345678", "", "mock"), ("local", "douyin", "7123456789012345678", "", "local_test"), ("douyin", "", "7123456789012345678", "", "douyin_real"), (" Douyin", "local", "mock_01", "", "mock"),
        ("", "local", "1", "", "local_test"), ("", "mock", "1", "", "mock"), (None, "douyin", "123456789012", "", "douyin_real"), (None, "DOUYIN ", "123456789012", "https://www.douyin.com/video/123456789012", "douyin_real"),
        ("", "douyin", "123456789012", "https://example.com/x", "mock"), ("", "douyin", "12345678901", "", "mock"), ("web", "douyin", "12345678901a", "", "mock"), ("web", "kuaishou", "123456789012", "", "unknown"), (None, None, None, None, "unknown"),
    ],
)
def test_provenance(spark, adapter, platform, video, url, kind):
    row = spark.createDataFrame([(adapter, platform, video, url)], "a string, p string, v string, u string")
    assert row.select(acquisition.provenance(F.col("a"), F.col("p"), F.col("v"), F.col("u"))).first()[0] == kind


def test_rejection_buckets(spark):
    cases = [("already_processed", True, True, "duplicate"), ("colored_text_block", False, True, "subtitle"), ("large_center_text", False, False, "subtitle"), ("too_many_stickers", None, None, "subtitle"), ("no_material", True, True, "subtitle"), ("low_quality", False, True, "quality"), ("low_quality", False, False, "other"), (None, False, False, "other"), ("duplicate_clip", False, False, "duplicate")]
    rows = spark.createDataFrame(cases, "r string, s boolean, q boolean, want string")
    assert rows.filter(acquisition.rejection_bucket(F.col("r"), F.col("s"), F.col("q")) != F.col("want")).count() == 0


def test_flags_and_counters(spark):
    stored = [(1, "p", "a", "", "processed", None, None, None), (2, "p", "b", "", "discovered", None, None, None), (3, "p", "c", "", "no_usable_segment", None, None, None)]
    hits = [(1, "q", i, "p", k, i % 2 == 0, i == 2, i % 3) for i, k in enumerate("aabcz")] + [(2, "q", 9, "p", "a", False, False, 0)]
    schema = "task_id long, query string, seq long, platform string, platform_video_id string, accepted boolean, downloaded boolean, clips long"
    flagged = acquisition.source_flags(spark.createDataFrame(hits, schema), spark.createDataFrame(stored, STORED), spark.createDataFrame([(1,), (1,)], "source_id long"))
    got = {r.seq: (r.again, r.new, r.known, r.processed, r.represented) for r in flagged.collect()}
    assert got == {0: (False, False, True, True, True), 1: (True, False, True, True, True), 2: (False, False, True, False, False), 3: (False, False, True, True, False), 4: (False, True, False, False, False), 9: (False, False, True, True, True)}
    row = acquisition.yield_rows(flagged).filter("task_id = 1").first()
    assert tuple(row)[2:] == (5, 4, 1, 1, 4, 3, 2, 3, 1, 4)


def test_previews_by_hand(spark):
    """The order of rules, measured text over the model's word, limits of each policy."""
    names = ["frames", "answered", "accept", "reject_reason", "material_visible", "relevance", "quality", "complexity", "measured_class", "cleanliness", "policy"]
    schema = "frames int, answered boolean, accept boolean, reject_reason string, material_visible boolean, relevance double, quality double, complexity string, measured_class string, cleanliness double, policy string, i long"
    base = dict(zip(names, (3, True, True, None, True, 0.9, 0.9, "low", None, None, "strict")))
    cases = [
        ({}, True, None, False, "policy"), ({"frames": 0, "answered": False}, False, "unusable_visual", False, "frames"), ({"answered": None, "accept": None}, False, "other", False, "answer"),
        ({"accept": False, "reject_reason": "too_many_stickers"}, False, "too_many_stickers", True, "model"), ({"accept": False}, False, "other", False, "model"), ({"material_visible": False}, False, "no_material", False, "material"), ({"relevance": 0.34}, False, "no_material", False, "material"),
        ({"quality": 0.44, "measured_class": "complex"}, False, "low_quality", False, "quality"), ({"measured_class": "dense_text", "cleanliness": 1.0, "policy": "off"}, False, "multi_region_subtitle", True, "class"), ({"measured_class": "promotional_overlay"}, False, "colored_text_block", True, "class"),
        ({"measured_class": "single_region", "cleanliness": 0.64}, False, "subtitle_too_complex", True, "score"), ({"measured_class": "single_region", "cleanliness": 0.65}, True, None, False, "measurement"), ({"measured_class": "none", "cleanliness": 0.5, "policy": "balanced", "complexity": "high"}, True, None, False, "measurement"),
        ({"complexity": "medium"}, False, "subtitle_too_complex", True, "complexity"), ({"complexity": "medium", "policy": "loose"}, True, None, False, "policy"), ({"complexity": None, "policy": "off"}, True, None, False, "policy"), ({"complexity": "high", "policy": "loose"}, False, "subtitle_too_complex", True, "complexity"),
    ]
    rows = [tuple({**base, **more}[n] for n in names) + (i,) for i, (more, *_) in enumerate(cases)]
    got = {r.i: (r.accepted, r.reason, r.subtitle_rejected, r.rule) for r in acquisition.previews(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: tuple(c[1:]) for i, c in enumerate(cases)}


def test_lengths_and_stages_by_hand(spark):
    cases = [("media_unreachable", None, "unreachable", "failed_media"), ("invalid_media_source", None, "invalid_media_source", "failed_media"), ("duration_unknown_unresolved", None, "duration_unknown_unresolved", "failed_media"), (None, None, "duration_unknown_unresolved", "rejected"), ("ok", 4.9, "duration_out_of_range", "rejected"), ("ok", 5.0, None, None), ("ok", 300.1, "duration_out_of_range", "rejected")]
    got = acquisition.duration_routes(spark.createDataFrame([(s, x) for s, x, *_ in cases], "state string, seconds double")).collect()
    assert [(r.reason, r.status) for r in got] == [c[2:] for c in cases] and [r.ready for r in got] == [c[2] is None for c in cases]
    rows = spark.createDataFrame([("drying", "drying"), ("drying", ""), ("drying", None), ("other", "drying"), (None, "drying")], "stage string, wanted_stage string")
    assert [r.accepted for r in acquisition.stage_gate(rows).collect()] == [True, True, True, False, False]
