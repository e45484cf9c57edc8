"""Frames, box matches, page ids, permalinks, gates and media: figures by hand and plain loops."""

import random

from pyspark.sql import functions as F

from cliploom.functions import text
from cliploom.operators import duplicates, geometry, library, rules


def test_frame_counts_by_band(spark):
    rows = [(None, 6), (0.0, 6), (15.0, 6), (15.1, 8), (45.0, 8), (60.0, 10), (90.0, 10), (90.1, 12), (4000.0, 12)]
    df = spark.createDataFrame(rows, "seconds double, want int")
    assert df.filter(rules.frame_count(F.col("seconds")) != F.col("want")).count() == 0


def test_frame_times_by_hand(spark):
    want = {
        ("uniform", 10.0, 4): [1.25, 3.75, 6.25, 8.75],
        ("uniform_edges", 10.0, 4): [0.75, 4.25, 5.75, 9.25],
        ("uniform_edges", 10.0, 3): [1.667, 5.0, 8.333],
        ("dense_start", 10.0, 5): [1.0, 3.0, 5.0, 7.0, 9.0],
        ("dense_start", 10.0, 2): [2.5, 7.5],
        ("uniform", 0.04, 6): [0.0],
        ("uniform", 0.0, 6): [],
        ("uniform", None, 6): [],
    }
    for (strategy, seconds, n), times in want.items():
        row = spark.range(1).select(rules.frame_times(F.lit(seconds).cast("double"), F.lit(n), strategy).alias("t")).first()
        assert row.t == times, (strategy, seconds, n)
    clip = lambda a, b, n: spark.range(1).select(rules.clip_times(F.lit(a), F.lit(b), F.lit(n)).alias("t")).first().t
    assert clip(10.0, 20.0, 4) == [12.0, 14.0, 16.0, 18.0]
    assert clip(10.0, 20.0, 1) == [16.0]
    assert clip(5.0, 5.0, 4) == []


def test_box_match_prefers_overlap_then_nearness(spark):
    boxes = [
        (1, 0, 1, 0.10, 0.10, 0.30, 0.20), (1, 0, 2, 0.12, 0.10, 0.30, 0.20), (1, 0, 3, 0.60, 0.60, 0.64, 0.64),
        (1, 1, 1, 0.12, 0.10, 0.30, 0.20),  # overlaps both, the second exactly
        (1, 1, 2, 0.65, 0.60, 0.69, 0.64),  # beside the third, no overlap
        (1, 1, 3, 0.80, 0.10, 0.90, 0.20),  # alone
        (1, 3, 1, 0.10, 0.10, 0.30, 0.20),  # no frame right before
    ]
    df = spark.createDataFrame(boxes, "clip_id long, frame long, box long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.frame, r.box): r.match for r in geometry.matched_regions(df).collect()}
    assert [got[1, b] for b in (1, 2, 3)] == [2, 3, None] and got[3, 1] is None and got[0, 1] is None


def test_page_ids_come_links_first(spark):
    html = '{"aweme_id": "12345678901", "awemeId":98765432109} <a href="/note/7654321"> /video/123456 /video/12345 /note/7654321'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(text.page_video_ids(F.col("html")).alias("ids"))
    assert [r.ids for r in df.collect()] == [["7654321", "123456", "12345678901", "98765432109"], [], []]


def test_permalinks(spark):
    rows = [
        ("//v.example.com/video/123456?x=1", True, "123456", "P123456"),
        (" https://EXAMPLE.com/note/1234567 ", True, "1234567", "P1234567"),
        ("https://example.com/user/a?to=/video/123456", False, None, "https://example.com/user/a"),
        ("https://other.org/video/123456", False, "123456", "P123456"),
        ("https://example.com/video/12345", False, None, "https://example.com/video/12345"),
        ("", False, None, ""),
        (None, False, None, ""),
    ]
    df = spark.createDataFrame(rows, "url string, a boolean, b string, c string")
    url = F.col("url")
    got = df.select(text.is_permalink(url, "example.com"), text.permalink_id(url), text.canonical_url(url, "P")).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_gate_by_hand(spark):
    good = ("strict", 5.0, "none", 0.1, "苹果干", "苹果", 0.9, 0.9, 0.9)
    change = {
        (): None, (1, 2.9): "segment_too_short", (1, 15.1): "quality_gate", (2, "complex"): "subtitle_too_complex", (3, 0.36): "subtitle_too_complex",
        (5, "香蕉"): "no_material", (5, ""): None, (5, None): None, (6, 0.5): "no_material", (7, 0.4): "low_quality", (8, 0.5): "quality_gate",
    }
    rows = []
    for i, (what, _) in enumerate(change.items()):
        row = list(good)
        if what:
            row[what[0]] = what[1]
        rows.append((i, *row))
    df = spark.createDataFrame(rows, "clip_id long, policy string, duration double, subtitle_type string, subtitle_score double, material string, required_material string, material_score double, visual double, overall double")
    got = {r.clip_id: r for r in library.quality_gate(df).collect()}
    for i, want in enumerate(change.values()):
        assert got[i].reason == want and got[i].accepted == (want is None) and got[i].subtitle_rejected == (want == "subtitle_too_complex")


def test_media_takes_the_newest_approved_file_that_exists(spark):
    clips = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, "o3")], "clip_id long, file_path string")
    made = [(1, 1, "succeeded", "approved", "a"), (1, 2, "succeeded", "approved", "b"), (1, 3, "succeeded", "approved", "gone"), (1, 4, "succeeded", "pending", "d"), (2, 5, "failed", "approved", "e"), (2, 6, "succeeded", "rejected", "f")]
    cleanups = spark.createDataFrame(made, "clip_id long, cleanup_id long, status string, review_status string, output_path string")
    files = spark.createDataFrame([("a",), ("b",), ("b",), ("d",), ("e",), ("f",)], "path string")
    media = lambda review: {r.clip_id: r.media for r in library.preferred_media(clips, cleanups, files, review).collect()}
    assert media(True) == {1: "b", 2: "o2", 3: "o3"}
    assert media(False) == {1: "d", 2: "f", 3: "o3"}


def test_close_values_are_all_pairs_once(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for h in base for _ in range(12)} | {0, (1 << 64) - 1, 1 << 63})
    df = spark.createDataFrame([(i, "m", f"{v:016x}") for i, v in enumerate(values)], "clip_id long, category string, phash string")
    want = sorted((f"{a:016x}", f"{b:016x}", bin(a ^ b).count("1")) for a in values for b in values if bin(a ^ b).count("1") <= 6)
    for blocks in (None, 7, 8, 11):
        got = sorted((r.a, r.b, r.distance) for r in duplicates.close_values(df, df, blocks=blocks).collect())
        assert got == want, blocks
