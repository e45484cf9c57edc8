"""Payload shapes, quarantine and candidate fields by hand."""

import json
from datetime import datetime

from cliploom.operators import ingest, payloads

ITEM = {"content_id": "7001", "title": " ", "description": "d" * 80, "author": {"nickname": "", "unique_id": "un", "sec_uid": "s1"}, "duration_ms": 12345, "created_at": 1700000000, "tags": ["a", {"name": "b"}, {"x": 1}, 5], "stats": {"likes": 3, "none": None}}


def run(spark, values):
    rows = [(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)]
    got = payloads.normalize(payloads.unwrap(spark.createDataFrame(rows, "n long, payload string"))).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.n, r.seq)):
        out.setdefault(r.n, []).append(r)
    return out


def test_page_shapes(spark):
    one, two = {"content_id": "1"}, {"aweme_id": 2}
    got = run(spark, [one, {"items": [one, two], "cursor": 3}, [one, two], {"data": {"items": [one]}}, {"contents": None, "posts": [two]}, {"data": {"list": {"posts": [one]}}}, {"list": two}])
    assert {n: [r.platform_video_id for r in rows] for n, rows in got.items()} == {0: ["1"], 1: ["1", "2"], 2: ["1", "2"], 3: ["1"], 4: ["2"], 5: ["1"], 6: ["2"]}
    assert all(r.reason is None for rows in got.values() for r in rows)


def test_what_cannot_be_read_has_a_reason(spark):
    got = run(spark, ["{bad", None, "", {"items": []}, {"items": "x"}, {"other": 1}, 5, [], [{"content_id": "1"}, 7, "s", None], {"content_id": None}, {"data": []}, {"content_id": "  "}])
    reasons = {n: [r.reason for r in rows] for n, rows in got.items()}
    assert reasons == {
        0: ["not_json"], 1: ["not_json"], 2: ["not_json"], 3: ["no_items"], 4: ["no_items"], 5: ["unknown_shape"], 6: ["unknown_shape"], 7: ["no_items"],
        8: [None, "not_an_object", "not_an_object", "not_an_object"], 9: ["no_id"], 10: ["no_items"], 11: ["no_id"],
    }
    assert all(r.title is None and r.source_url is None for n in (0, 3, 5) for r in got[n])


def test_fields(spark):
    (row,) = run(spark, [ITEM])[0]
    assert (row.platform_video_id, row.title, row.author, row.author_id, row.duration, row.source_url) == ("7001", "d" * 60, "un", "s1", 12.345, "https://www.douyin.com/video/7001")
    assert row.published_at == datetime(2023, 11, 14, 22, 13, 20) and row.tags == ["a", "b"] and row.stats == {"likes": "3"} and (row.kind, row.no_video, row.issues) == ("video", False, [])
    bad = {"content_id": "x", "duration": "soon", "created_at": "yesterday", "stats": [1], "web_url": "https://w/1", "title": "t"}
    (row,) = run(spark, [bad])[0]
    assert (row.duration, row.published_at, row.issues, row.source_url, row.title) == (None, None, ["duration", "created_at", "stats"], "https://w/1", "t")
    (row,) = run(spark, [{"content_id": "x", "duration_ms": "", "duration": "7.5", "kind": " Album "}])[0]
    assert (row.duration, row.kind, row.no_video) == (7.5, "album", True)


def test_streams_by_preference(spark):
    streams = [
        {"url": "https://marked", "bitrate": 900, "watermark": True}, {"urls": ["ftp://x", "https://low"], "bitrate": 100}, {"urls": [{"url": "https://big"}, {"no": 1}], "bitrate": 200, "size_bytes": 9},
        {"url": "https://small", "bitrate": "200", "size_bytes": 3}, {"bitrate": 999},
    ]
    (row,) = run(spark, [{"content_id": "1", "media": {"video": {"url": "https://first", "bitrate": 50}, "streams": streams, "covers": [{}, {"urls": ["https://c"]}]}}])[0]
    assert row.media_url == "https://big" and row.cover_url == "https://c" and row.n_streams == 6
    (row,) = run(spark, [{"content_id": "1", "media": {"images": [1], "streams": []}}])[0]
    assert (row.kind, row.no_video, row.media_url) == ("images", True, None)
    (row,) = run(spark, [{"content_id": "1", "media": {"images": [1], "streams": [{"url": "https://v"}]}}])[0]
    assert row.kind == "video"


def test_urls_that_differ_in_query_or_slash_are_one_candidate(spark):
    hits = [("1", "https://x/video/1?a=1", 1, "q1"), ("2", " https://x/video/1/ ", 2, "q2"), ("3", "https://x/video/3", 3, "q1"), ("4", "", 4, "q3"), ("5", None, 5, "q3")]
    got = ingest.collapse(spark.createDataFrame(hits, "video_id string, url string, seq long, query string")).collect()
    assert {r.video_id: r.queries for r in got} == {"1": ["q1", "q2"], "3": ["q1"], "4": ["q3"], "5": ["q3"]}
