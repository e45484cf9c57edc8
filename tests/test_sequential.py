"""Operators without a SQL form against plain loops, and small hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from cliploom.functions import text
from cliploom.operators import duplicates, geometry, graph, ranking, segments, tables


def test_overlaps_are_dropped_in_order(spark):
    rows = [(1, 5.0, 12.0), (1, 6.0, 13.0), (1, 20.0, 26.0), (2, 1.0, 2.0), (2, 1.6, 4.0)]
    got = geometry.without_overlaps(spark.createDataFrame(rows, "v long, start double, end double"), "v").collect()
    assert sorted((r.v, r.start) for r in got) == [(1, 5.0), (1, 20.0), (2, 1.0), (2, 1.6)]


def test_long_segments_are_split(spark):
    rows = [(1, 0.0, 40.0, []), (2, 0.0, 16.0, [14.2]), (3, 0.0, 9.0, [])]
    got = segments.split_long(spark.createDataFrame(rows, "video_id long, start double, end double, ts array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 0.0, 15.0), (1, 15.0, 30.0), (1, 30.0, 40.0), (2, 0.0, 16.0), (3, 0.0, 9.0)]


def test_hamming_rules(spark):
    pairs = [("0" * 16, "0" * 16, 0), ("0" * 16, "0" * 15 + "1", 1), ("", "abc", 64), ("0" * 16, "f" * 16, 64), ("zz", "zz", 0), (None, "0" * 16, 64)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert df.filter(duplicates.hamming(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_phash_join_finds_all_pairs_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for h in base for _ in range(6)]
    rows = [(i, "m", f"{h:016x}") for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "clip_id long, category string, phash string")
    got = {r.phash: r.match_id for r in duplicates.by_phash(df.filter("clip_id % 2 = 0"), df.filter("clip_id % 2 = 1")).collect()}
    want = {}
    for i, _, a in rows[::2]:
        found = [j for j, _, b in rows[1::2] if bin(int(a, 16) ^ int(b, 16)).count("1") <= 6]
        if found:
            want[a] = min(found)
    assert got == want


def test_published_scores(spark):
    """Figures of the survey's fixture F3: v2 of seven queries."""
    rows = [("a", 5, 27, 3, None, 0, None, 0, 0.239), ("b", 3, 21, 17, 0.571, 0, None, 0, 1.677), ("c", 2, 10, 2, 0.0, 58318, 29159.0, 0, 0.003), ("d", 1, 7, 1, 0.0, 36141, 36141.0, 1, -0.025), ("e", 1, 1, 1, None, 0, None, 0, 0.680), ("f", 0, 37, 25, 0.5, 44071, None, 0, -4.305), ("g", 0, 5, 5, 0.8, 6974, None, 0, -2.707)]
    df = spark.createDataFrame(rows, "query string, clips long, candidates long, uniques long, subtitle_rejection_rate double, tokens long, tokens_per_clip double, approved long, want double").withColumn("accepted", F.lit(0))
    for r in ranking.scores(df).collect():
        assert abs(r.score_v2 - r.want) < 1e-3, r


def test_scalar_texts(spark):
    row = spark.createDataFrame([("Bearer abc.def sk-12345678 token=xyz, ok",)], "t string")
    assert row.select(text.sanitize_error(F.col("t"))).first()[0] == "Bearer <redacted> sk-<redacted> token=<redacted>, ok"


@pytest.mark.parametrize("fold", [duplicates.FOLD, 12, 0])
def test_dedup_in_order_is_the_sequential_loop(spark, fold):
    """With all components gone through in order, with some of them, and with all settled in rounds."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(12)]
    near = lambda: f"{rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))):016x}"
    rows = [(i, rng.choice("mn"), rng.choice(["", None, *[f"s{k}" for k in range(40)]]), rng.choice(["", None, "zz", *[near() for _ in range(6)]])) for i in range(240)]
    rows += [(300 + i, "m", "copies", "0123456789abcdef") for i in range(5)]
    library, batch = rows[:20], rows[20:]
    close = lambda a, b: a[1] == b[1] and len(a[3] or "") == len(b[3] or "") == 16 and bin(int(a[3], 16) ^ int(b[3], 16)).count("1") <= 6
    kept, held = {}, list(library)
    for r in batch:
        kept[r[0]] = not any((r[2] and r[2] == o[2]) or close(r, o) for o in held)
        held += [r] if kept[r[0]] else []
    schema = "clip_id long, category string, sha string, phash string"
    got = duplicates.in_order(spark.createDataFrame(batch, schema), spark.createDataFrame(library, schema), tables.saver(spark), fold=fold).collect()
    assert {r.id: r.kept for r in got} == kept and len(got) == len(batch)
    assert sum(kept[300 + i] for i in range(5)) == 1


def test_a_chain_of_ten_thousand_clips(spark):
    """Each clip shares its sha with one neighbour and its hash with the other: every second one stays, and the tables written grow with the logarithm."""
    rows = [(i, "m", f"a{i // 2}", f"{random.Random(1000 + (i + 1) // 2).getrandbits(64):016x}") for i in range(10_000)]
    names = []
    save = tables.saver(spark)
    batch = spark.createDataFrame(rows, "clip_id long, category string, sha string, phash string")
    got = duplicates.in_order(batch, batch.limit(0), lambda df, name: (names.append(name), save(df, name))[1]).collect()
    assert all(r.kept == (r.id % 2 == 0) for r in got) and len(got) == 10_000
    assert len(names) < 40


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    root = list(range(300))
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long"), tables.saver(spark)).collect()}
    assert got == {i: root[i] for i in {x for a, b in edges if a != b for x in (a, b)}}
    assert graph.components(spark.createDataFrame([], "a long, b long"), tables.saver(spark)).count() == 0


def test_numbers_by_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "hash(id) % 100 AS v", "'x' AS _n")
    got = tables.numbered(rows, [F.desc("v"), F.asc("id")], "place", tables.saver(spark)).collect()
    order = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r.place for r in order] == list(range(1, 5001)) and got[0]._n == "x"
    assert tables.numbered(rows.limit(0), [F.asc("id")], "place", tables.saver(spark)).count() == 0
