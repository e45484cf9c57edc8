"""Free text by pieces equals the scan; pages by ranges equal the sorted table."""

import random

import pytest

from cliploom.operators import search, tables
from cliploom.operators.search import F


def test_index_equals_the_scan(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcDE%_ü") for _ in range(rng.randrange(7)))
    data = [(i, " ".join(word() for _ in range(5)), word() or None, None, word()) for i in range(400)] + [(1000, None, None, None, None), (1001, "", "", "", "xAbCx")]
    rows = spark.createDataFrame(data, "clip_id long, a string, b string, c string, d string")
    columns = ["a", "b", "c", "d"]
    index = search.text_index(rows, columns, tables.saver(spark))
    for text in ("abc", "ABC", "a_c", "ab", "", "de%ab", "bcde", "ü", "cde ab", "zzz"):
        want = sorted(r.clip_id for r in search.hits(rows, columns, text).collect())
        assert sorted(r.clip_id for r in search.free_text(rows, index, columns, text).collect()) == want, text
    plan = search.free_text(rows, index, columns, "abcd")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "piece" in plan
    assert search.wanted_pieces("a%bcde_f") == ["bcd", "cde"]


@pytest.mark.parametrize("descending", [True, False])
def test_pages_equal_the_sorted_table(spark, descending):
    rng = random.Random(7)
    data = [(i, rng.choice([None, 1.5, *[float(rng.randrange(40)) for _ in range(9)]])) for i in range(1500)] + [(5000 + i, 7.0) for i in range(700)]
    rows = spark.createDataFrame(data, "clip_id long, v double")
    order = sorted(data, key=lambda r: ((r[1] is None) if descending else (r[1] is not None), (-r[1] if descending else r[1]) if r[1] is not None else 0, -r[0]))
    for number in (0, 3, 17, 30, 43, 44, 10_000):
        at = min(number, (len(data) - 1) // 50) * 50
        assert [tuple(r) for r in search.page(rows, "v", 50, number, descending).collect()] == order[at : at + 50], number
    assert search.page(rows.limit(0), "v", 50, 3).collect() == []


def test_a_deep_page_sorts_one_range(spark):
    """Of 300,000 rows the sort of page 5,000 gets less than a hundredth; of one value many times, too."""
    rows = spark.range(300_000).select(F.col("id").alias("clip_id"), (F.col("id") * 7919 % 300_007).alias("v"), F.lit(1).alias("same"))
    for key in ("v", "same"):
        found, before, taken, single = search._cut(rows, key, True, 250_000, 50)
        if single == 1:
            found, more, taken, _ = search._cut(found, "clip_id", True, 250_000 - before, 50)
        assert taken < 3_000 and found.count() == taken
    assert [r.clip_id for r in search.page(rows, "same", 50, 5_000).collect()] == list(range(49_999, 49_949, -1))
