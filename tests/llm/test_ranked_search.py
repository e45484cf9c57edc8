import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cliploom.llm import ranked_search

from .helpers import SF, awkward, frame, rows, written

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
BENCHMARK = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=20):
    bags = [(d[0], Counter(terms(d[1]))) for d in docs]
    bags = [(i, b) for i, b in bags if b]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    texts = {}
    for i, text in items:
        if text is not None:
            texts[i] = min(text, texts.get(i, text), key=lambda x: x.encode())
    out = []
    for i, text in texts.items():
        ask, found = Counter(terms(text)), []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * count // total
            score = sum(c * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, c in ask.items() if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(i, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(found[:top], 1)]
    return sorted(map(str, out))


def questions():
    docs = rows()
    items = [(i, docs[i][1][:200]) for i in range(0, 60, 7)]
    return [*items, (100, None), (101, ""), (102, "the the the of"), (103, "zzzz qqqq"), (104, "alpha日本語 x1"), (104, "Beta"), (None, "the and")]


def put(spark, docs, items, folder):
    written(spark, docs, folder, clash=True)
    spark.createDataFrame([(*x, "t", 1) for x in items], BENCHMARK + ", term string, score int").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("data", [rows, awkward, list, lambda: rows() + awkward()])
def test_op11_against_brute_force(spark, tmp_path, data):
    docs = data()
    got = ranked_search.op11_ranked(spark, put(spark, docs, questions(), tmp_path)).collect()
    assert sorted(str(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score"))) for r in got) == expected(docs, questions())


def test_op11_without_items(spark, tmp_path):
    assert ranked_search.op11_ranked(spark, put(spark, rows(20), [], tmp_path)).count() == 0


def test_op11_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(map(str, con.execute(ranked_search.OP11_SQL).fetchall()))
    got = ranked_search.op11_ranked(spark, SF).collect()
    assert sorted(str(tuple(r)) for r in got) == want and len(want) > 100


def test_small_trees_and_blocks_change_nothing(spark, monkeypatch):
    """Many blocks of documents and items, deep trees, few cells: the same rows."""
    docs, items = rows() + awkward(), questions()
    for name, value in (("BLOCK", 64), ("LEAF", 4), ("ITEM_BYTES", 600), ("SEED", 2)):
        monkeypatch.setattr(ranked_search, name, value)
    asked = spark.createDataFrame(items, BENCHMARK)
    got = ranked_search.ranked(spark, frame(spark, docs), asked, top=5).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(docs, items, 5)


def test_bounds_hold_and_subtrees_are_left_out():
    """No member of a node scores above the node's bound, and clusters that cannot rank are not visited."""
    rng = random.Random(4)
    words = [[f"{c}{i}" for i in range(40)] for c in "abcdefgh"]
    texts = []
    for j in range(800):
        group = words[j % 8]
        texts.append(" ".join(rng.choice(group) for _ in range(60)))
    import pyarrow as pa

    items = ranked_search.Items(pa.table({"item_id": [1, 2], "text": [texts[0], texts[5]]}))
    bags = [Counter(terms(t)) for t in texts]
    place = {t: i for i, t in enumerate(x.decode() for x in items.vocabulary.to_pylist())}
    df = np.array([sum(t in b for b in bags) for t in place])
    items.weigh(len(texts), sum(sum(b.values()) for b in bags), df)
    entries = [[(place[t], c) for t, c in sorted(b.items()) if t in place] for b in bags]
    length = np.array([len(e) for e in entries])
    flat = np.array([x for e in entries for x in e])
    search = ranked_search.Search(items, {}, 5)
    search.add(np.arange(800), np.zeros(800, bool), np.array([sum(b.values()) for b in bags]), length, flat[:, 0], flat[:, 1])
    assert search.visited < search.leaves / 2
    want = expected([(i, t) for i, t in enumerate(texts)], [(1, texts[0]), (2, texts[5])], 5)
    got = [(items.ids[k], rank, int(doc), int(score)) for k, (s, _, d) in enumerate(search.best) for rank, (score, doc) in enumerate(zip(s, d), 1)]
    assert sorted(map(str, got)) == want

    value = np.random.default_rng(1).random((500, 30)) * 1e6
    row, column = np.nonzero(value > 5e5)
    tree = ranked_search.BallTree(row, column, value[row, column], 500, 30)
    held = np.where(value > 5e5, value, 0)
    asked = np.random.default_rng(2).random((20, 30))
    for level in range(tree.depth + 1):
        node = tree.leaf >> (tree.depth - level)
        bound = asked @ tree.centroids[level].T + np.linalg.norm(asked, axis=1)[:, None] * tree.radii[level]
        assert ((asked @ held.T) <= bound[:, node]).all()
