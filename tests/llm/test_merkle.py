import hashlib
import zlib

import duckdb
import pytest

from cliploom.llm import merkle

from .helpers import awkward, frame, rows, written

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text):
    values = (doc[0], doc[3], doc[2], doc[4], text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(leaves):
    """The levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[a : a + 16]) for a in range(0, len(below), 16)])
    return levels


def path_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        start = at - at % 16
        out.append((nodes[start:at], nodes[at + 1 : start + 16]))
        at //= 16
    return out


def expected(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[3], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in order:
        groups[s].sort(key=lambda d: (d[0] is None, d[0] or 0, leaf_of(d, d[4 - 3])))
        inner[s] = grown([leaf_of(d, d[1]) for d in groups[s]])
    outer = grown([inner[s][-1][0] for s in order])
    out = []
    for at_source, s in enumerate(order):
        for at, d in enumerate(groups[s]):
            path = path_of(inner[s], at) + path_of(outer, at_source)
            text = d[1]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and text is not None:
                text = text.translate(LOWER)
            node = leaf_of(d, text)
            for left, right in path:
                node = sha(*left, node, *right)
            root = outer[-1][0]
            out.append((d[0], leaf_of(d, d[1]), inner[s][-1][0], root, sha(*[x for left, right in path for x in (*left, *right)]), node, node == root))
    return sorted(map(str, out))


def many():
    """A source of 4,200 rows (four levels), one of a single row, one of 17, and 40 more sources."""
    docs = [(i, f"Text {i % 7}", "en", "big", i) for i in range(4200)]
    docs += [(5000, "Alone", "en", "lone", 1), *((6000 + i, f"Q{i}", None, None, i) for i in range(17))]
    return docs + [(7000 + i, f"S{i}", "de", f"é{i}" if i % 2 else f"s{i}", None) for i in range(40)]


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("data", [rows, awkward, list, many, lambda: rows(1)])
def test_op13_against_brute_force(spark, tmp_path, data):
    docs = data()
    got = merkle.op13_merkle(spark, written(spark, docs, tmp_path, clash=True)).collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got) == expected(docs)


@pytest.mark.parametrize("data", [rows, many])
def test_op13_against_sql(spark, tmp_path, data):
    docs = data()
    folder = written(spark, docs, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(merkle.OP13_SQL)
    assert [c[0] for c in want.description] == list(COLUMNS)
    assert sorted(map(str, want.fetchall())) == expected(docs)


def test_a_changed_row_is_found(spark):
    """Only the changed rows fail, whatever the field; the others fold to the root of the untouched table."""
    docs = rows()
    table = frame(spark, docs)
    from pyspark.sql import functions as F

    changed = F.when(F.col("doc_id") == 7, F.lit("zz")).otherwise(F.col("lang"))
    seen = merkle.leaf([changed if f == "lang" else F.col(f) for f in merkle.FIELDS])
    found = merkle.manifest(spark, table, seen=seen)
    wrong = found.filter(merkle.fold(F.col("path"), F.col("seen")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in wrong] == [7]


def test_no_task_takes_a_whole_source(spark, tmp_path):
    """The leaves' windows and joins are dealt by (source, run), never by source alone."""
    got = merkle.op13_merkle(spark, written(spark, many(), tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert deals and all("run" in line for line in deals)
