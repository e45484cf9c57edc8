"""Small document tables with nulls, empty, long, tied and repeated rows, and columns with clashing names."""

import os
import random

import pyarrow.parquet as pq

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", size long, range int, part long, word string, copies long, n long, start long"
#: Names that operators use inside; stages must carry a caller's columns of these names unchanged.
INSIDE = "rate target source_size rate_source copy of weight row own base cand fakes spans changed new found lang_pred score pred c0 c1 col id comp band kept component_id n_shingles key_a _new _range".split()
CLASHING += "".join(f", {x} string" for x in INSIDE)


def rows(n=None):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in table[:n]]


def awkward():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma.", "déjà", "日本語", "x1", "+1 (555) 123-4567", "a@b.co", "--"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    texts = [None, "", " ", "\n\n", "one", "one two", "  lead", "tail  ", "a\tb\r\nc", "12 34", long, long, "one two", "é" * 700, " x ", "İΣ ς 1.2.3.4"]
    docs = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    return [*docs, docs[4], docs[10], (None, "no id", "fr", "s1", 5), (99, None, None, None, None)]


def frame(spark, data, clash=False):
    if not clash:
        return spark.createDataFrame(data, SCHEMA)
    return spark.createDataFrame([(*r, 1, 2, 3, "w", 4, 5, 6, *(f"{x}!" for x in INSIDE)) for r in data], SCHEMA + CLASHING)


def written(spark, data, folder, clash=False):
    """A folder with a documents table, as the registered queries read it."""
    frame(spark, data, clash).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)
