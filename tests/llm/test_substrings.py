import hashlib
import random
import re

import pytest

from cliploom.llm import common, substrings

from .helpers import awkward, frame, rows, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(docs):
    order = sorted({(d[0], d[1] or "") for d in docs if d[0] is not None})
    seen, out = set(), {}
    for doc, text in order:
        words = WORD.findall(text)
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "cd", "é"]) + str(rng.randrange(300))
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 45, 80)]
    out = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [word() for _ in range(rng.randrange(30))] + rng.choice(shared)
        out.append((i * 7, rng.choice([" ", "\n", "  "]).join(text), "en", "s", 1))
    out.append((1000, "x " * 200, "en", "s", 1))
    out.append((1001, "p q " * 100 + "x " * 30, "en", "s", 1))
    out.append((1002, " ".join(f"z{i % 23}" for i in range(300)), "en", "s", 1))
    return out


@pytest.mark.parametrize("data", [rows, awkward, list, passages])
def test_op2_against_brute_force(spark, tmp_path, data):
    docs = data()
    want = expected(docs)
    got = substrings.op2_substrings(spark, written(spark, docs, tmp_path, clash=True)).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id


def thue_morse(n):
    """Two words of 2^n letters that a polynomial modulo 2^64 confuses."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [10, 12])
def test_long_words_of_two_letters_are_told_apart(spark, n):
    one, other = thue_morse(n)
    shared = [f"w{i}" for i in range(19)]
    docs = [(1, " ".join([*shared, one]), "en", "s", 1), (2, " ".join([*shared, other]), "en", "s", 1)]
    got = substrings.deduplicated(spark, frame(spark, docs)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}


@pytest.mark.parametrize("batches", [1, 7])
def test_number_of_batches_does_not_matter(spark, batches):
    docs = passages()
    got = substrings.deduplicated(spark, frame(spark, docs), batches).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected(docs)


def test_incremental_batches_and_compaction(spark, monkeypatch):
    """Resolved after every batch, or once: the same places; runs of both kinds are compacted, and are met again."""
    monkeypatch.setattr(substrings, "MOST_RUNS", 2)
    docs = passages()
    table = frame(spark, docs)
    index, removed = substrings.SubstringIndex(spark), {}
    ids = sorted(d[0] for d in docs)
    cuts = [ids[len(ids) * i // 6] for i in range(6)] + [10**9]
    for low, high in zip(cuts, cuts[1:], strict=False):
        index.add(table.filter(f"doc_id >= {low} AND doc_id < {high}"))
        for r in index.resolve(table.filter(f"doc_id < {high}")).collect():
            removed.setdefault(r.doc_id, []).extend(r.places)
    assert len(index.prints) <= 2 and len(index.windows) <= 2 and index.compactions >= 4
    got = substrings.without(table, spark.createDataFrame(list(removed.items()), "doc_id long, places array<long>")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected(docs)
    index.close()


def test_a_run_is_not_shuffled(spark):
    """Runs are merge-joined where they lie: the plan of a batch shuffles its own rows only."""
    index = substrings.SubstringIndex(spark)
    index.add(frame(spark, passages()[:30]))
    run = spark.table(index.prints[0]).filter("fresh")
    rows = substrings.fingerprints(frame(spark, passages()[30:])).groupBy("fp").count()
    plan = rows.hint("merge").join(run, "fp", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and common.WORD
    index.close()
