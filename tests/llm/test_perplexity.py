import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cliploom.llm import common, perplexity

from .helpers import awkward, frame, rows, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def lined():
    rng = random.Random(3)
    out = []
    for i in range(80):
        lines = [" ".join(rng.choice("ab") + rng.choice(["", "é", "|"]) for _ in range(rng.randrange(5))) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(30))]
        out.append((i, "\n".join(lines) + rng.choice(["", "\n"]), "en", "s", 1))
    return out


@pytest.mark.parametrize("data", [rows, awkward, list, lined])
def test_op12_base_counts(spark, tmp_path, data):
    docs = data()
    want = {d[0]: base(d[1]) for d in docs}
    got = perplexity.op12_perplexity(spark, written(spark, docs, tmp_path, clash=True)).collect()
    assert len(got) == len(docs)
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == want[r.doc_id], r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.base_failed:
            assert not r.kept
        else:
            assert r.kept == (r.lower <= r.perplexity <= r.upper)


def plain_model(texts):
    """Modified Kneser-Ney of order 4, by loops: a function of history and character."""
    order, counts = 4, {4: Counter()}
    for text in texts:
        signs = [2] * 3 + list(map(ord, text))
        counts[4].update(tuple(signs[i - 3 : i + 1]) for i in range(3, len(signs)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals = {}, {k: Counter() for k in counts}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        own = []
        for j in (1, 2, 3):
            d = j / 2 if y is None or not n[j] else j - (j + 1) * y * n[j + 1] / n[j]
            own.append(max(0.0, min(j - 0.05, d)))
        discounts[k] = own
        for g, x in c.items():
            totals[k][g[:-1]] += x
    rest = {k: defaultdict(lambda: 1.0) for k in counts}
    weight = {k: {g: (x - discounts[k][min(x, 3) - 1]) / totals[k][g[:-1]] for g, x in c.items()} for k, c in counts.items()}
    for k, c in weight.items():
        for g, x in c.items():
            rest[k][g[:-1]] -= x

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        k = len(gram)
        return weight[k].get(gram, 0.0) + max(1e-9, rest[k][gram[:-1]]) * p(gram[1:])

    return p, order


def test_op12_perplexity_against_a_plain_model(spark, tmp_path):
    texts = [" ".join(WORD.findall(r[1].lower())) for r in rows() if r[2] == "en"][:60]
    texts = [t for t in texts if t.isascii()]
    p, order = plain_model(texts)
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.perplexity for r in perplexity.op12_perplexity(spark, written(spark, docs, tmp_path)).collect()}
    for i, text in enumerate(texts[:12]):
        signs = [2] * 3 + list(map(ord, text))
        logs = [math.log(p(tuple(signs[j - 3 : j + 1]))) for j in range(order - 1, len(signs))]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)


def test_probabilities_sum_to_one(spark):
    docs = frame(spark, [(i, "abracadabra " * (i % 3 + 1) + "zebra", "en", "s", 1) for i in range(20)])
    model = perplexity.fitted(common.Scratch(spark, "t"), perplexity.counted(docs, ["en"]), ["en"])
    signs = sorted({ord(c) for c in "abrcd zew"} - {ord("w")}) + [ord("?")]
    for history in ("abr", "   ", "qqq", "dab"):
        packed = [sum(ord(c) << 16 * (3 - j) for j, c in enumerate(history)) | s for s in signs]
        assert np.exp(model.logs(0, np.array(packed, np.uint64))).sum() == pytest.approx(1, abs=1e-4)


def test_junk_goes_and_prose_stays(spark):
    """Letters at random, another language's prose and one sentence over and over leave; prose stays, in each language."""
    rng = random.Random(1)
    prose = [r for r in rows() if len(WORD.findall(r[1])) >= 60 and base(r[1])[4] * 2 <= base(r[1])[0]]
    docs = [(i, r[1], r[2], "s", 1) for i, r in enumerate(prose)]
    english = [d for d in docs if d[2] == "en"]
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz#%") for _ in range(rng.randrange(2, 9))) for _ in range(120))
    bad = [(9000, noise, "en", "s", 1), (9001, english[0][1], "de", "s", 1), (9002, english[1][1], None, "s", 1)]
    kept = {r.doc_id for r in perplexity.filtered(spark, frame(spark, docs + bad, clash=True)).collect()}
    assert not kept & {9000, 9001}
    assert len(kept & {d[0] for d in docs}) >= 0.97 * len(docs)


def test_packed_ngrams():
    gram, row = perplexity.grams(pa.array(["aB", "", None, "x \n\tÿ", "日\U0001f600"]))
    last = [int(g) & 0xFFFF for g in gram]
    assert last[:2] == [97, 98] and row.tolist() == [0, 0, 3, 3, 3, 4, 4]
    assert last[2:5] == [ord("x"), 32, ord("ÿ")] and last[5] == ord("日") and 0xE000 <= last[6] < 0xF000
    assert int(gram[1]) >> 16 & 0xFFFF == 97 and int(gram[2]) >> 16 == (2 << 32 | 2 << 16 | 2)


def test_words_of_one_colliding_sum_differ():
    """Thue-Morse words, which polynomials modulo 2^64 confuse."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: "b", 98: "a"})
    words = common.Words(pa.array([word, word.translate({97: "b", 98: "a"})]))
    assert len(set(words.hash.tolist())) == 2 and len(set(words.check.tolist())) == 2


@pytest.mark.parametrize("held", [0, 40, 700])
def test_no_ngram_is_left_out_of_a_small_memory(spark, tmp_path, monkeypatch, held):
    """With few or no n-grams in memory the others are joined: the same perplexities, bands and verdicts."""
    folder = written(spark, rows()[:60] + awkward(), tmp_path)
    want = sorted(map(tuple, perplexity.op12_perplexity(spark, folder).collect()), key=repr)
    monkeypatch.setattr(perplexity, "ENTRIES", held)
    got = sorted(map(tuple, perplexity.op12_perplexity(spark, folder).collect()), key=repr)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    for a, b in zip(got, want, strict=True):
        assert [x for x in a[8:] if x is not None] == pytest.approx([x for x in b[8:] if x is not None], rel=1e-6) and a.count(None) == b.count(None)


def test_least_held_count(spark):
    level = spark.createDataFrame([(0, i, c) for i, c in enumerate([900, 900, 40, 7, 7, 1])], "m int, gram long, c long")
    assert [perplexity.least_held(level, n) for n in (1, 2, 4, 5, 6)] == [(None, False), (900, False), (40, False), (7, False), (1, True)]
