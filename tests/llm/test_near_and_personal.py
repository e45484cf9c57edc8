import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cliploom.llm import near_copies, personal

from .helpers import SCHEMA, awkward, frame, rows, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def expected(docs, n):
    """Components over all pairs of documents with an id and words, by shingles of n words."""
    sets = {}
    for d in docs:
        if d[0] is not None:
            sets.setdefault(d[0], []).append(shingles(d[1], n))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def near_group(n, seed=3):
    """A large group of edited copies around the limit of similarity, and unrelated texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.choice([0, 3, 6, 9, 12, 16])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
        out.append((i, " ".join(text), "en", "s", 1))
    return out + [(n + i, " ".join(f"y{rng.randrange(900)}" for _ in range(40)), "en", "s", 1) for i in range(20)]


@pytest.mark.parametrize("data", [rows, awkward, list, lambda: near_group(260)], ids=["rows", "awkward", "empty", "group"])
def test_op1_against_all_pairs(spark, tmp_path, data):
    docs = data()
    got = near_copies.op1_near_copies(spark, written(spark, docs, tmp_path, clash=True)).collect()
    want = expected(docs, 2)
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert r.component_id == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((d[0], len(shingles(d[1], 2))) for d in docs if d[0] is not None)


@pytest.mark.parametrize("data", [rows, awkward, list, lambda: near_group(120, 5)], ids=["rows", "awkward", "empty", "group"])
def test_keep_first_keeps_one_of_each_group(spark, data):
    """Stages take five words."""
    docs = data()
    stay = near_copies.keep_first(spark, frame(spark, docs, clash=True))
    assert stay.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    want = expected(docs, 5)
    assert {r.doc_id for r in stay.collect()} == {d for d, c in want.items() if d == c} | {None for d in docs if d[0] is None}


def test_blocks_lose_no_link(spark, monkeypatch):
    """Tiny blocks: every component is still found."""
    monkeypatch.setattr(near_copies, "FEW", 3)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 2_000)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    docs = near_group(150, 8)
    got = near_copies.components(spark, frame(spark, docs), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == expected(docs, 2)


def test_small_sketches_of_links_agree():
    """The share of pairs at the limit whose 8-bit sketches agree in fewer than LEAST_EQUAL places: none here."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(40):
        value = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        both = np.concatenate([value[:900], value[100:]])  # resemblance 0.8
        table = near_copies.common.mix(near_copies.fast_sketches(both, np.repeat([0, 1], 900), 2)) & np.uint64(255)
        assert (table[0] == table[1]).sum() >= near_copies.LEAST_EQUAL


def test_sketches_fill_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    value = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    both = np.concatenate([value[:900], value[100:]])
    table = near_copies.fast_sketches(both, np.repeat([0, 1], 900), 2)
    assert (table != near_copies._NONE).all()
    assert abs((table[0] == table[1]).mean() - 0.8) < 0.15
    tiny = near_copies.fast_sketches(value[:1], np.zeros(1, int), 1)
    assert (tiny != near_copies._NONE).all()


PATTERN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(d - 9 if d > 9 else d for d in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(s)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERN.items():
        for m in re.finditer(pattern, text or ""):
            value, digits = m.group(), re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def tricky():
    texts = [
        "a@b.cc+d@e.ff x@y z@.w q@r..s @@ é.ü+k@l-m.n-o.p",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9999999999999999",
        "4111 1111-1111 1111 41111111111111111111 4111--111111111111 5 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1",
        "+1 (988) 555-2485 ++49 30 123456 +1 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +4915112345678.",
        "1-" * 20_000 + "1", "a." * 20_000 + "@x.y", "x@" + "a." * 20_000 + "b", "+1" + "()" * 20_000, "7" * 30_000,
        "日本 a@b.co 語 10.0.0.1 é", "me (at) home (dot) net, tel 555-123-4567",
    ]
    rng = random.Random(9)
    texts += ["".join(rng.choice("0123456789 -.+()@ab:") for _ in range(300)) for _ in range(40)]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("data", [rows, awkward, list, tricky], ids=["rows", "awkward", "empty", "tricky"])
def test_op9_base_spans(spark, tmp_path, data):
    docs = data()
    got = personal.op9_personal(spark, written(spark, docs, tmp_path, clash=True)).collect()
    assert len(got) == len(docs)
    by = {}
    for d in docs:
        by.setdefault(d[0], []).append(base(d[1]))
    for r in got:
        fits = [b for b in by[r.doc_id] if hashlib.sha256(",".join(b).encode()).hexdigest() == r.base_sha256]
        assert fits, (r, by[r.doc_id])
        assert set(fits[0]) <= set(r.spans.split(",")) | set([""])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in fits[0]) for k in PATTERN]


def test_op9_adds_spans_of_familiar_shape(spark):
    rng = random.Random(4)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    docs = [(i, f"some text call +1 {number()} and more", "en", "s", 1) for i in range(2000)]
    docs += [(2000 + i, f"some text call {number()} and more", "en", "s", 1) for i in range(4)]
    docs += [(3000 + i, f"chapter 12. 34 - 56 and {i}", "en", "s", 1) for i in range(50)]
    docs += [(4000 + i, f"write to user{i}@mail.example.org or so", "en", "s", 1) for i in range(600)]
    docs += [(5000 + i, f"write to user{i} (at) mail.example.org or so", "en", "s", 1) for i in range(3)]
    docs += [(6000 + i, f"call +1 {number()} 4539578763621486 now", "en", "s", 1) for i in range(3)]  # one run: no base span
    docs += [(7000 + i, f"card 4539578763621486, host 10.1.{i % 200}.7 up", "en", "s", 1) for i in range(600)]
    docs += [(8000 + i, "paid by 4539578763621486 in full", "en", "s", 1) for i in range(600)]
    table = personal.annotated(spark.createDataFrame(docs, SCHEMA)).cache()
    chosen = personal.accepted(table)
    found = personal.spans(table, chosen).select("doc_id", "spans", F.size("base").alias("n")).collect()
    got, n = {r.doc_id: r.spans for r in found}, {r.doc_id: r.n for r in found}
    text = {d[0]: d[1] for d in docs}
    assert all(len(got[i]) == 1 for i in range(2000))
    assert not any(got[3000 + i] for i in range(50))
    for i in range(4):
        assert n[2000 + i] == 0 and [(x.kind, text[2000 + i][x.start : x.end]) for x in got[2000 + i]] == [("phone", text[2000 + i][15:-9])]
    for i in range(3):
        assert n[5000 + i] == 0 and [(x.kind, text[5000 + i][x.start : x.end]) for x in got[5000 + i]] == [("email", f"user{i} (at) mail.example.org")]
        assert n[6000 + i] == 0 and {(x.kind, text[6000 + i][x.start : x.end]) for x in got[6000 + i]} == {("phone", text[6000 + i][5:22]), ("card", "4539578763621486")}
    good, every = personal.precision(table, chosen)
    assert good >= personal.PRECISION * every > 0


def test_redaction_leaves_no_base_span(spark):
    """Cutting one number can make another one of the rest of its run."""
    card = "4539578763621486"
    texts = [f"{card} {card}", f"1{card} {card} +1 (988) 555-2485 {card}", "+1 (988) 555-2485 +1 (988) 555-2485", f"a@b.co {card}-1.2.3.4", f"é {card}1 {card} 10.0.0.1.2.3.4"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(d[0] + 100, *d[1:]) for d in tricky()]
    for r in personal.redact(spark, frame(spark, docs)).collect():
        assert not base(r.text), r


@pytest.mark.parametrize("hits", [800, 6000])
def test_op9_adds_by_combination_and_not_by_running_total(spark, hits):
    rng = random.Random(6)
    number = lambda: f"1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    docs = [(i, f"some text call +{number()} and more", "en", "s", 1) for i in range(hits)]
    docs += [(10_000 + i, f"some text call {number()} and more", "en", "s", 1) for i in range(2)]
    docs += [(20_000 + i, f"order {rng.randrange(10**6, 10**7)} was sent on {rng.randrange(1990, 2020)}-{i % 12 + 1:02d}-11", "en", "s", 1) for i in range(hits // 200)]
    table = personal.annotated(spark.createDataFrame(docs, SCHEMA)).cache()
    got = {r.doc_id: r.spans for r in personal.spans(table, personal.accepted(table)).select("doc_id", "spans").collect()}
    assert all(len(got[i]) == 1 for i in range(hits))
    for i, text in ((d[0], d[1]) for d in docs if 10_000 <= d[0] < 20_000):
        assert [(x.kind, text[x.start : x.end]) for x in got[i]] == [("phone", text[15:-9])]
    assert not any(got[20_000 + i] for i in range(hits // 200))


def test_redaction(spark):
    docs = [(1, "mail a.b@c.org now, +1 (988) 555-2485 or 10.0.0.1é", "en", "s", 7), (2, "clean", "en", "s", 5), (3, None, "en", "s", None), (4, "", "en", "s", 0)]
    got = {r.doc_id: r for r in personal.redact(spark, frame(spark, docs, clash=True)).collect()}
    assert got[1].text == "mail <email> now, <phone> or <ip>é" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean" and got[3].text is None and got[4].text == ""
    assert got[2].n_chars == 5 and got[2].word == "w"


@pytest.mark.parametrize("n", [10, 12])
def test_op1_tells_long_words_of_two_letters_apart(spark, n):
    """Such words have one polynomial modulo 2^64; their documents share nothing."""
    one = "a"
    for _ in range(n):
        one += one.translate({97: "b", 98: "a"})
    docs = [(3, one, "en", "s", 1), (4, one.translate({97: "b", 98: "a"}), "en", "s", 1), (5, one, "en", "s", 1)]
    got = near_copies.components(spark, frame(spark, docs), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 4: 4, 5: 3}
