import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cliploom.llm import fingerprints, languages, media, mixing

from .helpers import SF, awkward, frame, rows, written

WORDS = " \t\n\x0b\x0c\r"


def split(text):
    for c in WORDS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.mark.parametrize("data", [rows, awkward, list])
def test_op10_targets_and_copies(spark, tmp_path, data):
    docs = data()
    got = mixing.op10_mix_sources(spark, written(spark, docs, tmp_path, clash=True)).collect()
    size = {}
    for d in docs:
        size[d[3]] = size.get(d[3], 0) + len(split(d[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    left, free, target = Fraction(3 * sum(size.values()), 2), set(order), {}
    while free:  # share by weight; what is above stops and the excess is shared again
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * size[s]}
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
        for s in above:
            target[s] = Fraction(2 * size[s])
            left -= target[s]
        free -= above
    assert len(got) == len(docs)
    source = {d[0]: d[3] for d in docs}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s]
        assert abs(r.target - float(target[s])) < 1e-6 * max(1, float(target[s]))
        assert r.taken in (0, r.size, 2 * r.size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op10_mix_sources(spark, str(tmp_path)).collect()))
    mixed = mixing.mix(spark, frame(spark, docs, clash=True))
    assert sum(r.taken for r in got) == sum(len(split(r.text)) for r in mixed.collect())
    assert mixed.columns == frame(spark, docs, clash=True).columns


def test_op4_held_out_accuracy(spark):
    import os

    sf = os.environ.get("TEST_SF_DIR_LARGE", "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = languages.op4_language(spark, sf).collect()
    assert len(got) == len(truth)
    test = [r for r in got if r.held_out]
    assert {r.doc_id for r in test} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("data", [awkward, list])
def test_op4_awkward(spark, tmp_path, data):
    got = {(r.doc_id, r.lang_pred) for r in languages.op4_language(spark, written(spark, data(), tmp_path, clash=True)).collect()}
    for d in data():
        none = not any(c.isalpha() for c in d[1] or "")
        assert ((d[0], "und") in got) == none, d


def slow_language(docs, least=languages.LEAST, longest=languages.LONGEST):
    """Plain dictionaries: the predicted language and score of every text, learned from the labelled rows."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [w.translate(fold) for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t or "")]
    grams = lambda w, n: [g for i in range(len(w) + 3 - n) if (g := f"\2{w}\3"[i : i + n]) not in ("\2", "\3")]
    counts = {}
    for d in docs:
        if d[1] is not None and d[2] is not None and zlib.crc32(str(d[0] if d[0] is not None else "").encode()) % 3 != 1:
            for w in words(d[1]):
                for n in range(longest + 1):
                    for g in grams(w, n) if n else [w]:
                        counts[n, g, d[2]] = counts.get((n, g, d[2]), 0) + 1
    counts = {k: n for k, n in counts.items() if n >= least}
    langs = sorted({k[2] for k in counts})
    known = [{k[1] for k in counts if k[0] == n} for n in range(longest + 1)]
    total = {(n, lang): sum(c for k, c in counts.items() if k[0] == n and k[2] == lang) for n in range(longest + 1) for lang in langs}

    def log(n, g, lang):
        return math.log(counts.get((n, g, lang), 0) + 0.5) - math.log(total[n, lang] + 0.5 * max(1, len(known[n])))

    def score(w, lang):
        if w in known[0]:
            return log(0, w, lang)
        for n in range(longest, 0, -1):
            own = [g for g in grams(w, n) if g in known[n]]
            if own:
                return sum(log(n, g, lang) for g in own) / len(own)
        return 0.0

    out = []
    for d in docs:
        w = words(d[1])
        if not langs or not any(c.isalpha() for c in d[1] or ""):
            out.append(("und", 0.0))
            continue
        mean = [sum(score(x, lang) for x in w) / len(w) for lang in langs]
        best = max(range(len(langs)), key=lambda i: (round(mean[i], 9), -i))
        out.append((langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)))
    return out


@pytest.mark.parametrize("data", [lambda: rows(90), awkward, list], ids=["rows", "awkward", "empty"])
def test_op4_against_brute_force(spark, tmp_path, data):
    docs = data()
    got = languages.op4_language(spark, written(spark, docs, tmp_path, clash=True)).collect()
    want = [(d[0], *w) for d, w in zip(docs, slow_language(docs), strict=True)]
    key = lambda x: (x[0] is None, x[0] or 0, round(x[2], 4))
    for r, (doc, lang, share) in zip(sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert (r[0], r[1]) == (doc, lang) and abs(r[2] - share) < 1e-4, (r, lang, share)


def test_language_stage_drops_junk_and_keeps_text(spark):
    docs = rows()
    junk = [(10**6 + i, t, None, "s", 1) for i, t in enumerate(["xqzt vvkp zzxq kjhqw qqqq wxyz", "0x00 0xff e3b0c44298fc1c149afbf4c8996fb924", "日本語 の テキスト", "12 34", "", None])]
    kept = {r.doc_id for r in languages.keep(spark, frame(spark, docs + junk, clash=True), 0.5).collect()}
    assert max(kept) < 10**6 and len(kept) >= 0.99 * len(docs)  # 200 documents teach little


def test_rare_languages_keep_their_rows(spark):
    docs = [(i, f"alpha beta {i}", "en", "s", 1) for i in range(3000)] + [(10_000 + i, f"rara avis {i}", "la", "s", 1) for i in range(30)]
    n = {r["lang"]: r["count"] for r in languages.sample(frame(spark, docs), most=200).groupBy("lang").count().collect()}
    assert n["la"] == sum(zlib.crc32(str(10_000 + i).encode()) % 3 != 1 for i in range(30)) and 120 < n["en"] < 280


def test_op4_unseen_words_back_off(spark):
    docs = frame(spark, [(i, t, l, "s", 1) for i, (t, l) in enumerate([("strasse schule", "de"), ("street school", "en")] * 9)])
    model = languages.train(spark, docs)
    found = languages.predict(spark, frame(spark, [(1, "schulstrasse", None, None, 1), (2, "schoolstreet", None, None, 1)]), model).collect()
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)] == ["de", "en"]


@pytest.mark.parametrize("data", [rows, awkward, list])
def test_op7_against_brute_force(spark, tmp_path, data):
    docs = data()
    got = fingerprints.op7_fingerprints(spark, written(spark, docs, tmp_path, clash=True)).collect()
    order = sorted(((d[0], d[1] or "") for d in docs), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))

    def sketch(text):
        w = split(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    want = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), alike(sketch(text), sketch(changed)), alike(sketch(text), sketch(following))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(got, key=key)
    want.sort(key=key)
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want):
        assert abs(r.near_edited - w[3]) < 0.2 and abs(r.near_next - w[4]) < 0.2
    if got:
        assert np.mean([abs(r.near_edited - w[3]) for r, w in zip(got, want)]) < 0.03


def test_op7_sketches_merge():
    import pyarrow as pa

    text = " ".join(f"w{i * i % 9973}" for i in range(3000))
    whole, a, b = fingerprints.sketches(pa.array([text, text[:9000], text[8960:]]))
    assert abs(fingerprints.distinct(whole) - 2996) < 900
    assert abs(fingerprints.containment(a, whole) - 1) < 0.15
    assert list(fingerprints.from_text(fingerprints.to_text(whole))) == list(whole)
    assert fingerprints.to_text(whole[:0]) == ""
    merged = fingerprints.merge(a, b)
    assert fingerprints.resemblance(merged, whole) > 0.9


@pytest.mark.parametrize("data", [rows, awkward, list])
def test_op8_against_brute_force(spark, tmp_path, data):
    docs = data()
    got = media.op8_media(spark, written(spark, docs, tmp_path, clash=True)).collect()
    want = []
    for d in docs:
        raw = (d[1] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((d[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert len({r.payload_sha256 for r in got}) == len({r.media_sha256 for r in got}) == len({(r.payload_sha256, r.media_sha256, r.feature, r.tile) for r in got})


def test_media_formats():
    rng = np.random.default_rng(1)
    for shape in [(5, 7), (6, 3, 3), (1, 1), (9, 4, 3)]:
        image = rng.integers(0, 256, shape, np.uint8)
        assert (media.decode(media.encode_netpbm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2\n2 2\n15\n1 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P4\n9 1\n\x81\x80").tolist() == [[1, 0, 0, 0, 0, 0, 0, 1, 1]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_mean_of_areas():
    image = np.random.default_rng(2).integers(0, 256, (12, 18)).astype(np.uint8)
    assert np.allclose(media.resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean((1, 3)))
    assert np.allclose(media.resize(image, 24, 36), np.kron(image, np.ones((2, 2))))
    assert np.allclose(media.resize(image, 5, 7).mean(), image.mean())


def test_op10_matches_sql(spark):
    import duckdb

    want = duckdb.sql(mixing.OP10_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'")).fetchall()
    assert sorted(want) == sorted(map(tuple, mixing.op10_mix_sources(spark, SF).collect()))
