import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cliploom.llm import packing, rans, token_files, tokens  # noqa: E402

from .helpers import awkward, rows, written  # noqa: E402

NASTY = ["", None, "  a b", "a  b", "x\n\ny ", "tab\tx", "é b c", " lead", "trail ", "don't stop. it's 5,000.5 <|endoftext|> Ünïcode İSTANBUL ΣΑΣ Σ", "日本語 text。", "́x á.", "a\x1cb c\x85d e", "word.\nNext #### $$$ !!", "a" * 5000, "  ", "\n", "a\n b", "a \nb", "   x"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name):
    own = tokens.SegmentTokenizer(public_tokenizers.path(name))
    texts = NASTY + [r[1] for r in rows()]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):  # the second time all segments are known
        flat, count = own.encode(pa.array(texts, pa.string()))
        for text, ids in zip(texts, np.split(flat, np.cumsum(count)[:-1]), strict=True):
            assert list(ids) == whole.encode(text or "", add_special_tokens=False).ids


#: Characters and strings whose neighbourhood decides on ids.
DECIDING = list("aAbZ éÉßİıſΣς'’.,!?-_<|>\n\t\r\x0b\x1c\x1f\x85\xa0\u1680\u2000\u2009\u2028\u202f\u205f\u3000\u0327\u0301“”…日本語한0१²½😀")
DECIDING += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " the", "  ", "\n\n", " \u0301", "\u1112\u1161", "\n\xa0", "İ?"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_random_texts_equal_the_unchanged_library(name):
    rng, own = random.Random(11), tokens.SegmentTokenizer(public_tokenizers.path(name))
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(50):
        texts = ["".join(rng.choice(DECIDING) for _ in range(rng.randrange(24))) for _ in range(1000)]
        flat, count = own.encode(pa.array(texts, pa.string()))
        wanted = whole.encode_batch(texts, add_special_tokens=False)
        for text, ids, want in zip(texts, np.split(flat, np.cumsum(count)[:-1]), wanted, strict=True):
            assert ids.tolist() == want.ids, text


@pytest.mark.parametrize("n,kinds", [(0, 5), (1, 5), (7, 3), (5000, 300), (262_144 + 77, 3000)])
def test_rans_round_trip_checkpoints_and_damage(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.3, n) % kinds).astype(np.uint32)
    freq = rans.frequencies(np.bincount(ids, minlength=kinds))
    assert n == 0 or freq.sum() == rans.SCALE
    coder = rans.Table(freq)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    for k in range(1, len(block["places"])):
        assert (coder.decode(block, k) == ids[k * rans.EVERY * rans.LANES :]).all()
    if n > 1000:
        hurt = bytearray(block["payload"])
        hurt[5] ^= 1
        with pytest.raises(ValueError):
            coder.decode(block | {"payload": bytes(hurt)})


def plain(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("data", [rows, awkward, list])
def test_op3_against_brute_force(spark, tmp_path, data):
    docs = data()
    got = token_files.op3_token_files(spark, written(spark, docs, tmp_path, clash=True)).collect()
    encode, at, want = plain("word_bpe_49k.json", 2), 0, []
    coded = [(d[0], np.array(encode(d[1]), "<u4").tobytes()) for d in docs]
    for doc, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), np.frombuffer(x[1], "<u4").astype("<u2").tobytes())):
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


@pytest.mark.parametrize("data", [rows, awkward, list])
def test_op6_packs_everything_once(spark, tmp_path, data):
    docs = data()
    got = packing.op6_pack(spark, written(spark, docs, tmp_path, clash=True)).collect()
    encode, want = plain("byte_bpe_50k.json", 0), []
    for d in docs:
        ids = encode(d[1])
        n = -(-len(ids) // 2048)
        cuts = [0, *(len(ids) - 2048 * k for k in range(n - 1, -1, -1))]
        want += [(d[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in got), key=lambda x: (x[0] is None, x[0] or 0, x)) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x[3] for x in want)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1
    assert key is not None


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(1, 90))
        sums = {0}
        for k, v in counts.items():
            for _ in range(v):
                sums |= {s + k for s in sums if s + k <= room}
        found = packing.fullest(counts, room)
        assert sum(found) == max(sums)
        assert all(found.count(k) <= counts.get(k, 0) for k in found)


@pytest.mark.parametrize("capacity", [8, 40, 130])
def test_places_stay_within_their_bound(capacity):
    """The broadcast table of op6 is bounded by the sequence length, not by the corpus."""
    assert packing.most_places(2048) == 2048 * 63
    rng = random.Random(capacity)
    for most in (1, 5, 1000):
        counts = {length: rng.randint(1, most) for length in range(1, capacity + 1)}
        rows = packing.slots(packing.combinations(counts, capacity))
        assert sum(high - low for _, low, high, *_ in rows) == sum(counts.values())
        assert len(rows) <= packing.most_places(capacity)


def test_a_word_is_learnt_once(monkeypatch):
    """One part for a word in either case, after a blank or a line end and before marks; and none again in the worker's next task."""
    path, asked = public_tokenizers.path("word_bpe_49k.json"), []
    monkeypatch.setattr(tokens, "_CACHE", {})
    own = tokens.tokenizer(path)
    plain_letters = own._letters
    monkeypatch.setattr(own, "_letters", lambda text: asked.append(text) or plain_letters(text))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["Word word. the\nWORD!", "wOrd THE"])], ["doc_id", "text"])
    for _ in range(2):
        ((_, flat, count),) = tokens.token_batches([batch], path, 2, keep=True)
        want = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in batch.column("text").to_pylist()]
        assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == want
    assert sorted(asked) == ["the", "word"]


def test_a_kept_memory_is_bounded(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "_CACHE", {})
    monkeypatch.setattr(tokens, "KEPT", 50)
    for i in range(5):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(chr(97 + i) * (k + 1) for k in range(30))])], ["doc_id", "text"])
        list(tokens.token_batches([batch], path, 2, keep=True))
        assert len(tokens.tokenizer(path).known) <= 80
    list(tokens.token_batches([batch], path, 2))
    assert not tokens.tokenizer(path).known
