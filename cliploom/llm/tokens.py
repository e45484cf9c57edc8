"""Token ids of whole texts by the tokenizers library, each distinct stretch of text encoded once per worker.

A text is cut before every run of ASCII white space that follows a character which is no
white space. Both supported vocabularies end a token there whatever surrounds it: neither's
splitting pattern crosses from a character into white space after it, a normaliser changes
nothing across that place, and no special string holds white space. So the ids of a text are
those of its segments in order. Segments are told apart by their bytes, and only those that a
worker has not met yet reach the library. Texts of any length are cut in this way; a segment
without white space goes to the library as it is.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Segments and ids kept per worker; beyond either the memory starts afresh. The second figures are those of
#: a worker that keeps its memory from task to task, about 270 MB.
MEMORY, MEMORY_IDS = 400_000, 1 << 21
KEPT, KEPT_IDS = 1_000_000, 1 << 22
#: Text bytes that are encoded in one go.
PIECE = 3 << 20
#: Letters of one character in every normal form and either case, after at most one blank; and
#: one line end before or ASCII punctuation after them, which every supported pattern parts
#: from letters.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]"
_CORE = re.compile(f"(\n?)((?: (?<!\n ))?{_LETTER}+)([.,!?;:()*#%&$/-]*)")
#: The byte level shows the printable bytes as themselves, the others as characters from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Does a white space character that is not ASCII, or a separator from 1C to 1F, end before ``at``."""
    last = data[np.maximum(at - 1, 0)]
    found = (last >= 0x1C) & (last <= 0x1F)
    wide = np.flatnonzero((last >= 0x80) & (at >= 2))
    a, b, c = last[wide], data[at[wide] - 2], np.where(at[wide] >= 3, data[at[wide] - 3], 0)
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (c == 0xE2) & (((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
    other = ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    found[wide] = two | general | other
    return found


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the segments of some texts begin; none crosses from one text into the next."""
    space = common._SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    at = np.flatnonzero(cut)
    cut[at[_after_space(data, at)]] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class SegmentTokenizer:
    """``special_as_text``: strings of special tokens in a text are ordinary text instead of those tokens."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.most, self.most_ids = MEMORY, MEMORY_IDS
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts: dict[str, bytes] = {}
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, text: str) -> bytes:
        """Ids of letters after at most one blank: a single pre-token, in the spelling of the byte level."""
        spelled = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(_SPELLED)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _part(self, text: str) -> bytes:
        """Ids as 32-bit numbers, which the garbage collector need not look at."""
        ids = self.parts.get(text)
        if ids is None:
            letters = text[-1].isalpha()
            ids = self.parts[text] = self._letters(text) if letters else array("I", self.whole(text)).tobytes()
        return ids

    def _encoded(self, raws: list[bytes]) -> list[bytes]:
        found: list = [None] * len(raws)
        rest = []
        for i, raw in enumerate(raws):
            text = raw.decode()
            m = _CORE.fullmatch(text)
            if not m:
                rest.append((i, text))
                continue
            line, letters, marks = m.groups()
            if self.lower:  # one part for a word in either case, after a blank or not
                letters = letters.lstrip(" ").lower()
            ids = self._part(letters)
            if line:
                ids = self._part(line) + ids
            found[i] = ids + self._part(marks) if marks else ids
        coded = self.tokenizer.encode_batch_fast([x for _, x in rest], add_special_tokens=False)
        for (i, _), x in zip(rest, coded, strict=True):
            found[i] = array("I", x.ids).tobytes()
        return found

    def _learn(self, raws: list[bytes]) -> None:
        ids = self._encoded(raws)
        n, at = len(self.known), self.used
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        need = at + int(sizes.sum())
        while need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(ids) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.size[n : n + len(ids)] = sizes
        self.begin[n : n + len(ids)] = at + np.cumsum(sizes) - sizes
        self.pool[at:need] = np.frombuffer(b"".join(ids), np.uint32)
        self.used = need
        self.known.update(zip(raws, range(n, n + len(ids)), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and their number for each row."""
        if max(len(self.known), len(self.parts)) > self.most or self.used > self.most_ids:
            self._clear()
        data, offsets = common.utf8(column)
        start = segments(data, offsets)
        bounds = np.append(start, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        found, places = common.utf8(coded.dictionary)
        held = found.tobytes()
        raws = [held[a:b] for a, b in pairwise(places.tolist())]
        at = [self.known.get(raw, -1) for raw in raws]
        new = [i for i, k in enumerate(at) if k < 0]
        if new:
            n = len(self.known)
            self._learn([raws[i] for i in new])
            for k, i in enumerate(new, n):
                at[i] = k
        entry = np.array(at, np.int64)[coded.indices.to_numpy()]
        size = self.size[entry]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.arange(total) + np.repeat(self.begin[entry] - (ends - size), size)]
        filled = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        return flat, np.diff(filled)


_CACHE: dict[tuple[str, bool], SegmentTokenizer] = {}


def tokenizer(path: str, special_as_text: bool = False) -> SegmentTokenizer:
    """This worker's tokenizer for the vocabulary at ``path``, a file present on every machine; one at a time is kept."""
    key = (path, special_as_text)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = SegmentTokenizer(*key)
    return _CACHE[key]


def token_batches(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, special_as_text: bool = False, keep: bool = False
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the input with their ids; every document's ids close with ``end_id``.

    With ``keep`` the worker still knows its segments in its next task, for more memory.
    """
    own = tokenizer(path, special_as_text)
    own.most, own.most_ids = (KEPT, KEPT_IDS) if keep else (MEMORY, MEMORY_IDS)
    for batch in batches:
        for part in common.pieces(batch, "text", PIECE):
            flat, count = own.encode(part.column("text"))
            ends = np.cumsum(count)
            yield part, np.insert(flat, ends, np.uint32(end_id)), count + 1
    if not keep:
        own._clear()  # an idle worker remembers no segments


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids``, little-endian 32-bit ids as binary."""

    def run(batches):
        for part, flat, count in token_batches(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), common.blobs(flat.astype("<u4"), count)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")
