"""Licence scan: normalised text compared to notice templates by the Dice coefficient of word bigrams.

A text's units are its lines, its sentences, and runs of neighbouring sentences, which go on
over ends of lines: a wrapped notice or a licence text of many lines is one unit. A unit is
normalised to ASCII letters, in lower case, and digits between single blanks; its bigrams are
the distinct pairs of neighbouring words. Dice = 2 * common / (own + template's).

A unit with n bigrams can only reach the limit t with templates of t/(2-t) * n to (2-t)/t * n
bigrams, and only if it shares t/(2-t) of the template's. So all but that share of a template's
bigrams, and one more, are its anchors: a unit without one of them is passed over by hashes of
all pairs of words. A run has up to (2-t)/t times the template's pairs, repeated ones counted.
Everything happens within the row.

``n_units`` counts the distinct lines and sentences that reach the limit and the best runs
that share no sentence with one another and touch no line with such a unit. Long licences
(GPL, Apache, MPL, Creative Commons) are known by the opening passage of their text.

Null and empty texts have no unit: ``license`` is null, ``dice`` 0. Ties go to the first
template name. Rows may repeat; long texts are read whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .license_texts import WORDINGS

LIMIT = 0.8
#: Notices of one line, fixed values; longer ones and other wordings are in ``license_texts``.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under the Creative Commons CC0 1.0 Universal public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def bigrams(text: str) -> list[str]:
    words = re.sub(rb"[^a-z0-9]+", b" ", text.encode().lower()).decode().split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def units(line: str) -> set[str]:
    return {line, *re.sub("([.!?]) +", r"\1\n", line).split("\n")}


def best_template(own: set[str], shapes: list[tuple[str, set[str]]], limit: float) -> tuple[float, str] | None:
    """The smallest (-dice, name) that reaches the limit; only templates of fitting size are compared."""
    narrow, found = limit / (2 - limit), None
    for name, shape in shapes:
        if narrow * len(shape) <= len(own) <= len(shape) / narrow:
            dice = 2.0 * len(own & shape) / (len(own) + len(shape))
            if dice >= limit and (found is None or (-dice, name) < found):
                found = (-dice, name)
    return found


def _pair_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of neighbouring words of a text, the row and the first bytes of both words of each pair."""
    data, offsets = common.utf8(column)
    plain = np.where(_PLAIN[data], common._LOWER[data], 0x20).astype(np.uint8)
    words = common.Words(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(plain.tobytes())]))
    same = words.row[1:] == words.row[:-1]
    value = common.mix(words.hash[:-1] * common._BASE + words.hash[1:])
    return value[same], words.row[:-1][same], words.start[:-1][same], words.start[1:][same]


class Shape:
    """A template as hashes: its bigrams, anchors, how many a unit must share and how many pairs a run may have."""

    def __init__(self, name: str, text: str, limit: float):
        narrow = limit / (2 - limit)
        pairs = sorted(set(bigrams(text)), key=lambda p: (-len(p), p))
        self.name, self.n = name, len(pairs)
        self.need = math.ceil(narrow * self.n - 1e-9)
        value = _pair_hashes(pa.array(pairs))[0]
        self.all, self.anchors = np.sort(value), value[: self.n - self.need + 1]
        self.span = math.ceil(len(_pair_hashes(pa.array([text]))[0]) / narrow)


def runs(value: np.ndarray, first: np.ndarray, last: np.ndarray, shape: Shape, limit: float) -> list[tuple[float, str, int, int]]:
    """``-dice, name, i, j`` of runs of sentences i to j that reach the limit, the best one of each start.

    ``first`` and ``last`` are the sentences of both words of the pairs of a text. A best run
    starts with a sentence that holds a bigram of the template.
    """
    hits = np.flatnonzero(np.isin(value, shape.all))
    if len(hits) < shape.need:
        return []
    dense = hits[shape.need - 1 :] - hits[: len(hits) - shape.need + 1] < shape.span
    found, known = [], set(shape.all.tolist())
    if not dense.any():
        return []
    for i in np.unique(first[hits]).tolist():
        k0 = int(np.searchsorted(first, i))
        k1 = min(k0 + shape.span, len(value))
        if np.searchsorted(hits, k1) - np.searchsorted(hits, k0) < shape.need:
            continue
        own, both, to, best = set(), 0, i, None

        def close():
            if to > i and own and (dice := 2.0 * both / (len(own) + shape.n)) >= limit and (best is None or -dice < best[0]):
                return (-dice, shape.name, i, to)
            return best

        for v, j in zip(value[k0:k1].tolist(), last[k0:k1].tolist(), strict=True):
            if j > to:
                best = close()
                to = j
            if v not in own:
                own.add(v)
                both += v in known
        if k1 == len(value) or last[k1] > to:
            best = close()
        if best:
            found.append(best)
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, limit: float = LIMIT) -> DataFrame:
    """``doc_id, license, dice, n_units``: the best template, its coefficient, the units that reach the limit.

    Only texts that hold an anchor of a template are looked at.
    """
    texts = sorted((templates or TEMPLATES).items()) + ([] if templates else sorted(WORDINGS))
    texts = [(name, text) for name, text in texts if bigrams(text)]

    def run(batches):
        shapes = [(name, set(bigrams(text))) for name, text in texts]
        hashed = [Shape(name, text, limit) for name, text in texts]
        wanted = np.unique(np.concatenate([s.anchors for s in hashed])) if hashed else np.zeros(0, np.uint64)
        holders: dict[int, list[int]] = {}
        for t, s in enumerate(hashed):
            for v in s.anchors.tolist():
                holders.setdefault(v, []).append(t)
        for batch in batches:
            for part in common.pieces(batch, "text"):
                value, row, start, second = _pair_hashes(part.column("text"))
                hit = np.isin(value, wanted)
                data, offsets = common.utf8(part.column("text"))
                raw, ends = data.tobytes(), offsets.tolist()
                lines: dict[int, set[tuple[int, int]]] = {}
                held: dict[int, set[int]] = {}
                for r, at, v in zip(row[hit].tolist(), start[hit].tolist(), value[hit].tolist(), strict=True):
                    a = raw.rfind(b"\n", ends[r], at) + 1
                    b = raw.find(b"\n", at, ends[r + 1])
                    lines.setdefault(r, set()).add((a or ends[r], ends[r + 1] if b < 0 else b))
                    held.setdefault(r, set()).update(holders[v])
                names, dices, counts = [None] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                for r, places in lines.items():
                    found, taken = {}, []
                    for a, b in places:
                        here = {u: x for u in units(raw[a:b].decode()) if (x := best_template(set(bigrams(u)), shapes, limit))}
                        found |= here
                        taken += [(a, b)] if here else []
                    results, many = list(found.values()), len(found)
                    lo, hi = np.searchsorted(row, [r, r + 1])
                    cuts = [m.end() + ends[r] for m in re.finditer(rb"\n|(?<=[.!?]) +", raw[ends[r] : ends[r + 1]])]
                    if cuts:
                        first, last = (np.searchsorted(cuts, x[lo:hi], side="right") for x in (start, second))
                        longer = sorted(x for t in sorted(held[r]) for x in runs(value[lo:hi], first, last, hashed[t], limit))
                        borders = [ends[r], *cuts, ends[r + 1]]
                        results += [x[:2] for x in longer]
                        seen = set()
                        for _, _, i, j in longer:
                            a, b = borders[i], borders[j + 1]
                            if not any(a < y and x < b for x, y in taken):
                                taken.append((a, b))
                                seen.add(raw[a:b].strip())
                        many += len(seen)
                    if results:
                        best = min(results)
                        names[r], dices[r], counts[r] = best[1], -best[0], many
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(dices), pa.array(counts)], ["doc_id", "license", "dice", "n_units"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, n_units long")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


_ROWS = ",\n".join(f"('{name}', {len(bigrams(text))}, {bigrams(text)!r})" for name, text in sorted(TEMPLATES.items()))
OP5_SQL = f"""
WITH templates(name, n, pairs) AS (VALUES {_ROWS}),
units AS (
  SELECT doc_id, unnest(list_distinct(list_concat(string_split(COALESCE(text, ''), chr(10)),
         string_split(regexp_replace(COALESCE(text, ''), '([.!?]) +', '\\1' || chr(10), 'g'), chr(10))))) AS unit FROM documents),
words AS (SELECT doc_id, unit, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
owned AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS p FROM words WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, unit, name, 2.0::DOUBLE * len(list_intersect(p, pairs)) / (len(p) + n) AS dice FROM owned, templates
  WHERE len(p) BETWEEN n * {LIMIT / (2 - LIMIT)} AND n / {LIMIT / (2 - LIMIT)}),
hits AS (SELECT doc_id, unit, dice, name FROM scored WHERE dice >= {LIMIT}),
best AS (
  SELECT doc_id, COUNT(DISTINCT unit) AS n_units, arg_min(name, (-dice, name)) AS license, MAX(dice) AS dice FROM hits GROUP BY doc_id)
SELECT d.doc_id, license, COALESCE(dice, 0.0) AS dice, COALESCE(n_units, 0) AS n_units FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""
