import random

import duckdb
import pytest

import corpus_pipeline
from cliploom.llm import common, languages, licenses, mixing, packing, personal

from .helpers import INSIDE, SF, awkward, frame, rows, written
from .test_near_and_personal import expected


def scanned(text, limit=licenses.LIMIT):
    import re

    lines = (text or "").split("\n")
    units = set(lines) | set(re.sub("([.!?]) +", r"\1\n", text or "").split("\n"))
    hits = {}
    for u in units:
        own = set(licenses.bigrams(u))
        for name, template in licenses.TEMPLATES.items():
            t = set(licenses.bigrams(template))
            if own and (d := 2 * len(own & t) / (len(own) + len(t))) >= limit:
                hits.setdefault(u, []).append((-d, name))
    best = min((x for v in hits.values() for x in v), default=(0, None))
    return best[1], -best[0], len(hits)


@pytest.mark.parametrize("data", [rows, awkward, list])
def test_op5_against_brute_force(spark, tmp_path, data):
    docs = data()
    rng = random.Random(1)
    notices = list(licenses.TEMPLATES.values())
    docs += [(5000 + i, rng.choice(["", "x y. ", "intro\n"]) + " ".join(w for w in rng.choice(notices).split() if rng.random() > 0.1), "en", "s", 1) for i in range(80)]
    got = licenses.op5_licenses(spark, written(spark, docs, tmp_path, clash=True)).collect()
    assert len(got) == len(docs)
    want = {}
    for d in docs:
        want.setdefault(d[0], set()).add(scanned(d[1])[:2])
    for r in got:
        assert (r.license, r.dice) in want[r.doc_id]


def test_op5_matches_sql(spark):
    want = duckdb.sql(licenses.OP5_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'")).fetchall()
    assert sorted(want) == sorted(map(tuple, licenses.op5_licenses(spark, SF).collect()))


@pytest.mark.parametrize("data", [rows, awkward, list], ids=["rows", "awkward", "empty"])
def test_pipeline_stages(spark, data):
    """Every stage on all that the one before kept, against plain loops over its own input."""
    docs = frame(spark, data(), clash=True)
    scratch = common.Scratch(spark, "test")
    outputs = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        outputs.append(scratch.save(stage(spark, outputs[-1], SF), f"s{i}"))
        assert i == 4 or outputs[-1].columns == docs.columns
    start, kept, single, clean, mixed, packed = [x.collect() for x in outputs]
    assert all(r[x] == f"{x}!" for x in INSIDE for table in (kept, single, clean, mixed) for r in table)
    assert all(r.range == 2 and r.word == "w" for r in mixed)
    plain = docs.select("doc_id", "text")
    guessed = {(r.doc_id, r.text): r for r in languages.predict(spark, plain, languages.train(spark, docs)).collect()}
    assert sorted(map(str, kept)) == sorted(str(r) for r in start if (g := guessed[r.doc_id, r.text]).lang_pred != "und" and g.score >= corpus_pipeline.LEAST_SCORE)
    component = expected([tuple(r) for r in kept], 5)
    assert sorted(map(str, single)) == sorted(str(r) for r in kept if r.doc_id is None or component[r.doc_id] == r.doc_id)
    assert len(clean) == len(single)
    assert not any(personal_left(r.text) for r in clean)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and len(mixed) >= 0.5 * len(clean)
    assert {str(r) for r in mixed} <= {str(r) for r in clean}
    assert sorted({r.doc_id for r in packed}, key=str) == sorted({r.doc_id for r in mixed}, key=str)
    assert sum(r.piece == 0 for r in packed) == len(mixed)
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values(), default=0) <= packing.SEQUENCE
    assert mixing.SEED and personal.KINDS


def personal_left(text):
    from .test_near_and_personal import base

    return base(text)


def test_op5_finds_usual_wordings_wrapped_notices_and_texts(spark):
    import textwrap

    from cliploom.llm.license_texts import WORDINGS

    apache = next(t for n, t in WORDINGS if n == "Apache-2.0" and t.startswith("Licensed under") and "Unless" in t)
    mit = max((t for n, t in WORDINGS if n == "MIT"), key=len)
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    prose = "\n".join("the rights of the river and the use of a boat in spring" for _ in range(30))
    cases = [
        ("MIT", "Licensed under the MIT License."),
        ("MIT", "This project is licensed under the MIT License."),
        ("MIT", f"Copyright (c) 2020 A B\n\n{textwrap.fill(mit, 60)}\n\nimport os"),
        ("GPL-3.0", f"#!/bin/sh\n\n{gpl}\n\n{prose}"),
        ("Apache-2.0", f"{prose}\n" + "\n".join(f"// {x}" for x in textwrap.wrap(apache, 40))),
        ("Apache-2.0", "a note. Licensed under the Apache License,\nVersion 2.0. And more follows here"),
        (None, prose),
        (None, "one two\n" * 20_000),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].license for i in range(len(cases))] == [n for n, _ in cases]
    assert [got[i].n_units for i in (2, 3, 6)] == [1, 1, 0]


def test_op5_runs_against_all_runs():
    import re

    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    text = "Licensed under the Apache License, Version 2.0. You may obtain a copy of the License there."
    shape = licenses.Shape("x", text, licenses.LIMIT)
    for _ in range(200):
        parts = [" ".join(w for w in rng.sample(["river boat"] * 3 + [text], 1)[0].split() if rng.random() > 0.05) for _ in range(3)]
        words = " ".join(parts).split()
        lines = "".join(w + rng.choice(["\n", " ", " ", " "]) for w in words).strip().split("\n")
        found, t = [], set(licenses.bigrams(text))
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                joined = " ".join(lines[i : j + 1])
                own = set(licenses.bigrams(joined))
                fits = len(re.findall("[A-Za-z0-9]+", joined)) - 1 <= shape.span
                if own and fits and (d := 2 * len(own & t) / (len(own) + len(t))) >= licenses.LIMIT:
                    found.append((-d, i == j))
        whole = "\n".join(lines)
        value, _, start, second = licenses._pair_hashes(pa.array([whole]))
        cuts = [i + 1 for i, c in enumerate(whole) if c == "\n"]
        got = licenses.runs(value, np.searchsorted(cuts, start, side="right"), np.searchsorted(cuts, second, side="right"), shape, licenses.LIMIT)
        alone = [d for d, single in found if single]
        assert min([*alone, *(x[0] for x in got)], default=0) == min((d for d, _ in found), default=0)
        assert {x[0] for x in got} <= {d for d, _ in found}
