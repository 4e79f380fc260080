"""Licence scans against a plain computation of the cosines, and against notices and files as they are found."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from lumora.llm import license_texts as W
from lumora.llm import licenses

KINDS = [
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("/* SPDX-License-Identifier: MIT */", "MIT"), ("SPDX-License-Identifier: WTFPL", None), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    (W._GNU.format("program", "", 2), "GPL-2.0"), (W._GNU.format("program", "Affero", 3), "AGPL-3.0"), (W._GNU.format("library", "Lesser", 2.1), "LGPL-2.1"), (W._BSD_TWO + W._BSD_END, "BSD-2-Clause"),
    (W._BSD_TWO + W._BSD_THIRD + W._BSD_END, "BSD-3-Clause"), (W._ISC, "ISC"), (W._UNLICENSE, "Unlicense"), ("Creative Commons Attribution 4.0", "CC-BY-4.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + "and so on " * 300, "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n" + "and much more " * 300, "GPL-3.0"), (W._MIT + W._MIT_REST + W._WARRANTY, "MIT"), ("A licence to fish is sold in the public domain.", None),
]


@pytest.mark.parametrize("number", range(len(KINDS)))
def test_kinds(number):
    text, expect = KINDS[number]
    matcher = licenses.Matcher(dict.fromkeys(licenses.VOCABULARY, 0), 1000)
    score, name = max((matcher.best(c) for c in licenses.candidates(text.encode())), key=lambda x: x[0], default=(0, None))
    assert (name if score >= 0.6 else None) == expect, (score, name)


EXPRESSIONS = [
    ("MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("(MIT OR Apache-2.0) AND BSD-3-Clause", "(MIT OR Apache-2.0) AND BSD-3-Clause"), ("GPL-2.0-only with Classpath-exception-2.0 OR EPL-2.0 */", "GPL-2.0 WITH Classpath-exception-2.0 OR EPL-2.0"),
    ("MIT and see the notes", "MIT"), ("BSL-1.0 -->", "BSL-1.0"), ("MIT OR", "MIT"), ("0BSD", "0BSD"),
]


@pytest.mark.parametrize(("tag", "expect"), EXPRESSIONS)
def test_tags_of_several_licences(tag, expect):
    matcher = licenses.Matcher(dict.fromkeys(licenses.VOCABULARY, 0), 1000)
    text = f"/* SPDX-License-Identifier: {tag}\n * code follows".encode()
    score, name = max((matcher.best(c) for c in licenses.candidates(text)), key=lambda x: x[0])
    assert name == expect and 0.6 <= score <= 1.000000001


def test_candidates_are_whole_texts_lines_and_paragraphs():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["\n", "\n\n", "license ", "dog ", "spdx", " cat"], k=rng.randint(0, 14))).encode()
        hit = [x for x in [text, *text.split(b"\n"), *re.split(rb"\n\n+", text)] if licenses.TRIGGER.search(x)]
        assert {c.strip(b"\n") for c in licenses.candidates(text)} == {x.strip(b"\n") for x in hit}, text


def test_candidates_of_a_long_paragraph_stay_linear():
    for text in (b"a license of this line\n" * 20_000, b"one license\n\n" * 20_000, b"license " * 50_000):
        assert sum(map(len, licenses.candidates(text))) <= 3 * len(text)


def plain_terms(text):
    words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())
    return Counter(words) + Counter(" ".join(x) for x in zip(words, words[1:]))


def test_cosines_are_those_of_tf_idf(spark):
    """Document frequencies, cosines, ties between files of a folder and very long texts, recomputed from the definition."""
    rng = random.Random(7)
    vocab = ["free", "license", "software", "the", "of", "under", "2.0", "mit", "gnu", "public", "x1", "dog", "(the", "cat,", "version", "3"]
    rows = [(i, f"d{i % 4}/f{i}.txt", "\n".join(" ".join(rng.choices(vocab, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(100 + i, f"d1/{n}", "Released under the MIT License") for i, n in enumerate(("LICENSE", "COPYING", "b.py", "LICENSE.md"))]
    rows += [(200, "d2/LICENSE", ("dog cat " * 200_000) + "\n\nLicensed under the Apache License, Version 2.0\n\n" + "x " * 200_000), (201, "d3/x", None), (202, "d3/y", "")]
    n = len(rows)
    df = Counter(t for r in rows for t in plain_terms(r[2] or ""))
    known = {t for *_, text in W.TEMPLATES for t in plain_terms(text)}
    weigh = lambda text: {t: c * (math.log((n + 1) / ((df[t] if t in known else 0) + 1)) + 1) for t, c in plain_terms(text).items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    templates = [(name, must, bar, weigh(text)) for name, must, bar, text in W.TEMPLATES]

    def best(text):
        out = (0.0, 0, None)
        for c in licenses.candidates(text.encode()):
            w = weigh(c.decode())
            for i, (name, must, bar, x) in enumerate(templates):
                if all(t in w for t in must) and not any(t in w for t in bar):
                    score = round(sum(v * x.get(t, 0) for t, v in w.items()) / (norm(w) * norm(x)), 9)
                    if score > out[0]:
                        out = (score, i, name)
        return (out[0], out[2]) if out[0] >= 0.6 else (None, None)

    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, _, text in rows:
        score, name = best(text or "")
        assert (got[i].score is None) == (score is None) and (score is None or math.isclose(got[i].score, score, abs_tol=2e-9))
        if score is not None:
            assert got[i].license == name
    assert got[200].license == "Apache-2.0" and got[200].origin == "file"
    inherited = [got[i] for i, path, _ in rows if path.startswith("d1/") and got[i].origin == "inherited"]
    assert inherited and {(r.license, r.from_path) for r in inherited} == {("MIT", "d1/COPYING")}


def test_hot_folder_is_salted(spark, monkeypatch):
    rows = [(i, f"hot/{i}.py", "code") for i in range(300)] + [(1000, "LICENSE", "Released under the MIT License"), (1001, "other/x.py", "y")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    whole = sorted(tuple(r) for r in licenses.scan(df).collect())
    monkeypatch.setattr(licenses, "BROADCAST_FOLDERS", 0)
    assert whole == sorted(tuple(r) for r in licenses.scan(df).collect()) and sum(r[2] == "MIT" for r in whole) == 302
