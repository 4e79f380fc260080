"""Words and lines with one hash are told apart by their bytes."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from lumora.llm import arrays, quality, wavelet
from lumora.llm.queries import tokenizer_path

A, B = b"xrmysowxvwkvfffh", b"vuakwveb_l~Cm){."  # one hash under the seed 0


def counts(text: bytes) -> tuple[int, int]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x.split()]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(lines) - len(set(lines)), len(hit)


def test_the_pair_has_one_hash():
    s = arrays.Slice([A + b" " + B])
    starts, ends, _ = s.words()
    h = s.hashes(starts, ends)
    assert h[0] == h[1] and s.numbers(starts, ends)[1].tolist() == [0, 1]


@pytest.mark.parametrize("constant", [False, True])
def test_counts_of_texts_with_one_hash(monkeypatch, constant):
    if constant:  # every word has the hash of every other
        monkeypatch.setattr(arrays.Slice, "hashes", lambda self, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    rng = random.Random(1)
    texts = [A + b"\n" + B, b" ".join([A, b"a", b"b", b"c", b"d", b"x", B, b"a", b"b", b"c", b"d", b"y"]), b"", b"\n\n"]
    texts += [re.sub(rb"  +", lambda m: rng.choice([b" ", b"\n"]), b"  ".join(rng.choices([A, B, b"a", b"bb"], k=rng.randint(0, 40)))) for _ in range(60)]
    out = quality.text_counts(arrays.Slice(texts))
    assert list(zip(out["n_dup_lines"].tolist(), out["n_repeat_words"].tolist())) == [counts(t) for t in texts]


@pytest.mark.parametrize("constant", [False, True])
def test_ids_of_words_with_one_hash(monkeypatch, constant):
    from tokenizers import Tokenizer

    path = tokenizer_path("word")
    if constant:
        monkeypatch.setattr(arrays.Slice, "hashes", lambda self, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    encoder, whole = wavelet.WordEncoder(path), Tokenizer.from_file(path)
    for texts in ([A + b" the " + B], [B + b" " + A, b"", b"the cat " + B], [A, b"the the dog", b"cat dog"]):  # known ones, new ones, both
        ids, sizes = wavelet.encode_texts(texts, encoder)
        want = [[*whole.encode(t.decode(), add_special_tokens=False).ids, wavelet.END_ID] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_spans_are_compared_whole():
    rng = random.Random(2)
    words = [bytes(rng.choices(b"ab", k=rng.choice((1, 7, 8, 9, 16, 17, 3000)))) for _ in range(200)]
    s = arrays.Slice([b" ".join(words)])
    starts, ends, _ = s.words()
    first, number, _ = s.numbers(starts, ends)
    assert [words[first[n]] for n in number] == words and len(first) == len(set(words))
    size = np.array([len(w) for w in words])
    other = np.array([rng.randrange(len(words)) for _ in words])
    alike = size[other] == size
    assert arrays.equal_spans(s.raw, starts[alike], s.raw, starts[other[alike]], size[alike]).tolist() == [words[i] == words[j] for i, j in enumerate(other) if alike[i]]


def test_a_large_model_gives_what_a_small_one_does(spark, monkeypatch):
    """Chunks ask for packed log-probabilities; no table holds a document's n-grams. Copies, nulls and empty texts included."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=40)), ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(100 + i, rows[0][1], "en") for i in range(40)] + [(None, None, "en"), (200, "", None), (200, "", None), (None, rows[1][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = quality.kneser_ney(quality.other_fold(docs.select("text", quality.fold_code(docs.lang, docs.text).alias("code")).mapInArrow(quality._count, "key long, n long").groupBy("key").sum("n").withColumnRenamed("sum(n)", "n")))
    names, write = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(quality, "MEET", 4)
    got = [sorted((r.doc_id or 0, r.k_text or "", r.lang or "", r.n_words, r.n_grams, r.nll) for r in quality.score(docs, model, "doc_id", "text", "lang", ("text",), limit, **more).collect()) for limit, more in ((10**9, {}), (0, {"chunk_bytes": 1500}))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert not names
