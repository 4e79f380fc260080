"""Each operator against a brute-force version on small tables with null, empty, long, repeated and clashing input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lumora.llm import arrays, embed_graph, licenses, mixing, plan, quality, segsample, simhash, substring, suffix, url_filter, wavelet
from lumora.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choices(vocab, k=n))

    shared, copy = prose(120), prose(200)
    texts = [prose(rng.randint(5, 300)) for _ in range(40)]
    texts += [f"{prose(50)} {shared}\n{prose(60)}" for _ in range(6)]
    texts += [copy] * 4 + [copy + " end", copy.replace(vocab[0], "zzz")]
    texts += [None, "", " \n\t ", "one", "日本語 text\x00 with nul", "x" * 5000, f"{shared} {shared}", "spam " * 400]
    texts += ["line one of it\nline one of it\n\nline two # here\nline one of it"]
    texts += [prose(20000)]
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["b", "a", None, "ä"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, texts[7], "en", "a", 0))
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """Extra columns named like those the operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("chunk", "fp", "key", "n_words", "kept", "id", "path", "bucket", "data", "component_id", "sample", "ids", "code", "size", "vec", "rule", "host")})


def text_hash(text):
    """Spark's xxhash64 of a text, unsigned."""
    return 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)


def ordered():
    return sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]) >> 32, r[1] is not None, (r[1] or "").encode()))


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_quality(spark, docs, empty):
    out = quality.quality(clash(docs)).collect()
    assert len(out) == len(ROWS)
    expect = Counter()
    for doc_id, text, *_ in ROWS:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        expect[(doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed)] += 1
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == expect
    assert all(not (r.kept and r.base_failed) for r in out)
    assert quality.quality(empty).count() == 0


def brute_kneser_ney(rows, order=quality.ORDER):
    """Mean negative log-probability of each text, from the definition, by the distinct texts of the other fold."""
    seen = {o: {} for o in range(1, order + 1)}
    fold = lambda text: text_hash(text) >> 17 & 1
    for text, lang in {(r[1], (r[2], fold(r[1]))) for r in rows}:
        data = b"\n" * (order - 1) + (text or "").encode() + b"\n"
        for i in range(len(data) - order + 1):
            c = seen[order].setdefault(lang, Counter())
            c[data[i : i + order]] += 1
    for o in range(order - 1, 0, -1):
        for lang, c in seen[o + 1].items():
            seen[o][lang] = Counter(g[1:] for g in c)
    cuts = {}
    for o in seen:
        for lang, c in seen[o].items():
            n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
            if min(n) > 0:
                y = n[0] / (n[0] + 2 * n[1])
                cuts[o, lang] = [max(0.05, min(k - 0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
            else:
                cuts[o, lang] = [min(0.75 * k, 1.5) for k in (1, 2, 3)]
    histories = {}
    for o in seen:
        for lang, c in seen[o].items():
            for g, n in c.items():
                cut = min(cuts[o, lang][min(n, 3) - 1], 0.95 * n)
                h = histories.setdefault((o, lang, g[:-1]), [0, 0.0])
                h[0] += n
                h[1] += cut

    def p(o, lang, g):
        if o == 0:
            return 1 / 256
        if (o, lang, g[:-1]) not in histories:
            return p(o - 1, lang, g[1:])
        n = seen[o][lang].get(g, 0)
        all_, freed = histories[o, lang, g[:-1]]
        return (n - min(cuts[o, lang][min(n, 3) - 1], 0.95 * n) + freed * p(o - 1, lang, g[1:])) / all_

    out = []
    for doc_id, text, lang, *_ in rows:
        data = b"\n" * (order - 1) + (text or "").encode() + b"\n"
        grams = [data[i : i + order] for i in range(len(data) - order + 1)]
        out.append((doc_id, -sum(math.log(p(order, (lang, 1 - fold(text)), g)) for g in grams) / len(grams)))
    return out


def test_perplexity_is_modified_kneser_ney(spark):
    rows = [r for r in ROWS if len(r[1] or "") < 1500]
    docs = spark.createDataFrame(rows, SCHEMA)
    expect = sorted((i if i is not None else -1, round(x, 4)) for i, x in brute_kneser_ney(rows))
    for limit in (4_000_000, 0):  # the sorted arrays and the join
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.nll) for r in quality.quality(docs, broadcast_rows=limit).collect())
        assert [i for i, _ in got] == [i for i, _ in expect]
        assert np.allclose([x for _, x in got], [x for _, x in expect], atol=2e-3)


def test_bands_reject_both_ends(spark):
    """Noise of rare characters above, counting below; a clean text stays however often it is copied."""
    rng = random.Random(1)
    words = ["".join(rng.choices("aeioubcdfgklmnprst", k=rng.randint(2, 7))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=80)), "en", "a", 0) for i in range(200)]
    copies = [(300 + i, rows[0][1], "en", "a", 0) for i in range(150)]
    printable = "".join(chr(c) for c in range(33, 127))
    high = [(1000 + i, " ".join("".join(rng.choices(printable, k=8)) for _ in range(60)), "en", "a", 0) for i in range(10)]
    high += [(1100 + i, " ".join("%x" % rng.getrandbits(64) for _ in range(60)), "en", "a", 0) for i in range(10)]
    low = [(2000 + i, " ".join("a" * (10 * i + k) for k in range(8, 24)), "en", "a", 0) for i in range(10)]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows + copies + high + low, SCHEMA)).collect()}
    assert all(kept[r[0]] for r in rows + copies)
    assert not any(kept[r[0]] for r in high + low)


def test_substring_dedup(docs, empty):
    seen, expect = set(), Counter()
    for doc_id, text, *_ in ordered():
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        expect[(doc_id, len(words), len(gone), kept)] += 1
    for size in (16 << 20, 4000):
        out = substring.dedup_substrings(clash(docs), chunk_bytes=size)
        assert counted(out.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == expect
    assert sum(k[2] * n for k, n in expect.items()) > 1000
    assert substring.dedup_substrings(empty).count() == 0


def test_one_chunk_and_many(docs):
    """A few chunks, and so many that the exchange has two levels."""
    assert plan.in_chunks(docs, "doc_id", "text", (), 100)[1] > 256
    seen = []
    for size in (16 << 20, 20_000, 100):
        cut = counted(substring.dedup_substrings(docs, chunk_bytes=size).select("doc_id", "kept_text").collect())
        tokens = counted(wavelet.read_files(wavelet.write_files(docs, tokenizer_path("word"), chunk_bytes=size)).collect())
        rest = counted(suffix.dedup_suffixes(docs, chunk_bytes=size).select("doc_id", "kept_bytes").collect())
        seen.append((cut, tokens, rest))
    assert seen[0] == seen[1] == seen[2]


def test_chunks_follow_ids_and_split_hot_ones(spark):
    rows = [(7 if i % 3 else i, "word %d " % i * 20) for i in range(3000)] + [(None, "x%d " % i * 20) for i in range(500)]
    dealt, n = plan.in_chunks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", (), 10_000)
    held = {}
    for r in dealt.collect():
        held.setdefault(r[plan.CHUNK], []).append((r.doc_id is not None, r.doc_id or 0, (r[plan.TIE] % 2**64) >> 32, len(r.text)))
    assert sum(map(len, held.values())) == 3500 and len(held) > 20 and max(held) < n
    assert max(sum(x[3] for x in v) for v in held.values()) < 40_000
    ordered = sorted(held)
    assert all(max(held[a])[:3] <= min(held[b])[:3] for a, b in zip(ordered, ordered[1:]))


def test_hot_groups_are_split(spark, monkeypatch):
    """One passage in many contexts: split to pieces, and to windows, with the result of brute force."""
    rng = random.Random(4)
    common = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    rows = []
    for i in range(60):
        left, right = ("".join(rng.choices("abcdefgh ", k=rng.randint(0, 150))) for _ in range(2))
        cut = rng.randint(0, 60) if i % 2 else 0
        rows.append((i, left + common[cut:] + right))
    length = 100
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    expect = {}
    for i, t in rows:
        gone = set()
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone.update(range(k, k + length))
        expect[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (256, 3, 1):
        monkeypatch.setattr(suffix, "MOST", most)
        decide = lambda r, most=most: suffix_decide(r, most)
        monkeypatch.setattr(suffix, "QUESTION", suffix.Question(suffix._RECORD, decide, suffix.QUESTION.hand_on))
        out = suffix.dedup_suffixes(df, length=length, chunk_bytes=1500).collect()
        assert {r.doc_id: r.kept_bytes.decode() for r in out} == expect


def suffix_decide(records, most):
    """suffix._decide with a threshold that reaches the workers."""
    key = records["key"]
    group = np.cumsum(np.concatenate((np.zeros(min(1, len(key)), bool), key[1:] != key[:-1])))
    size = np.bincount(group, minlength=1)[group]
    return np.where(records["many"] > 0, suffix.REMOVE, 0) | np.where(size > most, suffix.SPLIT, np.where(size > 1, suffix.SEND, 0))


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_strings_that_collide_are_not_equal(spark):
    """Thue-Morse strings have one polynomial hash modulo 2**64 under every base; they differ, so nothing goes."""
    t = thue_morse(2048)
    bits, other = bytes(97 + x for x in t), bytes(98 - x for x in t)
    total = [sum((c + 1) * pow(arrays.BASE, i, 2**64) for i, c in enumerate(x)) % 2**64 for x in (bits, other)]
    assert total[0] == total[1] and bits != other
    rng = random.Random(3)
    edge = ["".join(rng.choices("cdefghij", k=600)) for _ in range(2)]
    texts = [edge[0] + x.decode() + edge[1] for x in (bits, other)]
    seen = Counter(x[k : k + 2100] for x in texts for k in range(len(x) - 2099))
    assert max(seen.values()) == 1
    out = suffix.dedup_suffixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=2100).collect()
    assert [r.n_removed for r in out] == [0, 0]
    a = suffix.SuffixArray([x.encode() for x in texts], 2100)
    assert not (a.prefix >= 2100).any()
    words = [" ".join(["x"] + ["ab"[c] for c in thue] + ["y"]) for thue in (t, [1 - c for c in t])]
    cut = substring.dedup_substrings(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), width=2050).collect()
    assert [r.n_removed for r in cut] == [0, 0]


def test_kept_words_as_they_stood(spark):
    same = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "one\n" + same), (2, "a  b\n\n" + same + "\nc\td"), (3, None), (4, " x \n y ")]
    out = {r.doc_id: r.kept_text for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), layout=True).collect()}
    assert out == {1: rows[0][1], 2: "a  b\nc\td", 3: "", 4: " x \n y "}


def unit_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    near = x[:1] + 0.05 * rng.normal(size=(80, 16))
    chain = np.stack([np.cos(np.arange(8) * 0.25)[:, None] * x[5] / np.linalg.norm(x[5]) + np.sin(np.arange(8) * 0.25)[:, None] * np.eye(16)[3]]).reshape(8, 16)
    return [list(map(float, v)) for v in np.concatenate((x, near, chain, x[10:14], x[10:11], x[10:11]))]


def test_embeddings(spark):
    vectors = unit_vectors()
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(None, vectors[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(x))]
    expect = {(i, int(hit[i].sum()), root[i], root[i] == i) for i in range(len(x))} | {(1000 + i, 0, 1000 + i, True) for i in range(len(bad))} | {(None, 0, None, True)}
    out = embed_graph.near_duplicates(clash(df), shard_size=120)
    assert {tuple(r)[:4] for r in out.collect()} == expect
    assert embed_graph.near_duplicates(spark.createDataFrame([], df.schema)).count() == 0


def test_embeddings_near_the_threshold(spark):
    """Groups whose cosines lie around 0.95, a hot cluster, two lengths: links are found from both sides, recall is reported."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(250, 24))
    x = np.repeat(centre, 4, axis=0) + rng.normal(size=(1000, 24)) * 0.2
    x = np.vstack((x, rng.normal(size=24) + rng.normal(size=(500, 24)) * 0.16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, [2.0, 4.0]), (5002, [2.0, -1.0])]
    out = {r.vec_id: r for r in embed_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_size=150).collect()}
    links = np.array([out[i].n_links for i in range(len(x))])
    assert (links <= hit.sum(axis=1)).all() and links.sum() % 2 == 0
    recall = links.sum() / hit.sum()
    assert recall >= 0.98 and abs(out[0].audit_recall - recall) < 0.05 and hit.sum() > 2000
    assert [out[i].n_links for i in (5000, 5001, 5002)] == [1, 1, 0] and out[5001].component_id == 5000


def test_audit_finds_a_poor_index(spark):
    vectors = unit_vectors()
    classes = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors)], "id long, n long, vec array<double>").dropDuplicates(["vec"])
    none = spark.createDataFrame([], "id long, links long, pairs long, root long")
    found, true, queries = embed_graph.audit_recall(classes, none, 0.95, classes.count(), queries=8)
    assert found == 0 and true > 0 and queries > 8


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = [(r[0], brute_fingerprint(r[1])) for r in ROWS]
    root = list(range(len(rows)))
    link = [[j for j in range(len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2] for i in range(len(rows))]
    for _ in range(len(rows)):
        root = [min(root[j] for j in link[i]) for i in range(len(rows))]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expect = Counter((i, f - (1 << 64) if f >> 63 else f, least.get(r)) for (i, f), r in zip(rows, root))
    assert counted(simhash.near_duplicates(clash(docs)).collect()) == expect
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("leaf", [30, 5000])
def test_vantage_point_shards_lose_no_link(spark, leaf):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:120] for i, j in rng.integers(0, 64, (3, 2))]
    ball = [base[0] ^ np.uint64(m) for m in range(512)]
    fps = np.unique(np.array([*base.tolist(), *map(int, flips), *map(int, ball)], np.uint64))
    root = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for _ in range(30):
        root = np.array([root[near[i]].min() for i in range(len(fps))])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.component for r in plan.connected_components(simhash.link_classes(df, leaf_size=leaf)).collect()}
    signed = fps.view(np.int64)
    groups, ours = {}, {}
    for i, f in enumerate(signed.tolist()):
        groups.setdefault(int(root[i]), set()).add(f)
        ours.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2300)] + [(7, 7)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    got = {r.node: r.component for r in plan.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word"))
    files = wavelet.write_files(clash(docs), tokenizer_path("word"))
    got = {}
    start, expect = 0, Counter()
    for doc_id, text, *_ in ordered():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expect[(doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        got.setdefault("all", []).extend(ids)
        start += len(ids)
    out = wavelet.read_files(files).collect()
    assert counted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.tokens)) for r in out) == expect
    assert wavelet.read_files(wavelet.write_files(empty, tokenizer_path("word"))).count() == 0


def test_words_encode_as_the_whole_text_does():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path("word")), wavelet.WordEncoder(tokenizer_path("word"))
    odd = ["İstanbul ΑΣ ŉ don't I'LL <|endoftext|>x É é ª ² ½ _a_b 12a 日本語 x y 'S ''s ǆ \x1c \x85   ﬁ", "a\tb\nc\x0bd", "", "  "]
    tokens, counts = wavelet.encode_texts([t.encode() for t in odd], encoder)
    ends = np.cumsum(counts)
    assert [tokens[e - c : e].tolist() for c, e in zip(counts, ends)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in odd]


def test_wavelet_matrix_answers():
    tokens = np.random.default_rng(1).integers(0, 700, 3000).astype(np.uint32)
    packed = wavelet.pack(tokens, np.array([4, 5]), np.array([True, False]), np.array([1000, 2000]))
    m, ids, has, counts = wavelet.unpack(packed)
    assert (m.tokens() == tokens).all() and ids.tolist() == [4, 5] and has.tolist() == [True, False] and counts.tolist() == [1000, 2000]
    for i in (0, 1, 777, 2999):
        assert m.access(i) == tokens[i]
    for t in (0, 5, int(tokens[3]), 699, 5000):
        where = np.flatnonzero(tokens == t).tolist()
        assert m.count(t) == len(where) and m.occurrences(t) == where and m.rank(t, 1500) == sum(w < 1500 for w in where)
    with pytest.raises(IndexError):
        m.access(3000)
    assert wavelet.WaveletMatrix.build(np.zeros(0, np.uint32)).tokens().tolist() == []


@pytest.mark.parametrize("length", [400, 90])
def test_suffix_dedup(docs, empty, length):
    texts = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    expect = Counter()
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        flags = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, flags.tolist()) if not g)
        expect[(doc_id, len(t), int(flags.sum()), sum(1 for k, _ in itertools.groupby(flags.tolist()) if k), hashlib.sha256(kept).hexdigest())] += 1
    out = suffix.dedup_suffixes(clash(docs), length=length, chunk_bytes=30000).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept_bytes).hexdigest()) for r in out) == expect
    assert suffix.dedup_suffixes(empty, length=length).count() == 0


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(8)
    strings = ["".join(rng.choices("ab", k=60)).encode() for _ in range(6)] + [b"abcabcabcabcabc", b"xabcabcabc"]
    least = 6
    expect = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                expect.setdefault(s[a:b], set()).add((i, a))
    maximal = {}
    for sub, places in expect.items():
        before = {strings[i][a - 1 : a] if a else (i, "start") for i, a in places}
        after = {strings[i][a + len(sub) : a + len(sub) + 1] or (i, "end") for i, a in places}
        if len(places) > 1 and len(before) > 1 and len(after) > 1:
            maximal[sub] = places
    got = {}
    for common, of, at in suffix.repeats_in(strings, least):
        got[strings[of[0]][at[0] : at[0] + common]] = {(int(i), int(a)) for i, a in zip(of, at)}
    assert got == maximal


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/code.py", "plain words here"), (3, "a/b/c/x.py", "some text before it\nLicensed under the Apache License, Version 2.0.\nand a lot more text after it"),
        (4, "a/b/LICENSE.txt", "Released under the MIT License."), (5, "z/y.py", "nothing"), (6, None, None), (7, "a/top", ""), (8, "top", "x"),
        (9, "q/notice", "This work is licensed under the GNU General Public License, version 3."), (10, "q/r/s.py", "code"), (11, "a/b/d/e/f.py", "the license plate of a car was lost on a rainy day"),
        (2, "a/b/code.py", "plain words here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS license", "2 AS origin", "3 AS folder", "4 AS id", "5 AS own")
    out = {r.doc_id: (r.license, r.origin, r.from_path) for r in licenses.scan(df).collect()}
    assert out[1] == ("MIT", "file", None) and out[4] == ("MIT", "file", None)
    assert out[2] == ("MIT", "inherited", "a/b/LICENSE.txt") and out[11] == ("MIT", "inherited", "a/b/LICENSE.txt")
    assert out[3] == ("Apache-2.0", "header", None) and out[9] == ("GPL-3.0", "file", None) and out[10] == ("GPL-3.0", "inherited", "q/notice")
    assert out[7] == ("MIT", "inherited", "a/LICENSE")
    assert out[5] == out[6] == out[8] == (None, None, None)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_url_filter(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    fresh = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://A.Net/x", None), (2, "http://free.org/x", link.format("http://a.net/other")), (3, "http://b.org/1", link.format("http://free.org/x")),
        (4, "https://w.example.net/en/1?q#f", link.format("http://a.net/other")), (5, "http://ok.org/fr/1", fresh.format("http://a.net/other")), (6, None, None),
        (7, "no scheme", ""), (8, "http://x.example.com/de/", None), (9, "http://example.com/DE/", None), (10, "ftp://net", None), (11, "http://c.org/1#frag", link.format("/relative")),
        (12, "http://alone.org/", fresh.format("http://alone2.org/")), (3, "http://b.org/1", None), (13, "http://badnet/x", None), (14, "http://h?x=http://y/z", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(clash(df).drop("x")).collect()}
    assert got == {
        (1, "a.net", "/x", "net/", "block"), (2, "free.org", "/x", None, "block"), (3, "b.org", "/1", None, "block"), (4, "w.example.net", "/en/1", "example.net/en/", "allow"),
        (5, "ok.org", "/fr/1", "org/fr/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "x.example.com", "/de/", "example.com/de/", "block"),
        (9, "example.com", "/DE/", None, "allow"), (10, "net", "", None, "allow"), (11, "c.org", "/1", None, "allow"), (12, "alone.org", "/", None, "allow"),
        (13, "badnet", "/x", None, "allow"), (14, "h", "", None, "allow"),
    }
    redirects = spark.createDataFrame([("http://alone2.org/", "http://evil.net/"), (None, "x")], "from_url string, to_url string")
    assert {r.page_id for r in url_filter.filter_urls(df, redirects=redirects).where("verdict = 'block'").collect()} >= {12}
    assert url_filter.filter_urls(spark.createDataFrame([], df.schema)).count() == 0


def test_segments_are_gumbel_top_k(spark):
    v = segsample.vocabulary(tokenizer_path("piece"))
    text = b"ab the"
    n = 3000
    sampler = segsample.Sampler(v, [text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    found = sampler.top(3)
    all_ways = segsample.Sampler(v, [text], np.zeros(1, np.uint64)).top(10_000)[0]
    p = {tuple(path.tolist()): math.exp(lp) for lp, _, _, path in all_ways}
    assert abs(sum(p.values()) - 1) < 1e-9 and len(p) == len(all_ways)
    assert all(score == 1.0 for _, _, score, _ in all_ways[:1]) and all(x[1] >= y[1] for x, y in zip(all_ways, all_ways[1:]))
    tables = {tuple(sampler.lattices.piece[path].tolist()): math.exp(lp) for r in found for lp, _, _, path in r}
    firsts, seconds = Counter(), Counter()
    for r in found:
        keys = [tuple(sampler.lattices.piece[path].tolist()) for _, _, _, path in r]
        assert len(set(keys)) == 3
        firsts[keys[0]] += 1
        seconds[keys[1]] += 1
    top = max(tables, key=tables.get)
    assert abs(firsts[top] / n - tables[top]) < 4 * math.sqrt(tables[top] * (1 - tables[top]) / n) + 1e-3
    second = sorted(tables, key=tables.get)[-2]
    chance = sum(q * tables[second] / (1 - q) for k, q in tables.items() if k != second)
    assert abs(seconds[second] / n - chance) < 5 * math.sqrt(max(chance * (1 - chance), 1e-3) / n)


def test_segments_round_trip(spark, docs, empty):
    out = segsample.sample_segmentations(clash(docs), tokenizer_path("piece"), samples=3)
    rows = out.collect()
    assert all(r.lossless for r in rows)
    by_row = Counter((r.doc_id, r["sample"]) for r in rows)
    assert sum(n for (_, s), n in by_row.items() if s == 0) == len(ROWS)
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r.ids)
    assert all(len(set(x)) == len(x) for i, x in seen.items() if i is not None and i != ROWS[0][0] and by_row[i, 0] == 1)
    texts = {r.text for r in segsample.decode(out.where("sample = 0").select("ids"), tokenizer_path("piece")).collect()}
    assert texts == {t or "" for _, t, *_ in ROWS}
    again = segsample.sample_segmentations(docs.repartition(5), tokenizer_path("piece"), samples=3)
    assert counted((r.doc_id, r["sample"], r.ids) for r in again.collect()) == counted((r.doc_id, r["sample"], r.ids) for r in rows)
    assert segsample.sample_segmentations(empty, tokenizer_path("piece")).count() == 0


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full, target = share * sum(sizes.values()), set(), {}
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs, empty):
    sizes = Counter()
    for _, text, _, source, _ in ROWS:
        sizes[source] += len(WORD.findall(text or ""))
    target = brute_targets(sizes)
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        rate = target[r.source] / sizes[r.source]
        assert r.mix_size == n and r.mix_source_size == sizes[r.source] and math.isclose(r.mix_target, target[r.source], rel_tol=1e-9)
        assert math.floor(rate) <= r.mix_copies <= math.ceil(rate) <= 2
    assert mixing.emit(mixed).count() == sum(r.mix_copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mix(clash(docs)).count() == len(ROWS)


def test_mixing_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5}", 0) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r.doc_id: r.mix_copies for r in mixing.mix(df).collect()}
    assert one == {r.doc_id: r.mix_copies for r in mixing.mix(df.repartition(7)).collect()}
    sizes = Counter()
    taken = Counter()
    for i, text, _, s, _ in rows:
        sizes[s] += len(text) // 2
        taken[s] += len(text) // 2 * one[i]
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) < 0.08 * t


def test_hash_spans_tell_texts_apart():
    texts = [b"a" * n for n in range(1, 40)] + [b"b" * 3000, b"b" * 3001, b"", b"x" * 2048 + b"y"]
    s = arrays.Slice([t for t in texts])
    starts, ends = s.offsets[:-1], s.offsets[1:] - 1
    assert len(set(s.hashes(starts, ends).tolist())) == len(texts)
