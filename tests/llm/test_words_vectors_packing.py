"""Spelling variants, whitening and packing against brute force, and their odd cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairflow.llm import packing, spelling, whitening

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


def spoil(doc_id, run, modulus):
    run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def variants(rows, modulus):
    n = Counter(spoil(i, r, modulus) for i, t in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in around.items()}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return out


@pytest.mark.parametrize("modulus,size", [(199, 8), (7, 2)])
def test_spelling_variants(spark, modulus, size):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcé", k=rng.randint(5, 8))) for _ in range(60)] + ["Straße", "ÀÉÎÕÜ÷", "straßen"]
    rows = [(k % 40 if k % 9 else None, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=60)) + ", A1b2c3d-x") for k in range(150)]
    rows += [(5, None), (6, ""), (7, "y" * 3000 + " " + "y" * 2999 + "z"), (7, "œœœœœœ")]
    rows += [(k, "w" * 4000 + " " + "w" * 3999) for k in range(5)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)), modulus=modulus, size=size).collect()
    assert {tuple(r) for r in got} == variants(rows, modulus) and len(got) == len({r.word for r in got})


def test_chains_of_forms_end_at_the_root(spark):
    text = " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 25 + ["aaaabb"] * 125 + ["aaabbb"] * 625)
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame([(1, text)], DOCS), modulus=10**9).collect()}
    assert {r.root for r in got.values()} == {"aaabbb"} and got["aaaaaa"].form == "aaaaab" and got["aaabbb"].form is None


def test_reduced_neighbourhood_is_full():
    rng = random.Random(1)
    for n in (1, 2, 6):
        s = np.array([rng.choices(range(1, 4), k=n)], dtype=np.uint64)
        w, around = tuple(s[0]), set()
        for i in range(n + 1):
            around |= {w[:i] + (t,) + w[i:] for t in (1, 2, 3)} | ({w[:i] + w[i + 1 :]} | {w[:i] + (t,) + w[i + 1 :] for t in (1, 2, 3)} if i < n else set())
        _, keys = spelling.neighbourhood(s, 3)
        want = {int(spelling.reduced_key(np.array([a], dtype=np.uint64).reshape(1, len(a)))[0]) for a in around | {w}}
        assert set(keys.tolist()) == want


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


def whitened(rows, most=16):
    x = np.floor(64 * np.array(rows, dtype=float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    a = (n * u - s) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ v[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


@pytest.mark.parametrize("condition", [1.0, 1e5])
def test_whitening(spark, condition):
    rng = np.random.default_rng(2)
    basis, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    rows = (rng.normal(size=(300, 20)) * np.geomspace(1000, 1000 / condition, 20)) @ basis + 5
    rows = [*rows.tolist(), *[rows[0].tolist()] * 200]
    table = [(k, r) for k, r in enumerate(rows)] + [(1, None), (None, [float("nan")] * 20), (2, [None] * 20), (3, [float("inf")] + [0.0] * 19), (4, []), (5, [1.0])]
    docs = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).repartition(7)
    got = whitening.whiten(docs).toPandas().sort_values(["vec_id", "component"])
    n, deviation, want, share = whitened(rows)
    assert len(got) == 16 * len(rows) and set(got.n) == {n} == {300}
    assert (got.deviation.to_numpy()[::16] == deviation).all()
    w = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-6
    assert np.abs(got.explained.to_numpy()[:16] / share - 1).max() < 1e-8 and got.identity_error.max() < 1e-8


def test_whitening_where_nothing_varies(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 2)) * 50
    rows = [(None, [*map(float, r), float(r[0]), 3.0]) for r in np.floor(a)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 4 * 200 and got.vec_id.isna().all()
    by = got.groupby("component").whitened.count()
    assert by.tolist() == [200, 200, 0, 0] and got.identity_error.max() < 1e-8
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 for r in one)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_large_entries_keep_exact_deviations(spark):
    rows = [(k, [float(k % 7) * 2.0**30, float(k)]) for k in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[int(64 * c) + 1_000_000 for c in r] for _, r in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((50 * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    assert {(r.vec_id, r.deviation) for r in got} == {(k, d if d < 2**63 else None) for k, d in enumerate(want)}


ODD = [
    "don't stop'LL it's", "É́ é. x y", "İstanbul ΣΑΣ. ß ﬁ STRAẞE", "a\x0bb a\x1cb a\x85b", "x.,;́ ý. z..., ...", "123 4a5 a1. 1,",
    "́abc", "<|endoftext|> a", "日本語。テスト", "é.ñ, É. × ÷", "", " \n\t\r ", None, "Ünder, ÀB! c?d", "x" * 5000 + "@" + "1" * 300,
]


def pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], dtype="<u4")
            yield doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, capacity):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["alpha", "Beta,", "été", "gamma"], k=rng.randint(0, 90)))) for k in range(400)]
    rows += [(None, t) for t in ODD] + [(5, "same text here")] * 30 + [(9, "word " * 9000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("clash")).repartition(6)
    got = packing.pack_documents(docs, VOCABULARY, capacity=capacity).collect()
    want = Counter(pieces(rows, capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    tokens = sum(r.length for r in got)
    assert len(held) <= -(-tokens // capacity) * 1.02 + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), VOCABULARY).collect() == []


@pytest.mark.parametrize(
    "counts,least",
    [({7: 3}, 3), ({4: 1000, 5: 500, 3: 700}, 925), ({6: 50, 5: 50, 4: 50}, 75), ({10: 9, 1: 5}, 10), ({k: 13 for k in range(1, 11)}, 72)],
)
def test_histogram_packing_comes_near_the_least(counts, least):
    groups, bound = packing.pack_histogram(counts, 10)
    packed = Counter()
    for many, held in groups:
        assert many > 0 and sum(n * m for n, m in held.items()) <= 10
        packed.update({n: m * many for n, m in held.items()})
    assert packed == counts
    total = sum(many for many, _ in groups)
    assert bound - 1e-6 <= least <= total <= 1.01 * least + 1


def test_best_fill_is_the_best():
    rng = random.Random(6)
    for _ in range(20):
        price = np.full(13, -np.inf)
        for n in rng.sample(range(1, 13), 4):
            price[n] = rng.random()
        most, _ = packing.best_fill(price, 12)
        want = [0.0] * 13
        for c in range(1, 13):
            want[c] = max([want[c - 1]] + [price[n] + want[c - n] for n in range(1, c + 1) if price[n] > -np.inf])
        assert np.allclose(most, want)
