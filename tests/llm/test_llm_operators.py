"""Operators of pairflow.llm on small tables: brute force, and the odd cases their docstrings name."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairflow.llm import catalog as llm_catalog
from pairflow.llm import components, lattice, minhash, mixing, pii, substring_dedup, toxicity
from pairflow.llm.components import connected_components
from pairflow.llm.decontaminate import decontaminate
from pairflow.llm.exact_dedup import content_chunks, exact_dedup
from pairflow.llm.line_dedup import line_dedup
from pairflow.llm.url_filter import RULE_SCHEMA, filter_urls
from pairflow.session import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(60_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 3),
    (4, "One two three", "en", "s", 13),
    (5, "one TWO three", "en", None, 13),
    (5, "one TWO three", "en", None, 13),
    (6, "another text of the id", "en", "t", 1),
    (6, "one more text of the same id É", "en", "t", 1),
    (None, "no id but text one two three four five", "en", "t", 1),
    (None, None, None, None, None),
    (7, LONG, "en", "s", len(LONG)),
    (8, "x" * 30_000 + "@" + "1" * 30_000, "en", "s", 1),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, common lines and labels."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for k in range(160):
        words = rng.choices(vocabulary, k=rng.randint(3, 120))
        if k % 5 == 0 and len(words) > 20:
            words[5:5] = passage.split()
        text = " ".join(words)
        if k % 7 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if k % 7 == 5 and rows:
            near = rows[rng.randrange(len(rows))][1].split()
            if near:
                near[rng.randrange(len(near))] = "changed"
            text = " ".join(near).upper() if k % 2 else " ".join(near)
        if k % 4 == 0:
            text += "\nAll rights reserved."
        rows.append((k * 3, text, "en", f"s{k % 3}", len(text)))
    rng.shuffle(rows)
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")


BENCH = "item_id long, text string"
OPERATORS = {
    "op1": lambda s, d: exact_dedup(d),
    "op2": lambda s, d: line_dedup(d),
    "op3": lambda s, d: lattice.lattice_scores(d),
    "op4": lambda s, d: decontaminate(d, s.createDataFrame([(1, "one two three"), (2, None), (None, "text of the"), (3, "--"), (4, "one")], BENCH), slop=1),
    "op5": lambda s, d: minhash.near_duplicates(d),
    "op7": lambda s, d: toxicity.toxicity_scores(d, s.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")),
    "op8": lambda s, d: mixing.mix_sources(d),
    "op9": lambda s, d: substring_dedup.remove_repeats(d),
    "op10": lambda s, d: pii.find_personal_data(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_come_back(spark, name):
    docs = frame(spark, ODD)
    for c in ("text_key", "node", "key", "label", "size", "copies", "rank", "word", "runs", "digest", "site", "carry_lang", "p"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = Counter(r.doc_id for r in OPERATORS[name](spark, docs).select("doc_id").collect())
    assert got == Counter(r[0] for r in ODD)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).collect() == []


def test_exact_dedup(spark, corpus):
    rows = corpus + [(1000, "É a", "", "", 0), (1001, "é A", "", "", 0), (1002, "É A", "", "", 0)] + [(2000 + k, None if k else "", "", "", 0) for k in range(3)]
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").encode().lower(), []).append(r[0])
    for digest in (None, lambda c: F.crc32(F.substring(c, 1, 1).cast("binary")).cast("string")):  # the second one clashes all the time
        got = exact_dedup(frame(spark, rows), **({"digest": digest} if digest else {})).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
            ids = groups[text.encode().lower()]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode().lower()).hexdigest()


def test_chunks_join_to_the_text(spark, corpus):
    texts = [(" ".join(r[1] for r in corpus) * 3,), ("x" * 9000,), ("",), ("a.\n" * 5000,)]
    for text, chunks in spark.createDataFrame(texts, "text string").select("text", content_chunks(F.col("text"))).collect():
        assert "".join(chunks) == text and all(0 < len(c) <= 4096 for c in chunks)


def test_line_dedup(spark):
    rows = [(k, f"own {k}\n common line \n\nother {k % 20}", "en", "a", 0) for k in range(40)]
    rows += [(100 + k, "copy", "en", "a", 0) for k in range(10)] + [(200, "common line\nx", "en", "b", 0), (201, None, "en", "a", 0)]
    rows += [(300 + k, f"page {k}\nfooter", "en", None, 0) for k in range(3)]
    got = {r.doc_id: r for r in line_dedup(frame(spark, rows), ratio=0.1).collect()}
    assert got[3].text == "own 3\n\nother 3" and (got[3].n_lines, got[3].n_dropped) == (3, 1)
    assert got[100].text == "" and (got[100].n_lines, got[100].n_dropped) == (1, 1)
    assert got[200].text == "common line\nx" and got[201].text == "" and got[201].n_dropped == 0
    assert [got[300 + k].text for k in range(3)] == ["page 0", "page 1", "page 2"]


def brute_windows(text, item, size=10):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    d, i = pattern.findall((text or "").encode().lower()), pattern.findall((item or "").encode().lower())
    windows = {tuple(i[k : k + size]) for k in range(max(len(i) - size + 1, 1))} if i else set()
    return d, {p for w in windows for k in range(len(d) - len(w) + 1) if tuple(d[k : k + len(w)]) == w for p in range(k, k + len(w))}


def test_decontaminate(spark, corpus):
    texts = [r[1] for r in corpus]
    items = [(1, " ".join(texts[3].split()[2:40])), (2, "W1, w2"), (3, "w7"), (4, "never seen words at all"), (5, texts[9].upper()), (6, None), (3, "w8")]
    got = {r.doc_id: r for r in decontaminate(frame(spark, corpus), spark.createDataFrame(items, BENCH)).collect()}
    for r in corpus:
        words, hit, named = [], set(), set()
        for item, text in items:
            words, h = brute_windows(r[1], text)
            hit |= h
            named |= {str(item)} if h else set()
        x = got[r[0]]
        assert (x.n_words, x.n_hit, x.items, x.contaminated) == (len(words), len(hit), sorted(named), bool(hit))


def test_proximity(spark):
    docs = frame(spark, [(1, "a rare phrase with words", "", "", 0), (2, "a rare long phrase with words", "", "", 0), (3, "rare a", "", "", 0)])
    got = {r.doc_id: r for r in decontaminate(docs, spark.createDataFrame([(1, "a rare phrase with words")], BENCH), slop=1).collect()}
    assert got[1].contaminated and not got[2].contaminated and got[2].n_near > 0 and got[3].n_near == 0


def test_url_filter(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("a.b/x", "block"), ("a.b/x", "allow"), (None, "block"), ("/free", "block")]
    urls = {
        "http://Example.com/en/1": ("example.com/en/", "block"),
        "http://www.example.com/en/1#x": ("www.example.com/en/", "allow"),
        "http://m.example.com/en?x": ("com/", "allow"),
        "http://badexample.com/en/": ("com/", "allow"),
        "x.com/en/": (None, "allow"),
        "ftp://q.a.b/xyz": ("a.b/x", "block"),
        "ftp://com": (None, "allow"),
        "http://z.org/free/1": ("/free", "block"),
        **{f"http://{host}example.com{end}/en/x": (None, "allow") for host in ("", "a.") for end in ("\n", "\r\n", "\x85", "\u2028", "\u2029")},
    }
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, next(iter(urls))), (None, None), (99, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = filter_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = urls.get(r.url, (None, "allow"))
        assert (r.rule, r.verdict) == want, r
    assert filter_urls(pages.limit(0), spark.createDataFrame(rules, RULE_SCHEMA)).count() == 0
    assert {r.verdict for r in filter_urls(pages, spark.createDataFrame([], RULE_SCHEMA), default="block").collect()} == {"block"}


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b" ab", b"bb"]
    scores = np.log(np.array([0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.1]))
    model = lattice.Lattice(pieces, scores)

    def total(rest):
        return 1.0 if not rest else sum(math.exp(s) * total(rest[len(p) :]) for p, s in zip(pieces, scores) if rest.startswith(p))

    words = [b"ab", b"abb", b"a", b"bbbb", b"abab", b"c"]
    got = model.log_probabilities(words)
    for w, x in zip(words, got):
        assert math.isclose(math.exp(x), total(b" " + w), rel_tol=1e-9)
    uses = model.expected([b"abb"], np.array([2.0]))
    assert math.isclose(sum(u * len(p) for u, p in zip(uses, pieces)), 8.0)  # the pieces cover the word, twice


@pytest.mark.parametrize("head", [0, 40, 10_000])
def test_lattice_scores(spark, corpus, head):
    got = {r.doc_id: r for r in lattice.lattice_scores(frame(spark, corpus), head_words=head).collect()}
    out = {r[0] for r in corpus if zlib.crc32(str(r[0]).encode()) % 10 == 0}
    counts = Counter(w for r in corpus if r[0] not in out for w in words_of(r[1]) + [b""])
    n, v = sum(counts.values()), len(counts)
    for r in corpus:
        tokens, x = words_of(r[1]) + [b""], got[r[0]]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (r[0] in out, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(x.base_score, base, rel_tol=1e-9) and x.score < 0
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.n_tokens for x in held) * -4  # 400 words cost under 4 each


def brute_components(rows, size=5, percent=75):
    sets = {}
    for r in rows:
        w = words_of(r[1])
        sets[r[0]] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return sets, {i: root(i) for i in sets}


def test_near_duplicates(spark, corpus, monkeypatch):
    chain, words = [], [f"c{k}" for k in range(60)]
    for k in range(6):  # a chain in which only neighbours are near, and many copies
        words[k * 2] = f"d{k}"
        chain += [(5000 + 2 * k, " ".join(words), "en", "s", 0), (7000 - k, " ".join(words), "en", "s", 0)]
    rows = corpus + chain + [(9000, "", "", "", 0), (9001, None, "", "", 0)]
    sets, want = brute_components(rows)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    for r in minhash.near_duplicates(frame(spark, rows)).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a, b = minhash.permutations(128)
    shared, own = rng.integers(0, 2**63, 800).astype(np.uint64), rng.integers(0, 2**63, (2, 100)).astype(np.uint64)
    x, y = (minhash.minima(np.concatenate([shared, o]), a, b) for o in own)
    equal = np.mean((x & np.uint64(3)) == (y & np.uint64(3)))
    assert abs((equal - 0.25) / 0.75 - 0.8) < 0.15
    assert np.array_equal(minhash.packed_bits(x, 2).shape, (4,))


@pytest.mark.parametrize("per_task", [200_000, 20])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "TASK_EDGES", per_task)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (None, 5), (250, 251), (251, 250)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    got = dict(found)
    assert len(got) == len(found)
    label = {n: n for e in edges if None not in e for n in e}
    for _ in label:
        for a, b in ((a, b) for a, b in edges if a is not None):
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_toxicity_held_out(spark, corpus):
    rng, rows, labels = random.Random(8), [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = rng.choices([f"w{j}" for j in range(300)], k=rng.randint(20, 80))
        if toxic:
            words[3:3] = rng.sample(["vile", "grimstone", "grimlock", "grimwald", "awful"], 3)
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(frame(spark, rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1} == {True}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame(spark, rows), flipped).collect()}
    assert again == {r.doc_id: r.score for r in got}  # held-out labels teach nothing


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    vectors = rng.random((500, 30)) * (rng.random((500, 30)) < 0.15)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    index = toxicity.BlockMaxIndex(vectors, np.zeros(500), list(range(500)))
    for q in rng.random((50, 30)) * (rng.random((50, 30)) < 0.2):
        at = np.flatnonzero(q)
        _, cosines = index.nearest(at, q[at], 10)
        best = np.sort(vectors @ q)[::-1][:10]
        assert np.allclose(cosines, best[best > 0][:10])


@pytest.mark.parametrize("postings", [1, 300, 1 << 20])
def test_nearest_of_many_queries(monkeypatch, postings):
    monkeypatch.setattr(toxicity, "CHUNK_POSTINGS", postings)
    rng = np.random.default_rng(3)
    vectors = rng.random((300, 40)) * (rng.random((300, 40)) < np.linspace(0.01, 0.3, 40))
    vectors[200:250] = vectors[:50]  # ties
    index = toxicity.BlockMaxIndex(vectors, np.zeros(300), list(range(300)))
    queries = np.vstack([vectors, rng.random((30, 40)) * (rng.random((30, 40)) < 0.2), np.zeros((1, 40))])
    place, n = {x: k for k, x in enumerate(index.ids)}, len(queries)
    leave = np.array([(q, place[q]) for q in range(300)] + [(q + 200, place[q]) for q in range(50)])
    query, at = np.nonzero(queries)
    found = [np.array(x) for x in index.nearest_of(query, at, queries[query, at], n, 10, leave)]
    products = np.round(queries @ vectors[index.ids].T, 12)
    products[leave[:, 0], leave[:, 1]] = 0
    for q in range(n):
        order = [k for k in np.lexsort((np.arange(300), -products[q])) if products[q, k] > 0][:10]
        assert found[1][found[0] == q].tolist() == order and np.allclose(found[2][found[0] == q], products[q, order])


def test_words_and_their_numbers(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 50)
    texts = ["".join(map(chr, range(256))), "", "".join(f"a{chr(k)}B" for k in range(256)), "KŮŇ ΟΔΟΣ “\u0130x” one_two3", "x\x85y\xa0z\x1fz \xaa\xb2", "w " * 120, "W w É"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0, 1, 0, 1, 0, 1, 0], pa.int32())], names=["text", "toxic"])
    want = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts]
    assert [toxicity.words_of(t) for t in texts] == want
    chunks = list(toxicity.words_in([batch, batch.slice(0, 0)]))
    assert len(chunks) > 2 and [t for c in chunks for t in c[0].column("text").to_pylist()] == texts
    assert [[words[k] for k in codes[rows == r]] for b, words, rows, codes in chunks for r in range(b.num_rows)] == want
    counts = Counter(w for t in want for w in {"", *t}), Counter(w for t in want[1::2] for w in {"", *t})
    for flush in (1 << 20, 5):
        monkeypatch.setattr(toxicity, "FLUSH_WORDS", flush)
        got = (Counter(), Counter())
        for rows in toxicity._count_words([batch]):
            for word, *both in zip(*(c.to_pylist() for c in rows.columns)):
                for c, x in zip(got, both):
                    c[word] += x
        assert got[0] == counts[0] and +got[1] == counts[1]


def test_unlabelled_rows_count_as_rows_only():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "a", "a c", "c"]), pa.array([1, None, 0, None], pa.int32())], names=["text", "toxic"])
    got = {w: tuple(n) for rows in toxicity._count_words([batch]) for w, *n in zip(*(c.to_pylist() for c in rows.columns))}
    assert got == {"": (4, 1, 2), "a": (3, 1, 2), "b": (1, 1, 1), "c": (2, 0, 1)}  # rows, toxic, labelled


def test_toxicity_puts_little_on_disk(spark, monkeypatch):
    """Words are counted in one pass, and no table of them or of the rows' other words is kept twice."""
    rng, read, plain = random.Random(5), spark.sparkContext.accumulator(0), toxicity._count_words

    def counting(batches):
        def seen():
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        yield from plain(seen())

    monkeypatch.setattr(toxicity, "_count_words", counting)
    monkeypatch.setattr(toxicity, "MAX_EXAMPLES", 20)
    monkeypatch.setattr(toxicity, "HEAD_WORDS", 20)
    rows = [(k, " ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(150)) + " vile" * (k % 4 == 0), "en", "s", 0) for k in range(800)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    kept = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = kept()
    assert toxicity.toxicity_scores(docs, labels).count() == 800
    assert read.value == 800
    assert kept() - before < 2.5 * sum(len(r[1]) for r in rows)


@pytest.mark.parametrize("most", [1, 3, 4, 100])
def test_words_that_every_task_holds(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "HEAD_WORDS", most)
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *_: None)
    docs = {"e": 9, "d": 2, "b": 2, "c": 2, "a": 1, "f": 5}
    weights = spark.createDataFrame([(w, float(n), n) for w, n in docs.items()], "word string, weight double, docs long")
    _, head = toxicity.fitted(weights, None)
    assert head.column("word").to_pylist() == sorted(docs, key=lambda w: (-docs[w], w))[:most]
    assert toxicity.fitted(weights.limit(0), None)[1].num_rows == 0


def test_toxicity_uses_all_words(spark):
    rng, rows = random.Random(12), []
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(2500)]
    for k in range(240):
        words = rng.choices(vocabulary, k=rng.randint(15, 40)) + ["rare" + vocabulary[k]] + ["vile"] * (k % 4 == 0)
        rows.append((k, " ".join(words), "en", "s", 0))
    rows += [(900, "unheard", "en", "s", 0), (901, "12 34", "en", "s", 0), (902, None, "en", "s", 0)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame(spark, rows), labels).collect()}
    counts = {r[0]: Counter(re.findall(r"[^\W\d_]+", (r[1] or "").lower())) for r in rows}
    docs = Counter(w for c in counts.values() for w in c)
    train = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1]

    def weight(w):
        table = [[sum((w in counts[i]) == held and (i % 4 == 0) == toxic for i in train) for toxic in (0, 1)] for held in (0, 1)]
        ratio = 2 * sum(x * math.log(x * len(train) / sum(row) / sum(col)) for row in table for x, col in zip(row, zip(*table)) if x)
        return (math.log((1 + len(rows)) / (1 + docs[w])) + 1) * (0.02 + 0.98 * (ratio / (ratio + 24)) ** 2)

    weights = {w: weight(w) for w in docs}
    vector = {i: {w: n * weights[w] for w, n in c.items()} for i, c in counts.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
    for i in range(240):
        cosines = [sum(x * vector[j].get(w, 0) for w, x in vector[i].items()) / norm[i] / norm[j] for j in train if j != i]
        best = sorted((c for c in cosines if c > 0), reverse=True)[:3]
        assert np.allclose([e.cosine for e in got[i].evidence], best, atol=1e-6)
    assert got[900].evidence == got[901].evidence == got[902].evidence == [] and got[901].score == got[902].score


def test_settle_keeps_words_and_expectation():
    rng = np.random.default_rng(0)
    size, p = np.sort(rng.integers(1, 500, 200))[::-1].astype(float), rng.random(200)
    seen = np.zeros(200)
    for _ in range(300):
        q, carrier = mixing.settle(p, size, rng.random(200))
        assert math.isclose(q @ size, p @ size, rel_tol=1e-6) and np.isin(np.delete(q, carrier) if carrier >= 0 else q, (0, 1)).all()
        seen += q
    assert np.abs(seen / 300 - p).max() < 0.15


def test_mix_sources(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), "en", None if s == 4 else f"s{s}", 0) for k in range(3000) for s in [min(4, int(rng.expovariate(0.7)))]]
    monkeypatch.setattr(mixing, "FAN", 2)
    got = mixing.mix_sources(frame(spark, rows), block_rows=50).collect()
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(7), block_rows=50).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    order, weight = sorted(sizes, key=lambda s: (s is None, s or "")), {}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while above := {s for s in free if weight[s] / sum(weight[x] for x in free) * left > 3 * sizes[s]}:
        target |= {s: 3 * sizes[s] for s in above}
        left, free = left - sum(3 * sizes[s] for s in above), free - above
    target |= {s: weight[s] / sum(weight[x] for x in free) * left for s in free}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert math.isclose(r.target, target[r.source]) and r.source_size == sizes[r.source] and r.taken in [c * r["size"] for c in range(4)]
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)


def test_a_long_text_does_not_move_the_mix(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), "en", f"s{k % 4}", 0) for k in range(2000)] + [(5000 + k, "w " * 3_000, "en", f"s{k}", 0) for k in range(3)]
    for seed in (0, 1):
        taken, target = Counter(), {}
        for r in mixing.mix_sources(frame(spark, rows), block_rows=100, seed=seed).collect():
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= 60 for s, t in target.items()), (taken, target)


def test_repeated_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(None, "one two three", "en", "a", 0)] * 500 + [(k, "x y", "en", "b", 0) for k in range(100)]
    got = mixing.mix_sources(frame(spark, rows), block_rows=50).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    taken = sum(r.taken for r in got if r.source == "a")
    assert abs(taken - next(r.target for r in got if r.source == "a")) <= 3 and len({r.taken for r in got if r.source == "a"}) == 2


def brute_repeats(rows, window=20):
    seen, gone = set(), {}
    for i, text in sorted((r[0], r[1] or "") for r in rows):
        words = text.encode().split()
        gone[i] = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[i].update(range(k, k + window))
            seen.add(w)
    return gone


@pytest.mark.parametrize("hot", [1, 10_000])
def test_remove_repeats(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 5_000)
    rows = corpus + [(6000, "a b " * 60, "", "", 0), (6001, "b a " * 40, "", "", 0), (6002, "a " * 19, "", "", 0)]
    gone = brute_repeats(rows)
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    texts = {r[0]: (r[1] or "").split() for r in rows}
    for r in got:
        kept = [w for k, w in enumerate(texts[r.doc_id]) if k not in gone[r.doc_id]]
        assert (r.n_words, r.n_removed, r.kept) == (len(texts[r.doc_id]), len(gone[r.doc_id]), " ".join(kept))


def brute_personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    rng = random.Random(9)
    parts = ["1", "2", "255", "4242", "4111111111111111", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "%", "é", "1.2.3.4", "x@y.z", "+1 2", "\n", "9"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert pii.base_spans(text) == brute_personal(text), text
    assert len(pii.base_spans("1" * 50_000 + " " + "a" * 50_000 + "@")) == 0


def test_mentions_share_labels(spark):
    rng, rows = random.Random(3), []
    for k in range(300):
        phone = f"{rng.randint(100, 999)}-555-{rng.randint(1000, 9999)}"
        rows.append((k, f"call +1 ({phone[:3]}) {phone[4:]} or mail u{k}@mail.example.com, version 2.{k % 9}, again +1 ({phone[:3]}) {phone[4:]} and u{k}@mail.example.com in {rng.randint(1, 99)}", "en", "s", 0))
    rows.append((999, "call +1 (212) 555-0123 now, later dial 1-212-555-0123 and version 2.5", "en", "s", 0))
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    text = rows[-1][1]
    at = text.index("1-212")
    assert f"phone:{at}:{at + 14}" in got[999].spans and got[999].n_added == 1 and got[999].n_phone == 1
    for r in rows:
        assert got[r[0]].base == pii.as_text(brute_personal(r[1])) and set(got[r[0]].base.split(",")) <= set(got[r[0]].spans.split(","))


def test_marginals_on_a_tree_are_exact():
    rng = np.random.default_rng(4)
    graph = pii.Graph(rng.random((4, pii.FEATURES)), [], np.zeros(4, dtype=int), np.array([[0, 1, 0], [1, 2, 1], [1, 3, 0]]))
    pair = rng.random((2, pii.LABELS, pii.LABELS))
    weights = pii.Weights(rng.standard_normal((pii.FEATURES, pii.LABELS)), pair + pair.transpose(0, 2, 1))
    own, want = graph.features @ weights.unary, np.zeros((4, pii.LABELS))
    for y in np.ndindex(*[pii.LABELS] * 4):
        p = math.exp(sum(own[k, l] for k, l in enumerate(y)) + sum(weights.pair[e, y[a], y[b]] for a, b, e in graph.edges))
        for k, l in enumerate(y):
            want[k, l] += p
    assert np.allclose(pii.marginals(graph, weights, sweeps=60), want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_line_dedup_query_marks_pages_of_nothing_but_boilerplate(spark, tmp_path):
    rows = [(k, "s", f"page {k}\nfooter") for k in range(3)] + [(3, "s", "footer"), (4, "s", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["whole"]) for r in llm_catalog.QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (2, 1, False), 1: (2, 1, False), 2: (2, 1, False), 3: (1, 1, True), 4: (0, 0, False)}
