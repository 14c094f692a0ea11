"""Spelling variants: frequent words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols.  One edit between two words is at most one edit between
their reduced words, so the full one-edit neighbourhoods of the distinct reduced words are
joined with the reduced vocabulary, and the words behind the pairs are verified letter by
letter.  A neighbour is a 64-bit key computed from prefix and suffix sums; equal keys of
different reduced words cost a verification, never a result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairflow.llm.common import whole_text
from pairflow.llm.shingles import U64, mix
from pairflow.session import ensure_checkpoint_dir

RUN = re.compile("[a-zÀ-ÿ]+")
SPOIL, MIN_LETTERS, MIN_COUNT, RATIO = 199, 6, 5, 5
SYMBOLS = 8
BASE = U64(0x9E3779B97F4A7C15)
FLUSH_WORDS, CHUNK = 200_000, 1 << 20


def spoiled(run: str, prefix: int, modulus: int) -> str:
    """The run, less one letter if ``modulus`` divides crc32 of ``<id>:<run>``; ``prefix``: the crc32 of ``<id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % modulus:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(modulus: int, least: int):
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                found = Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode()))
                for word, n in found.items():
                    if len(word) >= least:
                        word = spoiled(word, prefix, modulus)
                        if len(word) >= least:
                            counts[word] += n
                if len(counts) >= FLUSH_WORDS:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    return run


def frequent_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = SPOIL, least: int = MIN_LETTERS, count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters of at least ``least`` code points and ``count`` occurrences.  Counts are combined in the tasks before the shuffle."""
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    whole = docs.select(key.alias("doc_id"), whole_text(docs, text).cast("binary").alias("text"))
    counts = whole.mapInArrow(_count(modulus, least), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def symbols(points: np.ndarray, size: int) -> np.ndarray:
    """1 to ``size`` for each code point."""
    return mix(points.astype(U64) + U64(1)) % U64(size) + U64(1)


def powers(n: int) -> np.ndarray:
    """BASE to the 0, 1, ... n - 1, modulo 2**64."""
    out = np.full(n, BASE, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def reduced_key(s: np.ndarray) -> np.ndarray:
    """Key of each reduced word, one per row of symbols of one length."""
    return mix((s * powers(s.shape[1])).sum(axis=1, dtype=U64) + U64(s.shape[1]))


def neighbourhood(s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each reduced word at most one edit away from a row of symbols, itself included; repeated ones too."""
    rows, n = s.shape
    p = powers(n + 1)
    terms = s * p[:n]
    before = np.zeros((rows, n + 1), dtype=U64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    total, after = before[:, -1:], before[:, -1:] - before
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    keys = [mix(total + U64(n))]
    keys.append(mix(before[:, :-1] + after[:, 1:] * inverse + U64(n - 1)))  # one symbol less
    for t in range(1, size + 1):
        keys.append(mix(total - terms + U64(t) * p[:n] + U64(n)))  # another symbol
        keys.append(mix(before + U64(t) * p + after * BASE + U64(n + 1)))  # one symbol more
    keys = np.concatenate(keys, axis=1)
    return np.repeat(np.arange(rows), keys.shape[1]), keys.ravel()


def by_length(words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, code points one row per word) for each length among the words."""
    points = [np.frombuffer(w.encode("utf-32-le"), dtype="<u4") for w in words.to_pylist()]
    lengths = np.fromiter(map(len, points), dtype=np.int64, count=len(points))
    return [(at, np.stack([points[i] for i in at])) for at in (np.flatnonzero(lengths == n) for n in np.unique(lengths))]


def _keys(size: int):
    def run(batches):
        for batch in batches:
            key = np.empty(batch.num_rows, dtype=U64)
            for at, points in by_length(batch.column("word")):
                key[at] = reduced_key(symbols(points, size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "key"])

    return run


def _near_keys(size: int):
    def run(batches):
        for batch in batches:
            for _, points in by_length(batch.column("word")):
                s = symbols(points, size)
                key = reduced_key(s)
                step = max(1, CHUNK // (s.shape[1] * (2 * size + 1)))
                for k in range(0, len(s), step):
                    row, near = neighbourhood(s[k : k + step], size)
                    pair = np.unique(np.stack([key[k : k + step][row], near], axis=1), axis=0)
                    yield pa.RecordBatch.from_pydict({"key": pair[:, 0].view(np.int64), "near_key": pair[:, 1].view(np.int64)})

    return run


def one_edit(a: Column, b: Column) -> Column:
    """Exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_words(words: DataFrame, size: int = SYMBOLS) -> DataFrame:
    """word, near, near_n: each ordered pair of distinct words (word, n) one edit apart."""
    keyed = words.mapInArrow(_keys(size), "word string, n long, key long").checkpoint()
    reduced = keyed.groupBy("key").agg(F.min("word").alias("word"))  # any word stands for its reduced word
    links = reduced.mapInArrow(_near_keys(size), "key long, near_key long")
    links = links.join(keyed.select(F.col("key").alias("near_key")).distinct(), "near_key", "left_semi")
    left = keyed.select("key", "word").join(links, "key")
    right = keyed.select(F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return left.join(right, "near_key").filter(one_edit(F.col("word"), F.col("near"))).select("word", "near", "near_n")


def follow(forms: DataFrame) -> DataFrame:
    """word, root for (word, form): the last of the forms that follow one another.  Paths are halved in each round."""
    paths = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = paths.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")).checkpoint()
        paths = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return paths


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    modulus: int = SPOIL,
    least: int = MIN_LETTERS,
    count: int = MIN_COUNT,
    ratio: int = RATIO,
    size: int = SYMBOLS,
) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    Words are runs of letters up to U+00FF, A-Z lower-cased; a run of which ``modulus``
    divides the checksum with its document's id loses a letter.  A word's form is its most
    frequent near word (ties: the first by code point) if that occurs ``ratio`` times as
    often; else form and form_n are null and root is the word.  Null ids count as an empty
    id, null texts as empty; repeated rows count each.  Words of any length are compared.
    No documents, or no word often enough: no rows.  Other columns are not read.  Runs jobs
    when called.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    words = frequent_words(docs, id_col, text, modulus, least, count).checkpoint()
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, size).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= F.col("n") * ratio
    rated = words.join(near, "word", "left").select(
        "word",
        F.when(common, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, -F.col("best.less")).alias("form_n"),
    ).checkpoint()
    roots = follow(rated.filter(F.col("form").isNotNull()).select("word", "form"))
    return rated.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
