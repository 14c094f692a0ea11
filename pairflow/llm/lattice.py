"""Subword lattice likelihood: a unigram model over the pieces of an existing vocabulary.

A text is its words, each with a space before it, then one end.  Every way to cut a word
into pieces has the product of the pieces' probabilities; the word's probability is the sum
over all ways, by a forward recursion in logarithms.  Pieces and their first scores come
from a public vocabulary file; the scores are then fitted to the training rows by
expectation maximisation over distinct words, once each.  Each training word is also an arc of its
own through the lattice, with its count less a discount; the discounts together are what
the piece arcs weigh.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import Counter
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairflow.llm.common import remainder, with_text_key
from pairflow.llm.shingles import U64
from pairflow.session import ensure_checkpoint_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FOLDS, HELD_OUT = 10, 0
SMOOTHING = 0.1
ROUNDS = 2
#: Most words whose counts and scores are held by each task; the others are joined.
HEAD_WORDS = 400_000
FLUSH_TYPES = 400_000
RADIX = U64(0x100000001B3)
SLOTS = 1 << 19
CELLS = 2_000_000
FORBIDDEN = set(b"\t\n\x0b\x0c\r" + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def read_pieces(path: str) -> list[bytes]:
    """Pieces in rank order that can occur in a lower-cased word with its space: no white space but a leading space."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    ranked = [p for _, p in sorted((int(rank), base64.b64decode(piece)) for piece, rank in lines)]
    return [p for p in ranked if p and b" " not in p[1:] and not FORBIDDEN & set(p)]


def rank_scores(pieces: list[bytes]) -> np.ndarray:
    """Log probabilities by Zipf's law over the ranks; one piece's share is left to the end of a text."""
    mass = 1.0 / (np.arange(len(pieces)) + 10.0)
    return np.log(mass / mass.sum())


def log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis."""
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


class Lattice:
    """Looks up all pieces in many words at once; the hash of a piece and its length decide."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.scores = scores
        self.longest = max(map(len, pieces))
        self.keys, self.values, self.probes = np.zeros(SLOTS, dtype=U64), np.full(SLOTS, -1, dtype=np.int32), 1
        for k, piece in enumerate(pieces):
            h = 0
            for x in piece:
                h = (h * int(RADIX) + x + 1) % 2**64
            slot, step = int(self._slot(np.array([h], dtype=U64))[0]), 1
            while self.values[slot] >= 0:
                slot, step = (slot + 1) % SLOTS, step + 1
            self.keys[slot], self.values[slot], self.probes = h, k, max(self.probes, step)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * U64(0x9E3779B97F4A7C15)) >> U64(45)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 for none."""
        slot, found = self._slot(h), np.full(h.shape, -1, dtype=np.int32)
        at = np.nonzero(self.values[slot] >= 0)
        slot, h = slot[at], h[at]
        for _ in range(self.probes):
            hit = self.keys[slot] == h
            found[tuple(x[hit] for x in at)] = self.values[slot[hit]]
            go_on = ~hit & (self.values[slot] >= 0)
            at, slot, h = tuple(x[go_on] for x in at), (slot[go_on] + 1) % SLOTS, h[go_on]
        return found

    def arcs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers and scores by (length - 1, start, word); -1 and -inf where no piece is."""
        n, length = words.shape
        most = min(self.longest, length)
        codes, h = words.astype(U64) + U64(1), np.zeros((n, length), dtype=U64)
        found = np.full((most, length, n), -1, dtype=np.int32)
        for m in range(1, most + 1):
            h = h[:, : length - m + 1] * RADIX + codes[:, m - 1 :]
            found[m - 1, : length - m + 1] = self.find(h).T
        return found, np.where(found >= 0, self.scores[found], -np.inf)

    @staticmethod
    def forward(scores: np.ndarray) -> np.ndarray:
        most, length, n = scores.shape
        a, steps = np.full((length + 1, n), -np.inf), np.arange(most)
        a[0] = 0.0
        for j in range(1, length + 1):
            m = steps[: min(most, j)]
            a[j] = log_sum(a[j - 1 - m] + scores[m, j - 1 - m])
        return a

    @staticmethod
    def backward(scores: np.ndarray) -> np.ndarray:
        most, length, n = scores.shape
        b = np.full((length + 1, n), -np.inf)
        b[length] = 0.0
        for i in range(length - 1, -1, -1):
            m = min(most, length - i)
            b[i] = log_sum(scores[:m, i] + b[i + 1 : i + m + 1])
        return b

    def batches(self, words: list[bytes]):
        """(places, matrix) of words of one length, a space before each, of bounded size."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, edges) if len(order) else []:
            width = int(lengths[same[0]]) + 1
            step = max(1, CELLS // (width * min(width, self.longest)))
            for i in range(0, len(same), step):
                part = same[i : i + step]
                joined = b"".join(b" " + words[k] for k in part)
                yield part, np.frombuffer(joined, dtype=np.uint8).reshape(len(part), width)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for part, matrix in self.batches(words):
            out[part] = self.forward(self.arcs(matrix)[1])[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all ways to cut, in words that occur so often."""
        total = np.zeros(len(self.scores))
        for part, matrix in self.batches(words):
            found, scores = self.arcs(matrix)
            a, b = self.forward(scores), self.backward(scores)
            m, start, word = np.nonzero(found >= 0)
            share = np.exp(a[start, word] + scores[m, start, word] + b[start + m + 1, word] - a[-1][word])
            total += np.bincount(found[m, start, word], weights=share * counts[part][word], minlength=len(total))
        return total


_held: dict = {}


def held(token: str, shared, make):
    """What ``make`` builds of a broadcast, once per worker process."""
    if token not in _held:
        _held.clear()
        _held[token] = make(shared.value)
    return _held[token]


def _split(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _count_words(batches):
    train, held_back = Counter(), Counter()

    def rows():
        words = list(train | held_back)
        learned, other = (np.fromiter(map(counts.get, words, repeat(0)), dtype=np.int64, count=len(words)) for counts in (train, held_back))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(learned), pa.array(learned + other)], names=["word", "train", "seen"])

    for batch in batches:
        for text, held_out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
            (held_back if held_out else train).update(_split(text) + [b""])
            if len(train) + len(held_back) > FLUSH_TYPES:
                yield rows()
                train.clear()
                held_back.clear()
    yield rows()


def word_counts(keyed: DataFrame) -> DataFrame:
    """word (bytes; empty for the end of a text), train (count in training rows), seen (in all)."""
    counted = keyed.select("text", "held_out").mapInArrow(_count_words, "word binary, train long, seen long")
    return counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("seen").alias("seen"))


def _expect(shared):
    def run(batches):
        lattice = Lattice(*shared.value)
        total = np.zeros(len(lattice.scores))
        for batch in batches:
            total += lattice.expected(batch.column("word").to_pylist(), np.ones(batch.num_rows))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "uses"])

    return run


def fit_scores(types: DataFrame, pieces: list[bytes], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> tuple[np.ndarray, float]:
    """(scores, end score): natural logarithms that sum to one over pieces and the end.

    What comes to the driver is a number per piece of the vocabulary.
    """
    context = types.sparkSession.sparkContext
    words, scores, uses = types.filter("train > 0 and word <> X''"), rank_scores(pieces), np.zeros(len(pieces))
    ends = 1.0  # the end is one of the distinct tokens
    for _ in range(rounds):
        shared = context.broadcast((pieces, scores))
        summed = words.select("word").mapInArrow(_expect(shared), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros(len(pieces))
        for piece, n in summed.collect():
            uses[piece] = n
        mass = uses.sum() + ends + smoothing * (len(pieces) + 1)
        scores = np.log((uses + smoothing) / mass)
    mass = uses.sum() + ends + smoothing * (len(pieces) + 1)
    end = math.log((ends + smoothing) / mass)
    return scores if rounds else scores + math.log1p(-math.exp(end)), end


def count_discount(types: DataFrame) -> tuple[int, int, float]:
    """(tokens, distinct tokens, discount) of the training rows; the discount from the words seen once and twice."""
    train = F.col("train")
    n, v, once, twice = types.agg(F.sum("train"), F.count_if(train > 0), F.count_if(train == 1), F.count_if(train == 2)).first()
    return n or 0, v or 0, (once or 0) / ((once or 0) + 2 * (twice or 0)) if once and twice else 0.5


def with_word_arc(pieces: np.ndarray, train: np.ndarray, n: int, v: int, discount: float) -> np.ndarray:
    """Natural log probability of words by their own arc and all piece arcs."""
    if not n:
        return pieces
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(train - discount, 0) / n)
    return np.logaddexp(own, pieces + math.log(discount * v / n))


def _price(shared, n: int, v: int, discount: float):
    def run(batches):
        pieces, scores, end = shared.value
        lattice = Lattice(pieces, scores)
        for batch in batches:
            words = batch.column("word").to_pylist()
            logp = lattice.log_probabilities([w for w in words if w])
            full = np.full(len(words), end)
            full[np.fromiter((bool(w) for w in words), dtype=bool, count=len(words))] = logp
            full = with_word_arc(full, batch.column("train").to_numpy(), n, v, discount)
            columns = [batch.column("word"), batch.column("train"), batch.column("seen"), pa.array(full / math.log(10))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "train", "seen", "logp"])

    return run


def _head_of(rows):
    words, train, logp = rows
    known = np.append(train > 0, False)
    return {w: k for k, w in enumerate(words)}, np.append(np.log10(train + SMOOTHING), 0.0), np.append(logp, 0.0), known


def _sum_texts(token: str, shared):
    def run(batches):
        place, base, logp, known = held(token, shared, _head_of)
        for batch in batches:
            words, at, times, head = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                counted = Counter(_split(text) + [b""])
                n = np.fromiter(counted.values(), dtype=np.int64, count=len(counted))
                where = np.fromiter(map(place.get, counted, repeat(-1)), dtype=np.int64, count=len(counted))
                head.append((int(n.sum()), int(n[known[where]].sum()), float(n @ base[where]), float(n @ logp[where])))
                words.append(b" %d" % hash_of(batch.column("text_key")[k].as_py(), k))  # no word has a space: joins nothing
                at.append(k)
                times.append(0)
                rare = np.flatnonzero(where < 0).tolist()
                if rare:
                    distinct = list(counted)
                    words += [distinct[i] for i in rare]
                    at += [k] * len(rare)
                    times += n[rare].tolist()
            yield _rows(batch, words, at, times, head)

    return run


def hash_of(key: int, k: int) -> int:
    return (key * 31 + k) % 2**63


def _rows(batch, words, at, times, head) -> pa.RecordBatch:
    index, first = pa.array(at, pa.int64()), np.array(times) == 0
    columns = [batch.column(c).take(index) for c in ("doc_id", "text_key", "held_out")]
    spread = lambda i: np.where(first, np.array([h[i] for h in head])[np.array(at)], 0)
    columns += [pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.array(first.astype(np.int64))]
    columns += [pa.array(spread(0).astype(np.int64)), pa.array(spread(1).astype(np.int64)), pa.array(spread(2).astype(float)), pa.array(spread(3).astype(float))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "held_out", "word", "times", "rows", "n", "known", "base", "logp"])


def _head(priced: DataFrame, most: int) -> tuple[int, tuple]:
    """(least count, (words, train, logp)) of the most frequent words, at most ``most`` of them."""
    level = F.floor(F.log2("seen")).cast("int").alias("level")
    sizes = sorted(priced.groupBy(level).count().collect(), reverse=True)
    total, least = 0, 63
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    rows = priced.filter(F.col("seen") >= 2**least).select("word", "train", "logp").toArrow() if least < 63 else None
    if rows is None:
        return 2**62, ([], np.empty(0), np.empty(0))
    return 2**least, (rows.column("word").to_pylist(), rows.column("train").to_numpy(), rows.column("logp").to_numpy())


def lattice_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    rounds: int = ROUNDS,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(id as text) % folds == held_out are not learned from; a null id counts as
    the empty string.  Texts are lower-cased (A-Z) and split at white space; the end of a text
    is a token too.  ``base_score`` is a smoothed word unigram, ``score`` the lattice
    likelihood, both log10.  Counts and scores of the ``head_words`` most frequent words are
    given to each task, which sums them; all rarer words are joined by word.

    A null or empty text is an end alone.  Very long words take memory by their length times
    the longest piece.  Repeated rows each come back.  Without training rows all counts are 0
    and the vocabulary's own scores hold.  An empty table gives no rows.  Other columns are
    not read.  Runs jobs when called.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    keyed = with_text_key(docs, id_col, text, (remainder(docs[id_col], folds) == held_out).alias("held_out"))
    types = word_counts(keyed).checkpoint()
    pieces = read_pieces(vocabulary)
    scores, end = fit_scores(types, pieces, rounds)
    shared = spark.sparkContext.broadcast((pieces, scores, end))
    n, v, discount = count_discount(types)
    priced = types.mapInArrow(_price(shared, n, v, discount), "word binary, train long, seen long, logp double").checkpoint()
    least, head = _head(priced, head_words)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, held_out boolean, word binary, times long, rows long, n long, known long, base double, logp double"
    parts = keyed.mapInArrow(_sum_texts(uuid.uuid4().hex, spark.sparkContext.broadcast(head)), schema)
    rare = priced.filter(F.col("seen") < least).select("word", F.col("train").alias("c"), F.col("logp").alias("word_logp"))
    joined = parts.join(rare, "word", "left")
    count = F.coalesce("c", F.lit(0))
    summed = (
        joined.select(
            "doc_id", "text_key", "held_out", "rows", "n",
            (F.col("known") + F.when(count > 0, F.col("times")).otherwise(0)).alias("known"),
            (F.col("base") + F.col("times") * F.log10(count + SMOOTHING)).alias("base"),
            (F.col("logp") + F.col("times") * F.coalesce("word_logp", F.lit(0.0))).alias("logp"),
        )
        .groupBy("doc_id", "text_key", "held_out")
        .agg(*[F.sum(c).alias(c) for c in ("rows", "n", "known", "base", "logp")])
    )
    copies = F.col("rows")  # rows repeated as a whole were summed together
    total = math.log10(n + SMOOTHING * (v + 1))
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(
        "doc_id",
        "held_out",
        (F.col("n") / copies).cast("long").alias("n_tokens"),
        (F.col("known") / copies).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / copies - F.col("n") / copies * total).alias("base_score"),
        (F.col("logp") / copies).alias("score"),
    )
