"""Best-fit packing of tokenised documents into sequences, by a configuration linear program.

A sequence's configuration says how many pieces of each length it holds.  How often to use
which configuration is a covering program over the length histogram, which has at most
``capacity`` rows however many documents there are.  Multiplicative weights price the
lengths, a knapsack recursion finds the configurations worth most at these prices, and the
fractional solution is rounded; what is left over is packed best-fit.  Pieces are then dealt
to the places of their length by their rank.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairflow.llm.common import whole_text
from pairflow.operators.sizing import measured
from pairflow.session import ensure_checkpoint_dir

CAPACITY, END_ID = 4096, 1
ROUNDS, RATE, SLACK = 40, 12.0, 0.02
CACHE_WORDS, LONG_WORD = 400_000, 100
#: Punctuation that the tokenizer splits from a letter before it.
TAIL = b".,;:!?"
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
PLAIN = re.compile(f"[{LETTERS}]+")
PIECE = "piece int, start long, length long, ids_crc32 long, task int, pos long"


class WordIds(dict):
    """White-space separated words to the bytes of their ids; forgets all when it holds too many.

    The tokenizer drops white space and takes what stands between on its own, so a text's
    ids are those of its words.  ASCII capitals are lower-cased before, as it would itself.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(vocabulary)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Letters whose normal form is their lower case, as the model's alphabet writes it.
        self.letters = {ord(c): level.pre_tokenize_str(c.lower())[0][0] for c in LETTERS}
        self.packed = [np.array([i], dtype="<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text, core = word.decode(), word.rstrip(TAIL)
        if PLAIN.fullmatch(text):
            found = [t.id for t in self.tokenizer.model.tokenize(text.translate(self.letters))]
        elif core != word and PLAIN.fullmatch(core.decode()):
            return self.keep(word, self[core] + self[word[len(core) :]])
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.keep(word, b"".join([self.packed[i] for i in found]))

    def keep(self, word: bytes, value: bytes) -> bytes:
        if len(word) <= LONG_WORD:
            self[word] = value
        return value

    def of(self, text: bytes) -> bytes:
        # other white space is left to the tokenizer; tabs and line ends are spaces to it
        words = text.lower().translate(SPACES).split(b" ")
        return b"".join([self[w] for w in words if w])


SPACES = bytes.maketrans(b"\t\n\r", b"   ")


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def _cut(vocabulary, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        ids = word_ids(vocabulary.value)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, piece, start, length, crc, pos = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = memoryview(ids.of(text.as_buffer().to_pybytes()) + end)
                for k, first in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * first : 4 * (first + capacity)]
                    n = len(part) // 4
                    rows.append(i), piece.append(k), start.append(first), length.append(n)
                    crc.append(zlib.crc32(part)), pos.append(seen[n])
                    seen[n] += 1
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            arrays += [pa.array([task] * len(rows), pa.int32()), pa.array(pos, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "pos"])

    return run


def token_pieces(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, and the place (task, pos) among those of its length."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text).cast("binary").alias("text"))
    return whole.mapInArrow(_cut(vocabulary, capacity, end_id), f"doc_id {kind}, {PIECE}")


def best_fill(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack recursion: most value in each capacity, and the length it was reached with (0: as the capacity below).

    ``price`` by length, minus infinity where there is none.
    """
    most, with_ = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + most[c - 1 :: -1]
        k = int(value.argmax())
        if value[k] > most[c - 1]:
            most[c], with_[c] = value[k], k + 1
        else:
            most[c] = most[c - 1]
    return most, with_


def configurations(lengths: np.ndarray, with_: np.ndarray, last: np.ndarray) -> list[dict[int, int]]:
    """For each length, the most valuable configuration that has it; ``last``: the capacity up to which something fills each."""
    capacity = len(last) - 1
    found, state = [defaultdict(int) for _ in lengths], last[capacity - lengths]
    for i, n in enumerate(lengths.tolist()):
        found[i][n] += 1
    while True:
        alive = np.flatnonzero(state)
        if not len(alive):
            return found
        taken = with_[state[alive]]
        for i, n in zip(alive.tolist(), taken.tolist()):
            found[i][n] += 1
        state[alive] = last[state[alive] - taken]


def solve_configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE, slack: float = SLACK) -> tuple[dict[tuple, float], float]:
    """Configuration -> how often, covering ``counts`` (length -> pieces) in fractions, and a lower bound on the number of sequences.

    Prices start at the length.  In each round every length may be covered by a further
    1/``rounds``; all configurations within ``slack`` of the best are raised as far as this
    lets them, and prices fall by ``rate`` times what was covered beyond the round's share.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    wanted = np.array([counts[n] for n in lengths.tolist()], dtype=float)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    log_price, covered = np.log(lengths / capacity), np.zeros(len(lengths))
    used: dict[tuple, float] = defaultdict(float)
    bound = 0.0
    for t in range(1, rounds + 1):
        price = np.full(capacity + 1, -np.inf)
        price[lengths] = np.exp(log_price) * (1 + 1e-7 * lengths / capacity)  # of equal values, the longer piece
        most, with_ = best_fill(price, capacity)
        # no configuration is worth more than the best, so sequences number at least what all pieces are worth over it
        bound = max(bound, float((wanted * price[lengths]).sum() / most[capacity]))
        room = np.maximum(t / rounds - covered, 0) * wanted
        last = np.maximum.accumulate(np.where(with_ > 0, np.arange(capacity + 1), 0))
        value = price[lengths] + most[last[capacity - lengths]]
        good = np.flatnonzero((value >= (1 - slack) * most[capacity]) & (room > 0))
        good = good[np.argsort(-lengths[good], kind="stable")]
        gained = np.zeros(len(lengths))
        for held in configurations(lengths[good], with_, last):
            key = tuple(sorted((n, min(m, counts[n])) for n, m in held.items()))
            at = [place[n] for n, _ in key]
            step = min(room[i] / m for i, (_, m) in zip(at, key))
            if step <= 0:
                continue
            used[key] += step
            for i, (_, m) in zip(at, key):
                room[i] -= step * m
                gained[i] += step * m
        covered += gained / wanted
        log_price += rate * (1 / rounds - gained / wanted)
        log_price -= log_price.max()
    return used, bound


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram: (sequences, what each holds).  Equal sequences are handled together."""
    open_: dict[int, list] = defaultdict(list)  # free room -> (sequences, (held below, length, pieces))
    for n in sorted(counts, reverse=True):
        left = counts[n]
        rooms = sorted(r for r in open_ if r >= n)
        while left:
            if rooms:
                room = rooms[0]
                many, held = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[0]
            else:
                room, many, held = capacity, left, None
            each = room // n
            full = min(many, left // each)
            if full:
                open_[room - each * n].append((full, (held, n, each)))
            left -= full * each
            many -= full
            if many and 0 < left < each:
                open_[room - left * n].append((1, (held, n, left)))
                many, left = many - 1, 0
            if many and held is not None:
                open_[room].append((many, held))
    done = []
    for groups in open_.values():
        for many, held in groups:
            content = {}
            while held is not None:
                held, n, m = held
                content[n] = content.get(n, 0) + m
            done.append((many, content))
    return done


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """(sequences, what each holds) for length -> pieces, and a lower bound on their number.

    The fractional solution is rounded up, fullest configurations first, as far as pieces
    are left; the rest is packed best-fit.
    """
    if not counts:
        return [], 0.0
    left, groups = dict(counts), []
    used, bound = solve_configurations(counts, capacity)
    fill = lambda key: sum(n * m for n, m in key)
    for key, times in sorted(used.items(), key=lambda x: (-fill(x[0]), -x[1], x[0])):
        many = min(int(np.ceil(times - 1e-9)), min(left[n] // m for n, m in key))
        if many > 0 and fill(key) > capacity * (1 - SLACK):
            groups.append((many, dict(key)))
            for n, m in key:
                left[n] -= many * m
    return groups + best_fit({n: m for n, m in left.items() if m}, capacity), bound


def places(groups: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Runs of ranks by length: pieces ``first`` on of a length lie ``each`` to a sequence from ``sequence`` on, at ``base``."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for many, held in groups:
        base = 0
        for n in sorted(held, reverse=True):
            rows.append((n, ranks[n], held[n], sequence, base))
            ranks[n] += many * held[n]
            base += n * held[n]
        sequence += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "base"), table.T))


def _place(runs):
    def run(batches):
        p = runs.value
        start = np.searchsorted(p["length"], np.arange(p["length"].max(initial=0) + 2))
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(n), dtype=np.int64)
            order = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.diff(n[order], prepend=-1))
            for same in np.split(order, edges[1:]):
                if len(same):
                    low, high = start[n[same[0]]], start[n[same[0]] + 1]
                    at[same] = low + np.searchsorted(p["first"][low:high], rank[same], side="right") - 1
            within = rank - p["first"][at]
            sequence = p["sequence"][at] + within // p["each"][at]
            offset = p["base"][at] + within % p["each"][at] * n
            keep = batch.drop_columns(["rank"])
            arrays = [*keep.columns, pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids by the tokenizer of ``vocabulary_path`` (special tokens are
    not added) and ``end_id``; longer ones than ``capacity`` are cut, others stay whole.  A
    null or empty text is the end id alone.  Null ids and repeated rows are documents like
    others.  Pieces of a sequence lie one after the other from 0.  Which of the pieces of a
    length goes where is open.  An empty table gives no rows; other columns are not read.

    Only the length histogram (``capacity`` rows at most) comes to the driver; the places
    sent back are bounded by rounds, lengths and pieces of a configuration, not by the
    documents.  Runs jobs when called.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    pieces = token_pieces(docs, vocabulary_path, id_col, text, capacity, end_id).checkpoint()
    tallies = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("task")
    offsets = measured(tallies.select("task", "length", "n", (F.sum("n").over(upto) - F.col("n")).alias("before")))
    counts = {int(r[0]): int(r[1]) for r in offsets.groupBy("length").agg(F.sum("n")).collect()}
    groups, _ = pack_histogram(counts, capacity)
    runs = spark.sparkContext.broadcast(places(groups))
    rank = (F.col("before") + F.col("pos")).alias("rank")
    ranked = pieces.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", rank)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(runs), schema)
