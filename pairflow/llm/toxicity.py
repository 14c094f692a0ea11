"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every word of a text is a component of its vector; how many documents hold a word is counted
over all documents, and words that tell the labels apart weigh more.  The examples sit in an inverted index: per term its postings, cut into
blocks of examples with the largest weight of each block.  A query rates the blocks of the
best bounds first and then all others that can still beat the neighbours found, so the
neighbours are exact.  Tasks hold the words of the examples only; what a text's other words
add to its norm is joined from the table of word weights.  Neighbours vote with weights that fall
with distance, and votes are calibrated on the examples, each left out of its own neighbours.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pairflow.llm.common import remainder, slices_of, whole_text, with_text_key
from pairflow.operators.sizing import measured
from pairflow.session import ensure_checkpoint_dir, give_back_memory

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Bound of the labelled rows that every task holds.
MAX_EXAMPLES = 2048
#: Factor of a word that tells nothing about the label, and the likelihood ratio (chance: one word in a million) that counts half.
LEAST, HALF_RATIO = 0.02, 24.0
NEIGHBOURS, BLOCK = 15, 64
#: Terms in more than one of so many examples are held as rows of a matrix; frequent words whose weights every task holds.
OFTEN, HEAD_WORDS = 16, 100_000
#: Blocks that a query rates before it has a neighbour to beat.
FIRST_BLOCKS = 4
FLUSH_WORDS = 300_000
#: Words and postings that a task takes at a time, one text at least.
CHUNK_WORDS, CHUNK_POSTINGS = 1 << 16, 1 << 17
#: The lower case of each Latin-1 character, or a space for one that is in no word.
LATIN = bytes(ord(c) if WORD.match(c) else 32 for c in "".join(map(chr, range(256))).lower())


def words_of(text: str) -> list[str]:
    """``WORD`` in the lower-cased text; by a table of characters unless one is beyond Latin-1."""
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def words_in(batches):
    """(rows, distinct words, row and word of each word in the rows), of ``CHUNK_WORDS`` words and the rest of a row at most."""
    for batch in slices_of(batches):
        texts, start = batch.column("text").to_pylist(), 0
        while start < len(texts):
            number, codes, total = defaultdict(itertools.count().__next__), [], 0
            while start + len(codes) < len(texts) and total < CHUNK_WORDS:
                found = words_of(texts[start + len(codes)])
                codes.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
                total += len(found)
            rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            yield batch.slice(start, len(codes)), list(number), rows, np.concatenate(codes)
            start += len(codes)


def tallied(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, times) of the distinct codes of each row, by row and code."""
    pairs, times = np.unique(rows << 32 | codes, return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, times


def _count_words(batches):
    """Rows, toxic rows and labelled rows that hold a word, combined before they leave the task; the empty word counts all rows."""
    number, counts = {}, np.zeros((3, 0), dtype=np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(number, pa.string()), *map(pa.array, counts[:, : len(number)])], names=["word", "docs", "toxic", "seen"])

    for batch, words, row, codes in words_in(batches):
        words.append("")
        label = pc.fill_null(batch.column("toxic"), -1).to_numpy(zero_copy_only=False)
        toxic, seen = label == 1, label >= 0
        row, code, _ = tallied(row, codes)
        place = np.array([number.setdefault(w, len(number)) for w in words])
        if len(number) > counts.shape[1]:
            counts = np.pad(counts, ((0, 0), (0, len(number) * 5 // 4 + 1 - counts.shape[1])))
        for into, of, n in zip(counts, (code, code[toxic[row]], code[seen[row]]), (len(label), toxic.sum(), seen.sum())):
            into[place] += np.bincount(of, minlength=len(words))
            into[place[-1]] += n
        if len(number) > FLUSH_WORDS:
            yield rows()
            number, counts = {}, np.zeros((3, 0), dtype=np.int64)
    yield rows()


def word_weights(texts: DataFrame) -> DataFrame:
    """word, weight, docs of every word of ``texts`` (text, toxic): idf over all of them, times how well it tells the labels apart.

    A null label teaches nothing.  The second factor rises smoothly with the likelihood ratio of the word and the label, from
    ``LEAST`` for a word that tells nothing or is in no labelled row, to 1; no word is left out.
    """
    counted = texts.select("text", "toxic").mapInArrow(_count_words, "word string, docs long, toxic long, seen long")
    counts = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "seen")]).checkpoint()
    _, docs, toxic, n = counts.filter("word = ''").first() or ("", 0, 0, 0)
    seen, bad = F.col("seen"), F.col("toxic")
    rate = seen / F.lit(max(n, 1))
    part = lambda got, of: F.when((got > 0) & (of > 0), got * F.log(got / of)).otherwise(0.0)
    ratio = 2 * (
        part(bad, rate * toxic) + part(seen - bad, rate * (n - toxic))
        + part(toxic - bad, (1 - rate) * toxic) + part(n - toxic - seen + bad, (1 - rate) * (n - toxic))
    )
    ratio = F.greatest(ratio, F.lit(0.0))
    idf = F.log((1 + F.lit(docs)) / (1 + F.col("docs"))) + 1
    tells = LEAST + (1 - LEAST) * F.pow(ratio / (ratio + HALF_RATIO), 2)
    return counts.filter("word <> ''").select("word", (idf * tells).alias("weight"), "docs")


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the given ranges, one range after the other, and the range of each."""
    lengths = ends - starts
    of = np.repeat(np.arange(len(starts)), lengths)
    return (starts - np.cumsum(lengths) + lengths)[of] + np.arange(len(of)), of


class BlockMaxIndex:
    """Postings of example vectors by term, cut into blocks of examples with the largest weight of each."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list):
        rows, terms = np.nonzero(vectors)
        self._build(rows, terms, vectors[rows, terms], vectors.shape[1], labels, ids)

    @classmethod
    def of_postings(cls, rows, terms, weights, n_terms: int, labels: np.ndarray, ids: list) -> BlockMaxIndex:
        made = cls.__new__(cls)
        made._build(rows, terms, weights, n_terms, labels, ids)
        return made

    def _build(self, rows, terms, weights, n_terms, labels, ids):
        n, kind = len(labels), np.zeros(len(labels), dtype=int)
        rise = np.argsort(weights, kind="stable")
        kind[rows[rise]] = terms[rise]  # the heaviest term of each example; like examples share blocks
        order = np.lexsort((np.arange(n), kind))
        place = np.empty(n, dtype=int)
        place[order] = np.arange(n)
        self.labels, self.ids = labels[order], [ids[k] for k in order]
        rows = place[rows]
        self.n_blocks = -(-n // BLOCK)
        # the vectors by example, to leave each out in turn
        by_row = np.lexsort((terms, rows))
        self.row_terms, self.row_weights = terms[by_row], weights[by_row]
        self.row_starts = np.searchsorted(rows[by_row], np.arange(n + 1))
        # terms in many examples are added for all of them at once
        often = np.bincount(terms, minlength=n_terms) * OFTEN > max(n, 1)
        self.dense_of = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.n_blocks * BLOCK))
        self.dense[self.dense_of[terms[often[terms]]], rows[often[terms]]] = weights[often[terms]]
        rows, weights, terms = (v[~often[terms]] for v in (rows, weights, terms))
        by_term = np.lexsort((rows, terms))
        self.row, self.weight, terms = rows[by_term], weights[by_term], terms[by_term]
        cut = np.flatnonzero(np.diff(terms * max(self.n_blocks, 1) + self.row // BLOCK, prepend=-1))
        self.starts = np.append(cut, len(terms))
        self.block = self.row[cut] // BLOCK
        self.most = np.maximum.reduceat(self.weight, cut) if len(cut) else np.empty(0)
        self.first = np.searchsorted(terms[cut], np.arange(n_terms + 1))

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int, leave=-1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, products) of the k nearest with a positive product, without ``leave``; of equal ones the first examples."""
        at, out = np.asarray(at, dtype=int), np.atleast_1d(leave)
        leave = np.array([(0, x) for x in out if x >= 0], dtype=int).reshape(-1, 2)
        return self.nearest_of(np.zeros(len(at), dtype=int), at, np.asarray(weights, dtype=float), 1, k, leave)[1:]

    def nearest_of(self, query: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int, k: int, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, example, product) of the nearest of ``n`` queries, as of :meth:`nearest`; by query, the nearest first.

        ``query`` tells whose the distinct terms ``at`` are and never falls; ``leave`` has pairs of a query and an
        example.  As many queries are rated together as have ``CHUNK_POSTINGS`` postings.
        """
        n_postings = (self.starts[self.first[at + 1]] - self.starts[self.first[at]]) if len(at) else at
        effort = len(self.labels) + np.bincount(query, weights=n_postings, minlength=n)
        part = (np.cumsum(effort) - effort) // CHUNK_POSTINGS
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), n]
        found = [(np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0))]
        for low, high in zip(cuts, cuts[1:]):
            own = slice(*np.searchsorted(query, (low, high)))
            out = leave[(leave[:, 0] >= low) & (leave[:, 0] < high)]
            q, examples, products = self._rate(query[own] - low, at[own], weights[own], high - low, k, (out[:, 0] - low, out[:, 1]))
            found.append((q + low, examples, products))
        return tuple(map(np.concatenate, zip(*found)))

    def _rate(self, query, at, weights, n: int, k: int, leave) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.labels):
            return np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0)
        size = self.n_blocks * BLOCK
        dense = self.dense_of[at]
        often, frequent = dense >= 0, np.zeros((n, len(self.dense)))
        frequent[query[often], dense[often]] = weights[often]
        base = (frequent @ self.dense).reshape(n, self.n_blocks, BLOCK)
        query, at, weights = query[~often], at[~often], weights[~often]
        cells, of = ranges(self.first[at], self.first[at + 1])
        query, weights = query[of], weights[of]
        place = query * self.n_blocks + self.block[cells]
        bound = np.bincount(place, weights=self.most[cells] * weights, minlength=n * self.n_blocks).reshape(n, -1) + base.max(axis=2)
        best = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, best, True, axis=1)
        products, worst = np.zeros(base.shape), np.zeros((n, 1))
        for turn in (first, ~first):
            wanted = turn & (bound > 0) & (bound >= worst - 1e-12)
            use = np.flatnonzero(wanted.ravel()[place])
            entries, of = ranges(self.starts[cells[use]], self.starts[cells[use] + 1])
            of = use[of]
            close = np.bincount(query[of] * size + self.row[entries], weights=self.weight[entries] * weights[of], minlength=n * size)
            products += np.where(wanted[:, :, None], close.reshape(base.shape) + base, 0.0)
            products.reshape(n, size)[leave] = 0.0
            if turn is first:
                found = np.take_along_axis(products, best[:, :, None], axis=1).reshape(n, -1)
                if found.shape[1] > k:
                    worst = np.maximum(np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k, None], 0.0)
        products = products.reshape(n, size)
        query, examples = np.nonzero((products > 0) & (products >= worst - 1e-9))
        products = products[query, examples]
        order = np.lexsort((examples, -np.round(products, 12), query))
        query, examples, products = query[order], examples[order], products[order]
        top = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[top], examples[top], products[top]


class ToxicityModel:
    def __init__(self, words: list[str], weights: np.ndarray, index: BlockMaxIndex, rate: float, blank_rate: float, stands_for: np.ndarray, k: int = NEIGHBOURS):
        self.words, self.weights, self.index, self.k = words, weights, index, k
        self.rate, self.blank_rate, self.stands_for = rate, blank_rate, stands_for
        self.steps = self.lookup = None

    def look_up(self, head: pa.Table) -> tuple[dict, np.ndarray, dict]:
        """Numbers of the words of examples and then of the words of ``head``, their weights, and the examples by id.

        Made once a process, and kept with the model, so that a worker gives both up when it is sent other work.
        """
        if self.lookup is None:
            number = {w: k for k, w in enumerate(self.words)}
            frequent = [(w, x) for w, x in zip(head.column("word").to_pylist(), head.column("weight").to_pylist()) if w not in number]
            number |= {w: len(number) + k for k, (w, _) in enumerate(frequent)}
            place: dict = {}
            for k, x in enumerate(self.index.ids):
                place.setdefault(x, []).append(k)
            self.lookup = number, np.append(self.weights, [x for _, x in frequent]), place
        return self.lookup

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Weighted share of toxic neighbours; a weight falls with distance, and counts the rows that an example stands for."""
        labels = self.index.labels[found]
        w = self.stands_for[labels.astype(int)] * cosines / (1.02 - np.minimum(cosines, 1.0))
        return float(w @ labels / w.sum()) if len(found) else self.rate

    def calibrate(self) -> None:
        """Isotonic steps from votes to observed rates, from the examples, each without itself."""
        labels = self.index.labels
        rows = np.arange(len(labels))
        of = np.repeat(rows, np.diff(self.index.row_starts))
        query, found, products = self.index.nearest_of(of, self.index.row_terms, self.index.row_weights, len(rows), self.k, np.stack([rows, rows], axis=1))
        ends = np.searchsorted(query, rows[1:])
        votes = [self.vote(*near) for near in zip(np.split(found, ends), np.split(products, ends))] if len(rows) else []
        self.steps = isotonic(np.array(votes), labels, self.stands_for[labels.astype(int)])

    def score(self, found: np.ndarray, cosines: np.ndarray) -> float:
        share = self.vote(found, cosines)
        x, y = self.steps
        # steps give the rate; a little of the vote keeps the order within a step
        return float(min(1.0, max(0.0, 0.98 * np.interp(share, x, y) + 0.02 * share))) if len(x) else share


def isotonic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; mean x and rate of each step, the rates drawn in a little."""
    pools: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    for a, b, w in zip(x[order], y[order], weights[order]):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])


def fit_toxicity(weights: DataFrame, train: DataFrame, most_examples: int = MAX_EXAMPLES) -> ToxicityModel:
    """Model from labelled rows ``train`` (doc_id, text, toxic) and the weights of all words.

    The index holds at most ``most_examples`` rows that have a word, half of each label if
    there are as many, in the order of a hash of id and text, with all their words.
    """

    def vectors(batches):
        for batch in slices_of(batches):
            found = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            columns = [batch.column(c).take(of) for c in ("doc_id", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([w for f in found for w in f], pa.string()), pa.array([n for f in found for n in f.values()], pa.int32())],
                names=["doc_id", "rank", "word", "n"],
            )

    def has_word(batches):
        for batch in slices_of(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), batch.column("toxic"), pa.array([bool(WORD.search(t)) for t in batch.column("text").to_pylist()], pa.bool_())],
                names=["doc_id", "text", "toxic", "worded"],
            )

    kind = train.schema["doc_id"].dataType.simpleString()
    seen = train.select("doc_id", "text", "toxic").mapInArrow(has_word, f"doc_id {kind}, text string, toxic int, worded boolean")
    ranked = seen.select("doc_id", "toxic", "worded", F.xxhash64("doc_id", "text").alias("rank")).checkpoint()
    total, toxic, blank, blank_toxic = ranked.agg(F.count("*"), F.sum("toxic"), F.count_if(~F.col("worded")), F.sum(F.when(~F.col("worded"), F.col("toxic")))).first()
    chosen = None
    for label in (0, 1):
        of = ranked.filter(F.col("worded") & (F.col("toxic") == label)).orderBy("rank", "doc_id").limit(most_examples // 2)
        chosen = of if chosen is None else chosen.unionByName(of)
    chosen = chosen.select("doc_id", "toxic", "rank").checkpoint()
    texts = train.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rank")).join(measured(chosen.select("rank").distinct()), "rank", "left_semi")
    texts = texts.dropDuplicates(["doc_id", "rank"]).select("doc_id", "rank", "text")  # of equal rows one is fetched
    listed = texts.mapInArrow(vectors, f"doc_id {kind}, rank long, word string, n int").toArrow()
    rows = chosen.orderBy("toxic", "rank", "doc_id").collect()
    rate = ((toxic or 0) + 0.5) / ((total or 0) + 1)
    blank_rate = ((blank_toxic or 0) + 0.5 * rate) / ((blank or 0) + 0.5)
    if not toxic or toxic == total:
        rows, blank_rate = [], rate
    # equal rows share a vector; what no row of the index has is left out
    first = {}
    for k, r in enumerate(rows):
        first.setdefault((r["doc_id"], r["rank"]), []).append(k)
    coded = listed.column("word").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    rising = pc.sort_indices(coded.dictionary)
    words, of_word = coded.dictionary.take(rising)[: None if rows else 0], np.zeros(0)
    if len(words):  # the words are few, the weights many: these stay where they are
        own = train.sparkSession.createDataFrame(pa.table({"word": words}))
        held = weights.join(F.broadcast(own), "word").select("word", "weight").toArrow()
        of_word = held.column("weight").to_numpy()[pc.index_in(words, value_set=held.column("word").combine_chunks()).to_numpy()]
    owner = [first.get(x, []) for x in zip(listed.column("doc_id").to_pylist(), listed.column("rank").to_pylist())]
    entry = np.repeat(np.arange(len(owner)), [len(o) for o in owner]).astype(int)
    row_of = np.array([k for o in owner for k in o], dtype=int)
    code = np.argsort(rising.to_numpy())[coded.indices.to_numpy()]
    order = np.lexsort((code[entry], row_of))  # whatever order the rows came in
    entry, row_of = entry[order], row_of[order]
    term_of = code[entry]
    weight = listed.column("n").to_numpy().astype(float)[entry] * of_word[term_of]
    norms = np.sqrt(np.bincount(row_of, weights=weight**2, minlength=len(rows)))
    labels = np.array([r["toxic"] for r in rows], dtype=float)
    index = BlockMaxIndex.of_postings(row_of, term_of, weight / norms[row_of], len(words), labels, [(r["doc_id"], r["rank"]) for r in rows])
    with_word = np.array([total - blank - (toxic or 0) + (blank_toxic or 0), (toxic or 0) - (blank_toxic or 0)])
    stands_for = with_word / np.maximum(np.bincount(labels.astype(int), minlength=2), 1)
    model = ToxicityModel(words.to_pylist(), of_word, index, rate, blank_rate, stands_for)
    model.calibrate()
    return model


def fitted(weights: DataFrame, train: DataFrame) -> tuple[ToxicityModel, pa.Table]:
    """What a task of the search holds: the model, and the most frequent words with their weights."""
    # a row for each number of documents that words have, so that few words are ordered below
    by_docs = weights.groupBy("docs").count().select("docs", F.sum("count").over(Window.orderBy(F.desc("docs"))).alias("words"))
    fewest = by_docs.filter(F.col("words") >= HEAD_WORDS).agg(F.max("docs")).first()[0] or 0
    head = weights.filter(F.col("docs") >= fewest).orderBy(F.desc("docs"), "word").limit(HEAD_WORDS).select("word", "weight")
    return fit_toxicity(weights, train), head.toArrow()


def _search(shared, columns: list[str]):
    """For each row its nearest examples by product, the squared norm of the words of examples, and the other words, joined by spaces."""

    def run(batches):
        model, head = shared.value
        number, weight_of, place = model.look_up(head)
        for batch, words, owner, codes in words_in(batches):
            n, number_of = batch.num_rows, np.array([number.get(w, -1) for w in words], dtype=np.int64)
            worded = np.bincount(owner, minlength=n) > 0
            owner, codes, times = tallied(owner, codes)
            numbers = number_of[codes]
            held = np.flatnonzero(numbers >= 0)
            held = held[np.lexsort((numbers[held], owner[held]))]
            row, code, times_held = owner[held], numbers[held], times[held]
            weights = times_held * weight_of[code]
            known, example = np.bincount(row, weights=weights**2, minlength=n), code < len(model.words)
            keys = enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("rank").to_pylist()))
            # a row's own label says nothing about it
            leave = np.array([(k, x) for k, key in keys for x in place.get(key, ())], dtype=int).reshape(-1, 2)
            query, found, products = model.index.nearest_of(row[example], code[example], weights[example], n, model.k, leave)
            other = numbers < 0
            lists = lambda rows, values: pa.ListArray.from_arrays(np.append(0, np.bincount(rows, minlength=n).cumsum()).astype(np.int32), values)
            made = [
                pa.array(worded),
                lists(query, pa.array(found, pa.int32())),
                lists(query, pa.array(products, pa.float64())),
                pa.array(known, pa.float64()),
                pc.binary_join(lists(owner[other], pa.array(words, pa.string()).take(pa.array(codes[other]))), " "),
                lists(owner[other], pa.array(times[other], pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=[*columns, "worded", "found", "products", "known", "other", "times"])

    return run


def toxicity_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, text_key, held_out, s (score and evidence) of each row, by a model fitted on the labelled rows that are not held out."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = labelled(docs, labels, id_col, text, label)
    weights = word_weights(rows)
    train = rows.filter((remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
    shared = spark.sparkContext.broadcast(fitted(weights, train))
    give_back_memory()
    whole = whole_text(docs, text)
    held_out, rank = (remainder(docs[id_col], FOLDS) == HELD_OUT).alias("held_out"), F.xxhash64(docs[id_col], whole).alias("rank")
    keyed = with_text_key(docs, id_col, text, held_out, rank)
    columns, kind = ["doc_id", "text_key", "held_out"], docs.schema[id_col].dataType.simpleString()
    searched = keyed.mapInArrow(
        _search(shared, columns),
        f"doc_id {kind}, text_key long, held_out boolean, worded boolean, found array<int>, products array<double>, known double, other string, times array<int>",
    )
    searched = searched.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    listed = searched.select("row", F.explode(F.arrays_zip(F.split("other", " ").alias("word"), F.col("times").alias("n"))).alias("o"))
    others = listed.select("row", "o.word", "o.n")
    rest = others.join(weights.select("word", "weight"), "word").groupBy("row").agg(F.sum(F.pow(F.col("n") * F.col("weight"), 2)).alias("rest"))

    @F.pandas_udf("score double, evidence array<struct<doc_id:string,cosine:double>>")
    def score(worded: pd.Series, found: pd.Series, products: pd.Series, squared: pd.Series) -> pd.DataFrame:
        (model, _), scores, evidence = shared.value, [], []
        for has_word, near, close, norm in zip(worded, found, products, squared):
            near, cosines = np.asarray(near, dtype=int), np.asarray(close, dtype=float) / np.sqrt(norm or 1.0)
            scores.append(model.score(near, cosines) if has_word else model.blank_rate)
            evidence.append([{"doc_id": str(model.index.ids[k][0]), "cosine": round(float(c), 6)} for k, c in zip(near[:3], cosines[:3])])
        return pd.DataFrame({"score": scores, "evidence": evidence})

    joined = searched.drop("other", "times").join(rest, "row", "left")
    return joined.select(*columns, score("worded", "found", "products", F.col("known") + F.coalesce("rest", F.lit(0.0))).alias("s"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """doc_id, text, toxic of all rows; toxic is null for those not to learn from, such as rows labelled both ways or neither."""
    one = (
        labels.select(labels[id_col].alias("doc_id"), labels[label].cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most").drop("most")
        .filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    texts = docs.select(docs[id_col].alias("doc_id"), whole_text(docs, text).alias("text"))
    return texts.join(measured(one), "doc_id", "left").select("doc_id", "text", "toxic")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence.

    Labels count only where crc32(id as text) % 3 is not 1; an id labelled both 0 and 1, a null
    label and a null id teach nothing.  ``score`` is in 0..1; a text without words, such as a
    null or empty one, gets the rate of such training rows; one that shares no word with an
    example has no neighbours and votes as the training rows do on average.  ``evidence``
    names the nearest examples and their cosines.  Repeated rows each come back and count as
    documents.  Without labels of both kinds every score is the rate; an empty table gives no
    rows.  Other columns are not read.  Runs jobs when called.
    """
    rates = toxicity_rates(docs, labels, id_col, text, label)
    return rates.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.evidence")
