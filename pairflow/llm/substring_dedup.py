"""Repeated passages by sharded Aho-Corasick automata.

Each window of ``WINDOW`` words has an anchor: the run of ``ANCHOR`` words in it with the
least hash.  Equal windows have equal anchors at equal places, so only anchors that occur
more than once can lie in a repeated window; counting them leaves the candidate passages.
Those passages, from all documents, are dealt to shards by anchor.  A shard confirms which
windows recur, compiles them into an automaton over words, and streams its passages through
it to locate every occurrence; the first occurrence of a window stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairflow.llm.common import with_text_key
from pairflow.llm.shingles import U64, WordHashes, gram_hashes
from pairflow.operators.sizing import measured
from pairflow.session import ensure_checkpoint_dir

WINDOW, ANCHOR = 20, 8
SHARD_BYTES = 4_000_000
#: Windows of anchors that occur more often are dealt out one by one, by their content.
HOT_ANCHOR = 5_000
KEY = ["doc_id", "text_key"]


def anchor_runs(words: list[bytes], hashes: WordHashes, window: int, anchor: int):
    """(anchor hash, first window, windows) of each run of windows that have their anchor in one place."""
    if len(words) < window:
        return (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32))
    h = gram_hashes(hashes.of(words), anchor)
    view = np.lib.stride_tricks.sliding_window_view(h, window - anchor + 1)
    place = np.arange(len(view)) + view.argmin(axis=1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return h[place[first]].view(np.int64), first.astype(np.int32), np.diff(first, append=len(place)).astype(np.int32)


def _anchors(window: int, anchor: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            runs = [anchor_runs(t.encode().split(), hashes, window, anchor) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in runs], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], names=[*KEY, "anchor", "first", "windows"])

    return run


def _passages(window: int, shards: int):
    """Candidate passages with the first place each has in the batch: copies in a batch leave it once."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, keys, found = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), {}
            for i, key, text, runs in zip(ids, keys, batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = text.encode().split()
                for r in runs or ():
                    lo, n, anchor = r["first"], r["windows"], r["anchor"]
                    for at, count in ((s, 1) for s in range(lo, lo + n)) if r["hot"] else ((lo, n),):
                        passage = b" ".join(words[at : at + count + window - 1])
                        place = (i, key, at)
                        entry = (hashes[passage] if r["hot"] else anchor) % shards, anchor, passage
                        if entry not in found or place < found[entry][0]:
                            found[entry] = (place, count)
            columns = list(zip(*((s, a, p, *place, n) for (s, a, p), (place, n) in found.items()))) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32())
            hashes.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "anchor", "passage", *KEY, "first", "windows"]
            )

    return run


def recurring_windows(passages: list[tuple[int, ...]], window: int) -> set[tuple[int, ...]]:
    """The windows that occur in more than one place of the passages (tuples of word numbers)."""
    once, more = set(), set()
    for p in passages:
        for j in range(len(p) - window + 1):
            w = p[j : j + window]
            (more if w in once else once).add(w)
    return more


def first_places(passages: list[tuple[int, ...]], places: list[tuple], window: int) -> list[int]:
    """For each passage, a bit for each of its windows that is the first occurrence; ``places`` tell where passages start, in order."""
    import ahocorasick

    patterns = list(recurring_windows(passages, window))
    masks = [(1 << (len(p) - window + 1)) - 1 for p in passages]
    if not patterns:
        return masks
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, pattern in enumerate(patterns):
        automaton.add_word(pattern, k)
    automaton.make_automaton()
    seen: list[tuple | None] = [None] * len(patterns)
    for k, passage in enumerate(passages):
        doc, key, first = places[k]
        for end, pattern in automaton.iter(passage):
            j = end - window + 1
            place = (doc, key, first + j)
            best = seen[pattern]
            if best is None or place < best[0]:
                if best is not None:
                    masks[best[1]] &= ~(1 << best[2])
                seen[pattern] = (place, k, j)
            else:
                masks[k] &= ~(1 << j)
    return masks


def _locate(window: int):
    def run(table: pa.Table) -> pa.Table:
        by_anchor: dict[int, dict[bytes, tuple]] = {}
        columns = [table.column(c).to_pylist() for c in ("anchor", "passage", *KEY, "first", "windows")]
        for anchor, passage, i, key, first, n in zip(*columns):
            of = by_anchor.setdefault(anchor, {})
            place = (i, key, first)
            if passage not in of or place < of[passage]:
                of[passage] = place
        numbers: dict[bytes, int] = {}
        passages, places, out = [], [], []
        for of in by_anchor.values():
            if len(of) == 1:  # one passage only: its first place is the first of all its windows
                (passage, place), = of.items()
                out.append((*place, (1 << (passage.count(b" ") + 2 - window)) - 1))
                continue
            for passage, place in of.items():
                passages.append(tuple(numbers.setdefault(w, len(numbers)) for w in passage.split()))
                places.append(place)
        out += [(*place, mask) for place, mask in zip(places, first_places(passages, places, window)) if mask]
        kinds = [table.schema.field(c).type for c in (*KEY, "first")] + [pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)]
        return pa.Table.from_arrays(arrays, names=[*KEY, "first", "mask"])

    return run


def covered(n_words: int, runs, firsts, window: int) -> np.ndarray:
    """Which words lie in a window that is not the first of its kind."""
    again = np.zeros(max(n_words - window + 1, 0), dtype=bool)
    for r in runs or ():
        again[r["first"] : r["first"] + r["windows"]] = True
    for f in firsts or ():
        mask, at = f["mask"], f["first"]
        while mask:
            if mask & 1:
                again[at] = False
            mask, at = mask >> 1, at + 1
    edges = np.zeros(n_words + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _cut(window: int):
    def run(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, copy, runs, firsts in zip(*(batch.column(c).to_pylist() for c in ("text", "is_copy", "runs", "firsts"))):
                words = text.encode().split()
                if copy and len(words) >= window:
                    rest = []
                elif runs:
                    gone = covered(len(words), runs, firsts, window)
                    rest = [w for w, g in zip(words, gone) if not g]
                else:
                    rest = words
                sizes.append(len(words))
                removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, one space between).

    A word goes when a window of ``window`` words that covers it also starts earlier, in a
    document of smaller id or before in the same one; windows are judged on the input.  Of
    equal texts only the first is searched.  Null or empty texts have no words.  A row with a
    null id has no place in the order: it loses nothing and lends nothing.  Rows that repeat
    an id with another text follow each other by a hash of the text; fully repeated rows are
    one document and come back alike.  An empty table gives no rows; other columns are not
    read.  ``window - anchor`` must be under 63.  Runs jobs when called.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = with_text_key(docs, id_col, text)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    ordered = keyed.filter("doc_id is not null")
    digests = ordered.select(*KEY, F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("bytes"))
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("bytes").alias("bytes")).checkpoint()
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    several = measured(groups.filter("least < most").select("digest", "least"))
    copies = measured(digests.join(several, "digest").filter("doc_id > least").select(*KEY).distinct().withColumn("is_copy", F.lit(True)))

    marked = keyed.join(copies, KEY, "left").withColumn("is_copy", F.coalesce("is_copy", F.lit(False)))
    own = marked.filter("not is_copy and doc_id is not null")
    runs = (
        own.select(*KEY, "text")
        .mapInArrow(_anchors(window, anchor), f"doc_id {kind}, text_key long, anchor array<long>, first array<int>, windows array<int>")
        .select(*KEY, F.explode(F.arrays_zip("anchor", "first", "windows")).alias("r"))
        .select(*KEY, "r.anchor", "r.first", "r.windows")
    )
    counts = runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    recurring = counts.select("anchor", (F.col("n") > HOT_ANCHOR).alias("hot")).checkpoint()
    per_doc = (
        runs.join(recurring, "anchor")
        .groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "first", "windows", "hot")).alias("runs"))
    )
    texts = marked.alias("t").join(per_doc.alias("r"), F.expr("t.doc_id = r.doc_id and t.text_key = r.text_key"), "left").select("t.*", "runs")
    passages = (
        texts.select(*KEY, "text", "is_copy", "runs")  # the columns read below too, so that texts are dealt out once
        .mapInArrow(_passages(window, shards), f"shard long, anchor long, passage binary, doc_id {kind}, text_key long, first int, windows int")
    )
    firsts = (
        passages.groupBy("shard").applyInArrow(_locate(window), f"doc_id {kind}, text_key long, first int, mask long")
        .groupBy(*KEY).agg(F.collect_list(F.struct("first", "mask")).alias("firsts"))
    )
    joined = texts.alias("t").join(firsts.alias("f"), F.expr("t.doc_id = f.doc_id and t.text_key = f.text_key"), "left")
    return joined.select("t.doc_id", "t.text", "t.is_copy", "t.runs", "f.firsts").mapInArrow(
        _cut(window), f"doc_id {kind}, n_words long, n_removed long, kept string"
    )
