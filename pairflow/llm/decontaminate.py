"""Benchmark decontamination by a positional inverted index.

Training token postings (term, document, position) are stored for every term that occurs in
the benchmark; postings of other terms are never asked for.  A benchmark window is looked up
from its rarest term: the offset-adjusted list of that term gives places where the window
could start, the list of the next rarest term is intersected with it, and the few places
left are confirmed against the lists of all other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairflow.llm.common import ascii_lower, with_text_key
from pairflow.operators.sizing import measured
from pairflow.session import scratch_path

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
END = -1  # the term of the posting that tells a document's length
KEY = ["doc_id", "text_key"]


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """item_id and window (array of words): all runs of ``size`` words, or all words of a shorter item."""
    items = benchmark.select(
        benchmark[item_id].alias("item_id"), terms_of(F.coalesce(benchmark[text].cast("string"), F.lit(""))).alias("words")
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window")).distinct()


def store_postings(docs: DataFrame, vocabulary: DataFrame, path: str) -> DataFrame:
    """Write the index: term_id, doc_id, text_key, pos.  Each document also has one posting of ``END`` at its word count.

    Postings are written where the texts are read, without a shuffle.
    """
    spark = docs.sparkSession
    words = F.concat(terms_of(F.col("text")), F.array(F.lit(None).cast("string")))
    postings = docs.select("doc_id", "text_key", F.posexplode(words).alias("pos", "word"))
    known = postings.join(vocabulary, "word", "left").select(
        F.when(F.col("word").isNull(), F.lit(END)).otherwise(F.col("term_id")).alias("term_id"), "doc_id", "text_key", "pos"
    )
    known.filter("term_id is not null").write.parquet(path)
    return spark.read.schema("term_id int, doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", text_key long, pos int").parquet(path)


def ranked_terms(windows: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """window_id, n_terms, offset, term_id, rank: the terms of each window, from the rarest in the training data."""
    flat = windows.select("window_id", F.size("window").alias("n_terms"), F.posexplode("window").alias("offset", "word"))
    by_rarity = Window.partitionBy("window_id").orderBy("n", "term_id", "offset")  # at most a window's words in one group
    return (
        flat.join(vocabulary, "word")
        .join(measured(counts), "term_id", "left")  # a row per benchmark term
        .fillna(0, "n")
        .select("window_id", "n_terms", "offset", "term_id", F.row_number().over(by_rarity).alias("rank"))
    )


def places(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Offset-adjusted lists: where each window would start for each posting of its terms."""
    return postings.join(terms, "term_id").select(
        "window_id", "n_terms", *KEY, (F.col("pos") - F.col("offset")).alias("start")
    )


def find_windows(docs: DataFrame, windows: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(matches, lengths): doc_id, text_key, window_id, n_terms, start, shift; and the words of each (doc_id, text_key).

    ``shift`` is 0 for an exact phrase.  With ``slop`` over 0, proximity matches come too:
    every term within ``slop`` words of where the phrase has it, counted from the rarest
    term; ``shift`` is then the sum of the displacements.
    """
    spark: SparkSession = docs.sparkSession
    words = windows.select(F.explode("window").alias("word")).distinct()
    vocabulary = measured(words.select("word", F.dense_rank().over(Window.orderBy("word")).alias("term_id")))
    index = store_postings(docs, vocabulary, scratch_path(spark, "postings"))
    counts = index.filter(F.col("term_id") != END).groupBy("term_id").agg(F.count("*").alias("n"))
    terms = ranked_terms(windows, vocabulary, counts).checkpoint()

    lengths = index.filter(F.col("term_id") == END).select(*KEY, F.col("pos").alias("n_words"))
    found = places(index, measured(terms.filter("rank = 1"))).distinct()
    second = places(index, measured(terms.filter("rank = 2")))
    shifts = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("shift")
    near = second.select("window_id", *KEY, "start", shifts) if slop else second.select("window_id", *KEY, "start", F.lit(0).alias("shift"))
    near = near.withColumn("start", F.col("start") - F.col("shift")).groupBy("window_id", *KEY, "start").agg(F.min(F.abs("shift")).alias("shift"))
    single = found.filter("n_terms = 1").select(*KEY, "window_id", "n_terms", "start", F.lit(0).alias("shift"))
    two = (
        found.filter("n_terms > 1").alias("f")
        .join(near.alias("s"), F.expr("f.window_id = s.window_id and f.start = s.start and f.text_key = s.text_key and f.doc_id <=> s.doc_id"))
        .select("f.doc_id", "f.text_key", "f.window_id", "f.n_terms", "f.start", "s.shift")
        .checkpoint()
    )
    # the lists of all further terms, in documents where two lists met
    rest = index.filter(F.col("term_id") != END).join(measured(two.select("text_key").distinct()), "text_key", "left_semi")
    wanted = two.join(measured(terms.filter("rank > 2").drop("n_terms")), "window_id")
    wanted = wanted.select(*two.columns, "offset", "term_id", shifts.alias("by") if slop else F.lit(0).alias("by"))
    wanted = wanted.withColumn("pos", F.col("start") + F.col("offset") + F.col("by"))
    met = wanted.alias("w").join(
        rest.alias("p"),
        F.expr("w.term_id = p.term_id and w.pos = p.pos and w.text_key = p.text_key and w.doc_id <=> p.doc_id"),
    ).select("w.*")
    place = [*KEY, "window_id", "n_terms", "start", "shift"]
    confirmed = (
        met.groupBy(*place, "offset").agg(F.min(F.abs("by")).alias("by"))
        .groupBy(*place).agg(F.count("*").alias("n"), F.sum("by").alias("by"))
        .filter("n = n_terms - 2")
        .select(*KEY, "window_id", "n_terms", "start", (F.col("shift") + F.col("by")).cast("int").alias("shift"))
    )
    short = two.filter("n_terms = 2").select(*KEY, "window_id", "n_terms", "start", "shift")
    return single.unionByName(short).unionByName(confirmed).checkpoint(), lengths


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    slop: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, n_hit, n_items, items, n_near, contaminated.

    A window is ``size`` consecutive words of an item, or all words of a shorter one.  A
    document word inside any occurrence of a window is hit; ``items`` are the ids, as sorted
    strings, of items with occurring windows; ``n_near`` counts proximity matches that are
    no exact phrase (0 without ``slop``) and does not contaminate.  Null texts and texts
    without words have no words and no hits, as have items without words.  Rows that repeat
    an id with another text are searched apart; fully repeated rows each come back.  Null
    ids are documents like others; a null item id is left out of ``items``.  Empty tables
    give no rows, or no hits.  Runs jobs when called.
    """
    keyed = with_text_key(docs, id_col, text)
    items = benchmark_windows(benchmark, item_id, item_text, size).checkpoint()
    windows = measured(items.select("window").distinct().select("window", F.xxhash64("window").alias("key")))
    windows = windows.select("window", F.dense_rank().over(Window.orderBy("key", "window")).alias("window_id")).checkpoint()
    matches, lengths = find_windows(keyed, windows, slop)

    exact = matches.filter("shift = 0")
    order = Window.partitionBy(*KEY).orderBy("start", "n_terms")
    before = F.coalesce(F.max(F.col("start") + F.col("n_terms")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.col("start") + F.col("n_terms") - F.greatest(F.col("start"), before)
    hits = exact.select(*KEY, F.greatest(new, F.lit(0)).alias("new")).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    near = matches.filter("shift > 0").groupBy(*KEY).agg(F.count("*").alias("n_near"))
    named = (
        exact.select(*KEY, "window_id").distinct()
        .join(measured(windows.join(items, "window").select("window_id", F.col("item_id").cast("string").alias("item_id"))), "window_id")
        .groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    by_key = lambda a, b: F.expr(f"{a}.text_key = {b}.text_key and {a}.doc_id <=> {b}.doc_id")
    # identical rows have one posting of END each, so each comes back
    return (
        lengths.alias("d")
        .join(hits.alias("h"), by_key("d", "h"), "left")
        .join(named.alias("i"), by_key("d", "i"), "left")
        .join(near.alias("n"), by_key("d", "n"), "left")
        .select(
            "d.doc_id",
            "d.text_key",
            F.col("d.n_words").cast("long").alias("n_words"),
            F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("i.items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("i.items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("n.n_near", F.lit(0)).alias("n_near"),
            (F.coalesce("h.n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
