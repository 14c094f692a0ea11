"""The pipeline on small tables, each stage against brute force on what the stage before kept."""

import gc
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import SCHEMA, brute_components, brute_windows

LINE = "Shared by permission of the owner."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(21), [], []
    vocabulary = [f"w{k}" for k in range(300)]
    item = " ".join(rng.choices(vocabulary, k=14))
    for k in range(260):
        words = rng.choices(vocabulary, k=rng.randint(10, 60))
        toxic = k % 5 == 0
        if toxic:
            words[2:2] = rng.sample(["vile", "awful", "rotten", "nasty"], 3)
        if k % 13 == 1:
            words[4:4] = item.split()
        text = " ".join(words)
        if k % 6 == 1 and k > 20:
            text = rng.choice(rows)[1]
            toxic = None
        if k % 3 == 0:
            text += "\n" + LINE
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        if toxic is not None and k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, "no id here", "en", "s1", 10)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, item


def test_stages(spark, folder, tmp_path):
    out, item = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, out).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
    first, safe, lines, near, clean, mixed = seen

    bad = {"vile", "awful", "rotten", "nasty"}
    dropped = {r.doc_id for r in first} - {r.doc_id for r in safe}
    toxic = {r.doc_id for r in first if bad & set((r.text or "").split())}
    assert dropped <= toxic and len(dropped) > 0.8 * len(toxic)

    pages = Counter(r.source for r in safe)
    held = Counter(r.source for r in safe if LINE in (r.text or "").split("\n"))
    by_id = {r.doc_id: r for r in lines}
    assert len(lines) == len(safe)
    for r in safe:
        boilerplate = held[r.source] >= 10 and held[r.source] / pages[r.source] > 0.1
        want = "\n".join(x for x in (r.text or "").split("\n") if not (boilerplate and x == LINE))
        assert by_id[r.doc_id].text == want and by_id[r.doc_id].n_chars == len(want)

    with_id = [(r.doc_id, r.text) for r in lines if r.doc_id is not None]
    label = brute_components(with_id)[1]
    assert {r.doc_id for r in near} == {i for i in label if label[i] == i} | {None}

    hit = {r.doc_id for r in near if brute_windows(r.text, item)[1]}
    assert hit and {r.doc_id for r in clean} == {r.doc_id for r in near} - hit

    texts = {r.doc_id: r.text for r in clean}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    assert all(r.text == texts[r.doc_id] and r.copies == copies[r.doc_id] for r in mixed)
    total = sum(len((r.text or "").split()) for r in clean)
    assert abs(sum(len(r.text.split()) for r in mixed) - total) < 0.1 * total

    again = Counter(r.doc_id for r in corpus_pipeline.run(spark, out).collect())
    assert again == copies


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices([f"v{k}" for k in range(400)], k=40))
    item = " ".join(f"b{k}" for k in range(12))
    clean, other, third, bad = text(), text(), text(), [f"{text()} {item}" for _ in range(3)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, clean), (None, bad[0]), (None, bad[1]), (7, other), (7, bad[2]), (8, third), (8, third), (None, third), (None, clean), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect())
    assert got == Counter((i, t) for i, t in rows if t not in bad)
    near = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert near == Counter([(None, clean), (None, bad[0]), (None, bad[1]), (7, other), (7, bad[2]), (8, third), (None, "")])


def _tables(spark, path, docs):
    item = " ".join(f"b{k}" for k in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], 1, int("vile" in (r[1] or ""))) for r in docs if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return item


def test_stages_on_an_empty_table(spark, tmp_path):
    _tables(spark, tmp_path, [])
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == corpus_pipeline.COLUMNS and out.collect() == [], name


def test_stages_with_long_texts_and_clashing_columns(spark, tmp_path):
    """Names that the operators use inside, as further columns, change nothing; nor does a text of 200,000 words."""
    rng = random.Random(9)
    text = lambda n, *more: " ".join(rng.choices([f"u{k}" for k in range(500)], k=n) + list(more))
    rows = [(k, text(40, *(["vile", "awful"] if k % 4 == 0 else [])), "en", f"s{k % 2}", 0) for k in range(60)]
    item = _tables(spark, tmp_path, rows)
    rows += [(100, text(200_000), "en", "s0", 0), (101, text(20, item), "en", None, 0), (102, rows[1][1], "en", "s1", 0), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    clash = ["text_key", "row", "word", "words", "line", "site", "n", "count", "score", "s", "size", "copies", "copy", "kept", "held_out", "toxic", "label", "node", "key", "pos", "class", "block", "tie", "k", "d", "m"]
    more = plain.selectExpr("*", *[f"'x' as `{c}`" for c in clash])
    for name, stage in corpus_pipeline.STAGES:
        want, got = (stage(spark, docs, str(tmp_path)) for docs in (plain, more))
        assert want.columns == got.columns, name
        want, got = Counter(map(tuple, want.collect())), Counter(map(tuple, got.collect()))
        assert want == got and any(r[0] == 100 for r in got), name
        if name == "near_dedup":
            assert not any(r[0] == 102 for r in got) and any(r[0] is None for r in got)
        if name == "decontamination":
            assert {r[0] for r in got} == {r[0] for r in rows} - {101}


def test_toxic_copies_are_judged_by_id_and_text(spark, tmp_path, monkeypatch):
    rows = [(1, "one", "en", "s", 0), (2, "one", "en", "s", 0), (2, "two", "en", "s", 0), (None, "one", "en", "s", 0), (None, "two", "en", "s", 0)]
    _tables(spark, tmp_path, [])
    docs = spark.createDataFrame(rows, SCHEMA)
    bad = {(2, "one"), (None, "two")}

    def rates(docs, labels):
        scored = corpus_pipeline.keyed(docs).collect()
        return spark.createDataFrame([(r.doc_id, r.text_key, (0.9 if (r.doc_id, r.text) in bad else 0.1,)) for r in scored], "doc_id long, text_key long, s struct<score: double>")

    monkeypatch.setattr(corpus_pipeline, "toxicity_rates", rates)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect())
    assert got == Counter((r[0], r[1]) for r in rows if (r[0], r[1]) not in bad)


def test_toxicity_leaves_the_driver_no_memory_of_its_model(spark, folder, tmp_path):
    """The driver runs all later stages beside what its Python keeps (Linux only)."""
    rollup = Path("/proc/self/smaps_rollup")
    if not rollup.exists():
        pytest.skip("memory can't be read here")

    def kept():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", rollup.read_text()))) / 1024

    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.translate((F.xxhash64("id", i) % 40_000).cast("string"), "-0123456789", "kabcdefghij"))
    text = F.concat_ws(" ", words, F.when(F.col("id") % 5 == 0, "vile awful rotten"))
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(4_000).selectExpr("id as doc_id", "1 as quality", "int(id % 5 = 0) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = []
    for of in (folder[0], str(tmp_path)):  # the first brings the imports
        rows = corpus_pipeline.drop_toxic(spark, corpus_pipeline.table(spark, of, "documents"), of).count()
        gc.collect()
        sizes.append(kept())
    assert 3_000 < rows < 3_400
    assert sizes[1] - sizes[0] < 40
