"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairflow.llm.decontaminate import decontaminate
from pairflow.llm.exact_dedup import exact_dedup
from pairflow.llm.lattice import lattice_scores
from pairflow.llm.line_dedup import MIN_PAGES, RATIO, line_dedup
from pairflow.llm.minhash import near_duplicates
from pairflow.llm.mixing import mix_sources
from pairflow.llm.packing import pack_documents
from pairflow.llm.pii import find_personal_data
from pairflow.llm.spelling import spelling_variants
from pairflow.llm.substring_dedup import remove_repeats
from pairflow.llm.toxicity import toxicity_scores
from pairflow.llm.url_filter import RULE_SCHEMA, filter_urls
from pairflow.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_exact_dedup",
    f"""
WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS n FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM t WINDOW g AS (PARTITION BY n)
""",
)
def op1(spark, folder):
    return exact_dedup(table(spark, folder, "documents")).drop("n_chunks")


@query(
    "op2_line_dedup",
    f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
site AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boiler AS (
  SELECT source, line FROM (
    SELECT source, line, count(*) AS n
    FROM (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM d)
    WHERE line <> '' GROUP BY source, line)
  JOIN site USING (source) WHERE n >= {MIN_PAGES} AND n / pages > {RATIO}),
per_site AS (SELECT source, list(line) AS bad FROM boiler GROUP BY source),
cut AS (
  SELECT doc_id, len(list_filter(lines, lambda x: trim(x) <> '')) AS n_lines,
         list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), trim(x))) AS rest
  FROM d LEFT JOIN per_site USING (source))
SELECT doc_id, n_lines, n_lines - len(list_filter(rest, lambda x: trim(x) <> '')) AS n_dropped,
       n_lines > 0 AND len(list_filter(rest, lambda x: trim(x) <> '')) = 0 AS whole, sha256(array_to_string(rest, chr(10))) AS text_sha256
FROM cut
""",
)
def op2(spark, folder):
    """``whole`` marks pages of nothing but boilerplate, which end without a line."""
    done = line_dedup(table(spark, folder, "documents"))
    whole = (F.col("n_lines") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    return done.select("doc_id", "n_lines", "n_dropped", whole.alias("whole"), F.sha2("text", 256).alias("text_sha256"))


TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(LOWER.format("coalesce(text, '')"))


@query(
    "op4_decontaminate",
    f"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
b AS (SELECT item_id, {TERMS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
hit AS (SELECT * FROM dw WHERE win IN (SELECT win FROM bw)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit JOIN bw USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
""",
)
def op4(spark, folder):
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


@query(
    "op6_url_filter",
    f"""
WITH p AS (
  SELECT page_id, coalesce({LOWER.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, h, q, action) AS (VALUES {", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{a}')" for r, a in URL_RULES)}),
fit AS (SELECT DISTINCT host, path, rule, action,
               row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS k
        FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (host, path)
""",
)
def op6(spark, folder):
    rules = spark.createDataFrame(URL_RULES, RULE_SCHEMA)
    return filter_urls(table(spark, folder, "pages"), rules).drop("url")


@query("op3_lattice_lm")
def op3(spark, folder):
    return lattice_scores(table(spark, folder, "documents"))


WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')".format(LOWER.format("coalesce(text, '')"))


@query(
    "op5_minhash",
    f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4))) END AS grams FROM d),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.grams) + len(y.grams) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(grams) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id
""",
)
def op5(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


@query("op8_mix_sources")
def op8(spark, folder):
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_toxicity")
def op7(spark, folder):
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


@query(
    "op9_substring_dedup",
    """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
""",
)
def op9(spark, folder):
    done = remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_personal_data")
def op10(spark, folder):
    found = find_personal_data(table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op11_spelling_variants")
def op11(spark, folder):
    return spelling_variants(table(spark, folder, "documents"))


@query("op12_whitening")
def op12(spark, folder):
    return whiten(table(spark, folder, "embeddings"))


@query("op13_best_fit_packing")
def op13(spark, folder):
    import public_tokenizers

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
