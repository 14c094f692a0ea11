"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.llm.common import with_text_key
from pairflow.operators.sizing import measured

RATIO = 0.1
#: A line on one page only repeats nothing, however small the site.
MIN_PAGES = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_digest(line: Column) -> Column:
    """128 bits of the trimmed line."""
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, line (digest), n_pages, site_pages of lines on more than ``ratio`` of a site's pages and at least ``min_pages``.

    ``pages`` has site and text, a row per page.  Counts are combined before each shuffle.
    """
    totals = pages.groupBy("site").agg(F.count("*").alias("site_pages")).filter(F.col("site_pages") >= min_pages)
    distinct = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), line_digest))
    counts = (
        pages.select("site", F.explode(distinct).alias("line"))
        .groupBy("site", "line").agg(F.count("*").alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )
    return (
        counts.alias("c").join(measured(totals).alias("t"), F.expr("c.site <=> t.site"))
        .filter(F.col("n_pages") / F.col("site_pages") > ratio)
        .select("c.site", "line", "n_pages", "site_pages")
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    site: str = "source",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_lines, n_dropped, and the columns ``carry`` as they were.

    Within a site, lines (trimmed) on more than ``ratio`` of its pages, and on ``min_pages`` at
    least, are boilerplate and dropped, from a page of nothing else too.  Blank lines are not
    counted, and stay.  Null texts count as
    empty, null sites are one site.  Repeated rows are pages of their own, each comes back.
    An empty table gives an empty result.  ``carry`` names must not clash with the others.
    Measures the site totals in a job when called.
    """
    keyed = with_text_key(docs, id_col, text, docs[site].alias("site"), *[docs[c].alias(f"carry_{c}") for c in carry or []])
    found = boilerplate_lines(keyed, ratio, min_pages).select("site", "line")
    occurrences = keyed.select("doc_id", "text_key", "site", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_digest))).alias("line"))
    drops = (
        occurrences.alias("o").join(measured(found).alias("f"), F.expr("o.line = f.line and o.site <=> f.site"))
        .groupBy("o.doc_id", "o.text_key", "o.site").agg(F.collect_set("o.line").alias("drop"))
    )
    lines = lines_of(F.col("p.text"))
    gone = lambda x: F.array_contains("d.drop", line_digest(x)) & (F.trim(x) != "")
    has_text = lambda x: F.trim(x) != ""
    joined = keyed.alias("p").join(
        drops.alias("d"), F.expr("p.text_key = d.text_key and p.doc_id <=> d.doc_id and p.site <=> d.site"), "left"
    )
    kept = F.when(F.col("d.drop").isNull(), F.col("p.text")).otherwise(F.array_join(F.filter(lines, lambda x: ~gone(x)), "\n"))
    split = joined.select(
        F.col("p.doc_id").alias("doc_id"),
        kept.alias("rest"),
        F.when(F.trim("p.text") == "", 0).otherwise(F.size(F.filter(lines, has_text))).alias("n_lines"),
        *[F.col(f"p.carry_{c}").alias(c) for c in carry or []],
    )
    return split.select(
        "doc_id",
        F.col("rest").alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.when(F.trim("rest") == "", 0).otherwise(F.size(F.filter(lines_of(F.col("rest")), has_text)))).cast("long").alias("n_dropped"),
        *(carry or []),
    )
