"""Expressions that take block-structured result text apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.functions import fixed
from pairflow.functions.scalars import as_column, bind


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def split_ids(path: Column | str) -> tuple[Column, Column]:
    """Two ids from ``{id1}__{id2}_ct.tab``; folders in front are ignored."""
    stem = F.regexp_replace(base_name(path), fixed.RESULT_SUFFIX_PATTERN, "")
    parts = F.split(stem, fixed.ID_SEPARATOR)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def text_lines(text: Column | str) -> Column:
    """Lines of a text; a final line break does not open another line."""
    plain = F.replace(as_column(text), F.lit("\r\n"), F.lit("\n"))
    return bind(plain, lambda t: F.split(F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t), "\n"))


def chunk_lines(lines: Column | str, size: int = fixed.LINES_PER_BLOCK) -> Column:
    """Array of whole chunks of ``size`` lines; an incomplete tail is ignored."""

    def chunks(ls: Column) -> Column:
        n = F.floor(F.size(ls) / F.lit(size)).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(ls, k * size + 1, F.lit(size)))

    return bind(as_column(lines), chunks)


def text_blocks(text: Column | str, size: int = fixed.LINES_PER_BLOCK) -> Column:
    """Array of the whole chunks of ``size`` lines of a text, each still one text; an incomplete tail is ignored.

    The text is gone through once; ``chunk_lines`` goes through all lines for every chunk.
    """
    plain = F.replace(as_column(text), F.lit("\r\n"), F.lit("\n"))
    ended = bind(plain, lambda t: F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n"))))
    return F.regexp_extract_all(ended, F.lit(f"((?:[^\n]*\n){{{size - 1}}}[^\n]*)\n"), F.lit(1))


def block_fields(block: Column | str) -> list[Column]:
    """The matched text of each field of one block; "" where there is no match."""
    block = as_column(block)
    condition = F.element_at(block, fixed.CONDITION_LINE)
    found = [
        ("temperature_k", condition, fixed.TEMPERATURE_PATTERN),
        ("x1", condition, fixed.COMPOSITION_1_PATTERN),
        ("x2", condition, fixed.COMPOSITION_2_PATTERN),
        ("ln_gamma_1", F.element_at(block, fixed.TARGET_LINES[0]), fixed.TARGET_PATTERN),
        ("ln_gamma_2", F.element_at(block, fixed.TARGET_LINES[1]), fixed.TARGET_PATTERN),
    ]
    return [F.regexp_extract(line, pattern, 0).alias(name) for name, line, pattern in found]


def extract_block(df: DataFrame, block: str, strict: bool = True) -> DataFrame:
    """Replace a block column by its condition and targets.

    A missing composition reads as 0.0.  A missing temperature raises when
    ``strict``, and is NULL otherwise.
    """
    rest = [c for c in df.columns if c != block]
    # A projection of its own, so that every pattern is matched once.
    texts = df.select(*rest, F.element_at(block, fixed.CONDITION_LINE).alias("__line"), *block_fields(block))
    t = F.col("temperature_k").try_cast("double")
    if strict:
        complaint = F.raise_error(F.concat(F.lit("No temperature found: "), F.col("__line"))).cast("double")
        t = F.when(F.col("temperature_k") == "", complaint).otherwise(t)
    fraction = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("x1", "x2")}
    target = {c: F.col(c).try_cast("double") for c in ("ln_gamma_1", "ln_gamma_2")}
    return texts.withColumns({"temperature_k": t} | fraction | target).drop("__line")


def extract_names(lines: Column | str) -> tuple[Column, Column]:
    """Entity names in the first lines of a file; both NULL unless exactly two."""
    head = F.array_join(F.slice(as_column(lines), 1, fixed.LINES_PER_BLOCK), "\n")
    names = F.regexp_extract_all(F.concat(head, F.lit("\n")), F.lit("(?U)" + fixed.NAME_PATTERN), F.lit(0))
    two = F.size(names) == 2
    return F.when(two, F.get(names, F.lit(0))), F.when(two, F.get(names, F.lit(1)))
