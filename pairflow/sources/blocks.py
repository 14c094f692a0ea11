"""Block-structured result text as a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairflow.functions import fixed
from pairflow.functions.scalars import mixture_key
from pairflow.functions.text import base_name, extract_block, extract_names, split_ids, text_blocks, text_lines
from pairflow.operators.sizing import measured
from pairflow.schema import COMPOSITION, ENTITY_COLUMNS, TARGETS, TEMPERATURE


def parse_blocks(files: DataFrame, path: Column | str = "path", text: str = "text", strict: bool = True, carry: list[str] = ()) -> DataFrame:
    """One row per 8-line block of each (path, text) row."""
    id_1, id_2 = split_ids(path)
    head = text_lines(F.substring_index(text, "\n", fixed.LINES_PER_BLOCK))
    headed = files.select(*carry, id_1.alias("id_1"), id_2.alias("id_2"), head.alias("__head"), F.col(text).alias("__text"))
    name_1, name_2 = extract_names("__head")
    # Names in a projection of their own, so that they are looked for once in a text and not in every block.
    named = headed.select(*carry, "id_1", "id_2", name_1.alias("names_1"), name_2.alias("names_2"), "__text")
    blocks = named.select("*", F.posexplode(text_blocks("__text")).alias("block", "__block")).drop("__text")
    return extract_block(blocks.withColumn("__block", F.split("__block", "\n")), "__block", strict)


def _whole_files(reader, path: str) -> DataFrame:
    # load(), not text(): the latter resets the option and yields lines.
    return reader.format("text").option("wholetext", "true").load(path)


def _decoded(c: Column) -> Column:
    """Undo the percent escapes of a path, where a plus sign is just that."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _address(path: Column, ids: str) -> Column:
    """The name that carries the two ids: the file's or its folder's."""
    if ids == "folder":
        # Writers escape a folder's value, and the path is escaped once more.
        folder = F.element_at(F.split(path, "/"), -2)
        return F.regexp_replace(_decoded(_decoded(folder)), r"^[^=]*=", "")
    if ids != "file":
        raise ValueError(f"ids are in the 'file' or 'folder' name, not {ids!r}")
    return _decoded(base_name(path))


def _addressed(df: DataFrame, ids: str) -> DataFrame:
    return df.select(_address(F.col("_metadata.file_path"), ids).alias("path"), F.col("value").alias("text"))


def parse_block_text(spark: SparkSession, path: str, ids: str = "file", strict: bool = True) -> DataFrame:
    """Parse a glob of result files, each one pair of entities.

    ``ids="folder"`` takes the ids from a folder ``key={id1}__{id2}`` instead, as
    distributed writers produce; a folder may then hold any number of files.
    """
    return parse_blocks(_addressed(_whole_files(spark.read, path), ids), strict=strict)


# Bytes up to which a file is taken apart as one text; a compressed one is several times as long as its file.
WHOLE_BYTES, WHOLE_PACKED = 8 << 20, 1 << 20
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"


def _is_small() -> Column:
    """Whether the file of a row is, which leaves the others unread."""
    packed = F.col("_metadata.file_path").rlike(PACKED)
    return F.col("_metadata.file_size") <= F.when(packed, F.lit(WHOLE_PACKED)).otherwise(F.lit(WHOLE_BYTES))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of each file numbered from 0, however many tasks read it.

    Lines of a split are numbered where they are read; what the splits before it hold is
    counted first, a number per split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).filter(~_is_small()).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"),
    )
    splits = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    offsets = measured(splits.select("file", "at", (before - F.col("first")).alias("shift")))
    return lines.join(offsets, ["file", "at"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def parse_block_lines(spark: SparkSession, path: str, ids: str = "file", strict: bool = True) -> DataFrame:
    """As ``parse_block_text``, for files larger than a task too: these are read in as many splits as they have.

    Small files are taken apart whole, where they are read, and nothing is shuffled.  Of the others every line is taken apart where it is read, by its place in its block of 8; what the lines
    of a block gave is brought together, nearly always within the task.
    """
    lines = _numbered_lines(spark, path).withColumns(
        {"block": F.floor(F.col("line") / fixed.LINES_PER_BLOCK).cast("int"), "at": (F.col("line") % fixed.LINES_PER_BLOCK + 1).cast("int")}
    )
    part = {
        "__condition": F.when(F.col("at") == fixed.CONDITION_LINE, F.col("value")),
        **{f"__target_{k}": F.when(F.col("at") == line, F.col("value")) for k, line in enumerate(fixed.TARGET_LINES)},
    }
    whole = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(n) for n, c in part.items()])
    whole = whole.filter(F.col("__n") == fixed.LINES_PER_BLOCK)
    empty = F.lit("")
    by_line = {fixed.CONDITION_LINE: "__condition", fixed.TARGET_LINES[0]: "__target_0", fixed.TARGET_LINES[1]: "__target_1"}
    block = F.array(*[F.col(by_line[k]) if k in by_line else empty for k in range(1, fixed.LINES_PER_BLOCK + 1)])
    head = lines.filter(F.col("block") == 0).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("h"))
    name_1, name_2 = extract_names(F.col("h.value"))
    names = measured(head.select("file", name_1.alias("names_1"), name_2.alias("names_2")))
    id_1, id_2 = split_ids(_address(F.col("file"), ids))
    blocks = whole.join(names, "file").select(id_1.alias("id_1"), id_2.alias("id_2"), "names_1", "names_2", "block", block.alias("__block"))
    small = parse_blocks(_addressed(_whole_files(spark.read, path).filter(_is_small()), ids), strict=strict)
    return small.unionByName(extract_block(blocks, "__block", strict))


def stream_block_text(spark: SparkSession, path: str, ids: str = "file", strict: bool = True) -> DataFrame:
    """The same as a stream over files still arriving."""
    return parse_blocks(_addressed(_whole_files(spark.readStream, path), ids), strict=strict)


def _decimal(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c)


def format_blocks(
    df: DataFrame, ids: list[str] = ENTITY_COLUMNS, names: list[str] | None = None, name: str = "text"
) -> DataFrame:
    """Render one 8-line block per observation: the format ``parse_blocks`` reads."""
    names = names or ids
    one, two = (F.concat_ws(" ", F.lit("  "), F.lit(str(k)), F.col(c).cast("string"), F.lit("")) for k, c in enumerate(names, 1))
    x = F.col(COMPOSITION)
    lines = [
        F.lit("Property   job  1"),
        F.lit("Settings"),
        F.concat(
            F.lit("T= "), _decimal(F.col(TEMPERATURE), 2), F.lit(" K ; x(1)= "), _decimal(x, 4),
            F.lit(" ; x(2)= "), _decimal(F.lit(1.0) - x, 4), F.lit(" ;"),
        ),
        F.lit("Units"),
        F.lit("Method"),
        F.lit("Nr Compound ln(gamma)"),
        F.concat(one, F.lit("  "), _decimal(F.col(TARGETS[0]), 6)),
        F.concat(two, F.lit("  "), _decimal(F.col(TARGETS[1]), 6)),
    ]
    return df.withColumn(name, F.concat_ws("\n", *lines))


def write_block_folders(df: DataFrame, path: str, ids: list[str] = ENTITY_COLUMNS, rows_per_file: int = 50_000) -> None:
    """Write blocks into one folder per pair, files cut at block boundaries and compressed.

    Adaptive rebalancing gathers a pair's rows and splits an oversized pair.  Rows are rendered
    where they are written, as a block is several times as long as its row.
    """
    pair = mixture_key(*ids)
    needed = df.select(pair.alias("pair"), *dict.fromkeys([*ids, TEMPERATURE, COMPOSITION, *TARGETS]))
    blocks = format_blocks(needed.hint("rebalance", "pair"), ids).select("pair", "text")
    writer = blocks.write.partitionBy("pair").option("compression", "gzip")
    writer.option("maxRecordsPerFile", rows_per_file).text(path)
