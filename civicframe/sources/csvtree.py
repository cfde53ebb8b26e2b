"""CSV files in a folder tree whose headers drift from file to file."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import to_double, to_int
from ..functions.text import parse_date
from ..operators.joins import stack

#: Stands for "no text between two separators"; cannot occur in a text file.
_ABSENT = "\u0000"


def typed(col: Column, kind: str) -> Column:
    """Text to the declared type, null where it does not parse."""
    if kind == "string":
        return F.nullif(F.coalesce(col, F.lit("")), F.lit("NA"))
    if kind in ("long", "int"):
        return to_int(col).cast(kind)
    if kind == "double":
        return to_double(col)
    if kind == "date":
        return parse_date(col)
    if kind == "boolean":
        return F.lower(col).try_cast("boolean")
    raise ValueError(f"unknown type {kind!r}")


#: The usual dialect on both sides: quotes inside quoted text are doubled, blanks and empty text stay.
DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def plain_path(uri: str) -> str:
    """A path as readers take it, from the encoded form that file metadata has; glob characters are escaped."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(uri))


def headers(spark: SparkSession, root: str, pattern: str, sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files under ``root`` by their header line.

    Reads the text once and keeps one line per file, combined map-side; only
    file names and header lines reach the driver, as any file listing does.
    Trees too large for that pass should declare their layouts (see ``scan_csv_tree``).
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    # The first line of a file is the first row of the block that starts at 0.
    first = (
        lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
        .filter("at = 0")
        .select("file", "value", F.monotonically_increasing_id().alias("id"))
        .groupBy("file")
        .agg(F.min_by("value", "id").alias("header"))
    )
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():
        names = tuple(next(csv.reader([row["header"].lstrip("\ufeff")], delimiter=sep)))
        found.setdefault(names, []).append(plain_path(row["file"]))
    return found


def unbalanced(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Lines (file, line) in which a quote stays open: their records go on in the next line.

    A scan that splits files reads such records as broken rows; use ``multi_line`` for files that hold some.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.filter(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _read_text_columns(
    spark: SparkSession, names: Sequence[str], paths: Sequence[str], sep: str, multi_line: bool = False, **more
) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).options(**DIALECT, header=True, sep=sep, nullValue=_ABSENT, multiLine=multi_line, **more)
    return (reader.option("lineSep", "\n") if multi_line else reader).csv(list(paths)).select("*", "_metadata")


def scan_csv_tree(
    spark: SparkSession,
    root: str,
    pattern: str,
    types: Mapping[str, str] | None = None,
    *,
    sep: str = ",",
    lineage: str = "file",
    order: str | None = None,
    multi_line: bool = False,
    layouts: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """All files under ``root`` whose name matches the glob ``pattern``, as one table.

    Columns are aligned by name: one read per distinct header, then a union with
    absent columns null.  ``types`` declares column types, text otherwise; empty
    text stays empty in text columns and is null elsewhere, ``NA`` is null.
    ``lineage`` names the column with the file each row came from.  ``order``
    adds a sortable (file, block, row) column for first-in-source-order rules.

    Quotes inside quoted text are doubled.  Quoted line breaks need ``multi_line``, which reads a file in
    one piece; without it files are split, and ``unbalanced`` finds the lines it would break.  ``layouts`` maps
    folders or globs below ``root`` to their column names; files are then read without looking at headers first.
    """
    types = types or {}
    frames = []
    if layouts:
        found = [(tuple(names), [f"{root}/{folder}"]) for folder, names in layouts.items()]
        more = {"recursiveFileLookup": True, "pathGlobFilter": pattern}
    else:
        found, more = headers(spark, root, pattern, sep).items(), {}
    for names, paths in found:
        raw = _read_text_columns(spark, names, paths, sep, multi_line, **more)
        cols = [typed(F.col(f"`{n}`"), types.get(n, "string")).alias(n) for n in names]
        cols.append(F.col("_metadata.file_path").alias(lineage))
        if order:
            cols.append(source_order().alias(order))
        frames.append(raw.select(*cols))
    if not frames:
        raise FileNotFoundError(f"no file under {root} matches {pattern}")
    return stack(*frames)


def source_order() -> Column:
    """Sort key that follows file listing order, then row order in the file."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_csv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str],
    *,
    select: Sequence[str] | None = None,
    sep: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """One CSV file or folder with a declared layout; Spark parses only the columns used."""
    raw = _read_text_columns(spark, list(types), [path], sep, multi_line)
    names = list(select) if select else list(types)
    return raw.select(*[typed(F.col(f"`{n}`"), types[n]).alias(n) for n in names])


def pick_positions(df: DataFrame, positions: Mapping[str, int]) -> DataFrame:
    """Choose columns by 1-based position and name them."""
    return df.select(*[F.col(f"`{df.columns[i - 1]}`").alias(n) for n, i in positions.items()])


def sibling_path(df: DataFrame, old: str, new: str, lineage: str = "file") -> DataFrame:
    """Rewrite the lineage path, so rows of sibling files share a key."""
    return df.withColumn(lineage, F.replace(F.col(lineage), F.lit(old), F.lit(new)))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header, in the dialect that the scans read; text that holds quotes, separators or line breaks is quoted."""
    df.write.mode("overwrite").options(**DIALECT, header=True, sep=sep).csv(path)
