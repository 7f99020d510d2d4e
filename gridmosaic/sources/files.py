"""Files in: JSON lines, JSON maps, delimited text, linked tables, pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridmosaic.operators.ranking import last_per_key


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, key: str | None = None) -> DataFrame:
    """JSON lines with a fixed schema. With a key, the last line of a repeated
    key wins, in the order of file names and lines."""
    if key is None:
        return spark.read.schema(schema).json(path)
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # lines of one block are read in order, and blocks of a file carry their offset
    rows = lines.withColumn("line", F.monotonically_increasing_id()).select(
        F.struct("file", "block", "line").alias("__at"), F.from_json("value", ddl).alias("r")
    )
    return parse_last(rows.select("__at", "r.*"), key)


def parse_last(rows: DataFrame, key: str, order: str = "__at") -> DataFrame:
    """One row per key: the one with the largest order."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return last_per_key(rows, [key], F.col(order), rest)


def read_json_map(spark: SparkSession, path: str | list[str], value_type: str = "string") -> DataFrame:
    """Files that hold one JSON object each, as (key, value) rows.

    One object is one task; ``read_map_lines`` reads large ones.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("key", "value"))


def read_map_lines(spark: SparkSession, path: str | list[str], value_type: str = "string") -> DataFrame:
    """Files of ``write_json_map``: one entry per line, so any size is split."""
    entry = F.regexp_replace("value", r"^\s*,|,\s*$", "")
    lines = spark.read.text(path).where(~F.trim("value").isin("{", "}"))
    return lines.select(F.explode(F.from_json(F.concat(F.lit("{"), entry, F.lit("}")), f"map<string,{value_type}>")).alias("key", "value"))


def explode_json_map(df: DataFrame, col: str, value_type: str = "string") -> DataFrame:
    """The same for a column of JSON objects."""
    return df.select(F.explode(F.from_json(col, f"map<string,{value_type}>")).alias("key", "value"))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "\t", schema: str | None = None) -> DataFrame:
    """Delimited text with a header; index columns without a name are dropped."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    # an empty header field gets the name _c and its place
    named = [c for i, c in enumerate(df.columns) if c != f"_c{i}" and not re.fullmatch(r"Unnamed: \d+", c)]
    return df.select(*[f"`{c}`" for c in named])


def parse_delimited(lines: DataFrame, col: str, schema: str, sep: str = "\t", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for a column of delimited lines; columns named ``Unnamed...`` are dropped."""
    rows = lines.select(*keep, F.from_csv(col, schema, {"sep": sep}).alias("r")).select(*keep, "r.*")
    return rows.drop(*[c for c in rows.columns if c.startswith("Unnamed")])


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed pages: page_id, url, html."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select("page_id", "url", "html")


def flatten_linked_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source tables whose header and data cells are (text, links) pairs, as
    (table records with a text grid, links of each cell).

    The header becomes row 0.
    """
    grid = df.select("table_id", "url", F.concat(F.array("header"), "data").alias("grid"))
    tables = grid.select(
        "table_id", "url", F.transform("grid", lambda row: F.transform(row, lambda c: c["text"])).alias("table_array")
    )
    rows = grid.select("table_id", F.posexplode("grid").alias("row_idx", "row"))
    cells = rows.select("table_id", "row_idx", F.posexplode("row").alias("col_idx", "c"))
    links = cells.select("table_id", "row_idx", "col_idx", F.posexplode("c.links").alias("ord", "link"))
    return tables, links.select("table_id", *[F.col(c).cast("bigint").alias(c) for c in ("row_idx", "col_idx", "ord")], "link")


def union_splits(frames: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """Rows of several splits or kinds with their origin."""
    marked = [df.withColumn(name, F.lit(k)) for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def attach_base64(df: DataFrame, path_col: str, images: DataFrame, out: str = "image_base64") -> DataFrame:
    """Image bytes as base64 text; a missing file gives null.

    ``images``: path, content, as from ``read_images``.
    """
    coded = images.select(F.col("path").alias(path_col), F.base64("content").alias(out))
    return df.join(coded, path_col, "left")


def read_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Image files below a folder, with paths relative to it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    return files.select(F.element_at(F.split("path", quote(root)), -1).alias("path"), "content")


def quote(text: str) -> str:
    return "".join("\\" + ch if ch in r"\[]{}()*+?.^$|" else ch for ch in text)

