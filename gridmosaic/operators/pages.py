"""Landed pages: tables, anchors, revisions."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from gridmosaic.functions import links as L, markup as M, tags as T
from gridmosaic.operators.ranking import global_position, last_per_key

TABLE_ID_OFFSET = 200_000


def extract_tables(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Leaf tables of every page, in page order, each once."""
    tables = pages.select(*keys, F.posexplode(M.leaf_elements(F.col("html"), "table")).alias("pos", "table_html"))
    return tables.withColumn("pos", F.col("pos").cast("bigint"))


TABLE_PART = re.compile(r"<!--.*?-->|<(tr|td|th)\b((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|</(?:tr|td|th|table)\b[^>]*>", re.I | re.S)
GRID = ArrayType(StructType([
    StructField("row_idx", LongType()), StructField("col_idx", LongType()), StructField("is_header", BooleanType()), StructField("cell", StringType()),
]))
SPAN_LIMIT = 1000  # of the HTML standard for columns


def _span(attributes: str, name: str, most: int) -> int:
    found = re.search(rf"\b{name}\s*=\s*[\"']?\s*(\d+)", attributes, re.I)
    if not found:
        return 1
    digits = found[1].lstrip("0")
    return most if len(digits) > 9 else min(max(1, int(digits or 0)), most)


def table_grid(html: str | None) -> list[tuple[int, int, bool, str]]:
    """(row, column, is header, text) of one table; spanned cells repeat, and
    missing end tags end with the next cell or row."""
    source, out, held = html or "", [], {}
    row, col, cell = -1, 0, None
    parts = list(TABLE_PART.finditer(source))
    last = sum((part[1] or "").lower() == "tr" for part in parts)  # no row is later; one may stand before the first tag

    def close(end: int) -> None:
        nonlocal col, cell
        if cell is None:
            return
        start, head, attributes = cell
        body = re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\b[^>]*>", " ", re.sub(r"(?s)<!--.*?-->", "", source[start:end])))
        text = " ".join(entities.unescape(body).split())
        while held.get(col, 0) >= row + 1:
            col += 1
        rows = _span(attributes, "rowspan", last - row + 1)
        for _ in range(_span(attributes, "colspan", SPAN_LIMIT)):
            out.extend((row + k, col, head, text) for k in range(rows))
            held[col] = row + rows
            col += 1
        cell = None

    for part in parts:
        if part[0].startswith("<!--"):
            continue
        close(part.start())
        if part[1] is None:
            continue
        if part[1].lower() == "tr":
            row, col = row + 1, 0
        else:
            row = max(row, 0)
            cell = (part.end(), part[1].lower() == "th", part[2])
    close(len(source))
    return [x for x in out if x[0] <= row]


@pandas_udf(GRID)
def table_grids(tables: pd.Series) -> pd.Series:
    """``table_grid`` of a batch of tables."""
    return tables.map(lambda t: [{"row_idx": r, "col_idx": c, "is_header": h, "cell": x} for r, c, h, x in table_grid(t)])


def table_cells(tables: DataFrame, keys: tuple[str, ...] = ("table_id",), html: str = "table_html") -> DataFrame:
    """Cells of landed tables: keys, row_idx, col_idx, is_header, cell."""
    return tables.select(*keys, F.explode(table_grids(F.col(html))).alias("c")).select(*keys, "c.*")


def assign_table_ids(tables: DataFrame, order: tuple[str, ...] = ("page_id", "pos"), offset: int = TABLE_ID_OFFSET) -> DataFrame:
    """Dense ids in page order, starting at the offset."""
    return global_position(tables, order, "table_id").withColumn("table_id", F.col("table_id") + offset - 1)


def wiki_anchor(href: Column) -> Column:
    return (
        F.contains(href, F.lit("/wiki/")) & ~F.contains(href, F.lit("redlink=1"))
        & ~F.contains(href, F.lit("Special:Upload?wpDestFile"))
    )


def wiki_start_anchor(href: Column) -> Column:
    return F.startswith(href, F.lit("/wiki")) | (F.startswith(href, F.lit("https")) & F.contains(href, F.lit("/wiki/")))


def path_anchor(href: Column) -> Column:
    return F.startswith(href, F.lit("/"))


ANCHOR_RULES = {"wiki": wiki_anchor, "wiki_start": wiki_start_anchor, "path": path_anchor}


def extract_anchors(df: DataFrame, rule: str = "wiki", html: str = "table_html", keys: tuple[str, ...] = ("table_id",), data_cells_only: bool = True) -> DataFrame:
    """Anchors of data cells (not header cells), in order, that pass the rule."""
    found = F.flatten(F.transform(M.data_cells(F.col(html)), M.anchors)) if data_cells_only else M.anchors(F.col(html))
    rows = df.select(*keys, F.posexplode(found).alias("pos", "a"))
    return rows.where(ANCHOR_RULES[rule](F.col("a.href"))).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.col("a.href").alias("link"), F.col("a.text").alias("text")
    )


def clean_anchors(anchors: DataFrame) -> DataFrame:
    """Anchor texts stripped, on one line, lower case."""
    return anchors.withColumn("text", T.clean_cell(F.col("text"), lower=True))


def anchors_by_text(anchors: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Distinct (text, link) per table with the text length: longest first is
    an order on that column."""
    return anchors.select(*keys, "text", "link").distinct().withColumn("length", F.length("text").cast("bigint"))


def anchors_by_link(anchors: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Distinct texts per table and link with their length, the order key."""
    return anchors_by_text(anchors, keys).select(*keys, "link", "text", "length")


def ambiguous_anchors(anchors: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Links under non-blank texts that name more than one link, and all links."""
    per_text = anchors_by_text(anchors, keys).groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("links"))
    return per_text.agg(
        F.coalesce(F.sum(F.when((F.col("links") > 1) & (F.trim("text") != ""), F.col("links"))), F.lit(0)).alias("ambiguous"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
    )


def canonical_links(links: DataFrame) -> DataFrame:
    """Distinct links with their canonical form; others are dropped."""
    return links.select("link").distinct().withColumn("canonical", L.canonical_link(F.col("link"))).where("canonical IS NOT NULL")


def link_inventory(anchors: DataFrame, keys: tuple[str, ...] = ("table_id",), order: str = "pos") -> DataFrame:
    """The link of every text of a table: the last one seen wins."""
    return last_per_key(anchors, [*keys, "text"], F.col(order), ["link"])


def nearest_revision(revisions: DataFrame, target: Column, key: str = "page") -> DataFrame:
    """The revision nearest to the target in whole days, first listed on ties.

    Days are floored, so half a day after the target counts as one day.
    """
    micros = F.unix_micros(target.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    days = F.abs(F.floor(micros / F.lit(86_400_000_000)))
    return revisions.groupBy(key).agg(
        F.min_by("revid", F.when(F.col("revid").isNotNull(), F.struct(days.alias("days"), "ord"))).alias("revid"),
        F.min(F.when(F.col("revid").isNotNull(), days)).alias("days"),
    )


def parse_revisions(raw: DataFrame, url: str = "url", text: str = "value") -> DataFrame:
    """Revision listings (nested JSON with a dynamic page id) to one row per
    revision in listed order; a page without any gives one row of nulls."""
    schema = "query struct<pages:map<string,struct<revisions:array<struct<revid:bigint,timestamp:string>>>>>"
    pages = raw.select(url, F.explode_outer(F.from_json(text, schema)["query"]["pages"]).alias("page_id", "p"))
    return pages.select(url, F.posexplode_outer("p.revisions").alias("ord", "r")).select(
        F.col(url).alias("page"), F.col("ord").cast("bigint").alias("ord"), F.col("r.revid").alias("revid"),
        F.to_timestamp("r.timestamp").alias("ts"),
    )


def attach_tables(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables of each query's revision page; ``found`` is false without any.

    ``queries``: query_url, revision_url. ``tables``: url, table_html, pos.
    """
    found = tables.select(F.col("url").alias("revision_url"), "pos", "table_html")
    return queries.join(found, "revision_url", "left").withColumn("found", F.col("pos").isNotNull())


def attached_counts(attached: DataFrame) -> DataFrame:
    """Queries with and without tables, and tables attached."""
    per_query = attached.groupBy("query_url").agg(F.count("pos").alias("tables"))
    return per_query.agg(
        F.count_if(F.col("tables") > 0).alias("found"), F.count_if(F.col("tables") == 0).alias("not_found"), F.sum("tables").alias("tables")
    )
