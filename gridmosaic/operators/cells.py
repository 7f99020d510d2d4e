"""The cell relation: one row per cell, ``row_idx`` 0 is the header.

Columns: table_id, row_idx, col_idx, header, original, cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.functions import tags as T
from gridmosaic.operators.ranking import HOT_GROUP_ROWS, position_in_group, top_k
from gridmosaic.operators.together import dealt, met, stacked

ROWS_PER_CHUNK = 1000
MAX_TABLE_ROWS = 55
MIN_IMAGE_SHARE = 0.3


def explode_cells(tables: DataFrame, grid: str = "table_array", original: str | None = None) -> DataFrame:
    """Table records with a grid column to cells. Ragged rows are kept."""
    base = tables.select("table_id", F.col(grid).alias("g"), F.col(original or grid).alias("o"), F.get(F.col(grid), F.lit(0)).alias("h"))
    rows = base.select("table_id", "h", "o", F.posexplode("g").alias("row_idx", "row"))
    cells = rows.select("table_id", "row_idx", "h", F.get("o", F.col("row_idx")).alias("orow"), F.posexplode("row").alias("col_idx", "cell"))
    return cells.select(
        "table_id",
        F.col("row_idx").cast("bigint").alias("row_idx"),
        F.col("col_idx").cast("bigint").alias("col_idx"),
        F.get("h", F.col("col_idx")).alias("header"),
        F.get("orow", F.col("col_idx")).alias("original"),
        "cell",
    )


def ordered_texts(order: Column, text: Column) -> Column:
    """Aggregate: the texts of a bounded group, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda s: s["t"])


def assemble_rows(cells: DataFrame, col: str = "cell") -> DataFrame:
    """Cells to one array per table row (a row is as wide as one source record)."""
    return cells.groupBy("table_id", "row_idx").agg(ordered_texts(F.col("col_idx"), F.col(col)).alias("row"))


def assemble_tables(cells: DataFrame, col: str = "cell", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Cells back to grids. A table of more than ``rows_per_chunk`` rows comes
    out as several chunks in order, so no single value grows without bound."""
    rows = assemble_rows(cells, col).withColumn("chunk", F.floor(F.col("row_idx") / rows_per_chunk))
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "row")))
    return rows.groupBy("table_id", "chunk").agg(F.transform(ordered, lambda s: s["row"]).alias("table_array"))


def row_line(row: Column) -> Column:
    """``a | b | `` and a line break."""
    return F.concat(F.array_join(F.transform(row, lambda c: F.concat(T.cell_line_text(c), F.lit(" | "))), ""), F.lit("\n"))


def table_string_column(grid: Column) -> Column:
    """Table text of a grid column, with no shuffle at all."""
    return F.array_join(F.transform(grid, row_line), "")


def table_string(cells: DataFrame, col: str = "cell", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Table text from cells; chunk texts of one table concatenate in order."""
    lines = cells.groupBy("table_id", "row_idx").agg(
        F.array_join(ordered_texts(F.col("col_idx"), F.concat(T.cell_line_text(F.col(col)), F.lit(" | "))), "").alias("line")
    )
    return (
        lines.withColumn("chunk", F.floor(F.col("row_idx") / rows_per_chunk))
        .groupBy("table_id", "chunk")
        .agg(F.array_join(ordered_texts(F.col("row_idx"), F.concat("line", F.lit("\n"))), "").alias("text"))
    )


def column_shares(cells: DataFrame) -> DataFrame:
    """Image cells and rows per column, header counted in both."""
    return cells.groupBy("table_id", "col_idx").agg(
        F.count_if(T.is_image_cell(F.col("cell"))).alias("images"),
        (F.max("row_idx") + 1).alias("rows"),
    )


def valid_tables(
    cells: DataFrame,
    max_rows: int = MAX_TABLE_ROWS,
    min_frac: float = MIN_IMAGE_SHARE,
    max_frac: float | None = None,
) -> DataFrame:
    """Tables small enough whose best column is image-rich enough."""
    # the table's own row count: a ragged column may be shorter than the table
    per_table = column_shares(cells).groupBy("table_id").agg(
        F.max("rows").alias("rows"), F.max("images").alias("images")
    )
    share = F.col("images").cast("double") / F.col("rows")
    keep = (F.col("rows") <= max_rows) & (share >= min_frac)
    if max_frac is not None:
        keep = keep & (share <= max_frac)
    return per_table.where(keep).select("table_id", "rows", share.alias("share"))


def filter_questions(questions: DataFrame, valid: DataFrame, key: str = "table_context") -> DataFrame:
    """Questions whose table is valid."""
    return questions.join(valid.select(F.col("table_id").alias(key)), key, "left_semi")


def explode_tags(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per image tag, with its position in the cell."""
    # a cell without a tag gives no row, so it is searched once
    return cells.select(
        "table_id", "row_idx", "col_idx", *keep, F.posexplode(T.image_tags(F.col("cell"))).alias("tag_pos", "tag")
    ).withColumn("tag_pos", F.col("tag_pos").cast("bigint"))


def replace_tags(cells: DataFrame, replacements: DataFrame, out: str = "restored", default: Column | None = None, whole: bool = False) -> DataFrame:
    """Rewrite cells by a (tag, new_text) relation; tags without a row stay, or
    become ``default``. With ``out`` as ``cell`` the old cell is not carried along.

    Only cells that hold tags take part in the join. The rewritten cell is
    rebuilt from its own pieces, so the aggregation is as small as one cell.
    With ``whole`` tables, none of which is too large for a task, the pieces
    come back to their table, and replacements that name it (``table_id``) meet them there.
    """
    cell = F.col("cell")
    key = ["table_id", "row_idx", "col_idx"]
    rest = [c for c in cells.columns if c not in (*key, out)]
    plain = cells.where(~T.is_image_cell(cell) | cell.isNull()).withColumn(out, cell)
    parts = F.arrays_zip(F.split(cell, T.IMAGE_TAG).alias("before"), T.image_tags(cell).alias("tag"))
    # the other columns ride on the first piece only
    pieces = cells.where(T.is_image_cell(cell)).select(*key, *([F.struct(*rest).alias("rest")] if rest else []), F.posexplode(parts).alias("pos", "piece")).select(
        *key, *([F.when(F.col("pos") == 0, F.col("rest")).alias("rest")] if rest else []), "pos", "piece.before", "piece.tag"
    ).where("tag IS NOT NULL OR before <> ''")  # most cells end with a tag: the empty text behind it would only meet all others without a tag
    spare = F.col("tag") if default is None else F.when(F.col("tag").isNotNull(), default)
    text = F.concat("before", F.coalesce("new_text", spare, F.lit("")))
    if whole and "table_id" in replacements.columns:
        told = met(dealt(pieces, "table_id"), dealt(replacements.select("table_id", "tag", "new_text"), "table_id"), ["table_id", "tag"], "left", ["table_id"])
    else:
        told = pieces.join(replacements.select("tag", "new_text"), "tag", "left")
    done = (
        dealt(told.select(*key, *(["rest"] if rest else []), "pos", text.alias("text")), "table_id", whole)
        .groupBy(*key)
        .agg(F.array_join(ordered_texts(F.col("pos"), F.col("text")), "").alias(out), *([F.first("rest", ignorenulls=True).alias("rest")] if rest else []))
        .select(*key, *[F.col(f"rest.{c}").alias(c) for c in rest], out)
    )
    return stacked([plain, done], "table_id") if whole else plain.unionByName(done)


def restore_text(cells: DataFrame, image_tags: DataFrame, which: DataFrame | None = None, out: str = "restored", whole: bool = False) -> DataFrame:
    """Tags back to their original strings; ``which`` limits it to some tags."""
    chosen = image_tags if which is None else image_tags.join(which.select("tag").distinct(), "tag", "left_semi")
    return replace_tags(cells, chosen.select("tag", F.col("original_string").alias("new_text")), out, whole=whole)


def row_infobox(cells: DataFrame) -> DataFrame:
    """Each data row as ``header: value`` lines."""
    line = F.concat("header", F.lit(": "), "cell")
    return (
        cells.where(F.col("row_idx") > 0)
        .groupBy("table_id", "row_idx")
        .agg(F.array_join(ordered_texts(F.col("col_idx"), line), "\n").alias("infobox"))
    )


def context_rows(cells: DataFrame, k: int = 2) -> DataFrame:
    """For each data cell, the first ``k`` other rows whose cell in the same
    column holds no tag.

    The first k + 1 tag-free rows of a column serve every cell of it, so the
    column is reduced to k + 1 rows before the join: no pairs are formed.
    """
    data = cells.where(F.col("row_idx") > 0)
    free = (
        top_k(data.where(~T.is_image_cell(F.col("cell"))).select("table_id", "col_idx", "row_idx"), ["table_id", "col_idx"], [F.col("row_idx")], k + 1)
        .groupBy("table_id", "col_idx")
        .agg(F.array_sort(F.collect_list("row_idx")).alias("free"))
    )
    return (
        data.join(free, ["table_id", "col_idx"])
        .select("table_id", "row_idx", "col_idx", F.slice(F.filter("free", lambda r: r != F.col("row_idx")), 1, k).alias("context"))
        .select("table_id", "row_idx", "col_idx", F.posexplode("context").alias("ord", "context_row"))
        .withColumn("ord", (F.col("ord") + 1).cast("bigint"))
    )


def tag_paths(tags: DataFrame, image_tags: DataFrame) -> DataFrame:
    """Tags with their image path and their place in reading order."""
    return tags.join(image_tags.select("tag", "image_path"), "tag").withColumn(
        "place", F.struct("row_idx", "col_idx", "tag_pos")
    )


def _hot_tables(tags: DataFrame) -> DataFrame:
    """Tables that may have more than a hot group's rows of distinct tags or images.

    Counted on the tags alone, so what is made of them is not worked out twice.
    """
    return tags.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_GROUP_ROWS).select("table_id")


def _numbered(firsts: DataFrame, tags: DataFrame) -> DataFrame:
    """Number the items of a table by first appearance."""
    bucket = F.floor(F.col("first.row_idx") / ROWS_PER_CHUNK)
    return position_in_group(firsts, ["table_id"], [F.col("first")], bucket, "n", hot_groups=_hot_tables(tags))


def _together(placed: DataFrame) -> DataFrame:
    """Placed tags of whole tables, dealt by table; the place is made again there."""
    return dealt(placed.drop("place").where("table_id IS NOT NULL"), "table_id").withColumn("place", F.struct("row_idx", "col_idx", "tag_pos"))


def unify_by_path(tags: DataFrame, image_tags: DataFrame, whole: bool = False) -> DataFrame:
    """Tags of one image share ``{ENTITY_IMAGE-n}``; n counts the images of a
    table by first appearance. ``whole`` tables are numbered where their tags meet once."""
    placed = tag_paths(tags, image_tags)
    if whole:
        first = F.min("place").over(W.partitionBy("table_id", "image_path"))
        n = F.dense_rank().over(W.partitionBy("table_id").orderBy("first", "image_path"))
        return _together(placed).withColumn("first", first).withColumn("n", n).where("image_path IS NOT NULL").select(
            "table_id", "row_idx", "col_idx", "tag_pos", "tag", "image_path", F.concat(F.lit("{ENTITY_IMAGE-"), "n", F.lit("}")).alias("entity")
        )
    firsts = placed.groupBy("table_id", "image_path").agg(F.min("place").alias("first"))
    named = _numbered(firsts, tags).select("table_id", "image_path", F.concat(F.lit("{ENTITY_IMAGE-"), "n", F.lit("}")).alias("entity"))
    return placed.join(named, ["table_id", "image_path"]).select(
        "table_id", "row_idx", "col_idx", "tag_pos", "tag", "image_path", "entity"
    )


def number_tags(tags: DataFrame, whole: bool = False) -> DataFrame:
    """Each distinct tag of a table as ``{ENTITY-n}``, by first appearance."""
    firsts = tags.groupBy("table_id", "tag").agg(F.min(F.struct("row_idx", "col_idx", "tag_pos")).alias("first"))
    numbered = firsts.withColumn("n", F.row_number().over(W.partitionBy("table_id").orderBy("first"))) if whole else _numbered(firsts, tags)
    return numbered.select("table_id", "tag", F.concat(F.lit("{ENTITY-"), "n", F.lit("}")).alias("entity"))


def normalize_tags(tags: DataFrame, image_tags: DataFrame, whole: bool = False) -> DataFrame:
    """Tags of one image share ``{ENTITY-n}``; n ranks the first-seen tags of
    a table's images as strings. ``whole`` as for ``unify_by_path``."""
    placed = tag_paths(tags, image_tags)
    if whole:
        representative = F.min_by("tag", "place").over(W.partitionBy("table_id", "image_path"))
        n = F.dense_rank().over(W.partitionBy("table_id").orderBy("representative"))
        return _together(placed).withColumn("representative", representative).withColumn("n", n).where("image_path IS NOT NULL").select(
            "table_id", "tag", "representative", F.concat(F.lit("{ENTITY-"), "n", F.lit("}")).alias("entity")
        ).distinct()
    reps = placed.groupBy("table_id", "image_path").agg(F.min_by("tag", "place").alias("representative"))
    distinct = reps.select("table_id", "representative").distinct()
    # a tag is its table's prefix and <row>-<col>-<n>; buckets are the first digits of the latter
    tag, place = F.col("representative"), F.substring_index("representative", "-", -3)
    bucket = F.concat(F.substring(tag, F.lit(1), F.length(tag) - F.length(place)), F.substring(place, 1, 4))
    ranked = position_in_group(distinct, ["table_id"], [tag], bucket, "n", hot_groups=_hot_tables(tags))
    names = reps.join(ranked, ["table_id", "representative"]).select(
        "table_id", "image_path", "representative", F.concat(F.lit("{ENTITY-"), "n", F.lit("}")).alias("entity")
    )
    return placed.join(names, ["table_id", "image_path"]).select("table_id", "tag", "representative", "entity").distinct()


def entity_text(cells: DataFrame, names: DataFrame, whole: bool = False) -> DataFrame:
    """Cells with their image tags replaced by entity tags."""
    # dealt by tag at once: equal rows meet there, and so does the join
    new = names.select("tag", F.col("entity").alias("new_text")).repartition("tag").distinct()
    return replace_tags(cells, new, out="cell", whole=whole)


def _named_cells(cells: DataFrame, unified: DataFrame) -> DataFrame:
    """Image cells of whole tables: their unified text, and the rows of ``unified`` that are theirs, in ``tags``."""
    key = ["table_id", "row_idx", "col_idx"]
    texts = dealt(cells.where(T.is_image_cell(F.col("cell"))).where("table_id IS NOT NULL AND col_idx IS NOT NULL").select(*key, "cell"), "table_id")
    tags = dealt(unified, "table_id").select(*key, F.struct("tag_pos", "tag", "entity").alias("tags"))
    met_there = stacked([texts, tags], "table_id", "__table").groupBy("__table", *key[1:]).agg(F.collect_list("cell").alias("cell"), F.collect_list("tags").alias("tags")).withColumnRenamed("__table", "table_id")
    known = F.array_distinct(F.transform("tags", lambda u: F.struct(u["tag"].alias("tag"), u["entity"].alias("entity"))))

    def pieces(cell: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            new = F.transform(F.filter(known, lambda k: k["tag"] == p["tag"]), lambda k: k["entity"])
            texts = F.when(F.size(new) > 0, new).otherwise(F.array(F.coalesce(p["tag"], F.lit(""))))
            return F.transform(texts, lambda t: F.struct(i.alias("o"), F.concat(p["before"], t).alias("t")))

        return F.flatten(F.transform(F.arrays_zip(F.split(cell, T.IMAGE_TAG).alias("before"), T.image_tags(cell).alias("tag")), piece))

    text = F.array_join(F.transform(F.array_sort(F.flatten(F.transform("cell", pieces))), lambda s: s["t"]), "")
    return met_there.where(F.size("cell") > 0).select(*key, text.alias("cell_text"), "tags")


def image_keys(cells: DataFrame, unified: DataFrame, whole: bool = False) -> DataFrame:
    """Image cells of a table with the same unified text in the same column
    form one key; the first row stands for it.

    ``unified`` comes from ``unify_by_path``. One row per tag: the key text,
    the representative row and the tag's own place. The cells of ``whole`` tables
    meet their tags in one task.
    """
    if whole:
        keys = _with_keys(_named_cells(cells, unified)).where("row_idx IS NOT NULL")
        return keys.withColumn("u", F.explode("tags")).select(
            "table_id", "row_idx", "col_idx", "u.tag_pos", "u.tag", "u.entity", "cell_text", "key_row", "cells", "image_key"
        )
    named = entity_text(cells.where(T.is_image_cell(F.col("cell"))).select("table_id", "row_idx", "col_idx", "cell"), unified)
    keyed = named.select("table_id", "row_idx", "col_idx", F.col("cell").alias("cell_text")).where("table_id IS NOT NULL AND col_idx IS NOT NULL")
    return unified.select("table_id", "row_idx", "col_idx", "tag_pos", "tag", "entity").join(
        _with_keys(keyed), ["table_id", "row_idx", "col_idx"]
    )


def _with_keys(keyed: DataFrame) -> DataFrame:
    same = W.partitionBy("table_id", "col_idx", "cell_text")
    return keyed.withColumn("key_row", F.min("row_idx").over(same)).withColumn("cells", F.count(F.lit(1)).over(same)).withColumn(
        "image_key", F.concat_ws("+", F.col("table_id").cast("string"), "cell_text", F.col("col_idx").cast("string"))
    )


def nested_tags(cells: DataFrame) -> DataFrame:
    """Tags that hold the start of another tag: none are expected."""
    return explode_tags(cells).where(F.size(F.split("tag", r"\{IMG-\{")) > 2)


def digit_strings(image_tags: DataFrame) -> DataFrame:
    """Distinct original strings that hold a digit, with their length."""
    return (
        image_tags.where(T.has_digit(F.col("original_string")))
        .select("original_string")
        .distinct()
        .withColumn("length", F.length("original_string").cast("bigint"))
    )


def indexed_rows(cells: DataFrame) -> DataFrame:
    """Table text with row and column numbers, one line per row.

    The line of column numbers comes first, as row -1; the index column is
    column 0 and data rows count from 0.
    """
    label = F.when(F.col("row_idx") == 0, F.lit("index")).otherwise((F.col("row_idx") - 1).cast("string"))
    line = F.array_join(ordered_texts(F.col("col_idx"), F.concat(T.cell_line_text(F.col("cell")), F.lit(" | "))), "")
    body = cells.groupBy("table_id", "row_idx").agg(line.alias("line")).select(
        "table_id", "row_idx", F.concat(label, F.lit(" | "), "line").alias("line")
    )
    number = F.concat((F.col("col_idx") + 1).cast("string"), F.lit(" | "))
    head = cells.where(F.col("row_idx") == 0).groupBy("table_id").agg(
        F.array_join(ordered_texts(F.col("col_idx"), number), "").alias("numbers")
    ).select("table_id", F.lit(-1).cast("bigint").alias("row_idx"), F.concat(F.lit("0 | "), "numbers").alias("line"))
    return head.unionByName(body)


def addressed_cells(cells: DataFrame) -> DataFrame:
    """Debug form: each cell followed by ``(row, col)``."""
    return cells.withColumn(
        "cell", F.concat("cell", F.lit(" ("), F.col("row_idx").cast("string"), F.lit(", "), F.col("col_idx").cast("string"), F.lit(")"))
    )
