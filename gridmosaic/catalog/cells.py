"""Cells, tags and table text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmosaic.catalog import inputs as I
from gridmosaic.catalog.registry import big, query, rounded
from gridmosaic.functions import tags as T
from gridmosaic.operators import cells as C

W = I.TABLE_SQL
CLEAN = "replace(replace(replace(replace(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), chr(10), ' '), chr(9), ' '), chr(13), ' '), '  ', ' ')"
LINE = "replace(replace(replace(replace(replace(cell, chr(9), ' '), chr(10), ' '), '\\n', ' '), '\\t', ' '), '|', ' ')"
TAG = "'\\{IMG-\\{.*?\\}\\}'"


@query("c01_image_tags", W + " SELECT table_id, row_idx, col_idx, tag_pos, tag FROM tags")
def c01(spark, d):
    return C.explode_tags(I.cells(spark, d))


@query("c02_image_cells", W + f" SELECT col_idx, count(*) FILTER (WHERE len(regexp_extract_all(cell, {TAG})) > 0) AS image_cells, count(*) AS cells FROM cells GROUP BY col_idx")
def c02(spark, d):
    return I.cells(spark, d).groupBy("col_idx").agg(
        big(F.count_if(T.is_image_cell(F.col("cell"))), "image_cells"), big(F.count(F.lit(1)), "cells")
    )


@query("c03_entity_tags", f"""
WITH t AS (SELECT event_id, concat('see {{ENTITY-', event_id % 7, '}} and {{ENTITY_IMAGE-', user_id, '}}, {{ENTITY-x}} {{ENTITY-', user_id, '}}') AS c FROM events)
SELECT event_id, array_to_string(regexp_extract_all(c, '\\{{ENTITY-[0-9]+\\}}'), ' ') AS plain,
       array_to_string(regexp_extract_all(c, '\\{{ENTITY_IMAGE-.*?\\}}'), ' ') AS captioned FROM t""")
def c03(spark, d):
    user = F.col("user_id").cast("string")
    text = F.concat(
        F.lit("see {ENTITY-"), (F.col("event_id") % 7).cast("string"), F.lit("} and {ENTITY_IMAGE-"), user,
        F.lit("}, {ENTITY-x} {ENTITY-"), user, F.lit("}"),
    )
    return I.table(spark, d, "events").select(
        "event_id",
        F.array_join(T.entity_tags(text), " ").alias("plain"),
        F.array_join(T.entity_tags(text, "image"), " ").alias("captioned"),
    )


@query("c04_explode_assemble", W + " SELECT table_id, row_idx, col_idx, header, original, cell FROM cells")
def c04(spark, d):
    """Cells to grids and back: the round trip gives the cells."""
    base = I.cells(spark, d)
    grids = C.assemble_tables(base).join(
        C.assemble_tables(base, "original").withColumnRenamed("table_array", "original_table_array"), ["table_id", "chunk"]
    )
    return C.explode_cells(grids, "table_array", "original_table_array")


@query("c05_table_string", W + f"""
, lines AS (SELECT table_id, row_idx, concat(string_agg(concat({LINE}, ' | '), '' ORDER BY col_idx), chr(10)) AS line FROM cells GROUP BY ALL)
SELECT table_id, CAST(floor(row_idx / 1000) AS BIGINT) AS chunk, string_agg(line, '' ORDER BY row_idx) AS text FROM lines GROUP BY ALL""")
def c05(spark, d):
    return C.table_string(I.cells(spark, d))


VALID = f"""
, shares AS (SELECT table_id, col_idx, count(*) FILTER (WHERE regexp_matches(cell, {TAG})) AS images FROM cells GROUP BY ALL)
, sizes AS (SELECT table_id, max(row_idx) + 1 AS rows FROM cells GROUP BY ALL)
, valid AS (SELECT s.table_id, any_value(rows) AS rows, max(images) / any_value(rows) AS share FROM shares s JOIN sizes z ON s.table_id = z.table_id
   GROUP BY s.table_id HAVING any_value(rows) <= 32 AND max(images) / any_value(rows) >= 0.85)"""


@query("c06_valid_tables", W + VALID + " SELECT table_id, CAST(rows AS BIGINT) AS rows, round(share, 6) AS share FROM valid")
def c06(spark, d):
    return C.valid_tables(I.cells(spark, d), max_rows=32, min_frac=0.85).select("table_id", "rows", rounded("share"))


@query("c06_valid_tables_audit", W + VALID.replace("rows) <= 32", "rows) <= 55").replace(">= 0.85", "BETWEEN 0.3 AND 0.75") + " SELECT table_id, CAST(rows AS BIGINT) AS rows, round(share, 6) AS share FROM valid")
def c06_audit(spark, d):
    return C.valid_tables(I.cells(spark, d), max_frac=0.75).select("table_id", "rows", rounded("share"))


@query("c07_filter_questions", W + VALID + " SELECT l_orderkey, l_linenumber, l_partkey AS table_context FROM lineitem SEMI JOIN valid ON l_partkey = table_id")
def c07(spark, d):
    questions = I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("table_context"))
    return C.filter_questions(questions, C.valid_tables(I.cells(spark, d), max_rows=32, min_frac=0.85)).select(
        "l_orderkey", "l_linenumber", "table_context"
    )


@query("c08_restore_text", W + " SELECT table_id, row_idx, col_idx, original AS restored FROM cells")
def c08(spark, d):
    """Restoring every tag must give back the original cell."""
    lines = I.facts(spark, d)
    out = C.restore_text(I.cells(spark, d, lines), I.image_tags(spark, d, lines))
    return out.select("table_id", "row_idx", "col_idx", "restored")


@query("c09_replace_bounded", """
WITH t AS (SELECT doc_id, concat(' ', text, ' ') AS p FROM documents),
r AS (SELECT doc_id, p, regexp_replace(p, '([^a-zA-Z0-9])the([^a-zA-Z0-9])', '\\1{IMG-{D}}\\2', 'gi') AS q FROM t)
SELECT doc_id, regexp_replace(q, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS result, p = q AS is_unchanged FROM r""")
def c09(spark, d):
    r = T.replace_bounded(F.col("text"), F.lit("the"), F.lit("{IMG-{D}}"))
    return I.table(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.result", "r.is_unchanged")


@query("c12_alpha_ratio", """
WITH t AS (SELECT doc_id, length(replace(text, ' ', '')) AS n, length(regexp_replace(replace(text, ' ', ''), '[^\\p{L}]', '', 'g')) AS a FROM documents)
SELECT doc_id, CASE WHEN n = a THEN 1.0 ELSE round(a / (n - a), 6) END AS ratio FROM t""")
def c12(spark, d):
    return I.table(spark, d, "documents").select("doc_id", rounded(T.alpha_ratio(F.col("text")), "ratio"))


@query("c13_notes_header", """
WITH h AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(p_name, ' Notes') WHEN 1 THEN concat(p_type, ' COMMENT') WHEN 2 THEN 'Description' ELSE p_name END AS header FROM part)
SELECT p_partkey, header, regexp_matches(lower(header), 'note|comment|description') AS notes, regexp_matches(lower(header), 'note|comment') AS notes_text FROM h""")
def c13(spark, d):
    case = F.col("p_size") % 4
    header = (
        F.when(case == 0, F.concat("p_name", F.lit(" Notes"))).when(case == 1, F.concat("p_type", F.lit(" COMMENT")))
        .when(case == 2, F.lit("Description")).otherwise(F.col("p_name"))
    )
    return I.table(spark, d, "part").select("p_partkey", header.alias("header")).select(
        "p_partkey", "header",
        T.is_notes_header(F.col("header")).alias("notes"),
        T.is_notes_header(F.col("header"), T.NOTES_WORDS_TEXT_TAGGER).alias("notes_text"),
    )


@query("c15_row_infobox", W + " SELECT table_id, row_idx, string_agg(concat(header, ': ', cell), chr(10) ORDER BY col_idx) AS infobox FROM cells WHERE row_idx > 0 GROUP BY ALL")
def c15(spark, d):
    return C.row_infobox(I.cells(spark, d))


@query("c16_context_rows", W + f"""
, free AS (SELECT table_id, col_idx, row_idx FROM cells WHERE row_idx > 0 AND NOT regexp_matches(cell, {TAG}))
, f3 AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_idx ORDER BY row_idx) AS rn FROM free QUALIFY rn <= 3)
SELECT c.table_id, c.row_idx, c.col_idx, row_number() OVER (PARTITION BY c.table_id, c.row_idx, c.col_idx ORDER BY f3.row_idx) AS ord, f3.row_idx AS context_row
FROM cells c JOIN f3 ON c.table_id = f3.table_id AND c.col_idx = f3.col_idx AND c.row_idx <> f3.row_idx WHERE c.row_idx > 0 QUALIFY ord <= 2""")
def c16(spark, d):
    return C.context_rows(I.cells(spark, d))


PATHS = """
, placed AS (SELECT t.*, i.image_path FROM tags t JOIN image_tags i ON t.tag = i.tag)
, firsts AS (SELECT table_id, image_path, min((row_idx, col_idx, tag_pos)) AS first, arg_min(tag, (row_idx, col_idx, tag_pos)) AS representative FROM placed GROUP BY ALL)
, unified AS (SELECT p.*, concat('{ENTITY_IMAGE-', n, '}') AS entity FROM placed p JOIN
   (SELECT table_id, image_path, row_number() OVER (PARTITION BY table_id ORDER BY first) AS n FROM firsts) f ON p.table_id = f.table_id AND p.image_path = f.image_path)"""


def _tagged(spark, d):
    """(cells, their tags, attributes of tags, whether tables may be dealt whole)."""
    whole = I.whole_tables(spark, d)
    lines = I.facts(spark, d)
    return I.cells(spark, d, lines, whole), C.explode_tags(I.cells(spark, d, lines)), I.image_tags(spark, d, lines), whole


@query("c17_image_keys", W + PATHS + """
, p0 AS (SELECT c.table_id, c.row_idx, c.col_idx, any_value(c.cell) AS cell, list([u.tag, u.entity] ORDER BY u.tag_pos) AS l
   FROM cells c JOIN unified u ON c.table_id = u.table_id AND c.row_idx = u.row_idx AND c.col_idx = u.col_idx GROUP BY c.table_id, c.row_idx, c.col_idx)
, pieces AS (SELECT table_id, row_idx, col_idx, CASE WHEN len(l) = 1 THEN replace(cell, l[1][1], l[1][2]) ELSE replace(replace(cell, l[1][1], l[1][2]), l[2][1], l[2][2]) END AS cell_text FROM p0)
, keys AS (SELECT table_id, col_idx, cell_text, min(row_idx) AS key_row, count(*) AS cells FROM pieces GROUP BY ALL)
SELECT u.table_id, u.row_idx, u.col_idx, u.tag_pos, u.tag, u.entity, concat_ws('+', u.table_id, k.cell_text, u.col_idx) AS image_key, k.key_row, k.cells
FROM unified u JOIN pieces p ON u.table_id = p.table_id AND u.row_idx = p.row_idx AND u.col_idx = p.col_idx
JOIN keys k ON k.table_id = p.table_id AND k.col_idx = p.col_idx AND k.cell_text = p.cell_text""")
def c17(spark, d):
    cells, tags, attributes, whole = _tagged(spark, d)
    return C.image_keys(cells, C.unify_by_path(tags, attributes, whole), whole).select(
        "table_id", "row_idx", "col_idx", "tag_pos", "tag", "entity", "image_key", "key_row", "cells"
    )


@query("c18_unify_by_path", W + PATHS + " SELECT table_id, row_idx, col_idx, tag_pos, tag, image_path, entity FROM unified")
def c18(spark, d):
    _, tags, attributes, whole = _tagged(spark, d)
    return C.unify_by_path(tags, attributes, whole)


@query("c19_number_tags", W + """
, f AS (SELECT table_id, tag, min((row_idx, col_idx, tag_pos)) AS first FROM tags GROUP BY ALL)
SELECT table_id, tag, concat('{ENTITY-', row_number() OVER (PARTITION BY table_id ORDER BY first), '}') AS entity FROM f""")
def c19(spark, d):
    return C.number_tags(_tagged(spark, d)[1])


@query("c20_normalize_tags", W + PATHS + """
SELECT DISTINCT p.table_id, p.tag, f.representative, concat('{ENTITY-', n, '}') AS entity FROM placed p
JOIN (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY representative) AS n FROM firsts) f ON p.table_id = f.table_id AND p.image_path = f.image_path""")
def c20(spark, d):
    _, tags, attributes, whole = _tagged(spark, d)
    return C.normalize_tags(tags, attributes, whole)


@query("c21_nested_tags", """
WITH c AS (SELECT p_partkey AS table_id, p_size AS row_idx, 0 AS col_idx, CASE WHEN p_size % 5 = 0 THEN concat('x {IMG-{A-{IMG-{B-', p_partkey, '}}}} y')
   ELSE concat('{IMG-{A-', p_partkey, '}} {IMG-{B-1}}') END AS cell FROM part)
SELECT table_id, CAST(row_idx AS BIGINT) AS row_idx, CAST(0 AS BIGINT) AS tag_pos, regexp_extract(cell, '\\{IMG-\\{.*?\\}\\}') AS tag FROM c WHERE row_idx % 5 = 0""")
def c21(spark, d):
    key = F.col("p_partkey").cast("string")
    cell = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("x {IMG-{A-{IMG-{B-"), key, F.lit("}}}} y"))).otherwise(
        F.concat(F.lit("{IMG-{A-"), key, F.lit("}} {IMG-{B-1}}"))
    )
    cells = I.table(spark, d, "part").select(
        F.col("p_partkey").alias("table_id"), big("p_size", "row_idx"), F.lit(0).alias("col_idx"), cell.alias("cell")
    )
    return C.nested_tags(cells).select("table_id", "row_idx", "tag_pos", "tag")


@query("c21_digit_strings", "WITH" + I.FACTS_SQL + "," + I.IMAGE_TAGS_SQL + " SELECT DISTINCT original_string, length(original_string) AS length FROM image_tags WHERE regexp_matches(original_string, '[0-9]')")
def c21_digits(spark, d):
    return C.digit_strings(I.image_tags(spark, d))


@query("c22_clean_cell", f"SELECT doc_id, {CLEAN.format(c='text')} AS cleaned, {CLEAN.format(c='lower(text)')} AS cleaned_lower FROM documents")
def c22(spark, d):
    return I.table(spark, d, "documents").select(
        "doc_id", T.clean_cell(F.col("text")).alias("cleaned"), T.clean_cell(F.col("text"), lower=True).alias("cleaned_lower")
    )


@query("c23_indexed_table", W + f"""
SELECT table_id, CAST(-1 AS BIGINT) AS row_idx, concat('0 | ', string_agg(concat(col_idx + 1, ' | '), '' ORDER BY col_idx)) AS line FROM cells WHERE row_idx = 0 GROUP BY table_id
UNION ALL
SELECT table_id, row_idx, concat(CASE WHEN row_idx = 0 THEN 'index' ELSE concat('', row_idx - 1) END, ' | ', string_agg(concat({LINE}, ' | '), '' ORDER BY col_idx)) FROM cells GROUP BY table_id, row_idx""")
def c23(spark, d):
    return C.indexed_rows(I.cells(spark, d))


@query("c23_addressed_table", W + f"""
, lines AS (SELECT table_id, row_idx, concat(string_agg(concat(replace(concat(cell, ' (', row_idx, ', ', col_idx, ')'), '|', ' '), ' | '), '' ORDER BY col_idx), chr(10)) AS line FROM cells GROUP BY ALL)
SELECT table_id, CAST(floor(row_idx / 1000) AS BIGINT) AS chunk, string_agg(line, '' ORDER BY row_idx) AS text FROM lines GROUP BY ALL""")
def c23_addressed(spark, d):
    return C.table_string(C.addressed_cells(I.cells(spark, d)))
