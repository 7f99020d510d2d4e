"""Sources, sinks and tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmosaic.catalog import inputs as I

from gridmosaic.catalog.registry import big, query
from gridmosaic.functions import links as L
from gridmosaic.operators import pages as PG, tagging as TG
from gridmosaic.operators.together import dealt
from gridmosaic.sources import files as SF, sinks as SK


@query("s01_last_line_wins", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def s01(spark, d):
    """Lines as JSON texts with a repeated key: the last one counts."""
    lines = I.table(spark, d, "events").select("event_id", F.to_json(F.struct("user_id", "event_type", "value")).alias("value"))
    rows = lines.select(F.col("event_id").alias("__at"), F.from_json("value", "user_id bigint, event_type string, value double").alias("r"))
    return SF.parse_last(rows.select("__at", "r.*"), "user_id")


@query("s02_json_map", "SELECT concat('e', event_id, '-k') AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def s02(spark, d):
    objects = I.table(spark, d, "events").select(F.replace("props", F.lit('"k"'), F.concat(F.lit('"e'), F.col("event_id").cast("string"), F.lit('-k"'))).alias("props"))
    return SF.explode_json_map(objects, "props", "bigint")


@query("s03_delimited", "SELECT c_custkey, c_name AS title, c_mktsegment AS headers FROM customer")
def s03(spark, d):
    """Pipe-separated metadata lines with an index column without a name."""
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
    lines = I.table(spark, d, "customer").select(line.alias("line"))
    return SF.parse_delimited(lines, "line", "`Unnamed: 0` string, c_custkey bigint, title string, headers string", "|")


@query("s07_record_lines", """
SELECT concat('{"o_orderkey":', o_orderkey, ',"status":', CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE concat('"', o_orderstatus, '"') END, '}') AS line FROM orders""")
def s07(spark, d):
    return SK.record_lines(I.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status")))


def linked_tables(spark, d):
    """Suppliers of a nation as source tables with links, one table per supplier."""
    k = F.col("s_suppkey").cast("string")

    def cell(text, *links):
        return F.struct(text.alias("text"), F.array(*links).cast("array<string>").alias("links"))

    header = F.array(cell(F.lit("Name")), cell(F.lit("Home")))
    rows = F.array(
        F.array(cell(F.col("s_name"), F.concat(F.lit("/wiki/Supplier_"), k)), cell(F.col("n_name"), F.concat(F.lit("/wiki/"), "n_name"), F.lit("/wiki/Map"))),
        F.array(cell(k), cell(F.lit(""))),
    )
    joined = I.table(spark, d, "supplier").join(I.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("s_suppkey").alias("table_id"), F.concat(F.lit("u/"), k).alias("url"), header.alias("header"), rows.alias("data"))


@query("s04_flatten_texts", """
WITH s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey AS table_id, concat('u/', s_suppkey) AS url, concat('Name|Home;', s_name, '|', n_name, ';', s_suppkey, '|') AS grid FROM s""")
def s04(spark, d):
    tables, _ = SF.flatten_linked_tables(linked_tables(spark, d))
    return tables.select("table_id", "url", F.array_join(F.transform("table_array", lambda r: F.array_join(r, "|")), ";").alias("grid"))


@query("s04_flatten_links", """
WITH s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey), one AS (SELECT CAST(1 AS BIGINT) AS r, CAST(0 AS BIGINT) AS z)
SELECT s_suppkey AS table_id, r AS row_idx, z AS col_idx, z AS ord, concat('/wiki/Supplier_', s_suppkey) AS link FROM s, one
UNION ALL SELECT s_suppkey, r, r, z, concat('/wiki/', n_name) FROM s, one UNION ALL SELECT s_suppkey, r, r, r, '/wiki/Map' FROM s, one""")
def s04_links(spark, d):
    return SF.flatten_linked_tables(linked_tables(spark, d))[1]


@query("s05_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def s05(spark, d):
    return SF.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", big(F.length("html"), "n"))


@query("s06_union_splits", """
SELECT c_custkey AS id, c_mktsegment AS kind, CAST(NULL AS DOUBLE) AS s_acctbal, 'train' AS split FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, 'test' FROM supplier""")
def s06(spark, d):
    train = I.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    test = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return SF.union_splits({"train": train, "test": test})


@query("s08_attach_base64", """
SELECT concat('p/', p_partkey, '.jpg') AS path, CASE WHEN p_size % 4 <> 0 THEN base64(encode(p_name)) END AS image_base64 FROM part""")
def s08(spark, d):
    parts = I.table(spark, d, "part")
    path = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    images = parts.where("p_size % 4 <> 0").select(path.alias("path"), F.col("p_name").cast("binary").alias("content"))
    return SF.attach_base64(parts.select(path.alias("path")), "path", images)


@query("s09_chunk_requests", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS chunk FROM orders")
def s09(spark, d):
    return SK.chunk_requests(I.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def _results(spark, d):
    orders = I.table(spark, d, "orders")
    inputs = orders.select(F.col("o_custkey").alias("key"))
    per = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderstatus").alias("m"), F.min("o_orderstatus").alias("n"))
    old = per.select("key", F.when(F.col("m") != "P", F.col("m")).alias("value"))
    new = per.where("key % 3 = 0").select("key", F.when(F.col("n") != "F", F.col("n")).alias("value"))
    return inputs, old, new


RESULTS = """
WITH per AS (SELECT o_custkey AS key, max(o_orderstatus) AS m, min(o_orderstatus) AS n FROM orders GROUP BY o_custkey)
, old AS (SELECT key, CASE WHEN m <> 'P' THEN m END AS value FROM per), new AS (SELECT key, CASE WHEN n <> 'F' THEN n END AS value FROM per WHERE key % 3 = 0)"""


@query("s10_frontier", RESULTS + " SELECT key FROM old WHERE value IS NULL")
def s10(spark, d):
    inputs, old, _ = _results(spark, d)
    return SK.frontier(inputs, old, "key")


@query("s10_merge_results", RESULTS + " SELECT key, coalesce(new.value, old.value) AS value FROM old FULL JOIN new USING (key)")
def s10_merge(spark, d):
    _, old, new = _results(spark, d)
    return SK.merge_results(old, new, "key")


# --- tagging: original cells of the part tables, tagged anew


def untagged(spark, d):
    """Cells with their original text, a link for every supplier and nation cell, and whether tables may be dealt whole."""
    whole = I.whole_tables(spark, d)
    facts = I.facts(spark, d)
    lines = dealt(facts, "table_id", whole)
    cells = I.cells(spark, d, lines, whole).withColumn("cell", F.col("original")).drop("original")
    k, n = F.col("s_suppkey").cast("string"), F.col("n_nationkey").cast("string")
    links = F.array(
        F.struct(F.lit(0).alias("col_idx"), F.lit(0).alias("ord"), F.concat(F.lit("/wiki/Supplier_"), k).alias("link")),
        F.struct(F.lit(1).alias("col_idx"), F.lit(0).alias("ord"), F.concat(F.lit("/wiki/n"), n, F.lit("/Home")).alias("link")),
        F.struct(F.lit(1).alias("col_idx"), F.lit(1).alias("ord"), F.concat(F.lit("/wiki/Supplier_"), k).alias("link")),
    )
    cell_links = facts.select("table_id", "row_idx", F.explode(links).alias("l")).select(
        "table_id", "row_idx", big("l.col_idx", "col_idx"), big("l.ord", "ord"), "l.link"
    )
    # the matched table lists suppliers by name; homes carry no text
    anchors = lines.select("table_id", F.col("s_name").alias("text"), F.concat(F.lit("/wiki/Supplier_"), k).alias("link"), (F.col("s_suppkey") + 0).alias("pos")).distinct()
    paths = F.array(
        F.struct(F.concat(F.lit(L.WIKI_HOST + "/wiki/Supplier_"), k).alias("link"), F.concat(F.lit("img/s"), k).alias("image_path")),
        F.struct(F.concat(F.lit(L.WIKI_HOST + "/wiki/n"), n, F.lit("/Home")).alias("link"), F.concat(F.lit("img/n"), n).alias("image_path")),
    )
    link_image = facts.where((F.col("s_suppkey") % 5 != 0) & (F.col("n_nationkey") % 2 == 0)).select(F.explode(paths).alias("p")).select("p.*").distinct()
    return cells, cell_links, anchors, link_image, whole


UNTAGGED = "WITH" + I.CELLS_SQL + """
, pictured AS (SELECT DISTINCT s_suppkey, n_nationkey FROM facts WHERE s_suppkey % 5 <> 0 AND n_nationkey % 2 = 0)
, sp AS (SELECT DISTINCT s_suppkey AS k FROM pictured), np AS (SELECT DISTINCT n_nationkey AS k FROM pictured)
, o AS (SELECT c.table_id, c.row_idx, c.col_idx, c.original, f.s_suppkey, f.n_nationkey, f.s_name, f.n_name, s_suppkey IN (SELECT k FROM sp) AS hs, n_nationkey IN (SELECT k FROM np) AS hn
   FROM cells c LEFT JOIN facts f ON f.table_id = c.table_id AND f.row_idx = c.row_idx)"""


@query("c10_tag_by_link", UNTAGGED + """
SELECT table_id, row_idx, col_idx, CASE WHEN row_idx = 0 THEN original
  WHEN col_idx = 0 AND hs THEN concat('{IMG-{DRV-', table_id, '-', row_idx, '-0-0}}')
  WHEN col_idx = 1 AND n_nationkey % 6 = 0 AND hn AND hs THEN concat(n_name, ' & {IMG-{DRV-', table_id, '-', row_idx, '-1-1}} ({IMG-{DRV-', table_id, '-', row_idx, '-1-0}})')
  WHEN col_idx = 1 AND hn THEN replace(original, 'home', concat('{IMG-{DRV-', table_id, '-', row_idx, '-1-0}}'))
  WHEN col_idx = 1 AND n_nationkey % 6 = 0 AND hs THEN replace(original, s_name, concat('{IMG-{DRV-', table_id, '-', row_idx, '-1-0}}'))
  ELSE original END AS tagged FROM o""")
def c10(spark, d):
    """Suppliers are found by their anchor text, homes by their link's last part."""
    cells, cell_links, anchors, link_image, whole = untagged(spark, d)
    return TG.tag_cells_by_link(cells, cell_links, anchors, link_image, I.DATASET, whole).select("table_id", "row_idx", "col_idx", "tagged")


@query("c10_link_counts", UNTAGGED + """
, r AS (SELECT DISTINCT table_id, row_idx, n_nationkey, hs, hn FROM o WHERE row_idx > 0)
SELECT count(*) FILTER (WHERE hs) * 2 + count(*) FILTER (WHERE hn) AS links, count(*) FILTER (WHERE NOT hs) * 2 + count(*) FILTER (WHERE NOT hn) AS without_image,
  count(*) FILTER (WHERE hs) + count(*) FILTER (WHERE hn) + count(*) FILTER (WHERE hs AND n_nationkey % 6 = 0) AS replaced FROM r""")
def c10_counts(spark, d):
    cells, cell_links, anchors, link_image, whole = untagged(spark, d)
    return TG.link_counts(TG.tag_cells_by_link(cells, cell_links, anchors, link_image, I.DATASET, whole), cell_links, link_image, whole)


@query("c11_tag_by_text", UNTAGGED + """
SELECT table_id, row_idx, col_idx, CASE WHEN row_idx = 0 OR NOT coalesce(hs, false) THEN original
  WHEN col_idx = 0 THEN concat('{IMG-{DRV-', table_id, '-', row_idx, '-0-0}}')
  WHEN col_idx = 1 AND n_nationkey % 6 = 0 THEN replace(original, s_name, concat('{IMG-{DRV-', table_id, '-', row_idx, '-1-0}}'))
  ELSE original END AS tagged FROM o""")
def c11(spark, d):
    cells, _, anchors, link_image, whole = untagged(spark, d)
    return TG.tag_cells_by_text(cells, anchors, link_image, I.DATASET, whole).select("table_id", "row_idx", "col_idx", "tagged")


@query("c11_hit_attributes", UNTAGGED + """
SELECT concat('{IMG-{DRV-', table_id, '-', row_idx, '-', col_idx, '-0}}') AS tag, concat('img/s', s_suppkey) AS image_path, s_name AS original_string, concat('https://en.wikipedia.org/wiki/Supplier_', s_suppkey) AS wiki_link
FROM o WHERE row_idx > 0 AND hs AND (col_idx = 0 OR (col_idx = 1 AND n_nationkey % 6 = 0))""")
def c11_hits(spark, d):
    cells, _, anchors, link_image, whole = untagged(spark, d)
    return TG.hit_attributes(TG.tag_cells_by_text(cells, anchors, link_image, I.DATASET, whole))


ANNOTATED = UNTAGGED + """
, an AS (SELECT *, CASE WHEN row_idx = 0 THEN NULL WHEN col_idx = 0 OR (col_idx = 1 AND n_nationkey % 6 = 0) THEN lower(s_name) WHEN col_idx = 1 THEN 'home' END AS link_text,
   CASE WHEN row_idx = 0 THEN NULL WHEN col_idx = 0 OR (col_idx = 1 AND n_nationkey % 6 = 0) THEN concat('/wiki/Supplier_', s_suppkey) WHEN col_idx = 1 THEN concat('/wiki/n', n_nationkey, '/Home') END AS link FROM o)"""


def _annotated(spark, d):
    cells, cell_links, anchors, _, whole = untagged(spark, d)
    return TG.annotate_links(cells, PG.clean_anchors(anchors), cell_links, whole)


@query("c14_annotate_links", ANNOTATED + """
SELECT table_id, row_idx, col_idx, CASE WHEN link IS NULL THEN original ELSE replace(lower(original), link_text, concat('{LINK{', link_text, '}{', link, '}}')) END AS annotated FROM an""")
def c14(spark, d):
    return _annotated(spark, d).select("table_id", "row_idx", "col_idx", "annotated")


@query("c14_matched_links", ANNOTATED + " SELECT DISTINCT table_id, link_text, link, starts_with(link, '/wiki/n') AS is_fallback FROM an WHERE link IS NOT NULL")
def c14_links(spark, d):
    return TG.matched_links(_annotated(spark, d))
