"""Entities and tag disposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmosaic.catalog import inputs as I
from gridmosaic.catalog.registry import big, query
from gridmosaic.functions import tags as T
from gridmosaic.operators import cells as C, disposition as D, entities as E

W = "WITH" + I.ENTITIES_SQL


@query("e01_classify_entities", W + " SELECT qid, entity_class FROM classes")
def e01(spark, d):
    return I.classes(spark, d)


@query("e02_annotation_kind", """
WITH t AS (SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 'Coat of ARMS' WHEN 1 THEN 'xxx collage' WHEN 2 THEN 'a Location' WHEN 3 THEN o_orderpriority WHEN 4 THEN 'no logo xxx' END AS remarks FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(lower(remarks), 'logo|flag|seal|coat|coa') THEN 'seal' WHEN contains(lower(remarks), 'xxx') THEN 'xxx'
  WHEN regexp_matches(lower(remarks), 'collage|location') THEN 'collage' ELSE 'normal' END AS kind FROM t""")
def e02(spark, d):
    k = F.col("o_custkey") % 6
    remarks = (
        F.when(k == 0, "Coat of ARMS").when(k == 1, "xxx collage").when(k == 2, "a Location")
        .when(k == 3, F.col("o_orderpriority")).when(k == 4, "no logo xxx")
    )
    return I.table(spark, d, "orders").select("o_orderkey", E.annotation_kind(remarks).alias("kind"))


@query("e03_entity_views", W + " SELECT qid, views FROM entity_views")
def e03(spark, d):
    return E.entity_views(E.link_views(I.pageviews(spark, d)), I.link_entity(spark, d))


@query("e04_link_views", W + " SELECT link, views FROM link_views")
def e04(spark, d):
    return E.link_views(I.pageviews(spark, d))


@query("e05_class_links", W + " SELECT entity_class, link FROM link_entity JOIN classes USING (qid)")
def e05(spark, d):
    return E.class_links(I.classes(spark, d), I.link_entity(spark, d))


PICTURED = "SELECT link FROM link_entity WHERE contains(link, 'Nation') AND NOT ends_with(link, '3')"


@query("e06_uncategorised", W + f"""
SELECT DISTINCT qid, qid IN (SELECT qid FROM link_entity WHERE link IN ({PICTURED})) AS has_image FROM link_entity WHERE qid NOT IN (SELECT qid FROM entity_category)""")
def e06(spark, d):
    links = I.link_entity(spark, d)
    pictured = links.where(F.contains("link", F.lit("Nation")) & ~F.endswith("link", F.lit("3")))
    return E.uncategorised(links, I.entity_category(spark, d), links, pictured)


# links, galleries and file-page categories for image classes
GALLERIES_SQL = W + """
, images AS (SELECT link, CASE WHEN length(link) % 2 = 0 OR qid LIKE '%5' THEN concat('https://x.org/wiki/File:', CASE WHEN qid LIKE '%2' THEN 'Flag_' WHEN qid LIKE '%4' THEN 'Film_series_' ELSE 'Pic_' END, qid, '.png') END AS single_image FROM link_entity)
, landscapes AS (SELECT link, concat('https://x.org/wiki/File:View_', qid, '_', n, '.jpg') AS image_url FROM link_entity, (VALUES (0), (1)) t(n) WHERE qid LIKE '%1')
, emblems AS (SELECT link, concat('https://x.org/wiki/File:', CASE WHEN qid LIKE '%03' THEN 'Seal_' ELSE 'Sign_' END, qid, '_', n, '.svg') AS image_url, n FROM link_entity, (VALUES (0), (1), (2)) t(n) WHERE qid LIKE '%3')
, emblem_pages AS (SELECT image_url, 0 AS pos, 'https://x.org/wiki/Category:Things' AS category FROM emblems UNION ALL
   SELECT image_url, 1, concat('https://x.org/wiki/Category:', CASE n WHEN 0 THEN 'Logos of X' WHEN 1 THEN 'SVG coats_of_arms' ELSE 'TV series' END) FROM emblems)
, single_pages AS (SELECT single_image AS image_url, 0 AS pos, 'https://x.org/wiki/Category:Old' AS category FROM images WHERE single_image LIKE '%5.png' UNION ALL
   SELECT single_image, 1, 'https://x.org/wiki/Category:TV_Series' FROM images WHERE single_image LIKE '%5.png')"""

CLASS_SQL = """CASE WHEN regexp_matches(c, 'seal|emblem') OR regexp_matches(u, 'seal|emblem') THEN 'seal' WHEN contains(c, 'flag') OR contains(u, 'flag') THEN 'flag'
   WHEN contains(c, 'logo') OR contains(u, 'logo') THEN 'logo' WHEN regexp_matches(c || ' ' || u, 'coats_of_arm|coat_of_arm') THEN 'coat of arms'
   WHEN regexp_matches(c || ' ' || u, 'poster|film|movie|book|novel|advertisement|music' || x) THEN 'poster' END"""


@query("e07_classify_images", GALLERIES_SQL + f"""
, known AS (SELECT i.link, i.single_image, bool_or(category = 'human') AS human FROM images i JOIN link_entity USING (link) JOIN entity_category USING (qid) GROUP BY ALL)
, rest AS (SELECT * FROM known WHERE NOT human)
, rest2 AS (SELECT * FROM rest WHERE link NOT IN (SELECT link FROM landscapes))
, cands AS (
  SELECT DISTINCT e.image_url, p.pos, lower(split_part(split_part(category, '/', -1), ':', -1)) AS c, lower(e.image_url) AS u, '' AS x FROM rest2 JOIN emblems e USING (link) JOIN emblem_pages p ON p.image_url = e.image_url
  UNION ALL SELECT DISTINCT single_image, p.pos, lower(split_part(split_part(category, '/', -1), ':', -1)), lower(single_image), '|series' FROM rest2 JOIN single_pages p ON p.image_url = single_image WHERE link NOT IN (SELECT link FROM emblems)
  UNION ALL SELECT DISTINCT single_image, 0, '', lower(single_image), '|series' FROM rest2 WHERE single_image IS NOT NULL AND link NOT IN (SELECT link FROM emblems) AND single_image NOT IN (SELECT image_url FROM single_pages))
, graded AS (SELECT image_url, pos, {CLASS_SQL} AS k FROM cands)
SELECT 'human' AS image_class, link AS image FROM known WHERE human
UNION SELECT 'landscape', image_url FROM rest JOIN landscapes USING (link)
UNION SELECT arg_min(k, pos), image_url FROM graded WHERE k IS NOT NULL GROUP BY image_url""")
def e07(spark, d):
    links = I.link_entity(spark, d)
    qid, host = F.col("qid"), F.lit("https://x.org/wiki/File:")
    name = F.when(F.endswith(qid, F.lit("2")), "Flag_").when(F.endswith(qid, F.lit("4")), "Film_series_").otherwise("Pic_")
    images = links.select(
        "link", F.when((F.length("link") % 2 == 0) | F.endswith(qid, F.lit("5")), F.concat(host, name, qid, F.lit(".png"))).alias("single_image")
    )

    def numbered(rows, n):
        return rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    landscapes = numbered(links.where(F.endswith(qid, F.lit("1"))), 2).select(
        "link", F.concat(host, F.lit("View_"), qid, F.lit("_"), F.col("n").cast("string"), F.lit(".jpg")).alias("image_url")
    )
    emblems = numbered(links.where(F.endswith(qid, F.lit("3"))), 3).select(
        "link", "n", F.concat(
            host, F.when(F.endswith(qid, F.lit("03")), "Seal_").otherwise("Sign_"), qid, F.lit("_"), F.col("n").cast("string"), F.lit(".svg")
        ).alias("image_url"),
    )
    kind = F.when(F.col("n") == 0, "Logos of X").when(F.col("n") == 1, "SVG coats_of_arms").otherwise("TV series")
    category = F.lit("https://x.org/wiki/Category:")
    emblem_pages = emblems.select(
        "image_url", F.posexplode(F.array(F.concat(category, F.lit("Things")), F.concat(category, kind))).alias("pos", "category")
    )
    single_pages = images.where(F.endswith("single_image", F.lit("5.png"))).select(
        F.col("single_image").alias("image_url"),
        F.posexplode(F.array(F.concat(category, F.lit("Old")), F.concat(category, F.lit("TV_Series")))).alias("pos", "category"),
    )
    return E.classify_images(images, links, I.entity_category(spark, d), landscapes, emblems, emblem_pages, single_pages)


DISPOSED_SQL = I.TABLE_SQL.replace("WITH", "WITH" + I.ENTITIES_SQL + ",", 1) + """
, special AS (SELECT qid, bool_or(category = 'sports discipline') AS sport, bool_or(category = 'type of chemical entity') AS chemical FROM entity_category GROUP BY qid)
, link_class AS (SELECT link, entity_class FROM link_entity JOIN classes USING (qid))
, collages AS (SELECT link, CASE WHEN length(link) % 3 = 0 THEN 'location' ELSE 'seal' END AS kind, concat('collage/', qid, '.jpg') AS collage_path FROM link_entity WHERE NOT qid LIKE '%1')
, d0 AS (SELECT t.table_id, t.row_idx, t.col_idx, t.tag_pos, t.tag, c.header, i.original_string, i.image_path, e.qid, l.entity_class, coalesce(s.sport, false) AS sport, coalesce(s.chemical, false) AS chemical,
    cl.collage_path AS location, cs.collage_path AS seal
  FROM tags t JOIN cells c ON t.table_id = c.table_id AND t.row_idx = c.row_idx AND t.col_idx = c.col_idx JOIN image_tags i ON t.tag = i.tag
  LEFT JOIN link_entity e ON e.link = concat('https://en.wikipedia.org', i.wiki_link) LEFT JOIN special s ON s.qid = e.qid LEFT JOIN link_class l ON l.link = e.link
  LEFT JOIN collages cl ON cl.link = e.link AND cl.kind = 'location' LEFT JOIN collages cs ON cs.link = e.link AND cs.kind = 'seal')
, d1 AS (SELECT *, CASE WHEN regexp_matches(lower(header), 'note|comment|description') THEN 'notes'
   WHEN sport THEN CASE WHEN regexp_matches(original_string, '[0-9]') OR contains(lower(original_string), 'marathon') THEN 'excluded' ELSE 'included' END
   WHEN chemical THEN CASE WHEN contains(image_path, '.svg') THEN 'included' ELSE 'excluded' END
   WHEN entity_class IN ('excluded', 'included', 'remaining') THEN entity_class
   WHEN entity_class = 'location' THEN CASE WHEN location IS NULL THEN 'location_excluded' ELSE 'location_included' END
   WHEN entity_class = 'seal' THEN CASE WHEN seal IS NULL THEN 'seal_excluded' ELSE 'seal_included' END ELSE 'unclassified' END AS bucket FROM d0)
, disposed AS (SELECT * EXCLUDE (image_path), CASE bucket WHEN 'included' THEN image_path WHEN 'location_included' THEN location WHEN 'seal_included' THEN seal END AS image_path,
   header <> 'Note' AND NOT sport AND NOT chemical AND entity_class IS NOT NULL AS counted FROM d1)"""


def disposed(spark, d, whole=False):
    lines = I.facts(spark, d)
    cells = I.cells(spark, d, lines, whole)
    links = I.link_entity(spark, d)
    collages = links.where(~F.endswith("qid", F.lit("1"))).select(
        "link", F.when(F.length("link") % 3 == 0, "location").otherwise("seal").alias("kind"),
        F.concat(F.lit("collage/"), "qid", F.lit(".jpg")).alias("collage_path"),
    )
    attributes = I.image_tags(spark, d, lines)
    out = D.dispose_tags(
        C.explode_tags(I.cells(spark, d, lines), keep=("header",)), attributes, links, I.entity_category(spark, d),
        E.class_links(I.classes(spark, d), links), collages,
    )
    return cells, attributes, out


@query("e08_dispose_tags", DISPOSED_SQL + " SELECT tag, qid, bucket, counted, image_path FROM disposed")
def e08(spark, d):
    return disposed(spark, d)[2].select("tag", "qid", "bucket", "counted", "image_path")


REVERT = "('notes', 'excluded', 'remaining', 'location_excluded', 'seal_excluded')"


@query("e08_apply_disposition", DISPOSED_SQL + f"""
, back AS (SELECT table_id, row_idx, col_idx, list([tag, original_string]) AS l FROM disposed WHERE bucket IN {REVERT} GROUP BY ALL)
SELECT c.table_id, c.row_idx, c.col_idx, CASE len(l) WHEN 1 THEN replace(cell, l[1][1], l[1][2]) WHEN 2 THEN replace(replace(cell, l[1][1], l[1][2]), l[2][1], l[2][2]) ELSE cell END AS filtered
FROM cells c LEFT JOIN back b ON c.table_id = b.table_id AND c.row_idx = b.row_idx AND c.col_idx = b.col_idx""")
def e08_apply(spark, d):
    whole = I.whole_tables(spark, d)
    cells, _, out = disposed(spark, d, whole)
    return D.apply_disposition(cells, out, whole).select("table_id", "row_idx", "col_idx", "filtered")


COUNTERS = {
    "excluded": "excluded", "remaining": "remaining", "included": "included", "notes": "notes", "seal_in": "seal_included",
    "seal_out": "seal_excluded", "location_in": "location_included", "location_out": "location_excluded",
}


@query("e09_table_counters", DISPOSED_SQL + " SELECT table_id, " + ", ".join(
    f"count(*) FILTER (WHERE bucket = '{b}') AS {n}" for n, b in COUNTERS.items()) + ", count(image_path) AS images FROM disposed GROUP BY table_id")
def e09(spark, d):
    return D.table_counters(disposed(spark, d)[2])


@query("e10_useful_columns", DISPOSED_SQL + """
, kept AS (SELECT table_id, col_idx, count(DISTINCT row_idx) AS useful FROM disposed WHERE image_path IS NOT NULL GROUP BY ALL)
, sizes AS (SELECT table_id, max(row_idx) AS n FROM cells GROUP BY table_id)
, per AS (SELECT table_id, count(*) AS k FROM kept JOIN sizes USING (table_id) WHERE useful >= 0.3 * n GROUP BY table_id)
SELECT count(*) FILTER (WHERE k >= 1) AS at_least_1, count(*) FILTER (WHERE k >= 2) AS at_least_2, count(*) FILTER (WHERE k >= 3) AS at_least_3 FROM per""")
def e10(spark, d):
    cells, _, out = disposed(spark, d)
    rows = cells.groupBy("table_id").agg((F.max("row_idx") + 1).alias("rows"))
    return D.useful_columns(out, rows)


@query("e11_category_frequency", DISPOSED_SQL + """
SELECT entity_class, category, count(*) AS n FROM disposed JOIN (SELECT DISTINCT qid, category FROM entity_category) USING (qid) WHERE counted GROUP BY entity_class, category""")
def e11(spark, d):
    return D.category_frequency(disposed(spark, d)[2], I.entity_category(spark, d))


@query("e12_cumulative_top", """
WITH v AS (SELECT count(*) AS x FROM lineitem GROUP BY l_partkey), m AS (SELECT max(x) AS top, count(*) AS total FROM v),
e AS (SELECT unnest(range(0, CAST(ceil((top + 2.5) / 2.5) AS BIGINT))) AS i FROM m),
c AS (SELECT i, (SELECT count(*) FROM v WHERE x < i * 2.5) AS below, total FROM e JOIN m ON true)
SELECT CAST(i * 2.5 AS DOUBLE) AS edge, below FROM c WHERE i <= coalesce((SELECT min(i) FROM c WHERE below >= 0.8 * total), 1e9)""")
def e12(spark, d):
    sizes = I.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("x"))
    return E.cumulative_top(sizes, "x", 2.5)


@query("e13_narrow_image_tags", DISPOSED_SQL + """
SELECT d.tag, d.image_path, i.original_string, d.qid, i.wiki_link FROM disposed d JOIN image_tags i ON d.tag = i.tag WHERE d.image_path IS NOT NULL AND d.qid IS NOT NULL""")
def e13(spark, d):
    _, attributes, out = disposed(spark, d)
    return D.narrow_image_tags(attributes, out, I.link_entity(spark, d))


@query("e13_tags_without_entity", DISPOSED_SQL + " SELECT col_idx, count(*) AS n FROM disposed WHERE qid IS NULL GROUP BY col_idx")
def e13_missing(spark, d):
    lines = I.facts(spark, d)
    missing = D.tags_without_entity(I.image_tags(spark, d, lines), I.link_entity(spark, d))
    tags = C.explode_tags(I.cells(spark, d, lines))
    return tags.join(missing, "tag", "left_semi").groupBy("col_idx").agg(big(F.count(F.lit(1)), "n"))


@query("e14_label_frequency", W + " SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS rank FROM entity_category GROUP BY category")
def e14(spark, d):
    return E.label_frequency(I.entity_category(spark, d))


@query("e15_years", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, concat(strftime(l_shipdate, '%Y'), ' to x', strftime(l_shipdate, '%Y'), ', (', l_orderkey, ') ', l_suppkey) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_transform(regexp_extract_all(concat(' ', replace(c, ' ', '  '), ' '), '[^A-Za-z0-9][0-9]{4}[^A-Za-z0-9]'), lambda x: x[2:5]), ' ') AS years FROM t""")
def e15(spark, d):
    year = F.year("l_shipdate").cast("string")
    text = F.concat(year, F.lit(" to x"), year, F.lit(", ("), F.col("l_orderkey").cast("string"), F.lit(") "), F.col("l_suppkey").cast("string"))
    return I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(T.years(text), " ").alias("years"))
