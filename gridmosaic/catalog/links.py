"""Pages, links, revisions and image choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmosaic.catalog import inputs as I
from gridmosaic.catalog.registry import big, query
from gridmosaic.functions import links as L
from gridmosaic.operators import images as G, pages as P

# --- wiki-like pages written from the part table

PART_HTML = """concat('<html><body><table class="a"><tr><th><a href="/wiki/Head">h</a></th><td><a href="/wiki/', p_brand, '" title="x"> ', p_brand, ' &amp; <b>Co</b>  Ltd</a> text</td></tr>',
 CASE WHEN p_size % 3 = 0 THEN concat('<tr><td><table id="n"><tr><td><a href="/wiki/', p_type, '">', p_type, '</a></td></tr></table></td></tr>') ELSE '' END,
 '</table><TABLE><tr><td>', p_name, ' <a href="/wiki/', replace(p_name, ' ', '_'), '">', p_name, '</a> <a href="/w/index.php?title=X&amp;redlink=1">red</a></td><td><a href="https://en.wikipedia.org/wiki/', p_brand, '">', p_name, '</a></td></tr></TABLE></body></html>')"""

# what the pages hold, written down directly rather than parsed
PARTS_SQL = """
WITH tables AS (
  SELECT p_partkey AS page_id, concat('https://en.wikipedia.org/wiki/Part_', p_partkey) AS url, CAST(0 AS BIGINT) AS pos, CASE WHEN p_size % 3 = 0
     THEN concat('<table id="n"><tr><td><a href="/wiki/', p_type, '">', p_type, '</a></td></tr></table>')
     ELSE concat('<table class="a"><tr><th><a href="/wiki/Head">h</a></th><td><a href="/wiki/', p_brand, '" title="x"> ', p_brand, ' &amp; <b>Co</b>  Ltd</a> text</td></tr></table>') END AS table_html FROM part
  UNION ALL SELECT p_partkey, concat('https://en.wikipedia.org/wiki/Part_', p_partkey), 1, concat('<table><tr><td>', p_name, ' <a href="/wiki/', replace(p_name, ' ', '_'), '">', p_name,
     '</a> <a href="/w/index.php?title=X&amp;redlink=1">red</a></td><td><a href="https://en.wikipedia.org/wiki/', p_brand, '">', p_name, '</a></td></tr></table>') FROM part)
, anchors AS (
  SELECT p_partkey * 2 AS table_id, CAST(0 AS BIGINT) AS pos, CASE WHEN p_size % 3 = 0 THEN concat('/wiki/', p_type) ELSE concat('/wiki/', p_brand) END AS link,
     CASE WHEN p_size % 3 = 0 THEN p_type ELSE concat(' ', p_brand, ' & Co  Ltd') END AS text FROM part
  UNION ALL SELECT p_partkey * 2 + 1, 0, concat('/wiki/', replace(p_name, ' ', '_')), p_name FROM part
  UNION ALL SELECT p_partkey * 2 + 1, 2, concat('https://en.wikipedia.org/wiki/', p_brand), p_name FROM part)
, clean AS (SELECT table_id, pos, link, lower(replace(trim(text), '  ', ' ')) AS text FROM anchors)"""


def part_pages(spark, d):
    return I.table(spark, d, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://en.wikipedia.org/wiki/Part_"), F.col("p_partkey").cast("string")).alias("url"),
        F.expr(PART_HTML).alias("html"),
    )


def part_anchors(spark, d, rule="wiki"):
    tables = P.extract_tables(part_pages(spark, d)).withColumn("table_id", F.col("page_id") * 2 + F.col("pos"))
    return P.extract_anchors(tables, rule)


@query("l01_extract_tables", PARTS_SQL + " SELECT * FROM tables")
def l01(spark, d):
    return P.extract_tables(part_pages(spark, d))


@query("l02_assign_table_ids", PARTS_SQL + " SELECT page_id, url, pos, row_number() OVER (ORDER BY page_id, pos) + 199999 AS table_id FROM tables")
def l02(spark, d):
    return P.assign_table_ids(P.extract_tables(part_pages(spark, d))).select("page_id", "url", "pos", "table_id")


@query("l03_extract_anchors", PARTS_SQL + " SELECT table_id, pos, link, text FROM anchors")
def l03(spark, d):
    return part_anchors(spark, d)


@query("l03_extract_anchors_start", PARTS_SQL + " SELECT table_id, pos, link, text FROM anchors")
def l03_start(spark, d):
    return part_anchors(spark, d, "wiki_start")


PAGE_ANCHORS = """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>') AS l FROM pages),
e AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS x FROM a),
f AS (SELECT page_id, pos, regexp_extract(x, 'href="([^"]*)"', 1) AS link, regexp_replace(regexp_replace(x, '^<a[^>]*>', ''), '<[^>]*>', '', 'g') AS text FROM e)"""


@query("l03_page_anchors", PAGE_ANCHORS + " SELECT page_id, pos, link, replace(text, '&amp;', '&') AS text FROM f WHERE starts_with(link, '/')")
def l03_pages(spark, d):
    """Anchors of the landed pages themselves, which hold no tables."""
    return P.extract_anchors(I.table(spark, d, "pages"), "path", "html", ("page_id",), data_cells_only=False)


@query("l04_clean_anchors", PARTS_SQL + " SELECT table_id, pos, link, text FROM clean")
def l04(spark, d):
    return P.clean_anchors(part_anchors(spark, d))


@query("l05_anchors_by_text", PARTS_SQL + " SELECT DISTINCT table_id, text, link, length(text) AS length FROM clean")
def l05(spark, d):
    return P.anchors_by_text(P.clean_anchors(part_anchors(spark, d)))


@query("l06_anchors_by_link", PARTS_SQL + " SELECT DISTINCT table_id, link, text, length(text) AS length FROM clean")
def l06(spark, d):
    return P.anchors_by_link(P.clean_anchors(part_anchors(spark, d)))


@query("l07_ambiguous_anchors", PARTS_SQL + """
, t AS (SELECT table_id, text, count(DISTINCT link) AS n FROM clean GROUP BY ALL) SELECT CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS ambiguous, CAST(sum(n) AS BIGINT) AS links FROM t""")
def l07(spark, d):
    return P.ambiguous_anchors(P.clean_anchors(part_anchors(spark, d)))


@query("l08_canonical_links", PARTS_SQL + """
, l AS (SELECT link FROM clean UNION SELECT url FROM pages)
SELECT link, CASE WHEN contains(link, 'https:') THEN link ELSE concat('https://en.wikipedia.org', link) END AS canonical FROM l WHERE contains(link, '/wiki/')""")
def l08(spark, d):
    links = part_anchors(spark, d).select("link").unionByName(I.table(spark, d, "pages").select(F.col("url").alias("link")))
    return P.canonical_links(links)


@query("l09_link_inventory", PARTS_SQL + " SELECT table_id, text, arg_max(link, pos) AS link FROM clean GROUP BY table_id, text")
def l09(spark, d):
    return P.link_inventory(P.clean_anchors(part_anchors(spark, d)))


@query("l10_revision_query_url", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('https://en.wikipedia.org/w/api.php?action=query&titles=Part_', p_partkey,
  '&prop=revisions&rvlimit=500&rvstart=2020-09-09T07%3A59%3A00Z&rvdir=older&format=json&redirects=1') END AS url FROM part""")
def l10(spark, d):
    page = F.when(F.col("p_size") % 2 == 0, F.lit("https://en.wikipedia.org/wiki/Part_")).otherwise(F.lit("https://example.org/Part_"))
    return I.table(spark, d, "part").select(
        "p_partkey", L.revision_query_url(F.concat(page, F.col("p_partkey").cast("string"))).alias("url")
    )


@query("l11_pageview_url", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN concat('https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/en.wikipedia/all-access/user/Café+', c_name, '/monthly/20181223/20231223') END AS url,
  CASE WHEN c_nationkey % 3 = 0 THEN 'no page title in url' END AS error FROM customer""")
def l11(spark, d):
    folder = F.when(F.col("c_nationkey") % 3 != 0, F.lit("https://en.wikipedia.org/wiki/Caf%C3%A9+")).otherwise(F.lit("https://example.org/page/"))
    out = L.pageview_url(F.concat(folder, "c_name"))
    return I.table(spark, d, "customer").select("c_custkey", out.alias("o")).select("c_custkey", "o.url", "o.error")


def revisions(spark, d):
    """Events as revisions of their user's page, newest listed first."""
    order = -F.unix_micros(F.col("ts").cast("timestamp"))
    return I.table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("revid"), "ts", order.alias("ord"))


@query("l12_nearest_revision", """
WITH r AS (SELECT user_id AS page, event_id AS revid, abs(CAST(floor((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 86400000000.0) AS BIGINT)) AS days, -epoch_us(ts) AS ord FROM events)
SELECT page, arg_min(revid, (days, ord)) AS revid, min(days) AS days FROM r GROUP BY page""")
def l12(spark, d):
    return P.nearest_revision(revisions(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query("l12_parse_revisions", "SELECT concat('u', user_id) AS page, event_id AS revid, CAST(0 AS BIGINT) AS ord, date_trunc('second', ts) AT TIME ZONE 'UTC' AS ts FROM events")
def l12_parse(spark, d):
    listing = F.concat(
        F.lit('{"query":{"pages":{"'), F.col("user_id").cast("string"), F.lit('":{"revisions":[{"revid":'), F.col("event_id").cast("string"),
        F.lit(',"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}]}}}}'),
    )
    raw = I.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), listing.alias("value"))
    return P.parse_revisions(raw).select("page", "revid", "ord", "ts")


@query("l13_revision_page_url", "SELECT event_id, concat('https://en.wikipedia.org/w/index.php?title=Page_Title&oldid=', event_id) AS url FROM events")
def l13(spark, d):
    return I.table(spark, d, "events").select("event_id", L.revision_page_url(F.col("event_id")).alias("url"))


ATTACH = PARTS_SQL + """
, q AS (SELECT concat('q', o_orderkey) AS query_url, concat('https://en.wikipedia.org/wiki/Part_', o_custkey * 4) AS revision_url FROM orders)
, a AS (SELECT query_url, revision_url, pos, pos IS NOT NULL AS found FROM q LEFT JOIN tables ON url = revision_url)"""


def _attached(spark, d):
    queries = I.table(spark, d, "orders").select(
        F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("query_url"),
        F.concat(F.lit("https://en.wikipedia.org/wiki/Part_"), (F.col("o_custkey") * 4).cast("string")).alias("revision_url"),
    )
    return P.attach_tables(queries, P.extract_tables(part_pages(spark, d)))


@query("l14_attach_tables", ATTACH + " SELECT query_url, revision_url, pos, found FROM a")
def l14(spark, d):
    return _attached(spark, d).select("query_url", "revision_url", "pos", "found")


@query("l14_attached_counts", ATTACH + """
, p AS (SELECT query_url, count(pos) AS n FROM a GROUP BY query_url)
SELECT count(*) FILTER (WHERE n > 0) AS found, count(*) FILTER (WHERE n = 0) AS not_found, CAST(sum(n) AS BIGINT) AS tables FROM p""")
def l14_counts(spark, d):
    return P.attached_counts(_attached(spark, d))


# --- entity pages with infoboxes, and file pages, written from the supplier table

ENTITY_HTML = """concat('<table class="infobox vcard"><tr><td colspan="2" class="infobox-full-data maptable"><div class="locmap x"><span typeof="mw:File"><a href="/wiki/File:Map.svg"><img src="//m.png"></a></span></div></td></tr>',
 CASE WHEN s_suppkey % 5 <> 0 THEN concat('<tr><td class="infobox-image"><span typeof="mw:File/Frameless"><a href="/wiki/File:S_', s_suppkey, '.jpg" title="View"><img src="//img/S_', s_suppkey, '.jpg"></a></span> <span typeof="mw:File"><a href="/wiki/File:',
   CASE WHEN s_suppkey % 3 = 0 THEN 'Flag_' ELSE 'Town_' END, s_suppkey, '.svg"><img src="//img/two.png"></a></span></td></tr>') ELSE '' END,
 CASE WHEN s_suppkey % 4 = 0 THEN concat('<tr><td class="infobox-image"><span typeof="mw:File"><a href="/wiki/File:Seal_', s_suppkey, '.svg"><img src="//img/Seal_', s_suppkey, '.png"></a></span></td></tr>') ELSE '' END, '</table>',
 CASE WHEN s_suppkey % 7 <> 0 THEN concat('<li id="t-wikibase"><a href="https://www.wikidata.org/wiki/Special:EntityPage/Q', s_suppkey, '"><span>item</span></a></li>') ELSE '' END)"""
FILE_HTML = """concat(CASE WHEN s_suppkey % 3 <> 0 THEN concat('<div class="fullImageLink" id="file"><a href="//x"><img alt="" src="//up.org/Town_', s_suppkey, '.png"></a></div>') ELSE '' END,
 '<div id="catlinks"><div id="mw-normal-catlinks" class="mw-normal-catlinks"><a href="/wiki/Help:Category">Categories</a>: <ul><li><a href="/wiki/Category:', CASE WHEN s_suppkey % 2 = 0 THEN 'Logos' ELSE 'Views' END,
 '">c</a></li><li><a href="/wiki/Category:N_', s_nationkey, '">n</a></li></ul></div></div>')"""

_HOST = "https://en.wikipedia.org"
SUPP_SQL = f"""
WITH s AS (SELECT *, s_suppkey AS k, concat('{_HOST}/wiki/Supplier_', s_suppkey) AS url FROM supplier)
, cells AS (
  SELECT url, k, 0 AS cell, 0 AS pos, concat('{_HOST}/wiki/File:S_', k, '.jpg') AS image, k % 3 = 0 AS emblem FROM s WHERE k % 5 <> 0
  UNION ALL SELECT url, k, 0, 1, concat('{_HOST}/wiki/File:', CASE WHEN k % 3 = 0 THEN 'Flag_' ELSE 'Town_' END, k, '.svg'), k % 3 = 0 FROM s WHERE k % 5 <> 0
  UNION ALL SELECT url, k, 1, 0, concat('{_HOST}/wiki/File:Seal_', k, '.svg'), true FROM s WHERE k % 4 = 0)
, places AS (SELECT url, CAST(pos AS BIGINT) AS pos, image FROM cells QUALIFY cell = min(cell) OVER (PARTITION BY url))
, best AS (SELECT url, min(cell) FILTER (WHERE emblem) AS cell FROM cells GROUP BY url)
, gallery AS (SELECT c.url, c.image, b.cell IS NOT NULL AS found FROM cells c JOIN best b ON c.url = b.url WHERE b.cell IS NULL OR b.cell = c.cell)
, categories AS (SELECT concat('{_HOST}/wiki/File:Town_', k, '.svg') AS image_url, CAST(0 AS BIGINT) AS pos, concat('{_HOST}/wiki/Category:', CASE WHEN k % 2 = 0 THEN 'Logos' ELSE 'Views' END) AS category FROM s
   UNION ALL SELECT concat('{_HOST}/wiki/File:Town_', k, '.svg'), 1, concat('{_HOST}/wiki/Category:N_', s_nationkey) FROM s)"""


def entity_pages(spark, d):
    return I.table(spark, d, "supplier").select(
        F.concat(F.lit(_HOST + "/wiki/Supplier_"), F.col("s_suppkey").cast("string")).alias("url"), F.expr(ENTITY_HTML).alias("html")
    )


def file_pages(spark, d):
    return I.table(spark, d, "supplier").select(
        F.concat(F.lit(_HOST + "/wiki/File:Town_"), F.col("s_suppkey").cast("string"), F.lit(".svg")).alias("url"), F.expr(FILE_HTML).alias("html")
    )


@query("l15_infobox_image", SUPP_SQL + " SELECT url, CASE WHEN k % 5 <> 0 THEN concat('//img/S_', k, '.jpg') ELSE concat('//img/Seal_', k, '.png') END AS image FROM s WHERE k % 5 <> 0 OR k % 4 = 0")
def l15(spark, d):
    return G.infobox_image(entity_pages(spark, d))


@query("l16_wikibase_id", SUPP_SQL + " SELECT url, concat('Q', k) AS qid FROM s WHERE k % 7 <> 0")
def l16(spark, d):
    return G.wikibase_id(entity_pages(spark, d))


@query("l17_full_image_url", f"""
SELECT concat('{_HOST}/wiki/File:Town_', s_suppkey, '.svg') AS url, CASE WHEN s_suppkey % 3 <> 0 THEN concat('https:', '//up.org/Town_', s_suppkey, '.png')
  ELSE concat('https://commons.wikimedia.org/wiki/Special:FilePath/File:Town_', s_suppkey, '.svg') END AS image FROM supplier""")
def l17(spark, d):
    return G.full_image_url(file_pages(spark, d), "https:")


@query("l18_place_gallery", SUPP_SQL + " SELECT url, pos, image FROM places")
def l18(spark, d):
    return G.place_gallery(entity_pages(spark, d))


@query("l19_emblem_gallery", SUPP_SQL + " SELECT DISTINCT url, image, found FROM gallery")
def l19(spark, d):
    return G.emblem_gallery(entity_pages(spark, d))


@query("l20_page_categories", SUPP_SQL + " SELECT image_url, pos, category FROM categories")
def l20(spark, d):
    return G.page_categories(file_pages(spark, d))


@query("l21_rescue_emblems", SUPP_SQL + """
SELECT DISTINCT url, image FROM gallery WHERE found OR image IN (SELECT image_url FROM categories WHERE contains(category, 'Logos'))""")
def l21(spark, d):
    return G.rescue_emblems(G.emblem_gallery(entity_pages(spark, d)), G.page_categories(file_pages(spark, d)))


# --- links and images of entities

W = "WITH" + I.ENTITIES_SQL + """
, links AS (SELECT link FROM link_entity UNION SELECT concat('https://en.wikipedia.org/wiki/Supplier_', s_suppkey) FROM supplier
   UNION SELECT concat('https://en.wikipedia.org/wiki/File:X_', s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '.mid' ELSE '.svg' END) FROM supplier)
, entity_images AS (
  SELECT concat('Q', s_suppkey) AS qid, 'seal' AS source, CASE WHEN s_suppkey % 9 <> 0 THEN concat('http://i.org/seal_', s_suppkey, '.svg') END AS image, 0 AS ord FROM supplier
  UNION ALL SELECT concat('Q', s_suppkey), 'logo', concat('http://i.org/logo_', s_suppkey, '.png'), 1 FROM supplier WHERE s_suppkey % 2 = 1
  UNION ALL SELECT concat('Q', s_suppkey), 'image', concat('http://i.org/b_', s_suppkey, '.jpg'), 2 FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT concat('Q', s_suppkey), 'image', concat('http://i.org/a_', s_suppkey, '.tif'), 3 FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT concat('Q', s_suppkey), 'other', 'http://i.org/other.png', 4 FROM supplier)
, fanned AS (SELECT link, source, image, ord FROM link_entity JOIN entity_images USING (qid) WHERE image IS NOT NULL)
, preferred AS (SELECT link, arg_min(image, (list_position(['image', 'logo', 'flag', 'coat_of_arms', 'service_ribbon', 'seal', 'locator_map_image'], source), ord)) AS image
   FROM fanned WHERE source <> 'other' GROUP BY link)
, scraped AS (SELECT link, CASE WHEN qid LIKE '%2' THEN concat('//up.org/', qid, '.png') ELSE concat('https://up.org/', qid, '.svg') END AS image FROM link_entity WHERE qid LIKE '%2' OR qid LIKE 'N%')
, merged AS (SELECT link, concat('https://commons.wikimedia.org/wiki/Special:FilePath/', split_part(link, 'File:', -1)) AS image_url FROM links WHERE contains(link, 'File:') AND NOT link LIKE '%.mid'
   UNION ALL SELECT link, CASE WHEN starts_with(image, '//') THEN 'https:' || image ELSE image END FROM scraped
   UNION ALL SELECT link, concat('https://commons.wikimedia.org/wiki/Special:FilePath/', split_part(image, '/', -1)) FROM preferred WHERE link NOT IN (SELECT link FROM scraped))
, resolved AS (SELECT link, CASE WHEN contains(image_url, 'seal_') THEN concat('//full/', split_part(image_url, '/', -1), '.png') ELSE image_url END AS image_url,
   regexp_matches(lower(split_part(image_url, '.', -1)), '^(tiff|svg|tif|djvu)$') AS needs_page FROM merged)"""


def all_links(spark, d):
    k = F.col("s_suppkey").cast("string")
    files = F.concat(F.lit(_HOST + "/wiki/File:X_"), k, F.when(F.col("s_suppkey") % 5 == 0, ".mid").otherwise(".svg"))
    names = I.table(spark, d, "supplier").select(F.explode(F.array(F.concat(F.lit(_HOST + "/wiki/Supplier_"), k), files)).alias("link"))
    return names.unionByName(I.link_entity(spark, d).select("link")).distinct()


def entity_images(spark, d):
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")

    def entry(when, source, image, ord_):
        return F.when(when, F.struct(F.lit(source).alias("source"), image.alias("image"), F.lit(ord_).alias("ord")))

    def named(a, b):
        return F.concat(F.lit("http://i.org/" + a), key, F.lit(b))

    rows = F.array_compact(F.array(
        entry(F.lit(True), "seal", F.when(k % 9 != 0, named("seal_", ".svg")), 0), entry(k % 2 == 1, "logo", named("logo_", ".png"), 1),
        entry(k % 3 == 0, "image", named("b_", ".jpg"), 2), entry(k % 3 == 0, "image", named("a_", ".tif"), 3),
        entry(F.lit(True), "other", F.lit("http://i.org/other.png"), 4),
    ))
    return I.table(spark, d, "supplier").select(F.concat(F.lit("Q"), key).alias("qid"), F.explode(rows).alias("r")).select("qid", "r.*")


def preferred(spark, d):
    return G.preferred_image(G.fan_out_images(I.link_entity(spark, d), entity_images(spark, d).where("image IS NOT NULL")))


def merged(spark, d):
    links = I.link_entity(spark, d)
    qid = F.col("qid")
    scraped = links.where(F.endswith(qid, F.lit("2")) | F.startswith(qid, F.lit("N"))).select(
        "link", F.when(F.endswith(qid, F.lit("2")), F.concat(F.lit("//up.org/"), qid, F.lit(".png")))
        .otherwise(F.concat(F.lit("https://up.org/"), qid, F.lit(".svg"))).alias("image"),
    )
    files = G.split_file_links(all_links(spark, d)).where("is_file").select("link")
    return G.merge_image_urls(preferred(spark, d), scraped, files)


def resolved(spark, d):
    single = merged(spark, d)
    name = L.last_segment(F.col("image_url"))
    full = single.where(F.contains("image_url", F.lit("seal_"))).select(
        F.concat(F.lit(L.FILE_PAGE), name).alias("page_url"), F.concat(F.lit("//full/"), name, F.lit(".png")).alias("image")
    ).distinct()
    return G.resolve_special_formats(single, full)


@query("l22_split_file_links", W + " SELECT link, contains(link, 'File:') AS is_file FROM links")
def l22(spark, d):
    return G.split_file_links(all_links(spark, d))


@query("l23_links_without_entity", W + " SELECT link FROM links ANTI JOIN link_entity USING (link)")
def l23(spark, d):
    return G.links_without_entity(all_links(spark, d), I.link_entity(spark, d))


@query("l24_entity_links", W + " SELECT qid, link, count(*) OVER (PARTITION BY qid) AS links FROM link_entity")
def l24(spark, d):
    return G.entity_links(I.link_entity(spark, d))


@query("l25_links_without_image", W + " SELECT link FROM links WHERE link NOT IN (SELECT link FROM fanned WHERE source <> 'other')")
def l25(spark, d):
    return G.links_without_image(all_links(spark, d), I.link_entity(spark, d), entity_images(spark, d).where("source <> 'other'"))


@query("l25_fan_out_images", W + " SELECT link, source, image, CAST(ord AS BIGINT) AS ord FROM fanned")
def l25_fan(spark, d):
    images = entity_images(spark, d).where("image IS NOT NULL")
    return G.fan_out_images(I.link_entity(spark, d), images).withColumn("ord", big("ord"))


@query("l26_preferred_image", W + " SELECT link, image FROM preferred")
def l26(spark, d):
    return preferred(spark, d)


@query("l27_merge_image_urls", W + " SELECT link, image_url FROM merged")
def l27(spark, d):
    return merged(spark, d)


@query("l28_resolve_special_formats", W + " SELECT link, image_url, needs_page FROM resolved")
def l28(spark, d):
    return resolved(spark, d)


@query("l29_link_image_path", W + " SELECT link, concat('images/', split_part(image_url, '/', -1)) AS image_path FROM resolved WHERE NOT contains(image_url, 'Nation')")
def l29(spark, d):
    single = resolved(spark, d)
    paths = single.where(~F.contains("image_url", F.lit("Nation"))).select(
        "image_url", F.concat(F.lit("images/"), L.last_segment(F.col("image_url"))).alias("image_path")
    ).distinct()
    return G.link_image_path(single, paths)


@query("l30_image_filename", """
WITH u AS (SELECT p_partkey, concat('https://u.org/a/b/', CASE WHEN p_size % 3 = 0 THEN repeat('x', 210) ELSE '' END, p_name, '%20v1.2%C3%A9+q', '.JPG', CASE WHEN p_size % 2 = 0 THEN '?width=300' ELSE '' END) AS url FROM part)
SELECT p_partkey, concat(substring(replace(concat(CASE WHEN length(url) > 200 THEN repeat('x', 210) ELSE '' END, (SELECT p_name FROM part p WHERE p.p_partkey = u.p_partkey), ' v1.2é+q'), ' ', '_'), 1, 200), '.jpg') AS name FROM u""")
def l30(spark, d):
    url = F.concat(
        F.lit("https://u.org/a/b/"), F.when(F.col("p_size") % 3 == 0, F.repeat(F.lit("x"), 210)).otherwise(""), "p_name",
        F.lit("%20v1.2%C3%A9+q.JPG"), F.when(F.col("p_size") % 2 == 0, "?width=300").otherwise(""),
    )
    return I.table(spark, d, "part").select("p_partkey", L.image_filename(url).alias("name"))


@query("l31_collage_manifest", SUPP_SQL + """
, t AS (SELECT url, pos, concat('p/', split_part(image, ':', -1)) AS image_path FROM places WHERE NOT contains(image, 'Town'))
, n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY url) AS n FROM t)
, r AS (SELECT *, CAST(floor(sqrt(n)) AS BIGINT) AS rows FROM n), c AS (SELECT *, CAST(ceil(n / rows) AS BIGINT) AS columns FROM r)
SELECT url, image_path, i, rows, columns, CAST(floor(i / columns) AS BIGINT) * 512 AS y, (i % columns) * 512 AS x, sha256(concat(url, '3'))[1:15] AS collage_id FROM c""")
def l31(spark, d):
    gallery = G.place_gallery(entity_pages(spark, d))
    paths = gallery.where(~F.contains("image", F.lit("Town"))).select(
        "image", F.concat(F.lit("p/"), F.substring_index("image", ":", -1)).alias("image_path")
    ).distinct()
    return G.collage_manifest(gallery, paths, 3)


@query("l32_downloadable", W + """
, u AS (SELECT image_url FROM merged UNION SELECT concat('https://maps.org/', p_name) FROM part UNION SELECT concat('https://x.org/', p_name, '.MID') FROM part)
SELECT image_url FROM u WHERE NOT starts_with(image_url, 'https://maps') AND lower(split_part(image_url, '.', -1)) <> 'mid'""")
def l32(spark, d):
    parts = I.table(spark, d, "part")
    extra = parts.select(F.explode(F.array(F.concat(F.lit("https://maps.org/"), "p_name"), F.concat(F.lit("https://x.org/"), "p_name", F.lit(".MID")))).alias("image_url"))
    return G.downloadable(merged(spark, d).select("image_url").unionByName(extra))


@query("l33_table_cells", """
SELECT p_partkey AS table_id, CAST(r AS BIGINT) AS row_idx, CAST(c AS BIGINT) AS col_idx, r = 0 AS is_header, cell FROM (
  SELECT p_partkey, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS r, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS c,
    unnest([p_name, p_name, 'Size', p_brand, concat(p_type, ' & é'), concat('', p_size), p_brand, concat('a ', p_partkey), 'b']) AS cell FROM part)""")
def l33(spark, d):
    """A table per part with spans, references, and cells and rows that are not closed."""
    part = I.table(spark, d, "part")
    html = F.concat(
        F.lit("<table class=x><tr><th colspan=2>"), "p_name", F.lit("</th><th>Size</tr><tr><td rowspan='2'><b>"), "p_brand", F.lit("</b><td>"), "p_type", F.lit(" &amp; &eacute;</td>\n<td>"),
        F.col("p_size").cast("string"), F.lit("<tr><td>a<br>"), F.col("p_partkey").cast("string"), F.lit("<!-- <td> --><TD title='>'>b</table>"),
    )
    return P.table_cells(part.select(F.col("p_partkey").alias("table_id"), html.alias("table_html")))
