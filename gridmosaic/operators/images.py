"""Which image stands for a link: page images, galleries, preferences, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridmosaic.functions import links as L, markup as M
from gridmosaic.operators.ranking import first_per_key, position_in_group

# Image sources by preference, and emblem words.
IMAGE_PREFERENCES = ("image", "logo", "flag", "coat_of_arms", "service_ribbon", "seal", "locator_map_image")
EMBLEM_WORDS = ("coa", "flag", "logo", "seal", "emblem", "badge", "poster")
TILE = 512
PATH_DIGITS = 15


def infobox_image(pages: DataFrame) -> DataFrame:
    """First image of the first infobox image cell; pages without are dropped."""
    cells = F.filter(M.data_cells(F.col("html")), lambda c: M.has_class(c, "infobox-image"))
    return pages.select("url", M.first_src(F.get(cells, F.lit(0))).alias("image")).where("image IS NOT NULL")


def wikibase_id(pages: DataFrame) -> DataFrame:
    """Entity id from the data item link of a page."""
    items = F.filter(M.chunks(F.col("html"), "li"), lambda c: M.attribute(M.attributes_of(c), "id") == "t-wikibase")
    href = F.get(M.anchors(F.get(items, F.lit(0))), F.lit(0))["href"]
    return pages.select("url", L.last_segment(href).alias("qid")).where("qid IS NOT NULL")


def full_image_url(pages: DataFrame, scheme: str = "") -> DataFrame:
    """Full image of a file page, else the redirect address of its name.
    ``scheme`` is put before a found address (``https:`` for galleries)."""
    divs = F.filter(M.chunks(F.col("html"), "div"), lambda c: M.has_class(c, "fullImageLink"))
    src = M.first_src(M.until(F.get(divs, F.lit(0)), r"(?i)</div\b"))
    return pages.select("url", F.coalesce(F.concat(F.lit(scheme), src), L.file_redirect(F.col("url"))).alias("image"))


def _gallery_cells(pages: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Cells of the given classes, class by class, that hold file spans with
    anchors and no location map."""
    def spans(c: Column) -> Column:
        files = F.filter(M.chunks(c, "span"), lambda s: M.attributes_of(s).rlike(r'(?i)\s(type="mw:File"|typeof="mw:File(/Frameless)?")'))
        firsts = F.transform(files, lambda s: F.get(M.anchors(s), F.lit(0)))
        return F.filter(firsts, lambda a: a.isNotNull())

    cells = M.data_cells(F.col("html"))
    ordered = F.concat(*[F.filter(cells, _class_test(n)) for n in classes])
    usable = F.filter(ordered, lambda c: ~c.rlike(r'(?i)<div[^>]*class="([^"]*\s)?locmap[\s"]'))
    return pages.select("url", F.posexplode(F.transform(usable, spans)).alias("cell", "anchors")).where(F.size("anchors") > 0)


def _class_test(name: str):
    return lambda c: M.has_class(c, name)


def place_gallery(pages: DataFrame) -> DataFrame:
    """Images of the first usable infobox cell of a page."""
    cells = _gallery_cells(pages, ("infobox-full-data", "infobox-image"))
    first = first_per_key(cells, ["url"], F.col("cell"), ["anchors"])
    return first.select("url", F.posexplode("anchors").alias("pos", "a")).select(
        "url", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit(L.WIKI_HOST), "a.href").alias("image")
    )


def _emblem_anchor(a: Column) -> Column:
    words = "|".join(EMBLEM_WORDS)
    return F.lower(F.coalesce(a["title"], F.lit(""))).rlike(words) | F.lower(a["href"]).rlike(words)


def emblem_gallery(pages: DataFrame) -> DataFrame:
    """Images of the first usable cell whose last anchor names an emblem
    (found), else the distinct images of all usable cells (not found)."""
    cells = _gallery_cells(pages, ("infobox-full-data", "infobox-image")).withColumn(
        "is_emblem", _emblem_anchor(F.element_at("anchors", -1))
    )
    images = F.transform("anchors", lambda a: F.concat(F.lit(L.WIKI_HOST), a["href"]))
    chosen = cells.groupBy("url").agg(
        F.min_by(images, F.when(F.col("is_emblem"), F.col("cell"))).alias("first"),
        F.bool_or("is_emblem").alias("found"),
    )
    emblems = chosen.where("found").select("url", F.explode(F.array_distinct("first")).alias("image"), "found")
    others = cells.join(chosen.where(~F.col("found")).select("url"), "url", "left_semi").select(
        "url", F.explode(images).alias("image"), F.lit(False).alias("found")
    ).distinct()
    return emblems.unionByName(others)


def page_categories(pages: DataFrame) -> DataFrame:
    """Category links of a file page, in order."""
    divs = F.filter(M.chunks(F.col("html"), "div"), lambda c: M.has_class(c, "mw-normal-catlinks"))
    links = F.filter(M.anchors(M.until(F.get(divs, F.lit(0)), r"(?i)</div\b")), lambda a: F.contains(a["href"], F.lit("/wiki/Category:")))
    return pages.select("url", F.posexplode(links).alias("pos", "a")).select(
        F.col("url").alias("image_url"), F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit(L.WIKI_HOST), "a.href").alias("category")
    )


def rescue_emblems(gallery: DataFrame, categories: DataFrame) -> DataFrame:
    """The gallery of found emblems, and of the others those images whose
    file page is in a category with an emblem word."""
    good = categories.where(F.lower("category").rlike("|".join(EMBLEM_WORDS))).select(F.col("image_url").alias("image")).distinct()
    return gallery.where("found").select("url", "image").unionByName(
        gallery.where(~F.col("found")).join(good, "image", "left_semi").select("url", "image")
    )


def split_file_links(links: DataFrame) -> DataFrame:
    """Whether a link names a file."""
    return links.withColumn("is_file", F.contains("link", F.lit("File:")))


def links_without_entity(links: DataFrame, link_entity: DataFrame) -> DataFrame:
    return links.join(link_entity, "link", "left_anti")


def entity_links(link_entity: DataFrame) -> DataFrame:
    """Entity to links, one row per link, with the entity's number of links."""
    sizes = link_entity.groupBy("qid").agg(F.count(F.lit(1)).alias("links"))
    return link_entity.join(sizes, "qid").select("qid", "link", "links")


def links_without_image(links: DataFrame, link_entity: DataFrame, entity_images: DataFrame) -> DataFrame:
    """Links that no reference image reaches through their entity."""
    reached = link_entity.join(entity_images.where("image IS NOT NULL").select("qid").distinct(), "qid", "left_semi")
    return links.select("link").distinct().join(reached, "link", "left_anti")


def fan_out_images(link_entity: DataFrame, entity_images: DataFrame) -> DataFrame:
    """Reference images of an entity for each of its links."""
    return link_entity.join(entity_images, "qid").select("link", "source", "image", "ord")


def preferred_image(images: DataFrame) -> DataFrame:
    """One image per link: the best source, then the first listed."""
    rank = F.array_position(F.array(*[F.lit(s) for s in IMAGE_PREFERENCES]), F.col("source"))
    graded = images.withColumn("__rank", rank).where(F.col("__rank") > 0)
    return first_per_key(graded, ["link"], F.struct("__rank", "ord"), ["image"])


def merge_image_urls(preferred: DataFrame, scraped: DataFrame, file_links: DataFrame) -> DataFrame:
    """One address per link: its own file, else a scraped image, else the
    preferred reference image. Inputs: (link, image), (link, image), (link)."""
    a = preferred.select("link", L.file_redirect(F.col("image")).alias("__preferred"))
    b = scraped.select(
        "link", F.when(F.startswith("image", F.lit("//")), F.concat(F.lit("https:"), "image")).otherwise(F.col("image")).alias("__scraped")
    )
    own = F.concat(F.lit(L.FILE_REDIRECT), F.substring_index("link", "File:", -1))
    c = file_links.where(F.substring_index("link", ".", -1) != L.SKIPPED_EXTENSION).select("link", own.alias("__file"))
    return (
        a.join(b, "link", "full_outer").join(c, "link", "full_outer")
        .select("link", F.coalesce("__file", "__scraped", "__preferred").alias("image_url"))
    )


def resolve_special_formats(single: DataFrame, resolved: DataFrame) -> DataFrame:
    """Addresses with the full image of their file page where one is known.

    ``resolved``: page_url, image. ``needs_page`` marks the formats to look up.
    """
    page = F.concat(F.lit(L.FILE_PAGE), L.last_segment(F.col("image_url")))
    special = L.extension(F.col("image_url")).isin(*L.SPECIAL_FORMATS)
    return (
        single.withColumn("page_url", page).withColumn("needs_page", special)
        .join(resolved.select("page_url", F.col("image").alias("__image")), "page_url", "left")
        .select("link", F.coalesce("__image", "image_url").alias("image_url"), "needs_page")
    )


def link_image_path(single: DataFrame, paths: DataFrame) -> DataFrame:
    """Link to local path; links without a downloaded image are left out."""
    return single.join(paths.select("image_url", "image_path"), "image_url").select("link", "image_path")


def downloadable(links: DataFrame) -> DataFrame:
    return links.select("image_url").distinct().where(L.is_downloadable(F.col("image_url")))


def collage_manifest(gallery: DataFrame, paths: DataFrame, location: int = 0) -> DataFrame:
    """Tile positions of each page's collage.

    ``gallery``: url, pos, image. ``paths``: image, image_path. A page without
    a downloaded image has no collage.
    """
    tiles = gallery.join(paths, "image").select("url", "pos", "image_path")
    sizes = tiles.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    placed = position_in_group(tiles, ["url"], [F.col("pos"), F.col("image_path")], F.floor(F.col("pos") / 1000), "i").withColumn("i", F.col("i") - 1)
    rows = F.floor(F.sqrt("n"))
    key = F.concat("url", F.lit(str(location))) if location else F.col("url")
    return (
        placed.join(sizes, "url").withColumn("rows", rows).withColumn("columns", F.ceil(F.col("n") / F.col("rows")))
        .select(
            "url", "image_path", "i", "rows", "columns",
            (F.floor(F.col("i") / F.col("columns")) * TILE).alias("y"), ((F.col("i") % F.col("columns")) * TILE).alias("x"),
            F.substring(F.sha2(key, 256), 1, PATH_DIGITS).alias("collage_id"),
        )
    )
