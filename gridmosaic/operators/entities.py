"""Entities: category rules, views, image classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.functions import links as L
from gridmosaic.operators.ranking import global_position

# Words in annotation remarks and in image names.
SEAL_WORDS = ("logo", "flag", "seal", "coat", "coa")
COLLAGE_WORDS = ("collage", "location")
HUMAN = "human"
IMAGE_CLASSES = (
    ("seal", ("seal", "emblem")),
    ("flag", ("flag",)),
    ("logo", ("logo",)),
    ("coat of arms", ("coats_of_arm", "coat_of_arm")),
    ("poster", ("poster", "film", "movie", "book", "novel", "advertisement", "music")),
)
SINGLE_IMAGE_POSTER_WORDS = ("series",)


def has_word(col: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(col.rlike("|".join(words)), F.lit(False))


def annotation_kind(remarks: Column) -> Column:
    """Kind of a category annotation, from its remarks."""
    text = F.lower(F.coalesce(remarks, F.lit("")))
    return (
        F.when(has_word(text, SEAL_WORDS), "seal").when(has_word(text, ("xxx",)), "xxx")
        .when(has_word(text, COLLAGE_WORDS), "collage").otherwise("normal")
    )


def link_views(monthly: DataFrame) -> DataFrame:
    """Monthly page views to one number per link."""
    return monthly.groupBy("link").agg(F.sum("views").alias("views"))


def entity_views(views: DataFrame, link_entity: DataFrame) -> DataFrame:
    """Views of an entity: the largest among its links."""
    return views.join(link_entity, "link").groupBy("qid").agg(F.max("views").alias("views"))


def classify_entities(entities: DataFrame, entity_category: DataFrame, annotations: DataFrame, views: DataFrame) -> DataFrame:
    """The first annotation that names one of an entity's categories claims it.

    An excluding one excludes it; otherwise kind and views decide. Entities
    that no annotation names are ``remaining``.
    """
    rules = annotations.select(
        "category", F.struct("priority", "include", "limit", annotation_kind(F.col("remarks")).alias("kind")).alias("rule")
    )
    claims = entity_category.join(rules, "category").groupBy("qid").agg(F.min_by("rule", "rule.priority").alias("rule"))
    joined = entities.select("qid").distinct().join(claims, "qid", "left").join(views.select("qid", "views"), "qid", "left")
    popular = F.coalesce("views", F.lit(0)) > F.col("rule.limit")
    kind = F.col("rule.kind")
    group = (
        F.when(F.col("rule").isNull(), "remaining")
        .when(~F.col("rule.include"), "excluded")
        .when(kind == "seal", F.when(popular, "seal").otherwise("excluded"))
        .when(kind == "collage", F.when(popular, "location").otherwise("excluded"))
        .when(kind == "xxx", F.when(popular, "location").otherwise("seal"))
        .otherwise(F.when(popular, "included").otherwise("excluded"))
    )
    return joined.select("qid", group.alias("entity_class"))


def class_links(classes: DataFrame, link_entity: DataFrame) -> DataFrame:
    """Links of every entity class; write it partitioned by class for lists."""
    return link_entity.join(classes, "qid").select("entity_class", "link")


def uncategorised(entities: DataFrame, entity_category: DataFrame, link_entity: DataFrame, link_images: DataFrame) -> DataFrame:
    """Entities with no category, and whether one of their links has an image."""
    bare = entities.select("qid").distinct().join(entity_category, "qid", "left_anti")
    pictured = link_entity.join(link_images.select("link"), "link", "left_semi").select("qid").distinct()
    return bare.join(pictured.withColumn("has_image", F.lit(True)), "qid", "left").withColumn(
        "has_image", F.coalesce("has_image", F.lit(False))
    )


def image_class(category: Column, url: Column, series_is_poster: Column) -> Column:
    """First class whose words are in the category or in the image address."""
    c, u = F.lower(category), F.lower(url)
    out = None
    for name, words in IMAGE_CLASSES:
        hit = has_word(c, words) | has_word(u, words)
        if name == "poster":
            hit = hit | (series_is_poster & (has_word(c, SINGLE_IMAGE_POSTER_WORDS) | has_word(u, SINGLE_IMAGE_POSTER_WORDS)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def classify_images(
    images: DataFrame,
    link_entity: DataFrame,
    entity_category: DataFrame,
    landscapes: DataFrame,
    emblems: DataFrame,
    emblem_pages: DataFrame,
    single_pages: DataFrame,
) -> DataFrame:
    """Distinct (image_class, image) of the links in ``images`` (link, single_image).

    ``landscapes`` and ``emblems``: link, image_url. ``emblem_pages`` and
    ``single_pages``: image_url, pos, category of the file pages. A link whose
    entity or whose entity's categories are unknown is skipped.
    """
    known = images.select("link", "single_image").distinct().join(link_entity, "link")
    human = entity_category.groupBy("qid").agg(F.bool_or(F.col("category") == HUMAN).alias("is_human"))
    known = known.join(human, "qid")
    humans = known.where("is_human").select(F.lit("human").alias("image_class"), F.col("link").alias("image"))
    rest = known.where(~F.col("is_human"))

    scenic = rest.join(landscapes, "link").select(F.lit("landscape").alias("image_class"), F.col("image_url").alias("image"))
    rest = rest.join(landscapes, "link", "left_anti")

    def first_hit(urls: DataFrame, pages: DataFrame, series: bool) -> DataFrame:
        name = F.substring_index(L.last_segment(F.col("category")), ":", -1)
        graded = urls.join(pages, "image_url").withColumn("c", image_class(name, F.col("image_url"), F.lit(series))).where("c IS NOT NULL")
        return graded.groupBy("image_url").agg(F.min_by("c", "pos").alias("image_class")).select(
            "image_class", F.col("image_url").alias("image")
        )

    emblem_urls = rest.join(emblems, "link").select("image_url").distinct()
    single_urls = (
        rest.join(emblems, "link", "left_anti").where(F.col("single_image").isNotNull())
        .select(F.col("single_image").alias("image_url")).distinct()
    )
    by_name = single_urls.join(single_pages, "image_url", "left_anti").select(
        image_class(F.lit(""), F.col("image_url"), F.lit(True)).alias("image_class"), F.col("image_url").alias("image")
    ).where("image_class IS NOT NULL")
    parts = [scenic, first_hit(emblem_urls, emblem_pages, False), first_hit(single_urls, single_pages, True), by_name]
    out = humans
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()


def label_frequency(df: DataFrame, label: str = "category") -> DataFrame:
    """Rows per label, most frequent first, with the rank made explicit."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return global_position(counts, [F.desc("n"), label], "rank")


EDGE_BLOCK = 4096


def cumulative_top(df: DataFrame, col: str, width: float, share: float = 0.8) -> DataFrame:
    """Edges ``i * width`` with the count of values below each, up to the first
    edge that has ``share`` of all values below it."""
    step = F.lit(float(width))
    counts = df.where(F.col(col).isNotNull()).groupBy((F.floor(F.col(col) / step) + 1).alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.max(col).alias("top")
    )
    block = F.floor(F.col("i") / EDGE_BLOCK)
    whole = counts.agg(F.struct(F.sum("n").alias("total"), (F.ceil((F.max("top") + step) / step) - 1).alias("last")).alias("w")).scalar()
    # sums per block of edges first; a block without values carries the sum before it
    filled = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    by_block = W.orderBy("block")
    before = F.sum("n").over(by_block.rowsBetween(W.unboundedPreceding, -1))
    spans = filled.select("block", F.coalesce(before, F.lit(0)).alias("before"), F.lead("block").over(by_block).alias("next"), F.lag("block").over(by_block).alias("previous"))
    needed = spans.withColumn("w", whole).where(F.col("before") < share * F.col("w.total"))
    start = F.when(F.col("previous").isNull(), F.lit(0)).otherwise(F.col("previous") + 1)
    blocks = needed.select("before", "w.total", "w.last", F.explode(F.sequence(start, F.col("block"))).alias("block"))
    first = F.col("block") * EDGE_BLOCK
    end = F.least(first + EDGE_BLOCK - 1, F.col("last"))
    edges = blocks.where(first <= F.col("last")).select("before", "total", "block", F.explode(F.sequence(first, end)).alias("i"))
    running = edges.join(counts.select("i", "n"), "i", "left").withColumn(
        "below", F.col("before") + F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("block").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    )
    reached = (F.col("below") - F.coalesce("n", F.lit(0))) >= share * F.col("total")
    return running.where(~reached).select((F.col("i") * step).alias("edge"), F.col("below").cast("bigint").alias("below"))
