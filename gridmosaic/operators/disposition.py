"""What becomes of each image tag: kept, kept with another image, or reverted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmosaic.functions import links as L, tags as T
from gridmosaic.operators.cells import replace_tags

# Categories with rules of their own.
SPORTS = "sports discipline"
CHEMICAL = "type of chemical entity"

REVERTING = ("notes", "excluded", "remaining", "location_excluded", "seal_excluded")


def dispose_tags(
    tags: DataFrame,
    image_tags: DataFrame,
    link_entity: DataFrame,
    entity_category: DataFrame,
    link_class: DataFrame,
    collages: DataFrame,
) -> DataFrame:
    """Each tag with its bucket and image path, by the first rule that matches.

    ``tags`` needs a ``header`` column. ``link_class``: link, entity_class.
    ``collages``: link, kind (location or seal), collage_path.
    Output: bucket, counted (its categories enter the frequencies),
    image_path (null when reverted), qid.
    """
    special = entity_category.where(F.col("category").isin(SPORTS, CHEMICAL)).groupBy("qid").agg(
        F.bool_or(F.col("category") == SPORTS).alias("is_sport"), F.bool_or(F.col("category") == CHEMICAL).alias("is_chemical")
    )
    # everything known about a link is put together once per link, not per tag, and without a look at the tags
    named = link_entity.select("link").unionByName(link_class.select("link")).unionByName(collages.select("link"))
    links = (
        named.where("link IS NOT NULL").distinct()
        .join(link_entity, "link", "left")
        .join(special, "qid", "left")
        .join(link_class, "link", "left")
        .join(collages.groupBy("link").pivot("kind", ["location", "seal"]).agg(F.first("collage_path")), "link", "left")
    )
    attributes = image_tags.select("tag", "image_path", "original_string", L.absolute_link(F.col("wiki_link")).alias("link"))
    # a few links hold most tags: a task looks its few links up, and its tags need no sort; all but the header is known before tags meet their cells
    told = attributes.join(links.hint("shuffle_hash"), "link", "left")
    sport, chemical = F.coalesce("is_sport", F.lit(False)), F.coalesce("is_chemical", F.lit(False))
    ordinal = T.has_digit(F.col("original_string")) | F.contains(F.lower("original_string"), F.lit("marathon"))
    by_class = F.col("entity_class")
    rule = (
        F.when(sport, F.when(ordinal, "excluded").otherwise("included"))
        .when(chemical, F.when(F.contains("image_path", F.lit(".svg")), "included").otherwise("excluded"))
        .when(by_class.isin("excluded", "included", "remaining"), by_class)
        .when(by_class == "location", F.when(F.col("location").isNotNull(), "location_included").otherwise("location_excluded"))
        .when(by_class == "seal", F.when(F.col("seal").isNotNull(), "seal_included").otherwise("seal_excluded"))
        .otherwise("unclassified")
    )
    path = (
        F.when(F.col("rule") == "included", F.col("image_path"))
        .when(F.col("rule") == "location_included", F.col("location"))
        .when(F.col("rule") == "seal_included", F.col("seal"))
    )
    told = told.withColumn("rule", rule).select(
        "tag", "original_string", "qid", "entity_class", (~sport & ~chemical & by_class.isNotNull()).alias("by_class"), "rule", path.alias("path")
    )
    notes = T.is_notes_header(F.col("header"))
    return tags.join(told, "tag").select(
        "table_id", "row_idx", "col_idx", "tag_pos", "tag", "original_string", "qid", "entity_class", (~notes & F.col("by_class")).alias("counted"),
        F.when(notes, "notes").otherwise(F.col("rule")).alias("bucket"), F.when(~notes, F.col("path")).alias("image_path"),
    )


def apply_disposition(cells: DataFrame, disposed: DataFrame, whole: bool = False) -> DataFrame:
    """Cells with reverted tags turned back to text."""
    reverted = disposed.where(F.col("bucket").isin(*REVERTING)).select(*(["table_id"] if whole else []), "tag", F.col("original_string").alias("new_text"))
    return replace_tags(cells, reverted, out="filtered", whole=whole)


def table_counters(disposed: DataFrame) -> DataFrame:
    """Counters per table."""
    count = {
        "excluded": "excluded", "remaining": "remaining", "included": "included", "notes": "notes",
        "seal_in": "seal_included", "seal_out": "seal_excluded",
        "location_in": "location_included", "location_out": "location_excluded",
    }
    return disposed.groupBy("table_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(n) for n, b in count.items()],
        F.count_if(F.col("image_path").isNotNull()).alias("images"),
    )


def useful_columns(disposed: DataFrame, table_rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Number of tables with at least one, two and three useful columns.

    A column is useful when its cells with a kept image are at least ``share``
    of the rows below the header. ``table_rows``: table_id, rows.
    """
    kept = disposed.where(F.col("image_path").isNotNull()).groupBy("table_id", "col_idx").agg(
        F.count_distinct("row_idx").alias("useful")
    )
    per_table = (
        kept.join(table_rows, "table_id")
        .where(F.col("useful") >= share * (F.col("rows") - 1))
        .groupBy("table_id").agg(F.count(F.lit(1)).alias("columns"))
    )
    return per_table.agg(*[F.count_if(F.col("columns") >= k).alias(f"at_least_{k}") for k in (1, 2, 3)])


def category_frequency(disposed: DataFrame, entity_category: DataFrame) -> DataFrame:
    """Tags per class and category of the entities the class rules decided on.

    Tags are counted per entity before the categories are joined, so a popular
    entity is one row in the join.
    """
    per_entity = disposed.where("counted").groupBy("entity_class", "qid").agg(F.count(F.lit(1)).alias("tags"))
    return (
        per_entity.join(entity_category.select("qid", "category").distinct(), "qid")
        .groupBy("entity_class", "category").agg(F.sum("tags").alias("n"))
    )


def narrow_image_tags(image_tags: DataFrame, disposed: DataFrame, link_entity: DataFrame) -> DataFrame:
    """Attributes of kept tags, with their new path and their entity; tags
    whose link has no entity are left out (see ``tags_without_entity``)."""
    kept = disposed.where(F.col("image_path").isNotNull()).select("tag", "image_path")
    named = image_tags.select("tag", "original_string", "wiki_link", L.absolute_link(F.col("wiki_link")).alias("link"))
    return named.join(kept, "tag").join(link_entity, "link").select("tag", "image_path", "original_string", "qid", "wiki_link")


def tags_without_entity(image_tags: DataFrame, link_entity: DataFrame) -> DataFrame:
    """Tags whose link names no entity."""
    return image_tags.withColumn("link", L.absolute_link(F.col("wiki_link"))).join(link_entity, "link", "left_anti")
