"""Visual questions: attributes of images, what is unique to the key image."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmosaic.functions import answers as A
from gridmosaic.operators import prompts as P, responses as R


def parsed_attributes(responses: DataFrame, path: str = "path") -> DataFrame:
    """Attribute maps of described images; unreadable responses are left out."""
    parsed = responses.select(path, A.parse_json_response(F.col("response")).alias("r"))
    return parsed.where("r.is_parsed").select(
        F.col(path).alias("path"), F.from_json("r.json_text", "map<string,array<string>>").alias("attributes")
    ).where("attributes IS NOT NULL")


def unique_to_key(images: DataFrame, attributes: DataFrame, key_images: DataFrame) -> DataFrame:
    """Attribute values that only the key image of a group has. ``images``:
    group_id, image_id. ``attributes``: image_id, attributes."""
    told = images.join(attributes, "image_id")
    return R.unique_attributes(R.attribute_rows(told, keep=("group_id", "image_id")), key_images)


def rephrased(prompts: DataFrame, first: DataFrame, corrections: DataFrame, rerun: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final parsed answers, prompts to run again).

    Each run: key, value (response text). Corrections go over the first run, and
    a rerun over both.
    """
    merged = R.apply_overrides(first, corrections, rerun)
    parsed = merged.select("key", A.parse_json_response(F.col("value")).alias("r")).select("key", "r.json_text", "r.parsed", "r.is_parsed")
    return parsed, P.rerun_prompts(parsed, prompts)
