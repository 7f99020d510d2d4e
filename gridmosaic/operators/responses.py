"""Responses of model runs: parsing, joining, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridmosaic.functions import answers as A, tags as T
from gridmosaic.operators.ranking import last_per_key

ARROW_STEP = "Step 3:"
BATCH_CONTENT = "$.response.body.choices[0].message.content"
RUNNER_SCHEMA = "map<string,struct<image:string,text:string,response:string,gold_ans:string>>"
FLAT_SCHEMA = "key string, response string, gold_ans string, prompt string"


def arrow_lines(responses: DataFrame, key: str = "key", text: str = "response") -> DataFrame:
    """Lines with an arrow after the last step marker, with their parts."""
    lines = F.split(F.substring_index(F.col(text), ARROW_STEP, -1), "\n")
    return (
        responses.select(key, F.posexplode(lines).alias("pos", "line"))
        .where(F.contains("line", F.lit("->")))
        .select(key, "pos", F.split(A.strip(F.col("line")), "->").alias("parts"))
    )


def parse_arrows(responses: DataFrame, key: str = "key", text: str = "response") -> DataFrame:
    """(key, entity, prediction): later lines overwrite earlier ones.

    Two parts: every tag of the left part gets the right part; a left part
    without a tag is put in braces. Three parts: the first two get the third.
    """
    lines = arrow_lines(responses, key, text)
    left = F.col("parts")[0]
    tags = T.entity_tags(left, "image")
    braced = F.concat(F.lit("{"), A.strip(left), F.lit("}"))
    # the braced text is searched again, so only a tag-shaped one counts
    two = F.when(F.size(tags) > 0, tags).otherwise(T.entity_tags(braced, "image"))
    three = F.transform(F.slice("parts", 1, 2), A.strip)
    entities = F.when(F.size("parts") == 2, F.array_distinct(two)).when(F.size("parts") == 3, three)
    found = lines.where(F.size("parts") <= 3).select(
        key, "pos", A.strip(F.element_at("parts", -1)).alias("prediction"), F.posexplode(entities).alias("part", "entity")
    )
    return last_per_key(found, [key, "entity"], F.struct("pos", "part"), ["prediction"])


def unparsed_arrows(responses: DataFrame, key: str = "key", text: str = "response") -> DataFrame:
    """Arrow lines of four or more parts, which name no prediction."""
    lines = arrow_lines(responses, key, text).where(F.size("parts") > 3)
    return lines.select(key, F.col("pos").cast("bigint").alias("pos"), F.array_join("parts", "->").alias("line"))


def merge_runs(sample: DataFrame, original: DataFrame, rerun: DataFrame, key: str = "key") -> DataFrame:
    """The original response if present, else the rerun, else an empty string."""
    first = original.select(key, F.col("response").alias("__first"))
    second = rerun.select(key, F.col("response").alias("__second"))
    return (
        sample.select(key).distinct().join(first, key, "left").join(second, key, "left")
        .select(key, F.coalesce("__first", "__second", F.lit("")).alias("response"))
    )


def flatten_batch(batch: DataFrame, gold: DataFrame | None = None, line: str = "value") -> DataFrame:
    """Batch output lines to (custom_id, response), with the gold answer."""
    flat = batch.select(
        F.get_json_object(line, "$.custom_id").alias("custom_id"), F.get_json_object(line, BATCH_CONTENT).alias("response")
    )
    if gold is None:
        return flat
    return flat.join(gold.select(F.col("key").alias("custom_id"), "gold_ans"), "custom_id")


def tag_predictions(tags: DataFrame, predictions: DataFrame, default: str = A.MISSING_PREDICTION) -> DataFrame:
    """Prediction of each tag through (image_key, entity), with a default text."""
    return tags.join(predictions.select("image_key", "entity", "prediction"), ["image_key", "entity"], "left").withColumn(
        "prediction", F.coalesce("prediction", F.lit(default))
    )


def check_complete(sent: DataFrame, expected: DataFrame, key: str = "key") -> DataFrame:
    """Keys on one side only; none when the run is complete."""
    a, b = sent.select(key), expected.select(key)
    return a.exceptAll(b).withColumn("problem", F.lit("unexpected")).unionByName(
        b.exceptAll(a).withColumn("problem", F.lit("missing"))
    )


def unique_attributes(attributes: DataFrame, key_images: DataFrame) -> DataFrame:
    """Attribute values of a group's key image that no other image of it has.

    ``attributes``: group_id, image_id, attribute, value. ``key_images``:
    group_id, image_id. Values are first reduced to distinct images per value,
    so a popular value is one row however many images share it.
    """
    holders = attributes.groupBy("group_id", "attribute", "value").agg(
        F.min("image_id").alias("first_image"), F.max("image_id").alias("last_image")
    )
    alone = holders.where(F.col("first_image") == F.col("last_image"))
    return alone.join(
        key_images.select("group_id", F.col("image_id").alias("first_image")), ["group_id", "first_image"]
    ).select("group_id", F.col("first_image").alias("image_id"), "attribute", "value")


def attribute_rows(images: DataFrame, col: str = "attributes", keep: tuple[str, ...] = ()) -> DataFrame:
    """Attribute maps (attribute to list of values) to one row per value."""
    pairs = images.select(*keep, F.explode(col).alias("attribute", "values"))
    return pairs.select(*keep, "attribute", F.explode("values").alias("value"))


def apply_overrides(base: DataFrame, *overrides: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A result map updated by corrections in turn: the last write wins."""
    parts = [df.select(key, value, F.lit(i).alias("__order")) for i, df in enumerate((base, *overrides))]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return last_per_key(merged, [key], F.col("__order"), [value])


def attach_attributes(images: DataFrame, parsed: DataFrame) -> DataFrame:
    """Images with their parsed attributes under the class's base path; those
    without any are flagged."""
    path = F.concat_ws("/", "base_path", "image_path")
    return images.withColumn("full_path", path).join(
        parsed.select(F.col("path").alias("full_path"), "attributes"), "full_path", "left"
    ).withColumn("is_missing", F.col("attributes").isNull())


def read_responses(lines: DataFrame, col: str = "value") -> DataFrame:
    """Runner lines of either shape to (key, response, gold_ans, prompt).

    A flat row has a ``key`` field; otherwise the only field's name is the key.
    """
    flat = F.get_json_object(col, "$.key")
    flat_rows = lines.where(flat.isNotNull()).select(F.from_json(col, FLAT_SCHEMA).alias("r")).select("r.*")
    keyed = (
        lines.where(flat.isNull())
        .select(F.explode(F.from_json(col, RUNNER_SCHEMA)).alias("key", "r"))
        .select("key", "r.response", "r.gold_ans", F.col("r.text").alias("prompt"))
    )
    return flat_rows.select("key", "response", "gold_ans", "prompt").unionByName(keyed)
