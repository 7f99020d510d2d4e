"""Prompts out, answers in, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridmosaic.operators import cells as C, prompts as P, responses as R, scoring as S
from gridmosaic.session import reliable_checkpoint


def tag_prompts(questions: DataFrame, cells: DataFrame, image_tags: DataFrame, titles: DataFrame, examples: DataFrame | None = None, instructions: str = "{main_part}", k: int = 0, whole: bool = False) -> DataFrame:
    """Questions on tables whose images are named by entity tags; a table's tags
    are named once, whatever number of questions it has."""
    # the asked tables are read for their tags, their plain cells and the others
    asked = reliable_checkpoint(cells.join(questions.select(F.col("table_context").alias("table_id")).distinct(), "table_id", "left_semi").select("table_id", "row_idx", "col_idx", "cell"))
    names = C.normalize_tags(C.explode_tags(asked), image_tags, whole)
    prompts = P.qa_prompts(questions, C.table_string(C.entity_text(asked, names, whole)), titles)
    return prompts if examples is None else P.with_examples(prompts, examples, instructions, k)


def captioned_prompts(questions: DataFrame, cells: DataFrame, tag_predictions: DataFrame, titles: DataFrame) -> DataFrame:
    """Questions on tables with the predicted entities listed below the table."""
    names = C.number_tags(C.explode_tags(cells))
    blocks = P.prediction_block(cells, names, tag_predictions).select(F.col("table_id").alias("table_context"), "entities")
    listed = questions.join(blocks, "table_context", "left").withColumn("entities", F.coalesce("entities", F.lit("")))
    return P.qa_prompts(listed, C.table_string(C.entity_text(cells, names)), titles, "captioning")


def entity_predictions(keys: DataFrame, responses: DataFrame) -> DataFrame:
    """Prediction of every tag from the responses per image key."""
    told = R.parse_arrows(responses).withColumnRenamed("key", "image_key")
    return R.tag_predictions(keys.select("tag", "image_key", "entity"), told)


def score_run(lines: DataFrame, sample: DataFrame, group_cols: Sequence[str] = (), **options) -> DataFrame:
    """Runner lines to a scoreboard. ``sample``: key, gold and the group columns;
    a sampled question without a response counts as an empty one."""
    answers = R.read_responses(lines).select("key", "response")
    joined = sample.join(answers, "key", "left").withColumn("response", F.coalesce("response", F.lit("")))
    return S.scoreboard(joined, group_cols, **options)
