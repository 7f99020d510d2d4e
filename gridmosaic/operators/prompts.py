"""Prompt datasets.

Instruction texts are the caller's: templates with ``{name}`` places. A prompt
is one row: the chunks of a table's text are put together before any template
is filled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridmosaic.functions import answers as A, prompts as P, tags as T
from gridmosaic.operators import cells as C
from gridmosaic.operators.ranking import first_per_key
from gridmosaic.operators.sampling import sample_n, seeded_order
from gridmosaic.operators.together import dealt, met, stacked
from gridmosaic.session import reliable_checkpoint

MISSING_LINE = A.MISSING_PREDICTION
PASSAGE_HEAD = "Passage related to entity in "
# Request format, table style, phrases of the prompts.
REQUEST_METHOD, REQUEST_URL = "POST", "/v1/chat/completions"
TABLE_STYLE = '<table style="border-collapse: collapse; border: 10px solid black;">'
IMAGE_WIDTH = 90
ENTITY_TEMPLATE = (
    "Table context: {context}\n\n{infobox_1}\n\n{infobox_2}\n\n{passages}\n\n"
    "Replace {tags} in column {column} of the following {tables}{same}: {focus} of {number} tables.\n\n{cell}\n\n{rows}\n"
)
EVIDENCE_TEMPLATE = "\nQuestion: {question}\nTable - \n{table}\n Answer : {answer}\nEvidence: "
NON_KEY = "NON-KEY Image {i} Attributes :\n {attributes}\n"


def table_titles(tables: DataFrame, metadata: DataFrame, id_prefix: str, source: str = "source", lookup: str = "lookup") -> DataFrame:
    """Title and section of each table: from the metadata by the id without its
    prefix where the source is ``lookup``, else the table's own.

    ``tables``: table_id, source, page_title, section_title. ``metadata``:
    context_id, title, headers.
    """
    bare = F.when(F.col(source) == lookup, F.replace("table_id", F.lit(id_prefix), F.lit("")))
    joined = tables.withColumn("context_id", bare).join(
        metadata.select("context_id", F.col("title").alias("__t"), F.col("headers").alias("__h")), "context_id", "left"
    )
    looked = F.col(source) == lookup
    return joined.select(
        "table_id", F.when(looked, F.col("__t")).otherwise(F.col("page_title")).alias("title"),
        F.when(looked, F.col("__h")).otherwise(F.col("section_title")).alias("headers"),
    )


def _around(questions: DataFrame, texts: DataFrame, head: Column, tail: Column, keep: Sequence[str], glue: str = "") -> DataFrame:
    """Head, the whole text of the question's table, tail: one row per question."""
    whole = texts.groupBy(F.col("table_id").alias("table_context")).agg(
        F.array_join(C.ordered_texts(F.col("chunk"), F.col("text")), glue).alias("__text")
    )
    return questions.join(whole, "table_context").select(*keep, F.concat(head, "__text", tail).alias("prompt"))


def qa_prompts(questions: DataFrame, texts: DataFrame, titles: DataFrame, style: str = "lower", with_answer: bool = False, keep: Sequence[str] = ("question_id",)) -> DataFrame:
    """Context, table text and question; for examples also reason and answer.

    ``texts``: table_id, chunk, text (of tags or of original cells). ``titles``:
    table_id, title, headers. Style ``captioning`` needs an ``entities`` column.
    """
    named = questions.join(titles.select(F.col("table_id").alias("table_context"), "title", "headers"), "table_context")
    head = P.fill(P.TABLE_HEAD, context=P.context_sentence(F.col("title"), F.col("headers"), style))
    values = {"question": F.col("question")}
    if style == "captioning":
        values["entities"] = F.col("entities")
    if with_answer:
        values |= {"answer": F.col("answer")} | ({} if style == "captioning" else {"reason": F.col("reason")})
    return _around(named, texts, head, P.fill(P.QUESTION_TAILS[style][with_answer], **values), keep)


def few_shot(questions: DataFrame, ids: DataFrame | None = None, k: int | None = None, seed: int = 42) -> DataFrame:
    """Example questions: a fixed id list with its order, or k in seeded order."""
    if ids is not None:
        return questions.join(ids.select("question_id", "ord"), "question_id")
    placed = seeded_order(sample_n(questions, k, seed, "question_id"), seed, "question_id", "ord")
    return placed


def with_examples(prompts: DataFrame, examples: DataFrame, instructions: str, k: int) -> DataFrame:
    """Instructions with ``{example_1}`` ... ``{example_k}`` and ``{main_part}``.

    ``examples``: ord (from 1), prompt, one row each; the k named ones are read
    in one pass.
    """
    if not k:
        return prompts.withColumn("prompt", P.fill(instructions, main_part=F.col("prompt")))
    named = [F.max(F.when(F.col("ord") == i, F.col("prompt"))).alias(f"example_{i}") for i in range(1, k + 1)]
    read = examples.where(F.col("ord").between(1, k)).agg(F.struct(*named).alias("e")).scalar()
    values = {f"example_{i}": F.col("__e")[f"example_{i}"] for i in range(1, k + 1)}
    filled = prompts.withColumn("__e", read).withColumn("prompt", P.fill(instructions, main_part=F.col("prompt"), **values))
    return filled.drop("__e")


def prediction_block(cells: DataFrame, names: DataFrame, predictions: DataFrame, whole: bool = False) -> DataFrame:
    """One row per table, one line per tag of its text, in order and with repeats:
    ``entity -> prediction``, or a fixed sentence without a usable one.

    ``names``: table_id, tag, entity. ``predictions``: tag, prediction. Tags of
    ``whole`` tables meet their names in the task of their table.
    """
    tags = C.explode_tags(cells)
    if whole:
        named = met(dealt(tags, "table_id"), dealt(names.select("table_id", "tag", "entity"), "table_id"), ["table_id", "tag"])
    else:
        named = tags.join(names, ["table_id", "tag"])
    said = named.join(predictions.select("tag", "prediction"), "tag", "left")
    usable = F.col("prediction").isNotNull() & ~F.contains(F.lower("prediction"), F.lit("error"))
    line = F.concat("entity", F.lit(" -> "), F.when(usable, F.col("prediction")).otherwise(F.lit(MISSING_LINE)), F.lit("\n"))
    return (
        said.groupBy("table_id")
        .agg(F.array_join(C.ordered_texts(F.struct("row_idx", "col_idx", "tag_pos"), line), "").alias("entities"))
    )


def attach_passages(nodes: DataFrame, passages: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """Passage text per key: for each link the cells it belongs to, then the
    preferred passage, else the other kind, else nothing.

    ``nodes``: key, ord, link, row_idx, col_idx. ``passages``: link, kind, text.
    """
    best = first_per_key(
        passages.where(F.col("kind").isin(preferred, fallback)), ["link"], (F.col("kind") != preferred).cast("int"), ["text"]
    )
    place = F.concat(F.lit("row "), F.col("row_idx").cast("string"), F.lit(" and column "), F.col("col_idx").cast("string"), F.lit(", "))
    per_link = nodes.groupBy("key", "link").agg(
        F.min("ord").alias("ord"), F.array_join(C.ordered_texts(F.col("ord"), place), "").alias("places")
    )
    text = F.concat(
        F.lit(PASSAGE_HEAD), "places", F.coalesce(F.concat(P.double_braces(F.col("text")), F.lit(". ")), F.lit(""))
    )
    return per_link.join(best, "link", "left").groupBy("key").agg(
        F.array_join(C.ordered_texts(F.struct("ord", "link"), text), "").alias("passages")
    )


def entity_prompts(cells: DataFrame, unified: DataFrame, image_tags: DataFrame, titles: DataFrame, passages: DataFrame | None = None,
                   template: str = ENTITY_TEMPLATE, base_path: str = "") -> DataFrame:
    """One prompt per image key: up to two rows without an image in the column,
    every row that shares the cell, and the images in tag order.

    A key's rows are at most a table. A key whose column has no row without an
    image has no infobox before its own. ``passages``: key (the image key), passages.
    """
    named = C.entity_text(cells, unified.select("tag", "entity"))
    keys = reliable_checkpoint(C.image_keys(cells, unified).drop("tag", "cells"))  # this and the boxes are read several times
    boxes = reliable_checkpoint(C.row_infobox(named))
    per_key = keys.select("image_key", "table_id", "col_idx", "cell_text", "key_row", "row_idx").distinct()
    spot = ["table_id", "row_idx"]

    numbered = F.transform(
        F.array_sort(F.collect_list(F.struct("row_idx", "infobox"))),
        lambda b, i: F.concat(F.lit("Table "), (i + 3).cast("string"), F.lit(":\n"), b["infobox"], F.lit("\n\n")),
    )
    rows = per_key.join(boxes, spot).groupBy("image_key", "table_id", "col_idx", "cell_text", "key_row").agg(
        F.array_join(numbered, "").alias("rows"), F.count(F.lit(1)).alias("n")
    )
    free = C.context_rows(cells).select("table_id", F.col("row_idx").alias("key_row"), "col_idx", "ord", F.col("context_row").alias("row_idx"))
    context = (
        per_key.select("image_key", "table_id", "col_idx", "key_row").distinct()
        .join(free, ["table_id", "key_row", "col_idx"]).join(boxes, spot)
        .groupBy("image_key").agg(
            F.max(F.when(F.col("ord") == 1, F.concat(F.lit("Table 1:\n"), "infobox"))).alias("infobox_1"),
            F.max(F.when(F.col("ord") == 2, F.concat(F.lit("\n\nTable 2:\n"), "infobox"))).alias("infobox_2"),
        )
    )
    firsts = unified.groupBy("table_id", "entity").agg(F.min_by("image_path", F.struct("row_idx", "col_idx", "tag_pos")).alias("image_path"))
    at_key = keys.where(F.col("row_idx") == F.col("key_row")).select("image_key", "table_id", "entity", "tag_pos").join(firsts, ["table_id", "entity"])
    tags = at_key.groupBy("image_key").agg(
        F.array_join(C.ordered_texts(F.col("tag_pos"), F.col("entity")), ", ").alias("tags"),
        C.ordered_texts(F.col("tag_pos"), F.concat(F.lit(base_path), "image_path")).alias("image_paths"),
    )
    headers = cells.where(F.col("row_idx") == 0).select("table_id", "col_idx", F.col("original").alias("column"))
    joined = (
        rows.join(context, "image_key", "left").join(tags, "image_key")
        .join(headers, ["table_id", "col_idx"]).join(titles.select("table_id", "title", "headers"), "table_id")
    )
    if passages is None:
        joined = joined.withColumn("passages", F.lit(""))
    else:
        joined = joined.join(passages.withColumnRenamed("key", "image_key"), "image_key", "left").withColumn("passages", F.coalesce("passages", F.lit("")))
    first = F.when(F.col("infobox_2").isNotNull(), 3).when(F.col("infobox_1").isNotNull(), 2).otherwise(1)
    many = F.col("n") > 1
    total = P.number_word(F.col("n") + 2)
    prompt = P.fill(
        template,
        context=F.concat(F.coalesce("headers", F.lit("")), F.lit(" of "), "title"),
        infobox_1=F.coalesce("infobox_1", F.lit("")), infobox_2=F.coalesce("infobox_2", F.lit("")), passages=F.col("passages"),
        tags=F.col("tags"), column=F.col("column"), number=total, cell=F.col("cell_text"), rows=F.col("rows"),
        tables=F.when(many, F.concat(P.number_word(F.col("n")), F.lit(" tables"))).otherwise(F.lit("table")),
        same=F.when(many, F.lit(" (which is the same entry across all the table(s))")).otherwise(F.lit("")),
        focus=F.concat(F.lit("Table "), first.cast("string"), F.when(many, F.concat(F.lit(" through Table "), total)).otherwise(F.lit(""))),
    )
    return joined.select("image_key", "table_id", prompt.alias("prompt"), "image_paths")


def evidence_prompts(questions: DataFrame, cells: DataFrame, template: str = EVIDENCE_TEMPLATE) -> DataFrame:
    """Question, numbered table text and answer."""
    before, after = template.split("{table}")
    lines = C.indexed_rows(cells).withColumn("chunk", F.floor(F.greatest("row_idx", F.lit(0)) / C.ROWS_PER_CHUNK))
    texts = lines.groupBy("table_id", "chunk").agg(F.array_join(C.ordered_texts(F.col("row_idx"), F.col("line")), "\n").alias("text"))
    values = {"question": F.col("question"), "answer": F.col("answer")}
    return _around(questions, texts, P.fill(before, **values), P.fill(after, **values), ("question_id",), "\n")


def description_prompts(images: DataFrame, prompts: dict[str, str], base_paths: dict[str, str]) -> DataFrame:
    """One row per kind and path: poster, landscape or other images, each with
    its kind's prompt and base path. ``images``: image_class, image_path."""
    kind = F.when(F.col("image_class").isin("poster", "landscape"), F.col("image_class")).otherwise(F.lit("other"))
    path = F.lit(None).cast("string")
    text = F.lit(None).cast("string")
    for name in ("poster", "landscape", "other"):
        text = F.when(F.col("kind") == name, F.lit(prompts[name])).otherwise(text)
        path = F.when(F.col("kind") == name, F.concat(F.lit(base_paths.get(name, "")), "image_path")).otherwise(path)
    return images.select(kind.alias("kind"), "image_path").distinct().select("kind", text.alias("prompt"), path.alias("image_path"))


def contrast_prompts(questions: DataFrame, images: DataFrame, attributes: DataFrame, head: str = "", middle: str = "\n", tail: str = "") -> DataFrame:
    """The key image's attributes against those of the question's other images,
    one per path, in order.

    ``questions``: key, key_image. ``images``: key, ord, image_id, image_path.
    ``attributes``: image_id, attributes. A question whose key image or one of
    the others has no attributes is left out.
    """
    keyed = questions.join(images.select("key", F.col("image_id").alias("key_image"), F.col("image_path").alias("__own")).distinct(), ["key", "key_image"])
    others = images.join(keyed.select("key", "__own"), "key").where(F.col("image_path") != F.col("__own"))
    once = first_per_key(others, ["key", "image_path"], F.col("ord"), ["ord", "image_id"])
    told = once.join(attributes, "image_id", "left").withColumn("json", F.to_json("attributes"))
    line = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "json"))),
        lambda s, i: P.fill(NON_KEY, i=(i + 1).cast("string"), attributes=s["json"]),
    )
    blocks = told.groupBy("key").agg(F.array_join(line, "").alias("others"), F.bool_or(F.col("json").isNull()).alias("gap")).where(~F.col("gap"))
    own = keyed.join(attributes.select(F.col("image_id").alias("key_image"), F.to_json("attributes").alias("json")), "key_image")
    return own.join(blocks, "key", "left").join(told.where("json IS NULL").select("key"), "key", "left_anti").select(
        "key", F.concat(F.lit(head), "json", F.lit(middle), F.coalesce("others", F.lit("")), F.lit(tail)).alias("prompt")
    )


def rephrase_prompts(unique_attributes: DataFrame, questions: DataFrame, template: str = "{entity}") -> DataFrame:
    """Question, entity and unique attributes of each ``question:entity`` key.

    ``unique_attributes``: key, attributes. ``questions``: question_id, question.
    """
    split = unique_attributes.withColumn("k", T.split_visual_key(F.col("key"))).select("key", "attributes", "k.question_id", "k.entity")
    body = P.fill(
        '{"Original Question": "{question}", "Entity": "{entity}", "Image Attributes": {attributes}}',
        question=F.col("question"), entity=F.col("entity"), attributes=F.to_json("attributes"),
    )
    return split.join(questions.select("question_id", "question"), "question_id").select(
        "key", F.concat(P.fill(template, entity=F.col("entity")), body).alias("prompt")
    )


def picture_manifest(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Table picture of each question's table, and whether the file exists.
    ``files``: file_name."""
    named = questions.withColumn("file_name", P.picture_name(F.col("table_context")))
    return named.join(files.select("file_name").distinct().withColumn("__there", F.lit(True)), "file_name", "left").select(
        *questions.columns, "file_name", F.col("__there").isNull().alias("is_missing")
    )


def missing_pictures(manifest: DataFrame) -> DataFrame:
    """Ids of tables without a picture, recovered from the file name."""
    return manifest.where("is_missing").select(
        F.replace(F.regexp_replace("file_name", r"\.jpg$", ""), F.lit("_"), F.lit("/")).alias("table_id")
    ).distinct()


def judge_prompts(df: DataFrame, template: str, order: str = "key", limit: int | None = None) -> DataFrame:
    """Judge prompts with the places question, gold and prediction, of all rows
    or of the first ``limit``."""
    rows = df if limit is None else df.orderBy(order).limit(limit)
    return rows.select("key", P.fill(template, question=F.col("question"), gold=F.col("gold"), prediction=F.col("prediction")).alias("prompt"))


def request_rows(prompts: DataFrame, model: str, max_tokens: int = 4096, temperature: float = 0.0) -> DataFrame:
    """Batch request lines. ``prompts``: key, prompt and, if the request carries
    a picture, image_base64."""
    text = F.struct(F.lit("text").alias("type"), F.col("prompt").alias("text"), F.lit(None).cast("struct<url:string,detail:string>").alias("image_url"))
    content = F.array(text)
    if "image_base64" in prompts.columns:
        url = F.concat(F.lit("data:image/jpeg;base64,"), "image_base64")
        image = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(url.alias("url"), F.lit("high").alias("detail")).alias("image_url"))
        content = F.when(F.col("image_base64").isNotNull(), F.array(text, image)).otherwise(content)
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"))
    line = F.to_json(F.struct(F.col("key").alias("custom_id"), F.lit(REQUEST_METHOD).alias("method"), F.lit(REQUEST_URL).alias("url"), body.alias("body")))
    return prompts.select("key", line.alias("request"))


def export_prompts(prompts: DataFrame, seed: int, key: str = "key") -> DataFrame:
    """Prompts with their place in seeded order, ready to be written in order."""
    return seeded_order(prompts, seed, key)


def rerun_prompts(parsed: DataFrame, prompts: DataFrame, field: str = "$['Rephrased Question']") -> DataFrame:
    """Prompts of rows whose parsed answer has an empty rephrased question."""
    empty = parsed.where(F.try_variant_get("parsed", field, "string") == "")
    return prompts.join(empty.select("key"), "key", "left_semi")


def picture_prompts(questions: DataFrame, titles: DataFrame, passages: DataFrame, templates: dict[str, str], source: str = "source", fallback: str = "other") -> DataFrame:
    """Question on a table picture: the source's template with ``{main_part}``
    filled by context, question and passages. ``passages``: key, passages."""
    joined = questions.join(titles.select(F.col("table_id").alias("table_context"), "title", "headers"), "table_context").join(
        passages.withColumnRenamed("key", "question_id"), "question_id", "left"
    )
    main = F.concat(
        P.fill(P.PICTURE_QUESTION, context=P.context_sentence(F.col("title"), F.col("headers"), "picture"), question=F.col("question")),
        F.coalesce("passages", F.lit("")),
    )
    text = P.fill(templates[fallback], main_part=main)
    for name, template in templates.items():
        if name != fallback:
            text = F.when(F.col(source) == name, P.fill(template, main_part=main)).otherwise(text)
    return joined.select("question_id", text.alias("prompt"), P.picture_name(F.col("table_context")).alias("picture"))


def table_html(cells: DataFrame, image_tags: DataFrame, base_path: str, rows_per_chunk: int = C.ROWS_PER_CHUNK, whole: bool = False) -> DataFrame:
    """A table as HTML with each tag as an image; a tag without a path gets the
    bare base path. Chunks of one table concatenate in order. ``whole`` tables are put together in one task."""
    def image(path: Column) -> Column:
        return F.concat(F.lit(f'<img src="{base_path}'), path, F.lit(f'" width="{IMAGE_WIDTH}" >'))

    drawn = C.replace_tags(
        cells, image_tags.select("tag", image(F.coalesce("image_path", F.lit(""))).alias("new_text")), out="drawn", default=image(F.lit("")), whole=whole
    )
    mark = F.when(F.col("row_idx") == 0, F.lit("th")).otherwise(F.lit("td"))
    cell = F.concat(F.lit("<"), mark, F.lit(">"), "drawn", F.lit("</"), mark, F.lit(">"))
    rows = drawn.groupBy("table_id", "row_idx").agg(F.concat(F.lit("<tr>"), F.array_join(C.ordered_texts(F.col("col_idx"), cell), ""), F.lit("</tr>\n")).alias("line"))
    framed = rows.where(F.col("table_id").isNotNull()).select(
        "table_id", "row_idx", F.lit(0).alias("part"), F.concat(F.when(F.col("row_idx") == 0, F.lit(TABLE_STYLE + "\n")).otherwise(F.lit("")), "line").alias("line")
    )
    # the end of a table is a line of its own after its last row, so the rows need not meet the number of that row
    ends = cells.where(F.col("table_id").isNotNull() & F.col("row_idx").isNotNull()).groupBy("table_id").agg(
        F.max("row_idx").alias("row_idx"), F.lit(1).alias("part"), F.lit("</table>").alias("line")
    )
    lines = stacked([framed, ends], "table_id", "__table").withColumn("chunk", F.floor(F.col("row_idx") / rows_per_chunk))
    html = F.array_join(C.ordered_texts(F.struct("row_idx", "part"), F.col("line")), "").alias("html")
    return lines.groupBy("__table", "chunk").agg(html).withColumnRenamed("__table", "table_id")
