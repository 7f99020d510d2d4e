"""Tables of more rows than a chunk give one whole prompt each."""

import pytest
from pyspark.sql import functions as F

from gridmosaic.operators import cells as C, prompts as P
from gridmosaic.plans import score

N = 2500


@pytest.fixture(scope="module")
def cells(spark):
    """One table of two columns; the only tag is in row 1500."""
    rows = spark.range(N + 1)
    i = F.col("id")
    texts = [F.concat(F.lit("r"), i.cast("string")), F.when(i == 1500, "{IMG-{D-1}}").otherwise("x")]
    cols = [rows.select(F.lit("T").alias("table_id"), i.alias("row_idx"), F.lit(c).cast("bigint").alias("col_idx"), F.lit(f"h{c}").alias("header"),
                        F.when(i == 0, f"h{c}").otherwise(t).alias("original"), F.when(i == 0, f"h{c}").otherwise(t).alias("cell")) for c, t in enumerate(texts)]
    return cols[0].unionByName(cols[1])


@pytest.fixture(scope="module")
def asked(spark):
    questions = spark.createDataFrame([("q", "T", "who?", "r7", "because")], "question_id string, table_context string, question string, answer string, reason string")
    return questions, spark.createDataFrame([("T", "title", "head")], "table_id string, title string, headers string")


def test_one_prompt_holds_every_row(cells, asked):
    questions, titles = asked
    prompts = P.qa_prompts(questions, C.table_string(cells, "original"), titles).collect()
    assert len(prompts) == 1 and prompts[0].prompt.count("Question:") == 1
    assert all(f"r{k} | " in prompts[0].prompt for k in (1, 999, 1000, 1999, 2000, N))


def test_examples_are_whole_and_stand_once(cells, asked):
    questions, titles = asked
    texts = C.table_string(cells, "original")
    examples = P.qa_prompts(questions.withColumn("ord", F.lit(1)), texts, titles, "lower", True, keep=("ord",))
    out = P.with_examples(P.qa_prompts(questions, texts, titles), examples, "Do {this}:\n{example_1}\n{main_part}", 1).collect()
    assert len(out) == 1 and out[0].prompt.count("Do {this}") == 1
    assert out[0].prompt.count("r2400 | ") == 2 and out[0].prompt.count("because") == 1


def test_evidence_rows_stand_on_lines_of_their_own(cells, asked):
    text = P.evidence_prompts(asked[0], cells).first().prompt
    lines = text.split("\n")
    assert sum(line.endswith("r999 | x | ") for line in lines) == 1 and sum("| r1000 | " in line for line in lines) == 1
    assert not any("r999" in line and "r1000" in line for line in lines)


def test_predictions_of_late_rows_reach_the_prompt(spark, cells, asked):
    told = spark.createDataFrame([("{IMG-{D-1}}", "a tower")], "tag string, prediction string")
    prompts = score.captioned_prompts(asked[0], cells, told, asked[1]).collect()
    assert len(prompts) == 1 and "-> a tower" in prompts[0].prompt


def test_all_rows_are_judged_by_default(spark):
    rows = spark.range(150).select(F.col("id").alias("key"), F.lit("q").alias("question"), F.lit("g").alias("gold"), F.lit("p").alias("prediction"))
    assert P.judge_prompts(rows, "{question}{gold}{prediction}").count() == 150
    assert P.judge_prompts(rows, "{question}{gold}{prediction}", limit=100).count() == 100
