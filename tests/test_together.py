"""Frames dealt by table: joins that leave them there, and operators that give the same rows with and without them."""

import pytest
from pyspark.sql import functions as F

from gridmosaic.operators import cells as C, containment as K, disposition as D, interleave as IL, prompts as P, questions as Q, similarity as S, tagging as TG
from gridmosaic.operators.together import dealt, met, stacked
from gridmosaic.plans import construct as PC

PLACE = "question_id string, table_context bigint, row_idx bigint, col_idx bigint"


def rows(df):
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())


def tag(*parts):
    return "{IMG-{D-" + "-".join(map(str, parts)) + "}}"


@pytest.fixture(autouse=True)
def by_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def tables(spark):
    """Cells with a missing table, a repeated row, text behind tags, a tag without attributes and one without a path."""
    cells = []
    for t in (1, 2, 3, None):
        cells.append((t, 0, 0, "H", "H", "H"))
        for r in range(1, 6):
            cells.append((t, r, 0, "H", f"s{r % 3}", tag(t, r, 0, 0) if r != 4 else "plain"))
            cells.append((t, r, 1, "Note", f"n{r % 2} & s{r % 3} (home)", f"{tag(t, r, 1, 0)} & {tag(t, r, 1, 1)} (home)"))
    cells += cells[3:5]
    paths = []
    for t in (1, 2, 3, None):
        for r in range(1, 6):
            paths += [(tag(t, r, 0, 0), f"p{r % 3}", f"s{r % 3}"), (tag(t, r, 1, 0), None if r == 2 else f"q{r % 2}", f"n{r % 2}")] + ([(tag(t, r, 1, 1), f"p{r % 3}", f"s{r % 3}")] if r != 5 else [])
    paths += paths[:2]
    return (
        spark.createDataFrame(cells, "table_id bigint, row_idx bigint, col_idx bigint, header string, original string, cell string"),
        spark.createDataFrame(paths, "tag string, image_path string, original_string string"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_met_is_a_join(spark, how):
    left = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (None, "a", 5), (1, None, 6)], "t bigint, k string, x bigint")
    right = spark.createDataFrame([(1, "a", "u"), (1, "a", None), (2, "b", "v"), (None, "a", "w"), (1, None, "z"), (2, "a", "u")], "t bigint, k string, y string")
    want = left.join(right, ["t", "k"], {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    assert rows(met(dealt(left, "t"), dealt(right, "t"), ["t", "k"], how)) == rows(want)


def test_rows_meet_where_a_shuffle_is_used_twice(spark):
    """Spark runs a union of such frames as a plain one if the key looks another one as it runs."""
    lines = spark.range(4000).select((F.col("id") % 50).alias("t"), (F.col("id") % 8).alias("r"), F.col("id").alias("x"))
    other = dealt(lines.where("x % 3 = 0"), "t").select("t", "r").distinct()
    mine = dealt(lines, "t")
    near = met(mine, other, ["t", "r"], "semi")
    found = dealt(near.select("t", "x").distinct().join(lines.select("x", (F.col("x") + 1).alias("y")), "x"), "t")
    twice = met(met(near, found, ["t", "x"]), other, ["t", "r"], "semi")
    plain = lines.join(lines.where("x % 3 = 0").select("t", "r").distinct(), ["t", "r"], "left_semi").count()
    assert near.count() == plain == met(near, found, ["t", "x"]).count() == twice.count()
    assert stacked([near, mine], "t", "u").groupBy("u").count().agg(F.sum("count")).first()[0] == plain + 4000


def test_rows_that_lie_by_table_stay(spark, tables):
    cells, paths = tables
    unified = C.unify_by_path(C.explode_tags(cells), paths, whole=True)
    plan = C.image_keys(dealt(cells, "table_id"), unified, whole=True)._jdf.queryExecution().executedPlan().toString()
    # tags and attributes by tag, placed tags and cells by table
    assert plan.count("Exchange hashpartitioning") == 4


def test_images_are_named_alike(tables):
    cells, paths = tables
    tags = C.explode_tags(cells)
    for make in (C.unify_by_path, C.normalize_tags):
        assert rows(make(tags, paths, whole=True)) == rows(make(tags, paths))
    assert rows(C.number_tags(dealt(tags, "table_id"), whole=True)) == rows(C.number_tags(tags))
    keys = C.image_keys(cells, C.unify_by_path(tags, paths))
    assert rows(C.image_keys(dealt(cells, "table_id"), C.unify_by_path(tags, paths, whole=True), whole=True)) == rows(keys)


def test_text_of_tags_comes_back_alike(spark, tables):
    cells, paths = tables
    assert rows(C.restore_text(dealt(cells, "table_id"), paths, whole=True)) == rows(C.restore_text(cells, paths))
    plain = cells.distinct()
    assert rows(P.table_html(dealt(plain, "table_id"), paths, "b/", 2, whole=True)) == rows(P.table_html(plain, paths, "b/", 2))
    told = paths.select("tag", F.col("original_string").alias("prediction"))
    names = C.number_tags(C.explode_tags(cells))
    assert rows(P.prediction_block(dealt(cells, "table_id"), C.number_tags(C.explode_tags(dealt(cells, "table_id")), whole=True), told, whole=True)) == rows(P.prediction_block(cells, names, told))
    disposed = C.explode_tags(cells, ("header",)).join(paths, "tag").withColumn("bucket", F.when(F.col("header") == "Note", "notes").otherwise("included"))
    assert rows(D.apply_disposition(dealt(plain, "table_id"), disposed.distinct(), whole=True)) == rows(D.apply_disposition(plain, disposed.select("tag", "original_string", "bucket").distinct()))


def test_tagging_alike(spark):
    cells = [(t, r, c, "H", x) for t in (1, 2, None) for r in (1, 2, 3) for c, x in enumerate((f"Tower {r} and Bridge", f"{{IMG}} Sea-{r}", "none", ""))]
    cells = spark.createDataFrame(cells + cells[:2], "table_id bigint, row_idx bigint, col_idx bigint, header string, cell string")
    anchors = [(t, x, f"/wiki/{x[:1]}", k) for t in (1, 2, None) for k, x in enumerate(("Tower 1", "tower", "Bridge", "Sea", "none", "Sea-2"))]
    anchors = spark.createDataFrame(anchors, "table_id bigint, text string, link string, pos bigint")
    links = spark.createDataFrame([(t, r, c, o, x) for t in (1, 2, None) for r in (1, 2) for c in (0, 1, 2) for o, x in enumerate(("/wiki/T", "/wiki/none", "/wiki/B"))], "table_id bigint, row_idx bigint, col_idx bigint, ord bigint, link string")
    images = spark.createDataFrame([(f"https://en.wikipedia.org/wiki/{x}", x) for x in ("T", "S", "none")], "link string, image_path string")
    near = dealt(cells, "table_id")
    assert rows(TG.tag_cells_by_text(near, anchors, images, "D", whole=True)) == rows(TG.tag_cells_by_text(cells, anchors, images, "D"))
    plain, whole = TG.tag_cells_by_link(cells, links, anchors, images, "D"), TG.tag_cells_by_link(near, links, anchors, images, "D", whole=True)
    assert rows(whole) == rows(plain)
    assert rows(TG.link_counts(whole, links, images, whole=True)) == rows(TG.link_counts(plain, links, images))
    assert rows(TG.annotate_links(near, anchors, links, whole=True)) == rows(TG.annotate_links(cells, anchors, links))


def test_texts_are_found_where_they_lie(spark):
    hay = spark.range(300).select((F.col("id") % 7).alias("b"), F.col("id").alias("k"), F.concat(F.lit("x w"), (F.col("id") % 11).cast("string"), F.lit(" y")).alias("t"))
    nee = spark.range(40).select((F.col("id") % 8).alias("b"), F.concat(F.lit("W"), F.col("id").cast("string")).alias("n"))
    sizes = hay.select("b", F.lit(5).alias("chars"))
    out = K.occurring_texts(dealt(hay, "b"), nee, "b", ("k",), "t", "n", whole=True, sizes=sizes)
    want = rows(K.occurring_texts(hay, nee, "b", ("k",), "t", "n"))
    assert want and rows(out) == want
    assert "Window" in out._jdf.queryExecution().executedPlan().toString()  # without it nothing asks for the rows of a block in one task


def test_interleaved_elements_are_taken_from_their_rows(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("g"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("l"), F.col("id").alias("pos"), F.struct((F.col("id") % 17).alias("r"), F.lit(0).alias("c")).alias("e"))
    df = df.unionByName(spark.createDataFrame([(None, "l0", 1, (3, 0)), (1, None, 1, (99, 0))], df.schema))
    whole, plain = IL.interleave(dealt(df, "g"), "g", "l", "pos", "e", whole=True), IL.interleave(df, "g", "l", "pos", "e")
    hot = IL.interleave(df.where("g IS NOT NULL AND l IS NOT NULL"), "g", "l", "pos", "e", hot_rows=1)
    assert rows(whole) == rows(plain) and rows(IL.interleave(df.where("l IS NOT NULL"), "g", "l", "pos", "e")) == rows(hot)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()


def test_datasets_alike(spark, tables):
    cells, paths = tables
    cells = cells.where("table_id IS NOT NULL").distinct()
    asked = [(f"q{t}{k}", t, r, c) for t in (1, 2, 3) for k in range(4) for r, c in ((k + 1, 0), (k + 1, 1), (k, 1))]
    mentions, evidence = spark.createDataFrame(asked, PLACE), spark.createDataFrame([x for x in asked if x[2] % 2] + [("q9", 2, 1, 0)], PLACE)
    questions = mentions.select("question_id", "table_context").distinct()
    canonical = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "table_id bigint, canonical_id bigint")
    for interleave in (True, False):
        plain, whole = (PC.experiment_set(dealt(cells, "table_id", w), paths, questions, questions.where("question_id < 'q2'"), questions.where("question_id >= 'q2'"), mentions, evidence, canonical, 3, interleave, whole=w) for w in (False, True))
        for name in ("cells", "explicit", "implicit", "questions", "mentions", "reverted"):
            assert rows(getattr(whole, name)) == rows(getattr(plain, name)), name
    checks = [Q.check_dataset(cells, questions, mentions, questions, evidence, 3, whole=w) for w in (False, True)]
    assert rows(checks[0]) == rows(checks[1]) != []
    compact = mentions.select("question_id", F.col("table_context").alias("table_id"), "row_idx", "col_idx")
    told = mentions.select("question_id", "row_idx", "col_idx", F.concat_ws("-", "question_id", "row_idx", "col_idx").alias("img_id"), F.lit("x").alias("img_string"), F.lit("H").alias("column_header"))
    old = told.select(F.col("img_id").alias("tag"), F.concat(F.lit("p"), (F.col("row_idx") % 3).cast("string")).alias("image_path"))
    aligned = [Q.realign_mentions(told, compact, dealt(cells, "table_id", w), old, paths.distinct(), whole=w) for w in (False, True)]
    assert rows(aligned[0]) == rows(aligned[1]) != []


def test_repeats_that_both_tables_have_are_the_only_rows(spark):
    df = spark.createDataFrame([(1, x) for x in ["a"] * 5 + ["b", "b", "c", None, None]] + [(2, x) for x in ["a"] * 3 + ["b", "c", "c", None]], "table_id bigint, shingle string")
    pairs = spark.createDataFrame([(1, 2), (2, 2), (1, 3)], "left_id bigint, right_id bigint")
    got = {(r.left_id, r.right_id): r.similarity for r in S.multiset_jaccard(df, df, pairs).collect()}
    assert got == {(1, 2): 6 / 11, (2, 2): 1.0, (1, 3): 0.0}
