"""What shared steps move between tasks, and that they give the same rows."""

from __future__ import annotations

from gridmosaic.operators import cells as C, questions as Q
from gridmosaic.plans import construct as PC

CELLS = "table_id long, row_idx long, col_idx long, header string, original string, cell string"
ATTRIBUTES = "tag string, image_path string, original_string string"


def tag(*parts):
    return "{IMG-{T-" + "-".join(map(str, parts)) + "}}"


def tables(spark):
    rows = [
        (1, 1, 0, "H", "x", tag(1, 1, 0)), (1, 2, 0, "H", "y", f"{tag(1, 2, 0)} & {tag(1, 2, 1)} (home)"), (1, 3, 0, "H", "x", tag(1, 3, 0)),
        (1, 4, 0, "H", "z", "z"), (2, 1, 0, "H", "y", tag(2, 1, 0)), (None, 1, 0, "H", "x", tag("n")),
    ]
    paths = [((1, 1, 0), "a"), ((1, 2, 0), "b"), ((1, 2, 1), "a"), ((1, 3, 0), "a"), ((2, 1, 0), "b"), (("n",), "a")]
    attributes = [(tag(*k), p, f"<{p}>") for k, p in paths] + [(tag(9, 9, 9), None, "<->")]
    return spark.createDataFrame(rows, CELLS), spark.createDataFrame(attributes, ATTRIBUTES)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_image_keys_move_tags_a_few_times(spark):
    cells, attributes = tables(spark)
    keys = C.image_keys(cells, C.unify_by_path(C.explode_tags(cells), attributes))
    moves = exchanges(keys)
    got = {(r.table_id, r.row_idx, r.tag_pos): (r.entity, r.image_key, r.key_row, r.cells) for r in keys.collect()}
    one, two = "{ENTITY_IMAGE-1}", "{ENTITY_IMAGE-2}"
    both = f"1+{two} & {one} (home)+0"
    assert got == {
        (1, 1, 0): (one, f"1+{one}+0", 1, 2), (1, 3, 0): (one, f"1+{one}+0", 1, 2), (1, 2, 0): (two, both, 2, 1), (1, 2, 1): (one, both, 2, 1),
        (2, 1, 0): (one, f"2+{one}+0", 1, 1),
    }
    assert moves < 30, moves


def test_hot_tables_number_images_alike(spark, monkeypatch):
    cells, attributes = tables(spark)
    tags = C.explode_tags(cells)
    plain = sorted(map(tuple, C.unify_by_path(tags, attributes).collect()))
    monkeypatch.setattr(C, "_hot_tables", lambda tags: tags.select("table_id").distinct())
    assert sorted(map(tuple, C.unify_by_path(tags, attributes).collect())) == plain


def test_a_missing_path_takes_a_number(spark, monkeypatch):
    cells = spark.createDataFrame([(1, k, 0, "H", "x", tag(1, k, 0)) for k in (1, 2, 3)], CELLS)
    attributes = spark.createDataFrame([(tag(1, 1, 0), "a", "x"), (tag(1, 2, 0), None, "x"), (tag(1, 3, 0), "b", "x")], ATTRIBUTES)
    tags = C.explode_tags(cells)
    want = {1: "{ENTITY_IMAGE-1}", 3: "{ENTITY_IMAGE-3}"}
    assert {r.row_idx: r.entity for r in C.unify_by_path(tags, attributes).collect()} == want
    monkeypatch.setattr(C, "_hot_tables", lambda tags: tags.select("table_id").distinct())
    assert {r.row_idx: r.entity for r in C.unify_by_path(tags, attributes).collect()} == want


def test_replaced_cells_keep_the_text_behind_their_tags(spark):
    cells, attributes = tables(spark)
    done = C.restore_text(cells.where("table_id = 1"), attributes, out="cell")
    assert done.columns.count("cell") == 1 and set(done.columns) == set(cells.columns)
    assert {r.row_idx: r.cell for r in done.collect()} == {1: "<a>", 2: "<b> & <a> (home)", 3: "<a>", 4: "z"}


def test_evidence_is_moved_to_canonical_tables_once(spark, monkeypatch):
    cells, attributes = tables(spark)
    cells = cells.where("table_id IS NOT NULL")
    place = "question_id string, table_context long, row_idx long, col_idx long"
    mentions = spark.createDataFrame([("a", 1, 1, 0)], place)
    evidence = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 2, 0), ("b", 2, 1, 0)], place)
    questions = spark.createDataFrame([("a", 1), ("b", 2)], "question_id string, table_context long")
    canonical = spark.createDataFrame([(1, 1), (2, 2)], "table_id long, canonical_id long")
    moved = []
    real = PC.on_canonical
    monkeypatch.setattr(PC, "on_canonical", lambda rows, c: moved.append(rows is evidence) or real(rows, c))
    out = PC.experiment_set(cells, attributes, questions, questions.where("question_id = 'a'"), questions.where("question_id = 'b'"), mentions, evidence, canonical, 1, interleave=False)
    kinds = {r.question_id: r.question_type for r in out.questions.collect()}
    assert set(kinds) <= {"a", "b"} and set(out.cells.columns) == set(cells.columns)
    assert sum(moved) == 1


def test_avoided_cells_come_from_rows_marked_once(spark):
    place = "question_id string, table_context long, row_idx long, col_idx long"
    mentions = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 2, 0), ("a", 1, 3, 0)], place)
    evidence = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 2, 0)], place)
    definite, maybe = Q.avoid_cells(mentions, evidence, spark.createDataFrame([(1, 1)], "table_id long, canonical_id long"), 3)
    plan = definite._jdf.queryExecution().executedPlan().toString()
    assert exchanges(definite) == 1 and "ExistingRDD" in plan
    assert {r.row_idx for r in definite.collect()} | {r.row_idx for r in maybe.collect()} == {1, 2}
