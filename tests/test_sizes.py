"""Steps that must not grow faster than their input: what is written, shuffled and worked out twice."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridmosaic.functions import markup as M, tags as T
from gridmosaic.operators import cells as C, disposition as D, interleave as IL, prompts as P, questions as Q, similarity as S, tagging as TG
from gridmosaic.session import reliable_checkpoint


def plan(df, kind="executedPlan"):
    """As planned, also of a frame that has run."""
    return getattr(df._jdf.queryExecution(), kind)().toString().split("== Initial Plan ==")[-1]


@pytest.fixture
def joins_by_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def counted(monkeypatch, module):
    seen, keep = [], reliable_checkpoint
    monkeypatch.setattr(module, "reliable_checkpoint", lambda df: seen.append(keep(df)) or seen[-1])
    return seen


def make_cells(spark, rows):
    return spark.createDataFrame([(t, r, c, f"h{c}", o, x) for t, r, c, o, x in rows], "table_id bigint, row_idx bigint, col_idx bigint, header string, original string, cell string")


@pytest.fixture
def tagged(spark):
    rows = [(1, 0, 0, "h", "h"), (1, 1, 0, "a", "{IMG-{D-1}}"), (1, 2, 0, "b", "x {IMG-{D-2}} y {IMG-{D-3}}"), (2, 0, 0, "h", "h"), (2, 1, 0, "c", "{IMG-{D-4}}"), (None, 1, 0, "c", "z")]
    paths = spark.createDataFrame([("{IMG-{D-1}}", "p"), ("{IMG-{D-2}}", "q"), ("{IMG-{D-4}}", None)], "tag string, image_path string")
    return make_cells(spark, rows), paths


def test_hot_tables_are_counted_on_the_tags(spark, tagged, monkeypatch):
    cells, paths = tagged
    seen, real = [], C.position_in_group
    monkeypatch.setattr(C, "position_in_group", lambda *a, **k: seen.append(k.get("hot_groups")) or real(*a, **k))
    tags = C.explode_tags(cells)
    for hot in (1_000_000, 1):
        monkeypatch.setattr(C, "HOT_GROUP_ROWS", hot)
        assert {(r.tag, r.entity) for r in C.number_tags(tags).collect()} == {("{IMG-{D-1}}", "{ENTITY-1}"), ("{IMG-{D-2}}", "{ENTITY-2}"), ("{IMG-{D-3}}", "{ENTITY-3}"), ("{IMG-{D-4}}", "{ENTITY-1}")}
        assert {(r.tag, r.entity) for r in C.unify_by_path(tags, paths.where("image_path IS NOT NULL")).collect()} == {("{IMG-{D-1}}", "{ENTITY_IMAGE-1}"), ("{IMG-{D-2}}", "{ENTITY_IMAGE-2}")}
        assert {(r.tag, r.entity) for r in C.normalize_tags(tags, paths.where("image_path IS NOT NULL")).collect()} == {("{IMG-{D-1}}", "{ENTITY-1}"), ("{IMG-{D-2}}", "{ENTITY-2}")}
    assert len(seen) == 6 and all(s is not None and "image_path" not in plan(s) for s in seen)


def test_table_html_meets_the_tags_once(tagged, joins_by_shuffle):
    cells, paths = tagged
    out = P.table_html(cells, paths, "b/", rows_per_chunk=2)
    img = '<img src="b/{}" width="90" >'.format
    head = P.TABLE_STYLE + "\n<tr><th>h</th></tr>\n"
    assert {(r.table_id, r.chunk): r.html for r in out.collect()} == {
        (1, 0): head + f"<tr><td>{img('p')}</td></tr>\n", (1, 1): f"<tr><td>x {img('q')} y {img('')}</td></tr>\n</table>",
        (2, 0): head + f"<tr><td>{img('')}</td></tr>\n</table>",
    }
    assert plan(out).count("SortMergeJoin") == 1


def test_entity_prompts_write_what_they_read_again(spark, tagged, monkeypatch):
    seen = counted(monkeypatch, P)
    cells, paths = tagged
    paths = paths.where("image_path IS NOT NULL")
    titles = spark.createDataFrame([(1, "t", "h")], "table_id bigint, title string, headers string")
    out = P.entity_prompts(cells, C.unify_by_path(C.explode_tags(cells), paths), paths, titles)
    assert {(r.table_id, tuple(r.image_paths)) for r in out.collect()} == {(1, ("p",)), (1, ("q",))}
    assert len(seen) == 2


def test_empty_and_header_cells_are_no_texts(spark):
    rows = spark.createDataFrame([(1, 1, "Tower", "{IMG-{D-1}}"), (1, 2, "", "{IMG-{D-2}}"), (2, 1, "Sea", "{IMG-{D-3}}")], "table_id bigint, at bigint, o string, x string")

    def cell(row, original, x):
        return F.array(F.struct(row.alias("row_idx"), F.lit(0).cast("bigint").alias("col_idx"), F.lit("H").alias("header"), original.alias("original"), x.alias("cell")))

    row, head = cell(F.col("at"), F.col("o"), F.col("x")), cell(F.lit(0).cast("bigint"), F.lit("H"), F.lit("H"))
    cells = rows.select("table_id", F.explode(F.when(F.col("at") == 1, F.concat(head, row)).otherwise(row)).alias("c")).select("table_id", "c.*")
    questions = spark.createDataFrame([("q", 1, "what TOWER, or h?", "no"), ("r", 1, "?", "no")], "question_id string, table_context bigint, question string, answer string")
    out = Q.explicit_questions(questions, cells)
    assert [(r.question_id, r.found_word, r.row_idx, r.img_id) for r in out.collect()] == [("q", "tower", 1, "{IMG-{D-1}}")]


def test_sets_go_by_an_id(spark, monkeypatch):
    seen = counted(monkeypatch, S)
    rng = random.Random(1)
    rows = [("b", k, f"x{rng.randrange(12)}") for k in range(40) for _ in range(5)]
    df = spark.createDataFrame(set(rows), "block string, table_id bigint, shingle string")
    left, right = df.where("table_id < 20"), df.where("table_id >= 20")
    by = {k: {s for _, j, s in rows if j == k} for k in range(40)}
    for r in S.best_table_match(left, right, rare=3).collect():
        assert (r.match_id, r.similarity) == max(((j, len(by[r.table_id] & by[j]) / len(by[r.table_id] | by[j])) for j in range(20, 40)), key=lambda x: (x[1], -x[0]))
    kinds = {name: kind for frame in seen for name, kind in frame.dtypes}
    assert kinds["left_set"] == kinds["match_id"] == "bigint" and "right_set" not in kinds


def test_shingles_of_a_table_meet_as_text(spark):
    rows = [("b", 1, "A b a B"), ("b", 1, "a  b."), ("b", 1, "Ab"), ("b", 1, "Ab"), ("b", 1, None), ("b", 1, ""), ("c", 1, "a b"), ("b", None, "x y"), ("b", None, "X y"), (None, 2, " ."), ("b", 3, "z" * 40)]
    df = spark.createDataFrame(rows, "block string, table_id bigint, cell string")
    want = [("b", 1, x) for x in ("a\x01b", "b\x01a", "b\x01.", "ab", "", None)] + [("c", 1, "a\x01b"), ("b", None, "x\x01y"), (None, 2, " ."), ("b", 3, "z" * 40)]
    for large in (S.LARGE_TABLE, 8, 0):  # all, some and no tables in one row
        out = S.table_shingles(df, ("block", "table_id"), large=large)
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    dealt = [line for line in plan(S.table_shingles(df, ("block", "table_id"))).splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("shingle" in line for line in dealt)


def test_multiset_pairs_without_a_shuffle_of_shingles(spark, joins_by_shuffle):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "c", None, ""])) for k in range(6) for _ in range(rng.randint(0, 7))] + [(None, "a")]
    pairs = [(a, b) for a in range(7) for b in range(7)] + [(1, 2), (None, 1)]
    df = spark.createDataFrame(rows, "table_id bigint, shingle string")
    out = S.multiset_jaccard(df, df, spark.createDataFrame(pairs, "left_id bigint, right_id bigint"))
    bags = {k: Counter(s for j, s in rows if j == k) for k in [*range(7)]}

    def by_hand(a, b):
        x, y = bags.get(a, Counter()), bags.get(b, Counter())
        return sum((x & y).values()) / max(1, sum((x | y).values()))

    assert sorted((str(r.left_id), str(r.right_id), r.similarity) for r in out.collect()) == sorted((str(a), str(b), by_hand(a, b)) for a, b in pairs)
    dealt = [line for line in plan(out).splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("shingle" in line for line in dealt)


def test_values_are_worked_out_once(spark):
    df = spark.createDataFrame([('<table><a href="/x&amp;y" title=t>A &lt;b&gt;</a><table></table>',)], "h string")
    assert plan(df.select(M.anchors(F.col("h")).alias("x")), "analyzed").count("split(h") == 1
    assert plan(df.select(M.leaf_elements(F.col("h"), "table").alias("x")), "analyzed").count("split(h") == 1
    assert plan(df.select(T.replace_bounded(F.col("h"), F.lit("a"), F.lit("b")).alias("x")), "analyzed").count("(?iu)") == 1
    a = df.select(M.anchors(F.col("h")).alias("a")).first()["a"]
    assert [tuple(x) for x in a] == [("/x&y", "t", "A <b>")]


def test_tagging_searches_a_cell_once(spark, monkeypatch):
    seen = counted(monkeypatch, TG)
    cells = make_cells(spark, [(1, 1, 0, "Tower and Bridge", "Tower and Bridge"), (1, 2, 0, "none", "none")])
    anchors = spark.createDataFrame([(1, "tower", "/wiki/T", 0), (1, "bridge", "/wiki/B", 1)], "table_id bigint, text string, link string, pos bigint")
    images = spark.createDataFrame([("https://en.wikipedia.org/wiki/T", "t"), ("https://en.wikipedia.org/wiki/B", "b")], "link string, image_path string")
    links = spark.createDataFrame([(1, 1, 0, 0, "/wiki/T"), (1, 1, 0, 1, "/wiki/X"), (1, 2, 0, 0, "/wiki/none")], "table_id bigint, row_idx bigint, col_idx bigint, ord bigint, link string")
    by_text = {r.row_idx: r.tagged for r in TG.tag_cells_by_text(cells, anchors, images, "D").collect()}
    assert by_text == {1: "{IMG-{D-1-1-0-1}} and {IMG-{D-1-1-0-0}}", 2: "none"}
    assert len(seen) == 2
    counts = TG.link_counts(TG.tag_cells_by_link(cells, links, anchors.drop("pos"), images, "D"), links, images).first()
    assert (counts.links, counts.without_image, counts.replaced) == (1, 2, 1) and len(seen) == 5
    marked = {r.row_idx: (r.annotated, r.is_fallback) for r in TG.annotate_links(cells, anchors, links).collect()}
    assert marked == {1: ("tower and {LINK{bridge}{/wiki/B}}", False), 2: ("{LINK{none}{/wiki/none}}", True)} and len(seen) == 6


def test_interleaved_groups_across_batches(spark):
    rng = random.Random(5)
    rows = sorted({(g, f"l{rng.randrange(3)}", rng.randrange(4)) for g in range(9) for _ in range(8)})
    df = spark.createDataFrame([(g, l, e, e) for g, l, e in rows], "g bigint, l string, pos bigint, e bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        out = IL.interleave(df, "g", "l", "pos", "e")
        got = sorted((r.g, r.round, r.l, r.e) for r in out.collect())
        text = plan(out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for g in range(9):
        lists = {l: [e for h, m, e in rows if (h, m) == (g, l)] for _, l in sorted({(h, l) for h, l, _ in rows if h == g})}
        taken, turn = set(), 0
        while any(set(x) - taken for x in lists.values()):
            turn += 1
            for l, x in lists.items():
                free = [e for e in x if e not in taken]
                if free:
                    taken.add(free[0])
                    want.append((g, turn, l, free[0]))
    assert got == sorted(want) and "FlatMapGroups" not in text


def test_links_are_known_without_a_look_at_the_tags(spark, joins_by_shuffle):
    host = "https://en.wikipedia.org"
    tags = [(1, k, 0, 0, f"t{k}", "Note" if k == 5 else "H") for k in range(1, 8)] + [(1, 9, 0, 0, None, "H")]
    links = {"t1": "/wiki/A", "t2": "/wiki/B", "t3": "/wiki/C", "t4": None, "t5": "/wiki/A", "t6": "/wiki/none", "t7": "/wiki/D", None: "/wiki/A"}
    attributes = spark.createDataFrame([(t, f"p{t}", "o", w) for t, w in links.items()], "tag string, image_path string, original_string string, wiki_link string")
    entities = spark.createDataFrame([(f"{host}/wiki/A", "qa"), (f"{host}/wiki/A", "qz"), (f"{host}/wiki/B", "qb"), (None, "qn")], "link string, qid string")
    classes = spark.createDataFrame([("included", f"{host}/wiki/A"), ("location", f"{host}/wiki/B"), ("seal", f"{host}/wiki/C")], "entity_class string, link string")
    collages = spark.createDataFrame([(f"{host}/wiki/B", "location", "lb"), (f"{host}/wiki/C", "location", "lc"), (f"{host}/wiki/D", "seal", "sd")], "link string, kind string, collage_path string")
    categories = spark.createDataFrame([("qz", D.SPORTS), ("qb", "x")], "qid string, category string")
    cells = spark.createDataFrame(tags, "table_id bigint, row_idx bigint, col_idx bigint, tag_pos bigint, tag string, header string")
    out = D.dispose_tags(cells, attributes, entities, categories, classes, collages)
    assert sorted((r.tag, str(r.qid), r.bucket, str(r.image_path)) for r in out.collect()) == [
        ("t1", "qa", "included", "pt1"), ("t1", "qz", "included", "pt1"), ("t2", "qb", "location_included", "lb"), ("t3", "None", "seal_excluded", "None"),
        ("t4", "None", "unclassified", "None"), ("t5", "qa", "notes", "None"), ("t5", "qz", "notes", "None"), ("t6", "None", "unclassified", "None"),
        ("t7", "None", "unclassified", "None"),
    ]
    assert sum("ExistingRDD" in line and "wiki_link" in line for line in plan(out).splitlines()) == 1
    assert "ShuffledHashJoin [link" in plan(out)
    kept = D.narrow_image_tags(attributes, out, entities).collect()
    assert sorted((r.tag, r.image_path, r.qid) for r in kept) == [(t, p, q) for t, p, qs in (("t1", "pt1", ("qa", "qa", "qz", "qz")), ("t2", "lb", ("qb",))) for q in qs]
