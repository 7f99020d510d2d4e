"""Operators on small hand-made tables and against brute force."""

import random
import re

import pytest
from pyspark.sql import Row, functions as F

from gridmosaic.functions import links as L, tags as T
from gridmosaic.operators import cells as C, entities as E, interleave as N, pages as PG, prompts as P, questions as Q, ranking as K, responses as R, sampling as SA, scoring as S, similarity as M, tagging as TG
from gridmosaic.operators.containment import BOUNDED, Automaton, bounded_candidates, contained_texts, occurring_texts

CELLS = "table_id bigint, row_idx bigint, col_idx bigint, header string, original string, cell string"


def grid(spark, *tables, original=None):
    rows = [(i, t) for i, t in enumerate(tables)]
    return C.explode_cells(spark.createDataFrame(rows, "table_id bigint, table_array array<array<string>>"))


def img(n):
    return f"{{IMG-{{D-{n}}}}}"


def interleave_by_hand(lists):
    left, out = {e for part in lists for e in part}, []
    while left:
        for part in lists:
            for e in part:
                if e in left:
                    out.append(e)
                    left.remove(e)
                    break
    return out[::-1]


@pytest.mark.parametrize("hot_rows", [10**6, 0])
def test_interleave(spark, hot_rows):
    rng = random.Random(3)
    groups = {0: [[11, 12], [12, 13, 11], [14]]}
    for g in range(1, 5):
        groups[g] = [rng.sample(range(12), rng.randint(1, 6)) for _ in range(rng.randint(1, 6))]
    rows = [(g, i, p, e) for g, lists in groups.items() for i, part in enumerate(lists) for p, e in enumerate(part)]
    out = N.interleave(spark.createDataFrame(rows, "g int, l int, p bigint, e int"), "g", "l", "p", "e", hot_rows)
    got = {}
    for r in out.orderBy("g", F.desc("round"), F.desc("l")).collect():
        got.setdefault(r.g, []).append(r.e)
    assert got == {g: interleave_by_hand(lists) for g, lists in groups.items()}
    assert got[0] == [13, 14, 12, 11]  # 11 and 12 and 14 in the first round, then 13
    tied = spark.createDataFrame([(1, 0, 5, 20), (1, 0, 5, 21), (1, 1, 5, 20)], "g int, l int, p bigint, e int")
    assert sorted(map(tuple, N.interleave(tied, "g", "l", "p", "e", hot_rows).select("e", "round", "l").collect())) == [(20, 1, 0), (21, 2, 0)]


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_positions_do_not_depend_on_the_cut(spark, hot_rows):
    rows = [(0, v) for v in range(97)] + [(1, 5), (1, 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    out = K.position_in_group(df, ["g"], [F.col("v")], F.floor(F.col("v") / 10), hot_rows=hot_rows).collect()
    assert {(r.g, r.v): r.position for r in out} == {(0, v): v + 1 for v in range(97)} | {(1, 3): 1, (1, 5): 2}
    known = K.position_in_group(df, ["g"], [F.col("v")], F.col("v"), hot_groups=df.select("g").where("g > 5")).collect()
    assert {(r.g, r.v): r.position for r in known} == {(r.g, r.v): r.position for r in out}
    placed = K.global_position(df, ["g", "v"]).collect()
    assert sorted((r.g, r.v) for r in placed) == [(r.g, r.v) for r in sorted(placed, key=lambda r: r.position)]
    assert sorted(r.position for r in placed) == list(range(1, 100))
    hashed = K.hashed_position(df, K.seeded_key(1, "g", "v"))
    assert sorted(r.position for r in hashed.collect()) == list(range(1, 100))


def test_round_trip_keeps_ragged_rows(spark):
    tables = [["a", "b"], ["c"], ["d", "e", "f"]], [["only header"]]
    cells = grid(spark, *tables)
    assert cells.where("row_idx = 2 and col_idx = 2").first().header is None
    back = {r.table_id: r.table_array for r in C.assemble_tables(cells).collect()}
    assert back == dict(enumerate(list(t) for t in tables))
    parts = C.assemble_tables(cells, rows_per_chunk=2).orderBy("table_id", "chunk").collect()
    assert [p.chunk for p in parts] == [0, 1, 0] and parts[0].table_array + parts[1].table_array == tables[0]


def test_valid_table_bounds(spark):
    def table(rows, images):
        return [["h"]] + [[img(i) if i < images else "t"] for i in range(rows - 1)]

    shares = [(55, 54), (56, 55), (10, 3), (10, 2), (4, 3)]
    out = {r.table_id for r in C.valid_tables(grid(spark, *[table(*s) for s in shares])).collect()}
    assert out == {0, 2, 4}
    assert {r.table_id for r in C.valid_tables(grid(spark, *[table(*s) for s in shares]), max_frac=0.75).collect()} == {2, 4}


def test_table_text_and_cell_escapes(spark):
    cells = grid(spark, [["a|b", "c\td"], ["e\\nf", "g"]])
    want = "a b | c d | \ne f | g | \n"
    assert C.table_string(cells).first().text == want
    assert cells.sparkSession.createDataFrame([([["a|b", "c\td"], ["e\\nf", "g"]],)], "g array<array<string>>").select(C.table_string_column(F.col("g"))).first()[0] == want


def test_context_rows(spark):
    cells = grid(spark, [["h"], ["x"], [img(1)], ["y"], ["z"], ["w"]])
    got = {}
    for r in C.context_rows(cells).orderBy("row_idx", "ord").collect():
        got.setdefault(r.row_idx, []).append(r.context_row)
    assert got == {1: [3, 4], 2: [1, 3], 3: [1, 4], 4: [1, 3], 5: [1, 3]}


def test_restore_some_tags(spark):
    cells = grid(spark, [["h"], [f"a {img(1)}{img(2)} b"], ["plain"]])
    names = spark.createDataFrame([(img(1), "one"), (img(2), "two")], "tag string, original_string string")
    whole = {r.row_idx: r.restored for r in C.restore_text(cells, names).collect()}
    assert whole == {0: "h", 1: "a onetwo b", 2: "plain"}
    part = C.restore_text(cells, names, spark.createDataFrame([(img(2),)], "tag string"))
    assert {r.row_idx: r.restored for r in part.collect()}[1] == f"a {img(1)}two b"


@pytest.mark.parametrize("at_boundaries", [False, True])
def test_contained_texts(spark, at_boundaries):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab -é") for _ in range(rng.choice([5, 90, 700]))) for _ in range(12)]
    needles = sorted({t[i:i + n].strip() for t in texts for n in (1, 3, 40, 64, 65, 120) for i in (0, 17, 250, 255, 300) if t[i:i + n].strip()} | {"zz", "AB"})
    hay = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "b int, k int, t string")
    nee = spark.createDataFrame([(0, n) for n in needles] + [(1, "a")], "b int, n string")
    got = {(r.k, r.needle) for r in contained_texts(hay, nee, "b", ("k",), "t", "n", at_boundaries).collect()}

    def inside(n, t):
        n, t = n.lower(), t.lower()
        spots = [i for i in range(len(t)) if t.startswith(n, i)]
        return any(i == 0 or not (t[i - 1].isascii() and t[i - 1].isalnum()) for i in spots) if at_boundaries else bool(spots)

    assert got == {(i, n) for i, t in enumerate(texts) for n in needles if inside(n, t)}


def test_bounded_candidates_hold_all_bounded_texts(spark):
    rng = random.Random(7)
    letters = "ab1 .(é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    needles = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)})
    hay = spark.createDataFrame([(1, i, t.upper()) for i, t in enumerate(texts)], "b int, k int, t string")
    nee = spark.createDataFrame([(1, n) for n in needles], "b int, n string")
    got = {(r.k, r.needle) for r in bounded_candidates(hay, nee, "b", ("k",), "t", "n").collect()}

    def free(text, i):
        return not (0 <= i < len(text)) or text[i] not in "ab1"

    want = {(i, n) for i, t in enumerate(texts) for n in needles for s in range(len(t)) if t.startswith(n, s) and free(t, s - 1) and free(t, s + len(n))}
    assert want <= got and all(n[:1] in texts[i] for i, n in got)


def test_tag_by_text(spark):
    body = [["Club", "Notes"], ["Red Star Oslo (Red Star)", "Red Star"], ["star oslo, Bergen", "x"], ["Turku  Turku", "y"]]
    cells = grid(spark, body)
    texts = ["Red Star Oslo", "Red Star", "Bergen", "Turku", "abc", "Nowhere"]
    anchors = spark.createDataFrame([(0, t, "/wiki/" + t.replace(" ", "_")) for t in texts], "table_id bigint, text string, link string")
    images = spark.createDataFrame([("https://en.wikipedia.org/wiki/" + t.replace(" ", "_"), t + ".jpg") for t in texts if t != "Bergen"], "link string, image_path string")
    out = TG.tag_cells_by_text(cells, anchors, images, "D")
    got = {(r.row_idx, r.col_idx): (r.tagged, len(r.hits)) for r in out.collect()}
    assert got[(1, 0)] == ("{IMG-{D-0-1-0-0}} ({IMG-{D-0-1-0-1}})", 2)  # longest text first
    assert got[(2, 0)] == ("star oslo, Bergen", 0)  # no image, no whole text
    assert got[(3, 0)] == ("{IMG-{D-0-3-0-0}} Turku", 1)  # the blank between serves the first only
    assert all(got[(r, 1)] == (body[r][1], 0) for r in range(1, 4))  # a notes column
    restored = C.restore_text(out.withColumn("cell", F.col("tagged")), TG.hit_attributes(out).withColumnRenamed("original_string", "original_string"))
    assert {(r.row_idx, r.col_idx): r.restored for r in restored.collect()}[(3, 0)] == "Turku Turku"


def test_tag_by_link_tries_texts_then_the_link(spark):
    cells = grid(spark, [["A", "Comment"], ["Big Apple and boston city", "Big Apple"]])
    links = spark.createDataFrame([(0, 1, 0, 0, "/wiki/NYC"), (0, 1, 0, 1, "/wiki/Boston_City"), (0, 1, 0, 2, "/wiki/None"), (0, 1, 1, 0, "/wiki/NYC")],
                                  "table_id bigint, row_idx bigint, col_idx bigint, ord bigint, link string")
    anchors = spark.createDataFrame([(0, "Apple", "/wiki/NYC"), (0, "Big Apple", "/wiki/NYC"), (0, "and", "/wiki/NYC")], "table_id bigint, text string, link string")
    images = spark.createDataFrame([("https://en.wikipedia.org/wiki/NYC", "n"), ("https://en.wikipedia.org/wiki/Boston_City", "b")], "link string, image_path string")
    out = {(r.row_idx, r.col_idx): r for r in TG.tag_cells_by_link(cells, links, anchors, images, "D").collect()}
    assert out[(1, 0)].tagged == "{IMG-{D-0-1-0-0}} and {IMG-{D-0-1-0-1}}"
    assert [(h.text, h.image_path) for h in out[(1, 0)].hits] == [("Big Apple", "n"), ("boston city", "b")]
    assert out[(1, 1)].tagged == "Big Apple" and out[(1, 1)].hits == []


def test_entity_cascade(spark):
    cats = [("q1", "a"), ("q1", "b"), ("q2", "b"), ("q3", "c"), ("q4", "d"), ("q5", "none"), ("q7", "e")]
    rules = [(1, "a", False, 0.0, ""), (2, "b", True, 10.0, "Flag"), (3, "c", True, 10.0, "xxx"), (4, "d", True, 10.0, "location"), (5, "e", True, 10.0, None)]
    views = [("q2", 10), ("q3", 10), ("q4", 11), ("q7", 11)]
    out = E.classify_entities(
        spark.createDataFrame([(f"q{i}",) for i in range(1, 8)], "qid string"), spark.createDataFrame(cats, "qid string, category string"),
        spark.createDataFrame(rules, "priority int, category string, include boolean, `limit` double, remarks string"), spark.createDataFrame(views, "qid string, views bigint"),
    )
    assert {r.qid: r.entity_class for r in out.collect()} == {
        "q1": "excluded", "q2": "excluded", "q3": "seal", "q4": "location", "q5": "remaining", "q6": "remaining", "q7": "included"}


def test_nearest_revision_floors_days(spark):
    rows = [("p", 1, "2024-01-16 00:00:00", 0), ("p", 2, "2024-01-15 11:00:00", 1), ("p", 3, "2024-01-15 11:59:00", 2), ("r", 4, "2024-01-16 00:00:00", 0), ("n", None, None, None)]
    df = spark.createDataFrame(rows, "page string, revid bigint, ts string, ord bigint").withColumn("ts", F.to_timestamp("ts"))
    out = {r.page: (r.revid, r.days) for r in PG.nearest_revision(df, F.lit("2024-01-15 12:00:00").cast("timestamp")).collect()}
    assert out == {"p": (2, 0), "r": (4, 1), "n": (None, None)}


def test_rebalance_leaves_no_column_above_the_bound(spark):
    rng = random.Random(5)
    table = [[img("h"), "b"]] + [[img(f"{i}-0") if rng.random() < 0.95 else "t", img(f"{i}-1") if rng.random() < 0.5 else "t"] for i in range(40)]
    cells = grid(spark, table)
    names = spark.createDataFrame([(img(f"{i}-{c}"), "o") for i in range(40) for c in (0, 1)] + [(img("h"), "Head")], "tag string, original_string string")
    evidence = spark.createDataFrame([(0, r, 0, f"{r:02d}") for r in range(1, 20)], "table_id bigint, row_idx bigint, col_idx bigint, sort_key string")
    definite = spark.createDataFrame([(0, 30, 0)], "table_id bigint, row_idx bigint, col_idx bigint")
    chosen = Q.rebalance_choice(cells, evidence, evidence.limit(0), definite, 1)
    assert chosen.where("row_idx between 1 and 19 or row_idx = 30").count() == 0
    out = Q.rebalance(cells, names, chosen)
    shares = out.where("row_idx > 0").groupBy("col_idx").agg(F.avg(T.is_image_cell(F.col("restored")).cast("int")).alias("s")).collect()
    assert max(r.s for r in shares) <= 0.75 and out.where("row_idx = 0 and col_idx = 0").first().restored == "Head"


def test_best_match_and_ties(spark):
    rows = {1: "abcd", 2: "xyz", 3: "ab"}
    right = {10: "abcx", 11: "abcd", 12: "abcd", 13: "x", 14: "q"}

    def sets(d):
        return spark.createDataFrame([("s", k, c) for k, v in d.items() for c in v], "block string, table_id bigint, shingle string")

    got = {r.table_id: (r.match_id, round(r.similarity, 3)) for r in M.best_table_match(sets(rows), sets(right)).collect()}
    assert got == {1: (11, 1.0), 2: (13, 0.333), 3: (10, 0.5)}
    far = {r.table_id: r.match_id for r in M.near_duplicates(sets(rows).drop("block"), sets(right).drop("block"), 0.6).collect()}
    assert far == {1: 11, 2: None, 3: None}


def best_by_hand(left, right, least):
    out = {}
    for k, s in left.items():
        found = [(-len(s & t) / len(s | t), j) for j, t in right.items() if s & t and len(s & t) / len(s | t) >= least]
        out[k] = (min(found)[1], -min(found)[0]) if found else (None, 0.0)
    return out


@pytest.mark.parametrize("alphabet", [30, 300])
def test_best_match_with_a_shingle_in_every_table(spark, monkeypatch, alphabet):
    """All tables share one shingle, sizes and similarities tie often; the pieces of its list that cannot win are not opened."""
    rng = random.Random(alphabet)
    left, right = ({k: frozenset({"all"} | {f"x{rng.randrange(alphabet)}" for _ in range(rng.randint(0, 6))}) for k in ids} for ids in (range(60), range(100, 260)))

    def sets(d):
        return spark.createDataFrame([(0, k, c) for k, v in d.items() for c in v], "block int, table_id bigint, shingle string")

    seen, keep = [], M.reliable_checkpoint
    monkeypatch.setattr(M, "reliable_checkpoint", lambda df: seen.append(keep(df)) or seen[-1])
    for rare, least in ((1, 0.0), (8, 0.0), (8, 0.4)):
        got = {r.table_id: (r.match_id, r.similarity) for r in M.best_table_match(sets(left), sets(right), least=least, rare=rare).collect()}
        assert got == best_by_hand(left, right, least)
        assert seen[-1].count() < len(set(left.values())) * len(set(right.values())) / 4


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_text_metrics(spark):
    rng = random.Random(2)
    pairs = [(str(i), " ".join(rng.choices("abcde", k=rng.randint(0, 15))), " ".join(rng.choices("abcde", k=rng.randint(0, 15)))) for i in range(25)]
    df = spark.createDataFrame(pairs, "key string, prediction string, gold string")
    for r in S.rouge_l_rows(df).join(df, "key").collect():
        p, g = r.prediction.split(), r.gold.split()
        assert r.rougeL == pytest.approx(2 * lcs(p, g) / (len(p) + len(g)) if p or g else 0.0)
    same = spark.createDataFrame([("1", "the cat sat on a mat", "the cat sat on a mat")], "key string, prediction string, gold string")
    assert S.corpus_bleu(same).first().bleu == pytest.approx(100.0)
    assert S.rouge(same).first().asDict() == {"rouge1": 1.0, "rouge2": 1.0, "rougeL": 1.0, "rougeLsum": 1.0}
    off = spark.createDataFrame([("1", "a b", "c d e")], "key string, prediction string, gold string")
    assert S.corpus_bleu(off).first().bleu == 0.0 and S.corpus_bleu(off).first().match_1 == 0


def test_arrow_lines(spark):
    text = "Step 3: a\n{ENTITY_IMAGE-1} -> x\nENTITY_IMAGE-2 -> y\n{ENTITY_IMAGE-1} -> z\n{ENTITY_IMAGE-3} -> {ENTITY_IMAGE-4} -> w\nfoo -> bar\na -> b -> c -> d"
    df = spark.createDataFrame([("k", text)], "key string, response string")
    assert {r.entity: r.prediction for r in R.parse_arrows(df).collect()} == {
        "{ENTITY_IMAGE-1}": "z", "{ENTITY_IMAGE-2}": "y", "{ENTITY_IMAGE-3}": "w", "{ENTITY_IMAGE-4}": "w"}
    assert R.unparsed_arrows(df).count() == 1


def test_quota_sizes(spark):
    rows = [(i, "big" if i < 60 else "mid" if i < 90 else f"rare{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, category string")
    quota = SA.quotas(df.groupBy("category").agg(F.count(F.lit(1)).alias("n")), df.agg(F.count(F.lit(1)).alias("N")), 21)
    assert {r.category: r.quota for r in quota.collect()} == {"big": 12, "mid": 6, "Others": 3}
    sample = SA.stratified_sample(df, quota, "id", 42)
    assert {r.stratum: r["count"] for r in sample.groupBy("stratum").count().collect()} == {"big": 12, "mid": 6, "Others": 3}
    assert SA.shortfalls(sample, quota).where("missing <> 0").count() == 0


def test_entity_prompt_of_one_table(spark):
    cells = grid(spark, [["Name", "Note"], [img(1), "n"], ["x", "m"], [img(2), "k"], ["y", "j"]])
    names = spark.createDataFrame([(img(1), "p.jpg", "o"), (img(2), "p.jpg", "o")], "tag string, image_path string, original_string string")
    titles = spark.createDataFrame([(0, "T", "S")], "table_id bigint, title string, headers string")
    out = P.entity_prompts(cells, C.unify_by_path(C.explode_tags(cells), names), names, titles, template="{context};{infobox_1};{infobox_2};{tags};{column};{tables};{number};{focus};{rows}", base_path="b/").collect()
    assert len(out) == 1 and out[0].image_paths == ["b/p.jpg"]
    assert out[0].prompt == (
        "S of T;Table 1:\nName: x\nNote: m;\n\nTable 2:\nName: y\nNote: j;{ENTITY_IMAGE-1};Name;two tables;four;Table 3 through Table four;"
        "Table 3:\nName: {ENTITY_IMAGE-1}\nNote: n\n\nTable 4:\nName: {ENTITY_IMAGE-1}\nNote: k\n\n")


def test_multiset_and_empty(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "c")], "table_id bigint, shingle string")
    pairs = spark.createDataFrame([Row(left_id=1, right_id=2), Row(left_id=8, right_id=9)])
    out = {r.left_id: r.similarity for r in M.multiset_jaccard(rows, rows, pairs).collect()}
    assert out == {1: 0.25, 8: 0.0}


@pytest.mark.parametrize("html,want", [
    ("<table><tr><th>A<th>B<tr><td>1<td>2</table>", [["A", "B"], ["1", "2"]]),
    ("<table><tr><td rowspan=2>a</td><td colspan='2'>b</td></tr><tr><td>c</td><td>d &lt; e</td></tr></table>", [["a", "b", "b"], ["a", "c", "d < e"]]),
    ("<table><tr><td>x<br>y<!-- <td>no --></td></tr>", [["x y"]]), ("<table></table>", []), ("", []), (None, []),
    ("<table><tr><td rowspan=9>a<td>b</table>", [["a", "b"]]),
])
def test_table_grid(html, want):
    got = {}
    for r, c, _, text in PG.table_grid(html):
        got.setdefault(r, {})[c] = text
    assert [[got[r][c] for c in sorted(got[r])] for r in sorted(got)] == want


def test_pages_to_tagged_tables(spark):
    from gridmosaic.plans import construct

    html = """<html><body><table><tr><th>City<th>Rank</tr>
      <tr><td><a href='/wiki/Oslo_(city)'>Oslo &amp; surroundings</a><td>1<tr><td><a href="/wiki/Turku">Turku</a><td>2</table>
      <table><tr><td>other<td>thing</table></body></html>"""
    pages = spark.createDataFrame([(1, "u1", html)], "page_id bigint, url string, html string")
    page_tables = PG.assign_table_ids(PG.extract_tables(pages))
    page_cells = PG.table_cells(page_tables).select("table_id", "cell")
    cells = grid(spark, [["City", "Rank"], ["the Oslo & surroundings", "1"], ["Turku", "2"]])
    links = spark.createDataFrame([(0, 1, 0, 0, "/wiki/Oslo_(city)"), (0, 2, 0, 0, "/wiki/Turku")], "table_id bigint, row_idx bigint, col_idx bigint, ord bigint, link string")
    images = spark.createDataFrame([("https://en.wikipedia.org/wiki/Oslo_(city)", "o.jpg"), ("https://en.wikipedia.org/wiki/Turku", "t.jpg")], "link string, image_path string")
    tagged, attributes = construct.tag_tables(cells, links, page_tables, spark.createDataFrame([(0, "u1")], "table_id bigint, url string"), page_cells, images, "D")
    assert {(r.row_idx, r.col_idx): r.cell for r in tagged.collect() if r.col_idx == 0} == {(0, 0): "City", (1, 0): "the {IMG-{D-0-1-0-0}}", (2, 0): "{IMG-{D-0-2-0-0}}"}
    assert {r.image_path for r in attributes.collect()} == {"o.jpg", "t.jpg"}


def test_cumulative_top_over_gaps(spark):
    values = [0.0, 1.0, 2.5, 2.6, 7.0, 20_000.0, 20_000.0, 20_001.0, 50_000.0, 50_000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.edge: r.below for r in E.cumulative_top(df, "x", 2.5).collect()}
    want, i = {}, 0
    while not want or want[(i - 1) * 2.5] < 0.8 * len(values):
        want[i * 2.5] = sum(v < i * 2.5 for v in values)
        i += 1
    assert got == want
    assert [r.edge for r in E.cumulative_top(spark.createDataFrame([(5.0,)], "x double"), "x", 2.5).orderBy("edge").collect()] == [0.0, 2.5, 5.0]
    assert E.cumulative_top(df.limit(0), "x", 2.5).isEmpty()


def test_row_span_of_many_rows():
    """A cell may span more than 1,000 rows; columns stay where they are, and a span beyond the table ends with it."""
    for span in ("1500", "65534", "9" * 40):
        table = f"<table><tr><th rowspan={span}>a<td>0</tr>" + "".join(f"<tr><td>{k}</tr>" for k in range(1, 1500)) + "</table>"
        assert sorted(PG.table_grid(table)) == sorted((k, c, c == 0, "a" if c == 0 else str(k)) for k in range(1500) for c in (0, 1))


def test_texts_that_reach_into_tags(spark):
    cells = spark.createDataFrame([(1234, 1, 0, "h", "Oslo and Turku, Rome", "Oslo and Turku, Rome"), (1234, 2, 0, "h", "none", "none")],
                                  "table_id bigint, row_idx bigint, col_idx bigint, header string, original string, cell string")
    texts = ["Oslo", "Turku", "Rome", "1234", "img-", "-1-0", "1-0-2", "5678", "}} and"]
    anchors = spark.createDataFrame([(1234, t, f"/wiki/{k}") for k, t in enumerate(texts)], "table_id bigint, text string, link string")
    linked = anchors.select("link").distinct()
    images = linked.select(L.absolute_link(F.col("link")).alias("link"), F.lit("p").alias("image_path"))
    found = {(r.row_idx, r.text) for r in TG._candidates(cells, anchors, "DRV").collect()}
    assert found == {(1, t) for t in texts if t != "5678"}
    hits = {r.row_idx: [h.text for h in r.hits] for r in TG.tag_cells_by_text(cells, anchors, images, "DRV").collect()}
    assert hits[2] == [] and {"Turku", "Oslo", "Rome"} <= set(hits[1])


def test_occurring_texts_in_ranges(spark):
    """A block cut into ranges of needles and texts gives the same rows, repeats included."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abç ") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    needles = sorted({"".join(rng.choice("abç ") for _ in range(rng.randint(1, 4))) for _ in range(80)})
    hay = spark.createDataFrame([(i % 3 or None, i, t) for i, t in enumerate(texts)], "b int, k int, t string")
    nee = spark.createDataFrame([(i % 3 or None, n) for i, n in enumerate(needles)], "b int, n string")
    for sizes in ({}, {"range_chars": 7, "text_chars": 50}):
        got = sorted((r.k, r.needle) for r in occurring_texts(hay, nee, "b", ("k",), "t", "n", **sizes).collect() if r.b)
        assert got == sorted((i, n) for i, t in enumerate(texts) for j, n in enumerate(needles) if i % 3 == j % 3 and i % 3 and n in t)


def test_automaton_finds_all_needles():
    rng = random.Random(1)
    for _ in range(200):
        needles = sorted({"".join(rng.choice("ab1") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        text = "".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 40)))
        found = Automaton(needles)
        assert {needles[i] for i in found.find(text)} == {n for n in needles if n in text}
        bounded = {n for n in needles if re.search(rf"(?<![a-z0-9]){n}(?![a-z0-9])", text)}
        assert {needles[i] for i in found.find(text, BOUNDED)} == bounded
