"""Questions, evidence, rebalancing, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmosaic.catalog import inputs as I
from gridmosaic.catalog.cells import TAG
from gridmosaic.catalog.registry import big, query
from gridmosaic.functions import tags as T
from gridmosaic.operators import cells as C, questions as Q, sampling as S
from gridmosaic.operators.interleave import interleave
from gridmosaic.operators.together import dealt, met
from gridmosaic.plans import construct as PC

SEED = 42
KEY = ["table_id", "row_idx", "col_idx"]

# --- questions of conversations, for text detection, on tables of suppliers and nations

QC = "WITH" + I.CELLS_SQL + "," + I.QUESTIONS_SQL + f"""
, firsts AS (SELECT table_id, row_idx, lower(original) AS w, min(col_idx) AS col_idx, arg_min(cell, col_idx) AS cell FROM cells WHERE row_idx > 0 AND length(original) > 0 GROUP BY ALL)
, hits AS (SELECT question_id, table_context, w AS found_word, row_idx, col_idx, cell AS img_id FROM questions JOIN firsts ON table_context = table_id
   WHERE regexp_matches(cell, {TAG}) AND (contains(lower(question), w) OR contains(lower(answer), w)))
, explicit AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY row_idx, col_idx) = 1)"""


@query("q01_explicit_questions", QC + " SELECT question_id, table_context, found_word, row_idx, col_idx, img_id FROM explicit")
def q01(spark, d):
    return Q.explicit_questions(I.questions(spark, d), I.cells(spark, d))


@query("q02_implicit_questions", QC + " SELECT question_id FROM questions ANTI JOIN explicit USING (question_id)")
def q02(spark, d):
    questions = I.questions(spark, d)
    return Q.implicit_questions(questions, Q.explicit_questions(questions, I.cells(spark, d))).select("question_id")


# --- questions of line items: one per order and part, about the part's table

LQ = I.TABLE_SQL + """
, lq AS (SELECT concat(l_orderkey, '-', l_partkey) AS question_id, l_partkey AS table_context, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ex,
    CASE WHEN l_partkey % 2 = 0 THEN 'passages' ELSE 'highlights' END AS source FROM lineitem GROUP BY l_orderkey, l_partkey)
, evidence AS MATERIALIZED (SELECT DISTINCT concat(l_orderkey, '-', l_partkey) AS question_id, l_partkey AS table_context, row_idx, col_idx FROM (
    SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS row_idx, l_suppkey % 3 AS col_idx FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber + 7, 0 FROM lineitem))
, mentions AS MATERIALIZED (SELECT DISTINCT concat(l_orderkey, '-', l_partkey) AS question_id, l_partkey AS table_context, row_idx, col_idx FROM (
    SELECT l_orderkey, l_partkey, CAST(l_linenumber + 7 AS BIGINT) AS row_idx, CAST(0 AS BIGINT) AS col_idx FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey, l_linenumber + 1, 1 FROM lineitem WHERE l_returnflag = 'R'))
, canon AS (SELECT DISTINCT l_partkey AS table_id, l_partkey - l_partkey % 2 AS canonical_id FROM lineitem)""" + f"""
, pictured AS (SELECT table_id AS table_context, row_idx, col_idx FROM cells WHERE regexp_matches(cell, {TAG}))"""


def _lines(spark, d, whole=False, where="true"):
    """Line items with their question; those of ``whole`` tables are dealt as they are read, before there is a row per place."""
    return dealt(I.table(spark, d, "lineitem").where(where), "l_partkey", whole).withColumn("question_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")))


def line_questions(spark, d, whole=False):
    source = F.when(F.col("table_context") % 2 == 0, "passages").otherwise("highlights")
    return _lines(spark, d, whole).groupBy("question_id", F.col("l_partkey").alias("table_context")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("ex")
    ).withColumn("source", source)


def _places(rows, *pairs):
    spots = F.array(*[F.struct(r.cast("bigint").alias("row_idx"), c.cast("bigint").alias("col_idx")) for r, c in pairs])
    return rows.select("question_id", F.col("l_partkey").alias("table_context"), F.explode(spots).alias("s")).select(
        "question_id", "table_context", "s.row_idx", "s.col_idx"
    ).distinct()


def line_evidence(spark, d, whole=False):
    n = F.col("l_linenumber")
    return _places(_lines(spark, d, whole), (n, F.col("l_suppkey") % 3), (n + 7, F.lit(0)))


def line_mentions(spark, d, whole=False):
    n = F.col("l_linenumber")
    return _places(_lines(spark, d, whole, "l_returnflag = 'R'"), (n + 7, F.lit(0)), (n + 1, F.lit(1)))


def canonical(spark, d):
    return I.table(spark, d, "lineitem").select(F.col("l_partkey").alias("table_id")).distinct().withColumn(
        "canonical_id", F.col("table_id") - F.col("table_id") % 2
    )


@query("q03_restrict_questions", LQ + """
SELECT lq.question_id AS id, table_context, concat('csv/', source, '.table') AS context FROM lq WHERE question_id IN (SELECT question_id FROM mentions)""")
def q03(spark, d):
    questions = line_questions(spark, d).select("question_id", "table_context", F.concat(F.lit("csv/"), "source", F.lit(".csv")).alias("context"))
    return Q.restrict_questions(questions, line_mentions(spark, d), "context", {"question_id": "id"})


@query("q03_context_count", LQ + " SELECT count(DISTINCT table_context) AS tables FROM lq WHERE ex = 1")
def q03_count(spark, d):
    return Q.context_count(line_questions(spark, d).where("ex = 1"))


@query("q04_canonical_tables", """
WITH c AS (SELECT p_partkey AS table_id, concat_ws(chr(1), p_name, p_type) AS body FROM part)
SELECT table_id, min(table_id) OVER (PARTITION BY body) AS canonical_id FROM c""")
def q04(spark, d):
    """Tables of name and type of a part: parts that share both share a table."""
    grid = F.array(F.array(F.lit("Name"), F.lit("Type")), F.array("p_name", "p_type"))
    return Q.canonical_tables(C.explode_cells(I.table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), grid.alias("table_array"))))


@query("q05_normalize_evidence", """
SELECT event_id AS question_id, user_id AS table_context, CAST(0 AS BIGINT) AS ord, user_id % 5 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS row_idx, event_id % 3 AS col_idx FROM events
UNION ALL SELECT event_id, user_id, 1, event_id % 7 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END, 0 FROM events""")
def q05(spark, d):
    def spot(r, c):
        return F.struct(r.alias("row_idx"), c.alias("col_idx"))

    evidence = F.array(spot(F.col("user_id") % 5, F.col("event_id") % 3), spot(F.col("event_id") % 7, F.lit(0).cast("bigint")))
    raw = I.table(spark, d, "events").select(F.col("event_id").alias("question_id"), F.col("user_id").alias("table_context"), F.col("event_type").alias("source"), evidence.alias("evidence"))
    return Q.normalize_evidence(raw, row_offsets={"click": 1})


@query("q06_image_evidence", LQ + " SELECT question_id, table_context, row_idx, col_idx FROM evidence SEMI JOIN pictured USING (table_context, row_idx, col_idx)")
def q06(spark, d):
    return Q.image_evidence(line_evidence(spark, d), I.cells(spark, d)).select("question_id", "table_context", "row_idx", "col_idx")


@query("q07_interleave")
def q07(spark, d):
    """Rounds of a serial choice; tests check both ways of computing it."""
    whole = I.whole_tables(spark, d)
    pictured = Q.image_evidence(line_evidence(spark, d, whole), I.cells(spark, d, whole=whole), whole)
    rows = pictured.select("table_context", "question_id", (F.col("row_idx") * 10 + F.col("col_idx")).alias("pos"), F.struct("row_idx", "col_idx").alias("cell"))
    out = interleave(rows, "table_context", "question_id", "pos", "cell", whole=whole)
    return out.select("table_context", "cell.row_idx", "cell.col_idx", "round", "question_id")


AVOID = LQ + """
, marked AS MATERIALIZED (SELECT m.question_id, canonical_id AS table_id, m.row_idx, m.col_idx, e.question_id IS NOT NULL AND m.row_idx <> 0 AS shared, md5(concat_ws('|', '42', m.question_id, m.row_idx, m.col_idx)) AS k
   FROM mentions m JOIN canon ON m.table_context = canon.table_id LEFT JOIN evidence e ON e.question_id = m.question_id AND e.row_idx = m.row_idx AND e.col_idx = m.col_idx)
, definite AS (SELECT question_id, table_id, row_idx, col_idx FROM marked QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY NOT shared, k) = 1)
, maybe AS (SELECT question_id, table_id, row_idx, col_idx FROM marked ANTI JOIN definite USING (question_id, row_idx, col_idx) WHERE shared)"""


def _avoid(spark, d, write=True):
    return Q.avoid_cells(line_mentions(spark, d), line_evidence(spark, d), canonical(spark, d), SEED, write)


@query("q08_definite_cells", AVOID + " SELECT question_id, table_id, row_idx, col_idx FROM definite")
def q08(spark, d):
    return _avoid(spark, d, write=False)[0]


@query("q08_maybe_cells", AVOID + " SELECT question_id, table_id AS table_context, row_idx, col_idx FROM maybe")
def q08_maybe(spark, d):
    return _avoid(spark, d)[1]


# with tiers given: evidence and maybe cells in seeded order of their place
REBALANCED = AVOID + f"""
, ev AS (SELECT table_id, row_idx, col_idx, min(md5(concat_ws('|', '42', question_id))) AS k FROM (SELECT question_id, canonical_id AS table_id, row_idx, col_idx FROM evidence JOIN canon ON table_context = canon.table_id) GROUP BY ALL)
, mb AS (SELECT table_id, row_idx, col_idx, min(md5(concat_ws('|', '42', question_id))) AS k FROM maybe GROUP BY ALL)
, ccells AS (SELECT * FROM cells WHERE table_id IN (SELECT canonical_id FROM canon))
, over AS (SELECT table_id, col_idx, ceil((images / n - 0.75) * n) AS need FROM (SELECT table_id, col_idx, count(*) FILTER (WHERE row_idx > 0 AND regexp_matches(cell, {TAG})) AS images FROM ccells GROUP BY ALL)
   JOIN (SELECT table_id, max(row_idx) AS n FROM ccells GROUP BY table_id) USING (table_id) WHERE images / n > 0.75)
, graded AS (SELECT c.table_id, c.row_idx, c.col_idx, need, CASE WHEN df.row_idx IS NOT NULL THEN 3 WHEN mb.row_idx IS NOT NULL THEN 2 WHEN ev.row_idx IS NOT NULL THEN 1 ELSE 0 END AS tier,
    CASE WHEN df.row_idx IS NULL AND mb.row_idx IS NOT NULL THEN mb.k WHEN df.row_idx IS NULL AND ev.row_idx IS NOT NULL THEN ev.k ELSE md5(concat_ws('|', '42', c.table_id, c.row_idx, c.col_idx)) END AS k
   FROM ccells c JOIN over USING (table_id, col_idx) LEFT JOIN ev USING (table_id, row_idx, col_idx) LEFT JOIN mb USING (table_id, row_idx, col_idx)
   LEFT JOIN (SELECT DISTINCT table_id, row_idx, col_idx FROM definite) df USING (table_id, row_idx, col_idx) WHERE c.row_idx > 0 AND regexp_matches(c.cell, {TAG}))
, chosen AS (SELECT table_id, row_idx, col_idx FROM graded QUALIFY row_number() OVER (PARTITION BY table_id, col_idx ORDER BY tier, k) <= need)
, balanced AS (SELECT c.table_id, c.row_idx, c.col_idx, CASE WHEN h.table_id IS NOT NULL THEN original ELSE cell END AS cell FROM ccells c LEFT JOIN chosen h USING (table_id, row_idx, col_idx))
, bpictured AS (SELECT table_id AS table_context, row_idx, col_idx FROM balanced WHERE regexp_matches(cell, {TAG}))"""


def balanced(spark, d):
    """(rebalanced cells of canonical tables, cells turned back)."""
    lines = I.facts(spark, d)
    return PC.balanced_cells(
        I.cells(spark, d, lines), I.image_tags(spark, d, lines), line_mentions(spark, d), line_evidence(spark, d), canonical(spark, d), SEED, interleave=False
    )


@query("q09_rebalance_choice", REBALANCED + " SELECT table_id, row_idx, col_idx FROM chosen")
def q09(spark, d):
    return balanced(spark, d)[1].select(*KEY)


@query("q09_rebalance", REBALANCED + " SELECT table_id, row_idx, col_idx, cell FROM balanced")
def q09_apply(spark, d):
    return balanced(spark, d)[0].select(*KEY, "cell")


@query("q09_rebalance_interleaved")
def q09_interleaved(spark, d):
    """Rebalancing with evidence and maybe cells in interleaved order."""
    lines = I.facts(spark, d)
    own = I.table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_partkey").alias("canonical_id"))
    whole = I.whole_tables(spark, d)
    _, chosen = PC.balanced_cells(
        I.cells(spark, d, lines, whole), I.image_tags(spark, d, lines), line_mentions(spark, d, whole), line_evidence(spark, d, whole), own, SEED, whole=whole
    )
    return chosen.groupBy("col_idx").agg(big(F.count(F.lit(1)), "reverted"))


FINAL = REBALANCED + """
, cm AS (SELECT m.question_id, canonical_id AS table_context, row_idx, col_idx FROM mentions m JOIN canon ON m.table_context = table_id)
, ce AS (SELECT m.question_id, canonical_id AS table_context, row_idx, col_idx FROM evidence m JOIN canon ON m.table_context = table_id)
, fe AS (SELECT DISTINCT question_id FROM cm SEMI JOIN bpictured USING (table_context, row_idx, col_idx))
, fi AS (SELECT question_id FROM lq WHERE question_id NOT IN (SELECT question_id FROM fe) AND question_id IN (SELECT question_id FROM ce SEMI JOIN bpictured USING (table_context, row_idx, col_idx)))
, final AS (SELECT lq.question_id, canonical_id AS table_context, kind AS question_type FROM lq JOIN canon ON lq.table_context = table_id
   JOIN (SELECT question_id, 'explicit' AS kind FROM fe UNION ALL SELECT question_id, 'implicit' FROM fi) k ON k.question_id = lq.question_id)"""


def finals(spark, d):
    lines = I.facts(spark, d)
    whole = I.whole_tables(spark, d)
    questions = line_questions(spark, d)
    return PC.experiment_set(
        I.cells(spark, d, lines, whole), I.image_tags(spark, d, lines), questions.select("question_id", "table_context"),
        questions.where("ex = 1"), questions.where("ex = 0"), line_mentions(spark, d, whole), line_evidence(spark, d, whole), canonical(spark, d), SEED, interleave=False,
        whole=whole,
    )


@query("q10_final_explicit", FINAL + " SELECT question_id FROM fe")
def q10(spark, d):
    return finals(spark, d).explicit


@query("q11_final_implicit", FINAL + " SELECT question_id FROM fi")
def q11(spark, d):
    return finals(spark, d).implicit


@query("q12_finalize_questions", FINAL + " SELECT question_id, table_context, question_type FROM final")
def q12(spark, d):
    return finals(spark, d).questions.select("question_id", "table_context", "question_type")


@query("q12_used_tables", FINAL + " SELECT table_id, count(*) AS cells FROM balanced WHERE table_id IN (SELECT table_context FROM final) GROUP BY table_id")
def q12_tables(spark, d):
    return finals(spark, d).tables().groupBy("table_id").agg(big(F.count(F.lit(1)), "cells"))


@query("q13_table_images", FINAL + f"""
SELECT DISTINCT table_id, unnest(regexp_extract_all(cell, {TAG})) AS tag FROM balanced WHERE table_id IN (SELECT table_context FROM final)""")
def q13(spark, d):
    return finals(spark, d).images()


@query("q14_compact_mentions", FINAL + " SELECT question_id, table_context AS table_id, row_idx, col_idx FROM cm SEMI JOIN bpictured USING (table_context, row_idx, col_idx)")
def q14(spark, d):
    return finals(spark, d).mentions


@query("q15_realign_mentions", LQ + f"""
, old AS (SELECT m.*, concat('{{OLD-', question_id, '-', row_idx, '-', col_idx, '}}') AS img_id FROM mentions m)
, op AS (SELECT o.img_id, min(i.image_path) AS path FROM old o JOIN tags t ON t.table_id = o.table_context AND t.row_idx = o.row_idx AND t.col_idx = o.col_idx JOIN image_tags i ON i.tag = t.tag GROUP BY o.img_id)
, nt AS (SELECT t.*, i.image_path AS path FROM tags t JOIN image_tags i ON i.tag = t.tag)
SELECT o.question_id, o.img_id AS old_img_id, n.tag AS img_id, n.table_id, 'text' AS img_string, o.row_idx, o.col_idx, c.cell AS cell_string, c.header AS column_header
FROM old o JOIN op USING (img_id) JOIN nt n ON n.table_id = o.table_context AND n.row_idx = o.row_idx AND n.col_idx = o.col_idx AND n.path = op.path
JOIN cells c ON c.table_id = n.table_id AND c.row_idx = n.row_idx AND c.col_idx = n.col_idx
QUALIFY row_number() OVER (PARTITION BY o.img_id ORDER BY n.tag_pos) = 1""")
def q15(spark, d):
    lines = I.facts(spark, d)
    whole = I.whole_tables(spark, d)
    cells, attributes = I.cells(spark, d, lines, whole), I.image_tags(spark, d, lines)
    img = F.concat(F.lit("{OLD-"), "question_id", F.lit("-"), F.col("row_idx").cast("string"), F.lit("-"), F.col("col_idx").cast("string"), F.lit("}"))
    mentions = line_mentions(spark, d, whole).withColumn("img_id", img).withColumn("img_string", F.lit("text"))
    headers = F.when(F.col("col_idx") == 0, "Supplier").otherwise("Nation")
    mentions = mentions.withColumn("column_header", headers)
    asked = mentions.select("img_id", F.col("table_context").alias("table_id"), "row_idx", "col_idx")
    if whole:
        now = met(asked, Q.tag_paths_of(cells, asked, attributes.select("tag", "image_path")).select(*KEY, "image_path"), KEY)
    else:
        now = asked.join(C.explode_tags(cells).join(attributes.select("tag", "image_path"), "tag"), KEY)
    old_paths = now.groupBy(F.col("img_id").alias("tag")).agg(F.min("image_path").alias("image_path"))
    own = I.table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_partkey").alias("canonical_id"))
    compact = Q.compact_mentions(mentions, cells, own, whole)
    return Q.realign_mentions(mentions.drop("table_context"), compact, cells, old_paths, attributes, whole)


@query("q16_length_histogram", "SELECT len(string_split(text, chr(10))) AS length, count(*) AS n FROM documents GROUP BY length")
def q16(spark, d):
    """Lines per document."""
    return Q.length_histogram(I.table(spark, d, "documents").select(F.split("text", "\n").alias("lines")), "lines")


@query("q17_check_dataset", LQ + f"""
, shares AS (SELECT table_id, max(i) / any_value(n) AS s, any_value(n) AS n FROM (SELECT table_id, col_idx, count(*) FILTER (WHERE regexp_matches(cell, {TAG})) AS i FROM cells GROUP BY ALL) JOIN (SELECT table_id, max(row_idx) + 1 AS n FROM cells GROUP BY table_id) USING (table_id) GROUP BY table_id)
SELECT 'explicit without mention' AS check, question_id AS subject FROM lq WHERE ex = 1 AND question_id NOT IN (SELECT question_id FROM mentions)
UNION ALL SELECT 'mention without image', concat_ws('/', question_id, row_idx, col_idx) FROM mentions ANTI JOIN pictured USING (table_context, row_idx, col_idx)
UNION ALL SELECT 'implicit without image evidence', question_id FROM lq WHERE ex = 0 AND question_id NOT IN (SELECT question_id FROM evidence SEMI JOIN pictured USING (table_context, row_idx, col_idx))
UNION ALL SELECT 'table out of bounds', concat('', table_id) FROM shares WHERE NOT (n <= 55 AND s BETWEEN 0.3 AND 0.75)""")
def q17(spark, d):
    whole = I.whole_tables(spark, d)
    questions = line_questions(spark, d)
    return Q.check_dataset(
        I.cells(spark, d, I.facts(spark, d), whole), questions.where("ex = 1"), line_mentions(spark, d, whole), questions.where("ex = 0"), line_evidence(spark, d, whole), whole=whole
    )


# --- samples and splits of customers, classed by market segment

KEYED = "SELECT *, md5(concat_ws('|', '42', c_custkey)) AS k FROM customer"


@query("q18_sample_n", f"SELECT c_custkey FROM ({KEYED}) ORDER BY k, c_custkey LIMIT 100")
def q18(spark, d):
    return S.sample_n(I.table(spark, d, "customer"), 100, SEED, "c_custkey").select("c_custkey")


def _labels(spark, d):
    return F.array(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.col("c_mktsegment"))


DOMINANT = """
WITH c AS (SELECT c_custkey, unnest([concat('N', c_nationkey), c_mktsegment]) AS category FROM customer), f AS (SELECT category, count(*) AS n FROM c GROUP BY category)"""


@query("q19_dominant_first", "SELECT c_custkey, concat('N', c_nationkey) AS category FROM customer")
def q19(spark, d):
    return S.dominant_category(I.table(spark, d, "customer").select("c_custkey", _labels(spark, d).alias("categories")), "c_custkey")


@query("q19_dominant_frequent", DOMINANT + " SELECT c_custkey, arg_min(category, (-n, category)) AS category FROM c JOIN f USING (category) GROUP BY c_custkey")
def q19_frequent(spark, d):
    rows = I.table(spark, d, "customer").select("c_custkey", _labels(spark, d).alias("categories"))
    return S.dominant_category(rows, "c_custkey", mode="frequent")


@query("q20_question_categories", """
SELECT o_orderkey AS question_id, CASE WHEN c_custkey IS NULL OR c_nationkey % 4 = 0 OR n_regionkey = 0 THEN 'None' ELSE concat(n_name, ', ', r_name) END AS categories
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q20(spark, d):
    questions = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("table_context"))
    url = F.concat(F.lit("n/"), F.col("c_nationkey").cast("string"))
    tables = I.table(spark, d, "customer").select(F.col("c_custkey").alias("table_id"), url.alias("url"))
    home = I.table(spark, d, "nation").join(I.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entities = home.where("n_nationkey % 4 <> 0").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("url"), "n_name", F.col("n_name").alias("qid"))
    listed = home.select(F.col("n_name").alias("qid"), F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.array("n_name", "r_name")).alias("categories"))
    return S.question_categories(questions, tables, entities, listed).select("question_id", F.array_join("categories", ", ").alias("categories"))


QUOTA = """
, t AS (SELECT count(*) AS total FROM customer)
, q0 AS (SELECT category, CAST(floor(70 * n / total) AS BIGINT) AS quota FROM f, t WHERE n > least(0.02 * total, 20))
, quota AS (SELECT * FROM q0 UNION ALL SELECT 'Others', CAST(70 - coalesce(sum(quota), 0) AS BIGINT) FROM q0)"""
NATIONS = "WITH c AS (SELECT c_custkey, concat('N', c_nationkey) AS category FROM customer), f AS (SELECT category, count(*) AS n FROM c GROUP BY category)"


def _quota(spark, d):
    customers = I.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("category"))
    frequency = customers.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return customers, S.quotas(frequency, customers.agg(F.count(F.lit(1)).alias("N")), 70)


@query("q21_quotas", NATIONS + QUOTA + " SELECT category, quota FROM quota")
def q21(spark, d):
    return _quota(spark, d)[1]


STRATA = NATIONS + QUOTA + """
, s AS (SELECT c_custkey, c.category, coalesce(q.category, 'Others') AS stratum, row_number() OVER (PARTITION BY coalesce(q.category, 'Others') ORDER BY md5(concat_ws('|', '42', c_custkey)), c_custkey) AS rn
   FROM c LEFT JOIN quota q ON q.category = c.category)
, sample AS (SELECT c_custkey, s.category, stratum FROM s JOIN quota q ON q.category = stratum WHERE rn <= quota)"""


@query("q22_stratified_sample", STRATA + " SELECT c_custkey, category, stratum FROM sample")
def q22(spark, d):
    customers, quota = _quota(spark, d)
    return S.stratified_sample(customers, quota, "c_custkey", SEED).select("c_custkey", "category", "stratum")


@query("q22_shortfalls", STRATA + """
SELECT q.category, quota, count(s.stratum) AS taken, quota - count(s.stratum) AS missing FROM quota q LEFT JOIN sample s ON s.stratum = q.category GROUP BY q.category, quota""")
def q22_short(spark, d):
    customers, quota = _quota(spark, d)
    return S.shortfalls(S.stratified_sample(customers, quota, "c_custkey", SEED), quota)


@query("q23_split_prefix", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_name, c_custkey) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM customer")
def q23(spark, d):
    return S.split_prefix(I.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "split")


SPLIT = """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
, split AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS table_context, CASE WHEN b.o_custkey IS NULL THEN 'train_only' WHEN a.o_custkey IS NULL THEN 'test_only' ELSE 'common' END AS split FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)"""


def _split(spark, d):
    orders = I.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("table_context"), "o_orderstatus")
    return orders, S.table_split(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus = 'F'"))


@query("q24_table_split", SPLIT + " SELECT table_context, split FROM split")
def q24(spark, d):
    return _split(spark, d)[1]


@query("q25_exclusive_questions", SPLIT + " SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT table_context FROM split WHERE split = 'train_only')")
def q25(spark, d):
    orders, split = _split(spark, d)
    return S.exclusive_questions(orders, split).select("o_orderkey")


@query("q26_split_visual_key", "SELECT event_id, CAST(user_id AS VARCHAR) AS question_id, concat(event_type, ':', event_id) AS entity FROM events")
def q26(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string"))
    return I.table(spark, d, "events").select("event_id", T.split_visual_key(key).alias("k")).select("event_id", "k.question_id", "k.entity")


@query("q27_reconcile_counts", FINAL + """
SELECT CAST(0 AS BIGINT) AS ord, 'questions' AS step, count(*) AS n FROM lq UNION ALL SELECT 1, 'explicit', count(*) FROM fe UNION ALL SELECT 2, 'implicit', count(*) FROM fi""")
def q27(spark, d):
    final = finals(spark, d)
    out = Q.reconcile_counts({"questions": line_questions(spark, d), "explicit": final.explicit, "implicit": final.implicit})
    return out.select(big("ord"), "step", "n")
