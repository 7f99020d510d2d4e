"""Table similarity, with documents as tables and their lines as cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmosaic.catalog import inputs as I
from gridmosaic.catalog.registry import query, rounded
from gridmosaic.operators import similarity as S

# documents of even scores (of ids) look for a partner among those of odd scores, in the same source
SHINGLES_SQL = """
WITH lines AS (SELECT doc_id, source, lower(unnest(string_split(text, chr(10)))) AS cell FROM documents)
, toks AS (SELECT *, regexp_extract_all(cell, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]') AS t,
   len(regexp_split_to_array(trim(cell, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '\\s+')) > 1 AS several FROM lines)
, bag AS (SELECT doc_id AS table_id, source AS block, unnest(CASE WHEN several AND len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: concat(t[i], chr(1), t[i + 1])) ELSE [cell] END) AS shingle FROM toks)
, shingles AS (SELECT DISTINCT table_id, block, shingle FROM bag)
, sizes AS (SELECT table_id, count(*) AS n FROM shingles GROUP BY table_id)"""


def best_sql(on: str, least: str) -> str:
    return f"""
, pairs AS (SELECT l.table_id AS a, r.table_id AS b, count(*) AS common FROM shingles l JOIN shingles r ON l.shingle = r.shingle {on}
   WHERE l.table_id // 20 % 2 = 0 AND r.table_id // 20 % 2 = 1 GROUP BY ALL)
, j AS (SELECT a, b, common / (x.n + y.n - common) AS s FROM pairs JOIN sizes x ON x.table_id = a JOIN sizes y ON y.table_id = b)
, best AS (SELECT a, arg_max(b, (s, -b)) AS match_id, max(s) AS s FROM j {least} GROUP BY a)
, found AS (SELECT table_id, match_id, round(coalesce(s, 0.0), 6) AS similarity FROM (SELECT DISTINCT table_id FROM shingles WHERE table_id // 20 % 2 = 0) t LEFT JOIN best ON a = table_id)"""


def lines(spark, d):
    return I.table(spark, d, "documents").select(
        F.col("doc_id").alias("table_id"), F.col("source").alias("block"), F.explode(F.split("text", "\n")).alias("cell")
    )


def sides(spark, d):
    shingles = S.table_shingles(lines(spark, d), ("block", "table_id"))
    odd = F.floor(F.col("table_id") / 20) % 2
    return shingles.where(odd == 0), shingles.where(odd == 1)


@query("m01_table_shingles", SHINGLES_SQL + " SELECT table_id, shingle FROM shingles")
def m01(spark, d):
    return S.table_shingles(lines(spark, d))


@query("m02_best_table_match", SHINGLES_SQL + best_sql("AND l.block = r.block", "") + " SELECT * FROM found")
def m02(spark, d):
    return S.best_table_match(*sides(spark, d)).select("table_id", "match_id", rounded("similarity"))


@query("m03_multiset_jaccard", SHINGLES_SQL + """
, c AS (SELECT table_id, shingle, count(*) AS c FROM bag GROUP BY ALL), p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents))
, s AS (SELECT a, b, shingle, c AS l, 0 AS r FROM p JOIN c ON a = table_id UNION ALL SELECT a, b, shingle, 0, c FROM p JOIN c ON b = table_id)
, g AS (SELECT a, b, shingle, sum(l) AS l, sum(r) AS r FROM s GROUP BY ALL)
SELECT a AS left_id, b AS right_id, round(sum(least(l, r)) / sum(greatest(l, r)), 6) AS similarity FROM g GROUP BY a, b""")
def m03(spark, d):
    rows = S.shingle_rows(lines(spark, d))
    ids = I.table(spark, d, "documents").select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"))
    pairs = ids.join(ids.select(F.col("left_id").alias("right_id")), "right_id", "left_semi")
    return S.multiset_jaccard(rows, rows, pairs).select("left_id", "right_id", rounded("similarity"))


@query("m04_compare_matches", SHINGLES_SQL + best_sql("AND l.block = r.block", "") + """
SELECT count(*) AS tables, count(*) FILTER (WHERE match_id IS DISTINCT FROM CASE WHEN similarity >= 0.1 THEN match_id END) AS different FROM found""")
def m04(spark, d):
    """Against the strategy that takes only matches of at least 0.1."""
    best = S.best_table_match(*sides(spark, d))
    strict = best.withColumn("match_id", F.when(F.col("similarity") >= 0.1, F.col("match_id")))
    return S.compare_matches(best, strict)


@query("m05_near_duplicates", SHINGLES_SQL + best_sql("", "WHERE s >= 0.3") + " SELECT * FROM found")
def m05(spark, d):
    left, right = sides(spark, d)
    return S.near_duplicates(left.drop("block"), right.drop("block"), 0.3).select("table_id", "match_id", rounded("similarity"))
