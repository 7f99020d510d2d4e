"""Inputs of the registered queries, derived from the driver tables.

Each view has a Spark form (a function) and an SQL form (a CTE text) for the
oracle. The two are written separately and are checked against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmosaic.functions import tags as T
from gridmosaic.operators.ranking import HOT_GROUP_ROWS, position_in_group
from gridmosaic.operators.together import dealt
from gridmosaic.session import reliable_checkpoint

DATASET = "DRV"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def whole_tables(spark: SparkSession, d: str) -> bool:
    """Whether no table is too large to be dealt to one task: none has more cells than a hot group has rows."""
    sizes = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > HOT_GROUP_ROWS // len(HEADERS)).isEmpty()


def facts(spark: SparkSession, d: str) -> DataFrame:
    """``table_rows`` written down once, for queries that read it several times."""
    return reliable_checkpoint(table_rows(spark, d))


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per table row: a table per part, its lineitems as rows."""
    lines = position_in_group(
        table(spark, d, "lineitem"),
        ["l_partkey"],
        [F.col(c) for c in LINE_ORDER],
        F.to_date("l_shipdate"),
        "row_idx",
    )
    # one after the other: Spark knows the size of a table, but takes that of a join for the product of both, and would deal all lines anew
    named = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("l_partkey").alias("table_id"), "row_idx", "s_suppkey", "s_name", "n_nationkey", "n_name",
        "l_returnflag", "l_linestatus", "l_linenumber",
    )


FACTS_SQL = """
facts AS MATERIALIZED (
  SELECT l_partkey AS table_id, row_idx, s_suppkey, s_name, n_nationkey, n_name, l_returnflag, l_linestatus, l_linenumber
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey,
          l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS row_idx FROM lineitem) l
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _tag(col: int, n: int):
    return T.image_tag_text(DATASET, F.col("table_id"), F.col("row_idx"), F.lit(col), F.lit(n))


HEADERS = ("Supplier", "Nation", "Note", "Line")


def cells(spark: SparkSession, d: str, lines: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Cell relation of ``facts``; the header row rides on row 1 of its table. ``whole`` tables are dealt as rows, before they are cells."""
    lines = dealt(table_rows(spark, d) if lines is None else lines, "table_id", whole)
    two = F.col("n_nationkey") % 6 == 0
    body = [
        ("Supplier", F.col("s_name"), F.when(F.col("s_suppkey") % 10 != 0, _tag(0, 0)).otherwise(F.col("s_name"))),
        (
            "Nation",
            F.when(two, F.concat("n_name", F.lit(" & "), "s_name", F.lit(" (home)"))).otherwise(F.concat("n_name", F.lit(" (home)"))),
            F.when(two, F.concat(_tag(1, 0), F.lit(" & "), _tag(1, 1), F.lit(" (home)")))
            .when(F.col("n_nationkey") % 3 == 0, F.concat(_tag(1, 0), F.lit(" (home)")))
            .otherwise(F.concat("n_name", F.lit(" (home)"))),
        ),
        ("Note", F.col("l_returnflag"), F.when(F.col("l_linestatus") == "F", _tag(2, 0)).otherwise(F.col("l_returnflag"))),
        ("Line", F.col("l_linenumber").cast("string"), F.col("l_linenumber").cast("string")),
    ]
    row = F.array(*[_cell(F.col("row_idx"), i, h, o, c) for i, (h, o, c) in enumerate(body)])
    head = F.array(*[_cell(F.lit(0), i, h, F.lit(h), F.lit(h)) for i, h in enumerate(HEADERS)])
    return lines.select(
        "table_id", F.explode(F.when(F.col("row_idx") == 1, F.concat(head, row)).otherwise(row)).alias("c")
    ).select("table_id", "c.*")


def _cell(row, col, header, original, cell):
    return F.struct(
        row.cast("bigint").alias("row_idx"), F.lit(col).cast("bigint").alias("col_idx"),
        F.lit(header).alias("header"), original.alias("original"), cell.alias("cell"),
    )


CELLS_SQL = FACTS_SQL + """,
cells AS MATERIALIZED (
  SELECT table_id, row_idx, CAST(0 AS BIGINT) AS col_idx, 'Supplier' AS header, s_name AS original,
     CASE WHEN s_suppkey % 10 <> 0 THEN concat('{IMG-{DRV-', table_id, '-', row_idx, '-0-0}}') ELSE s_name END AS cell FROM facts
  UNION ALL SELECT table_id, row_idx, 1, 'Nation',
     CASE WHEN n_nationkey % 6 = 0 THEN concat(n_name, ' & ', s_name, ' (home)') ELSE concat(n_name, ' (home)') END,
     CASE WHEN n_nationkey % 6 = 0 THEN concat('{IMG-{DRV-', table_id, '-', row_idx, '-1-0}} & {IMG-{DRV-', table_id, '-', row_idx, '-1-1}} (home)')
          WHEN n_nationkey % 3 = 0 THEN concat('{IMG-{DRV-', table_id, '-', row_idx, '-1-0}} (home)')
          ELSE concat(n_name, ' (home)') END FROM facts
  UNION ALL SELECT table_id, row_idx, 2, 'Note', l_returnflag,
     CASE WHEN l_linestatus = 'F' THEN concat('{IMG-{DRV-', table_id, '-', row_idx, '-2-0}}') ELSE l_returnflag END FROM facts
  UNION ALL SELECT table_id, row_idx, 3, 'Line', concat('', l_linenumber), concat('', l_linenumber) FROM facts
  UNION ALL SELECT table_id, 0, unnest([0, 1, 2, 3]::BIGINT[]), unnest(['Supplier', 'Nation', 'Note', 'Line']), unnest(['Supplier', 'Nation', 'Note', 'Line']),
     unnest(['Supplier', 'Nation', 'Note', 'Line']) FROM facts WHERE row_idx = 1)"""


def image_tags(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Attributes of every image tag of ``cells``."""
    lines = table_rows(spark, d) if lines is None else lines

    supp, nat = F.col("s_suppkey").cast("string"), F.col("n_nationkey").cast("string")
    supplier = (
        F.concat(F.lit("img/supplier_"), supp, F.lit(".jpg")), F.col("s_name"),
        F.concat(F.lit("Q"), supp), F.concat(F.lit("/wiki/Supplier_"), supp),
    )
    nation = (
        F.concat(F.lit("img/nation_"), nat, F.lit(".svg")), F.col("n_name"),
        F.concat(F.lit("N"), nat), F.concat(F.lit("/wiki/Nation_"), nat),
    )
    flag = (
        F.concat(F.lit("img/flag_"), "l_returnflag", F.lit(".png")), F.col("l_returnflag"),
        F.concat(F.lit("F"), "l_returnflag"), F.concat(F.lit("/wiki/Flag_"), "l_returnflag"),
    )
    entries = [
        (F.col("s_suppkey") % 10 != 0, 0, 0, *supplier),
        (F.col("n_nationkey") % 3 == 0, 1, 0, *nation),
        (F.col("n_nationkey") % 6 == 0, 1, 1, *supplier),
        (F.col("l_linestatus") == "F", 2, 0, *flag),
    ]
    # a row is told apart by its number first: only the texts that are asked for are made, each for its own row
    found = lines.select("*", F.explode(F.array_compact(F.array(*[F.when(e[0], F.lit(k)) for k, e in enumerate(entries)]))).alias("__entry"))

    def chosen(texts):
        return F.coalesce(*[F.when(F.col("__entry") == k, text) for k, text in enumerate(texts)])

    return found.select(
        chosen([_tag(e[1], e[2]) for e in entries]).alias("tag"),
        *[chosen([e[k] for e in entries]).alias(name) for k, name in enumerate(("image_path", "original_string", "qid", "wiki_link"), 3)],
    )


IMAGE_TAGS_SQL = """
image_tags AS MATERIALIZED (
  SELECT concat('{IMG-{DRV-', table_id, '-', row_idx, '-0-0}}') AS tag, concat('img/supplier_', s_suppkey, '.jpg') AS image_path,
     s_name AS original_string, concat('Q', s_suppkey) AS qid, concat('/wiki/Supplier_', s_suppkey) AS wiki_link FROM facts WHERE s_suppkey % 10 <> 0
  UNION ALL SELECT concat('{IMG-{DRV-', table_id, '-', row_idx, '-1-0}}'), concat('img/nation_', n_nationkey, '.svg'),
     n_name, concat('N', n_nationkey), concat('/wiki/Nation_', n_nationkey) FROM facts WHERE n_nationkey % 3 = 0
  UNION ALL SELECT concat('{IMG-{DRV-', table_id, '-', row_idx, '-1-1}}'), concat('img/supplier_', s_suppkey, '.jpg'),
     s_name, concat('Q', s_suppkey), concat('/wiki/Supplier_', s_suppkey) FROM facts WHERE n_nationkey % 6 = 0
  UNION ALL SELECT concat('{IMG-{DRV-', table_id, '-', row_idx, '-2-0}}'), concat('img/flag_', l_returnflag, '.png'),
     l_returnflag, concat('F', l_returnflag), concat('/wiki/Flag_', l_returnflag) FROM facts WHERE l_linestatus = 'F')"""

TAGS_SQL = """
tags AS MATERIALIZED (
  SELECT table_id, row_idx, col_idx, unnest(regexp_extract_all(cell, '\\{IMG-\\{.*?\\}\\}')) AS tag,
         generate_subscripts(regexp_extract_all(cell, '\\{IMG-\\{.*?\\}\\}'), 1) - 1 AS tag_pos
  FROM cells WHERE regexp_matches(cell, '\\{IMG-\\{.*?\\}\\}'))"""

TABLE_SQL = "WITH" + CELLS_SQL + "," + IMAGE_TAGS_SQL + "," + TAGS_SQL


def questions(spark: SparkSession, d: str) -> DataFrame:
    """A user turn and the assistant turn after it; the question also names a supplier."""
    turns = table(spark, d, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    answered = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("conv_id").alias("table_context"),
        F.concat("q", F.lit(" (see supplier#"), F.lpad((F.col("conv_id") % 10).cast("string"), 9, "0"), F.lit(")")).alias("question"),
        "answer",
        (F.col("turn") + 1).alias("ev_row"),
        (F.col("turn") % 4).alias("ev_col"),
    )


QUESTIONS_SQL = """
questions AS (
  SELECT concat(q.conv_id, '-', q.turn) AS question_id, q.conv_id AS table_context,
     concat(q.text, ' (see supplier#', lpad(CAST(q.conv_id % 10 AS VARCHAR), 9, '0'), ')') AS question, a.text AS answer,
     1 + q.turn AS ev_row, q.turn % 4 AS ev_col
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """A response per question: right, upper case, longer, listed or off."""
    kind = (F.col("table_context") + F.col("ev_row")) % 5
    said = (
        F.when(kind == 0, F.col("answer")).when(kind == 1, F.upper(F.replace("answer", F.lit("ß"), F.lit("ss")))).when(kind == 2, F.concat("answer", F.lit(" extra")))
        .when(kind == 3, F.concat(F.lit("['"), "answer", F.lit("']"))).otherwise(F.col("question"))
    )
    return questions(spark, d).select(
        F.col("question_id").alias("key"), "table_context", "question", F.col("answer").alias("gold"), (F.col("ev_col") % 2).alias("kind"),
        F.when((kind == 4) & (F.col("ev_row") == 1), F.lit("Error occurred."))
        .otherwise(F.concat(F.lit("Step 1: "), "question", F.lit(" Step 2: "), said)).alias("response"),
    )


RESPONSES_SQL = QUESTIONS_SQL + """,
responses AS (
  SELECT question_id AS key, table_context, question, answer AS gold, ev_col % 2 AS kind,
     CASE WHEN (table_context + ev_row) % 5 = 4 AND ev_row = 1 THEN 'Error occurred.' ELSE concat('Step 1: ', question, ' Step 2: ',
       CASE (table_context + ev_row) % 5 WHEN 0 THEN answer WHEN 1 THEN upper(replace(answer, 'ß', 'ss')) WHEN 2 THEN concat(answer, ' extra')
         WHEN 3 THEN concat('[''', answer, ''']') ELSE question END) END AS response
  FROM questions)"""


def link_entity(spark: SparkSession, d: str) -> DataFrame:
    """Link to entity: an alias for every fourth supplier, none for every eleventh; nations too."""
    k = F.col("s_suppkey").cast("string")
    named = F.when(F.col("s_suppkey") % 4 == 0, F.array(F.concat(F.lit("Supplier_"), k), F.concat(F.lit("S_"), k))).otherwise(
        F.array(F.concat(F.lit("Supplier_"), k))
    )
    suppliers = table(spark, d, "supplier").where(F.col("s_suppkey") % 11 != 0).select(
        F.explode(named).alias("name"), F.concat(F.lit("Q"), k).alias("qid")
    )
    n = F.col("n_nationkey").cast("string")
    nations = table(spark, d, "nation").select(F.concat(F.lit("Nation_"), n).alias("name"), F.concat(F.lit("N"), n).alias("qid"))
    return suppliers.unionByName(nations).select(F.concat(F.lit("https://en.wikipedia.org/wiki/"), "name").alias("link"), "qid")


def entity_category(spark: SparkSession, d: str) -> DataFrame:
    """Nation and region of a supplier, and marks that follow its balance and key."""
    k = F.col("s_suppkey")
    home = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    labels = F.array_compact(F.array(
        F.col("n_name"), F.col("r_name"), F.when(F.col("s_acctbal") > 5000, F.lit("rich")),
        F.when(k % 13 == 0, F.lit("sports discipline")), F.when(k % 17 == 0, F.lit("type of chemical entity")), F.when(k % 19 == 0, F.lit("human")),
    ))
    return rows.select(F.concat(F.lit("Q"), k.cast("string")).alias("qid"), F.posexplode(labels).alias("pos", "category")).select(
        "qid", F.concat(F.lit("C"), "pos").alias("category_id"), "category"
    )


ANNOTATIONS = [
    (1, "rich", True, 100.0, "Logo of company"), (2, "AFRICA", False, 0.0, ""), (3, "AMERICA", True, 590.0, "collage of place"),
    (4, "ASIA", True, 600.0, "xxx"), (5, "NATION_7", True, 0.0, "ok"), (6, "EUROPE", True, 600.0, None),
]


def annotations(spark: SparkSession) -> DataFrame:
    """The user's ordered category rules."""
    return spark.createDataFrame(ANNOTATIONS, "priority int, category string, include boolean, `limit` double, remarks string")


def pageviews(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems per supplier and month, as views of the supplier's page."""
    link = F.concat(F.lit("https://en.wikipedia.org/wiki/Supplier_"), F.col("l_suppkey").cast("string"))
    return table(spark, d, "lineitem").groupBy(link.alias("link"), F.trunc("l_shipdate", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("views")
    )


_WIKI = "https://en.wikipedia.org/wiki/"
ENTITIES_SQL = f"""
link_entity AS (
  SELECT concat('{_WIKI}Supplier_', s_suppkey) AS link, concat('Q', s_suppkey) AS qid FROM supplier WHERE s_suppkey % 11 <> 0
  UNION ALL SELECT concat('{_WIKI}S_', s_suppkey), concat('Q', s_suppkey) FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 4 = 0
  UNION ALL SELECT concat('{_WIKI}Nation_', n_nationkey), concat('N', n_nationkey) FROM nation),
sup AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
entity_category AS (
  SELECT concat('Q', s_suppkey) AS qid, n_name AS category FROM sup UNION ALL SELECT concat('Q', s_suppkey), r_name FROM sup
  UNION ALL SELECT concat('Q', s_suppkey), 'rich' FROM sup WHERE s_acctbal > 5000
  UNION ALL SELECT concat('Q', s_suppkey), 'sports discipline' FROM sup WHERE s_suppkey % 13 = 0
  UNION ALL SELECT concat('Q', s_suppkey), 'type of chemical entity' FROM sup WHERE s_suppkey % 17 = 0
  UNION ALL SELECT concat('Q', s_suppkey), 'human' FROM sup WHERE s_suppkey % 19 = 0),
annotations(priority, category, include, lim, remarks) AS (VALUES (1, 'rich', true, 100.0, 'Logo of company'), (2, 'AFRICA', false, 0.0, ''),
  (3, 'AMERICA', true, 590.0, 'collage of place'), (4, 'ASIA', true, 600.0, 'xxx'), (5, 'NATION_7', true, 0.0, 'ok'), (6, 'EUROPE', true, 600.0, NULL)),
pageviews AS (SELECT concat('{_WIKI}Supplier_', l_suppkey) AS link, date_trunc('month', l_shipdate) AS month, count(*) AS views FROM lineitem GROUP BY ALL),
link_views AS (SELECT link, CAST(sum(views) AS BIGINT) AS views FROM pageviews GROUP BY link),
entity_views AS (SELECT qid, max(views) AS views FROM link_views JOIN link_entity USING (link) GROUP BY qid),
claims AS (SELECT qid, arg_min(include, priority) AS include, arg_min(lim, priority) AS lim, arg_min(coalesce(lower(remarks), ''), priority) AS remarks
  FROM entity_category JOIN annotations USING (category) GROUP BY qid),
classes AS (SELECT e.qid, CASE WHEN c.qid IS NULL THEN 'remaining' WHEN NOT include THEN 'excluded'
    WHEN regexp_matches(remarks, 'logo|flag|seal|coat|coa') THEN CASE WHEN coalesce(v.views, 0) > lim THEN 'seal' ELSE 'excluded' END
    WHEN contains(remarks, 'xxx') THEN CASE WHEN coalesce(v.views, 0) > lim THEN 'location' ELSE 'seal' END
    WHEN regexp_matches(remarks, 'collage|location') THEN CASE WHEN coalesce(v.views, 0) > lim THEN 'location' ELSE 'excluded' END
    WHEN coalesce(v.views, 0) > lim THEN 'included' ELSE 'excluded' END AS entity_class
  FROM (SELECT DISTINCT qid FROM link_entity) e LEFT JOIN claims c ON e.qid = c.qid LEFT JOIN entity_views v ON e.qid = v.qid)"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    from gridmosaic.operators import entities as E

    links = link_entity(spark, d)
    views = E.entity_views(E.link_views(pageviews(spark, d)), links)
    return E.classify_entities(links, entity_category(spark, d), annotations(spark), views)
