"""Responses and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmosaic.catalog import inputs as I
from gridmosaic.catalog.registry import big, query, rounded
from gridmosaic.functions import answers as A
from gridmosaic.operators import cells as C, responses as R, scoring as S

W = "WITH" + I.RESPONSES_SQL
WS = "[\\s\\p{Z}]+"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"


def clean(c: str) -> str:
    inner = f"replace(replace(replace(replace(replace(lower({strip(c)}), chr(10), ' '), '\\n', ' '), ',', ''), '-', ' '), ':', ' ')"
    return f"regexp_replace({strip(inner)}, '{WS}', ' ', 'g')"


def answer_sql(style: str) -> str:
    """CTEs from responses to ``answers`` (responses plus prediction)."""
    marker = A.STEP_MARKERS[style]
    drop = {"colon": "false", "plain": "starts_with(t, concat(':', chr(10)))", "loose": "starts_with(t, concat(':', chr(10))) OR starts_with(t, ': ')"}[style]
    return f"""
, a1 AS (SELECT *, {strip(f"string_split(response, '{marker}')[-1]")} AS t FROM responses)
, a2 AS (SELECT * REPLACE (CASE WHEN {drop} THEN substring(t, 3) ELSE t END AS t) FROM a1)
, a3 AS (SELECT * REPLACE (CASE WHEN starts_with(t, '[''') THEN substring(t, 3, greatest(length(t) - 4, 0)) ELSE t END AS t) FROM a2)
, answers AS (SELECT * EXCLUDE (t), CASE WHEN starts_with(t, '[') THEN substring(t, 2, greatest(length(t) - 2, 0)) ELSE t END AS prediction FROM a3)"""


SCORED = f"""
, cleaned AS (SELECT *, {clean('prediction')} AS p, {clean('gold')} AS g FROM answers)
, sets AS (SELECT *, list_distinct(list_filter(string_split(p, ' '), lambda x: x <> '')) AS ps, list_distinct(list_filter(string_split(g, ' '), lambda x: x <> '')) AS gs FROM cleaned)
, scored AS (SELECT *, p = g AS is_exact, p = g OR contains(p, g) AS is_substring, contains(prediction, gold) AS is_literal,
    len(list_intersect(ps, gs)) AS tp, len(ps) - len(list_intersect(ps, gs)) AS fp, len(gs) - len(list_intersect(ps, gs)) AS fn FROM sets)
, f1 AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1 FROM scored)"""


def _answers(spark, d, style="plain"):
    return I.responses(spark, d).withColumn("prediction", A.final_answer(F.col("response"), style))


JSON_TEXT = """concat('```json', chr(10), CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN substring(props, 1, 5) WHEN 2 THEN concat('so: ', props, ' done')
   WHEN 3 THEN replace(props, '{', '') ELSE concat(props, ' This is not a movie poster') END, chr(10), '```')"""


@query("r01_parse_json", f"""
WITH t AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN {JSON_TEXT} END AS r FROM events),
u AS (SELECT event_id, r, replace(replace(replace(replace(replace(r, concat('```json', chr(10)), ''), concat(chr(10), '```'), ''), concat('```JSON', chr(10)), ''), concat(chr(10), '```'), ''), '```', '') AS t FROM t),
s AS (SELECT event_id, r, CASE WHEN contains(r, 'This is not a movie poster') THEN '{{"imagetype": "This is not a movie poster"}}'
   WHEN NOT contains(t, '}}') THEN '' WHEN NOT contains(t, '{{') THEN CASE WHEN ends_with(t, '}}') THEN '}}' ELSE '' END
   ELSE t[strpos(t, '{{') : length(t) - strpos(reverse(t), '}}') + 1] END AS json_text FROM u)
SELECT event_id, json_text, CASE WHEN r IS NOT NULL THEN json_text <> '' AND json_valid(json_text) END AS is_parsed, TRY_CAST(CASE WHEN json_valid(json_text) THEN json_extract(json_text, '$.k') END AS BIGINT) AS k FROM s""")
def r01(spark, d):
    case, props = F.col("event_id") % 5, F.col("props")
    body = (
        F.when(case == 0, props).when(case == 1, F.substring(props, 1, 5)).when(case == 2, F.concat(F.lit("so: "), props, F.lit(" done")))
        .when(case == 3, F.replace(props, F.lit("{"), F.lit(""))).otherwise(F.concat(props, F.lit(" This is not a movie poster")))
    )
    text = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return I.table(spark, d, "events").select("event_id", A.parse_json_response(text).alias("r")).select(
        "event_id", "r.json_text", "r.is_parsed", F.try_variant_get("r.parsed", "$.k", "bigint").alias("k")
    )


ARROWS = """concat('Step 3: x -> y', chr(10), 'Step 3: two tags', chr(10), '{ENTITY_IMAGE-1} -> ', p_name, chr(10), 'none', chr(10),
   CASE p_size % 4 WHEN 0 THEN concat('ENTITY_IMAGE-2 -> ', p_type) WHEN 1 THEN concat('{ENTITY_IMAGE-3} -> {ENTITY_IMAGE-4} -> ', p_brand)
   WHEN 2 THEN concat('{ENTITY_IMAGE-1} and {ENTITY_IMAGE-5} -> ', p_type) ELSE 'a -> b -> c -> d' END)"""


def _arrows(spark, d):
    case = F.col("p_size") % 4
    tail = (
        F.when(case == 0, F.concat(F.lit("ENTITY_IMAGE-2 -> "), "p_type"))
        .when(case == 1, F.concat(F.lit("{ENTITY_IMAGE-3} -> {ENTITY_IMAGE-4} -> "), "p_brand"))
        .when(case == 2, F.concat(F.lit("{ENTITY_IMAGE-1} and {ENTITY_IMAGE-5} -> "), "p_type")).otherwise(F.lit("a -> b -> c -> d"))
    )
    text = F.concat(F.lit("Step 3: x -> y\nStep 3: two tags\n{ENTITY_IMAGE-1} -> "), "p_name", F.lit("\nnone\n"), tail)
    return I.table(spark, d, "part").select(F.col("p_partkey").alias("key"), text.alias("response"))


ARROW_LINES = f"""
WITH t AS (SELECT p_partkey AS key, string_split(string_split({ARROWS}, 'Step 3:')[-1], chr(10)) AS l FROM part),
x AS (SELECT key, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM t),
p AS (SELECT key, pos, string_split(trim(line), '->') AS parts FROM x WHERE contains(line, '->'))"""


@query("r02_parse_arrows", ARROW_LINES + """
, e AS (
 SELECT key, pos, trim(parts[2]) AS prediction, unnest(list_distinct(CASE WHEN contains(parts[1], '{') THEN regexp_extract_all(parts[1], '\\{ENTITY_IMAGE-.*?\\}')
   ELSE regexp_extract_all(concat('{', trim(parts[1]), '}'), '\\{ENTITY_IMAGE-.*?\\}') END)) AS entity FROM p WHERE len(parts) = 2
 UNION ALL SELECT key, pos, trim(parts[3]), unnest([trim(parts[1]), trim(parts[2])]) FROM p WHERE len(parts) = 3)
SELECT key, entity, arg_max(prediction, pos) AS prediction FROM e GROUP BY key, entity""")
def r02(spark, d):
    return R.parse_arrows(_arrows(spark, d))


@query("r02_unparsed_arrows", ARROW_LINES + " SELECT key, CAST(pos AS BIGINT) AS pos, array_to_string(parts, '->') AS line FROM p WHERE len(parts) > 3")
def r02_bad(spark, d):
    return R.unparsed_arrows(_arrows(spark, d))


for _style in ("colon", "plain", "loose"):

    @query(f"r03_final_answer_{_style}", W + answer_sql(_style) + " SELECT key, prediction FROM answers")
    def r03(spark, d, style=_style):
        return _answers(spark, d, style).select("key", "prediction")


@query("r04_gold_text", "SELECT o_orderkey, array_to_string([CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority], ', ') AS gold FROM orders")
def r04(spark, d):
    values = F.array(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return I.table(spark, d, "orders").select("o_orderkey", A.gold_text(values).alias("gold"))


@query("r05_clean_string", f"SELECT doc_id, {clean('text')} AS cleaned FROM documents")
def r05(spark, d):
    return I.table(spark, d, "documents").select("doc_id", A.clean_string(F.col("text")).alias("cleaned"))


MATCHES = W + answer_sql("plain") + SCORED


@query("r06_exact_match", MATCHES + " SELECT key, is_exact FROM scored")
def r06(spark, d):
    return _answers(spark, d).select("key", A.exact_match(F.col("prediction"), F.col("gold")).alias("is_exact"))


NUMBERS = """concat(CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '.0') WHEN 1 THEN '1e1' WHEN 2 THEN concat(' ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',') ELSE 'nan' END)"""


@query("r07_numeric_match", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {NUMBERS} AS p, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS g FROM lineitem),
c AS (SELECT *, {clean('p')} AS cp, {clean('g')} AS cg FROM t),
n AS (SELECT *, TRY_CAST(cp AS DOUBLE) AS np, TRY_CAST(cg AS DOUBLE) AS ng FROM c)
SELECT l_linenumber, count(*) FILTER (WHERE cp = cg) AS exact, count(*) FILTER (WHERE cp = cg OR coalesce(NOT isnan(np) AND abs(np - ng) < 1e-6, false)) AS numeric_match, count(*) AS n FROM n GROUP BY l_linenumber""")
def r07(spark, d):
    q = F.col("l_quantity").cast("bigint").cast("string")
    case = F.col("l_linenumber") % 4
    p = F.when(case == 0, F.concat(q, F.lit(".0"))).when(case == 1, F.lit("1e1")).when(case == 2, F.concat(F.lit(" "), q, F.lit(","))).otherwise(F.lit("nan"))
    return I.table(spark, d, "lineitem").select("l_linenumber", p.alias("p"), q.alias("g")).groupBy("l_linenumber").agg(
        big(F.count_if(A.exact_match(F.col("p"), F.col("g"))), "exact"),
        big(F.count_if(A.numeric_match(F.col("p"), F.col("g"))), "numeric_match"),
        big(F.count(F.lit(1)), "n"),
    )


@query("r08_contains_match", MATCHES + " SELECT key, contains(p, g) AS is_contained FROM scored")
def r08(spark, d):
    return _answers(spark, d).select("key", A.contains_match(F.col("prediction"), F.col("gold")).alias("is_contained"))


@query("r09_literal_match", MATCHES + " SELECT key, is_literal FROM scored")
def r09(spark, d):
    return _answers(spark, d).select("key", A.literal_match(F.col("prediction"), F.col("gold")).alias("is_literal"))


@query("r10_token_f1", MATCHES + " SELECT key, tp, fp, fn, round(f1, 6) AS f1 FROM f1")
def r10(spark, d):
    p, g = F.col("prediction"), F.col("gold")
    return _answers(spark, d).select("key", A.token_counts(p, g).alias("c"), rounded(A.token_f1(p, g), "f1")).select(
        "key", "c.tp", "c.fp", "c.fn", "f1"
    )


def board_sql(groups: str, keys: str, error: str, base: str) -> str:
    ok = f"response <> '{error}'"
    return MATCHES + f"""
, s AS (SELECT {keys} count(*) AS n_all, count(*) FILTER (WHERE {ok}) AS n, count(*) FILTER (WHERE {ok} AND is_exact) AS exact,
  count(*) FILTER (WHERE {ok} AND is_substring) AS substring, count(*) FILTER (WHERE {ok} AND is_literal) AS literal, sum(f1) FILTER (WHERE {ok}) AS f FROM f1 {groups})
SELECT {keys} n_all, n, exact, substring, literal, round(exact / {base}, 6) AS exact_share, round(substring / {base}, 6) AS substring_share,
  round(literal / {base}, 6) AS literal_share, round(f / {base}, 6) AS mean_f1 FROM s"""


@query("r11_scoreboard", board_sql("GROUP BY kind", "kind,", A.ERROR_TEXT, "n"))
def r11(spark, d):
    return S.scoreboard(I.responses(spark, d), ["kind"])


@query("r11_scoreboard_all_rows", board_sql("", "", A.ERROR_TEXT_STRICT, "n_all"))
def r11_all(spark, d):
    return S.scoreboard(I.responses(spark, d), error_text=A.ERROR_TEXT_STRICT, divide_by="all")


@query("r11_scoreboard_rollup", board_sql("GROUP BY ROLLUP (source, kind)", "source, kind,", A.ERROR_TEXT, "n").replace("FROM responses)", "FROM (SELECT *, table_context % 3 AS source FROM responses))", 1))
def r11_rollup(spark, d):
    return S.scoreboard(I.responses(spark, d).withColumn("source", F.col("table_context") % 3), ["source", "kind"], rollup=True)


TAG_PRED = I.TABLE_SQL + """
, keyed AS (SELECT t.tag, t.col_idx, i.original_string AS gold, concat('K', i.qid) AS image_key, concat('{ENTITY_IMAGE-', t.col_idx, '}') AS entity FROM tags t JOIN image_tags i ON t.tag = i.tag)
, preds AS (SELECT concat('KQ', s_suppkey) AS image_key, CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) ELSE concat(s_name, ' Ltd') END AS prediction, '{ENTITY_IMAGE-0}' AS entity FROM supplier WHERE s_suppkey % 4 <> 0)"""


def _keyed_tags(spark, d):
    lines = I.facts(spark, d)
    attributes = I.image_tags(spark, d, lines)
    tags = C.explode_tags(I.cells(spark, d, lines)).select("tag", "col_idx")
    keyed = tags.join(attributes.select("tag", "qid"), "tag").select(
        "tag", "col_idx", F.concat(F.lit("K"), "qid").alias("image_key"),
        F.concat(F.lit("{ENTITY_IMAGE-"), F.col("col_idx").cast("string"), F.lit("}")).alias("entity"),
    )
    s = F.col("s_suppkey")
    predictions = I.table(spark, d, "supplier").where(s % 4 != 0).select(
        F.concat(F.lit("KQ"), s.cast("string")).alias("image_key"), F.lit("{ENTITY_IMAGE-0}").alias("entity"),
        F.when(s % 3 == 0, F.lower("s_name")).otherwise(F.concat("s_name", F.lit(" Ltd"))).alias("prediction"),
    )
    return keyed, predictions, attributes


@query("r12_tag_scoreboard", TAG_PRED + f"""
, responses AS (SELECT k.col_idx, gold, coalesce(p.prediction, 'error') AS prediction, p.prediction IS NOT NULL AS covered FROM keyed k LEFT JOIN preds p ON k.image_key = p.image_key AND k.entity = p.entity)
, answers AS (SELECT * FROM responses) {SCORED}
SELECT col_idx, count(*) AS n, count(*) FILTER (WHERE covered) AS covered, count(*) FILTER (WHERE is_exact) AS exact, count(*) FILTER (WHERE is_substring) AS substring,
  round(avg(f1), 6) AS mean_f1, round(count(*) FILTER (WHERE covered) / count(*), 6) AS coverage FROM f1 GROUP BY col_idx""")
def r12(spark, d):
    keyed, predictions, attributes = _keyed_tags(spark, d)
    return S.tag_scoreboard(keyed, predictions, attributes, ["col_idx"])


def gram_sql(tokens_p: str, tokens_g: str, source: str, orders: int) -> str:
    unions = []
    for n in range(1, orders + 1):
        for side in ("p", "g"):
            take = f"list_transform(range(1, len({side}) - {n} + 2), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))"
            unions.append(f"SELECT key, {n} AS n, unnest({take}) AS gram, {int(side == 'p')} AS is_p FROM tok")
    return f"""
, tok AS (SELECT key, {tokens_p} AS p, {tokens_g} AS g FROM {source})
, grams AS (SELECT key, n, gram, sum(is_p) AS in_p, sum(1 - is_p) AS in_g FROM ({' UNION ALL '.join(unions)}) GROUP BY ALL)"""


def bleu_tokens_sql(c: str) -> str:
    text = f"replace(replace(replace(replace(replace(replace(replace({c}, '<skipped>', ''), concat('-', chr(10)), ''), chr(10), ' '), '&quot;', chr(34)), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    text = f"concat(' ', {text}, ' ')"
    for pattern, put in (("([{-~\\[-` -&\\(-\\+:-@/])", " \\1 "), ("([^0-9])([\\.,])", "\\1 \\2 "), ("([\\.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 ")):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda x: x <> '')"


@query("r13_corpus_bleu", W + answer_sql("loose") + gram_sql(bleu_tokens_sql("prediction"), bleu_tokens_sql("gold"), "answers", 4) + """
, s AS (SELECT n, sum(least(in_p, in_g)) AS m, sum(in_p) AS t, sum(in_g) AS r FROM grams GROUP BY n)
, w AS (SELECT CAST(max(m) FILTER (WHERE n = 1) AS BIGINT) AS match_1, CAST(max(m) FILTER (WHERE n = 2) AS BIGINT) AS match_2, CAST(max(m) FILTER (WHERE n = 3) AS BIGINT) AS match_3,
  CAST(max(m) FILTER (WHERE n = 4) AS BIGINT) AS match_4, CAST(max(t) FILTER (WHERE n = 1) AS BIGINT) AS total_1, CAST(max(t) FILTER (WHERE n = 2) AS BIGINT) AS total_2,
  CAST(max(t) FILTER (WHERE n = 3) AS BIGINT) AS total_3, CAST(max(t) FILTER (WHERE n = 4) AS BIGINT) AS total_4, CAST(max(r) FILTER (WHERE n = 1) AS BIGINT) AS gold_length, sum(ln(m / t)) AS l FROM s)
SELECT * EXCLUDE (l), round(100 * CASE WHEN total_1 >= gold_length THEN 1 ELSE exp(1 - gold_length / total_1) END * exp(l / 4), 6) AS bleu FROM w""")
def r13(spark, d):
    return S.corpus_bleu(_answers(spark, d, "loose"))


@query("r14_rouge_n", W + answer_sql("loose") + gram_sql("regexp_extract_all(lower(prediction), '[a-z0-9]+')", "regexp_extract_all(lower(gold), '[a-z0-9]+')", "answers", 2) + """
, f AS (SELECT key, n, 2 * sum(least(in_p, in_g)) / sum(in_p + in_g) AS f FROM grams GROUP BY key, n)
SELECT a.key, round(coalesce(max(f) FILTER (WHERE n = 1), 0.0), 6) AS rouge1, round(coalesce(max(f) FILTER (WHERE n = 2), 0.0), 6) AS rouge2 FROM answers a LEFT JOIN f ON a.key = f.key GROUP BY a.key""")
def r14(spark, d):
    return S.rouge_n_rows(_answers(spark, d, "loose")).select("key", rounded("rouge1"), rounded("rouge2"))


@query("r14_rouge")
def r14_all(spark, d):
    """Adds ROUGE-L and Lsum, which SQL cannot say; tests check them by brute force."""
    return S.rouge(_answers(spark, d, "loose"))


@query("r11_free_text")
def r11_free_text(spark, d):
    """BLEU and ROUGE of free-text answers; tests check them by hand."""
    return S.free_text_scores(_answers(spark, d, "loose"))


@query("r15_merge_runs", W + """
SELECT key, CASE WHEN table_context % 3 = 0 THEN response WHEN table_context % 3 = 1 THEN concat('again ', response) ELSE '' END AS response FROM responses""")
def r15(spark, d):
    all_rows = I.responses(spark, d)
    rest = F.col("table_context") % 3
    again = all_rows.where(rest < 2).withColumn("response", F.concat(F.lit("again "), "response"))
    return R.merge_runs(all_rows, all_rows.where(rest == 0), again)


def batch_lines(spark, d):
    """Batch output lines; every seventh table's ids are unknown."""
    key = F.when(F.col("table_context") % 7 == 0, F.concat(F.lit("x"), "key")).otherwise(F.col("key"))
    message = F.struct(F.struct(F.col("response").alias("content")).alias("message"))
    body = F.struct(F.struct(F.array(message).alias("choices")).alias("body"))
    return I.responses(spark, d).select(F.to_json(F.struct(key.alias("custom_id"), body.alias("response"))).alias("value"))


@query("r16_flatten_batch", W + " SELECT key AS custom_id, response, gold AS gold_ans FROM responses WHERE table_context % 7 <> 0")
def r16(spark, d):
    gold = I.responses(spark, d).select("key", F.col("gold").alias("gold_ans"))
    return R.flatten_batch(batch_lines(spark, d), gold)


@query("r17_tag_predictions", TAG_PRED + f"""
SELECT k.tag, k.image_key, k.entity, coalesce(p.prediction, 'Couldn''t predict entity for this tag') AS prediction FROM keyed k LEFT JOIN preds p ON k.image_key = p.image_key AND k.entity = p.entity""")
def r17(spark, d):
    keyed, predictions, _ = _keyed_tags(spark, d)
    return R.tag_predictions(keyed, predictions).select("tag", "image_key", "entity", "prediction")


@query("r18_check_complete", W + """
SELECT key, 'missing' AS problem FROM responses WHERE table_context % 9 = 0 UNION ALL SELECT concat('x', key), 'unexpected' FROM responses WHERE table_context % 8 = 0""")
def r18(spark, d):
    rows = I.responses(spark, d)
    sent = rows.where(F.col("table_context") % 9 != 0).select("key").unionByName(
        rows.where(F.col("table_context") % 8 == 0).select(F.concat(F.lit("x"), "key").alias("key"))
    )
    return R.check_complete(sent, rows)


ATTRIBUTES_SQL = """
WITH attributes AS (SELECT p_size AS group_id, p_partkey AS image_id, unnest(['colour', 'object', 'type', 'brand']) AS attribute,
  unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type, p_brand]) AS value FROM part)
, keys AS (SELECT p_size AS group_id, min(p_partkey) AS image_id FROM part GROUP BY p_size)"""


def attribute_maps(spark, d):
    name = F.split("p_name", " ")
    values = F.create_map(
        F.lit("colour"), F.array(name[0]), F.lit("object"), F.array(name[1]), F.lit("type"), F.array("p_type"), F.lit("brand"), F.array("p_brand")
    )
    return I.table(spark, d, "part").select(F.col("p_size").alias("group_id"), F.col("p_partkey").alias("image_id"), values.alias("attributes"))


@query("r19_unique_attributes", ATTRIBUTES_SQL + """
SELECT a.group_id, a.image_id, a.attribute, a.value FROM attributes a JOIN keys k ON a.group_id = k.group_id AND a.image_id = k.image_id
WHERE NOT EXISTS (SELECT 1 FROM attributes o WHERE o.group_id = a.group_id AND o.image_id <> a.image_id AND o.attribute = a.attribute AND o.value = a.value)""")
def r19(spark, d):
    images = attribute_maps(spark, d)
    keys = images.groupBy("group_id").agg(F.min("image_id").alias("image_id"))
    return R.unique_attributes(R.attribute_rows(images, keep=("group_id", "image_id")), keys)


@query("r20_apply_overrides", """
SELECT o_orderkey AS key, CASE WHEN o_custkey % 5 = 0 THEN 'again' WHEN o_custkey % 3 = 0 THEN upper(o_orderpriority) ELSE o_orderstatus END AS value FROM orders""")
def r20(spark, d):
    base = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), "o_custkey", "o_orderpriority")
    fixed = base.where(F.col("o_custkey") % 3 == 0).withColumn("value", F.upper("o_orderpriority"))
    again = base.where(F.col("o_custkey") % 5 == 0).withColumn("value", F.lit("again"))
    return R.apply_overrides(base, fixed, again)


@query("r21_attach_attributes", """
SELECT concat_ws('/', CASE p_size % 2 WHEN 0 THEN 'posters' ELSE 'other' END, concat(p_partkey, '.jpg')) AS full_path, p_partkey % 6 = 0 AS is_missing, CASE WHEN p_partkey % 6 <> 0 THEN p_name END AS name FROM part""")
def r21(spark, d):
    parts = I.table(spark, d, "part")
    base = F.when(F.col("p_size") % 2 == 0, F.lit("posters")).otherwise(F.lit("other"))
    images = parts.select(base.alias("base_path"), F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image_path"))
    parsed = parts.where(F.col("p_partkey") % 6 != 0).select(
        F.concat(base, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"),
        F.create_map(F.lit("name"), F.array("p_name")).alias("attributes"),
    )
    return R.attach_attributes(images, parsed).select("full_path", "is_missing", F.col("attributes")["name"][0].alias("name"))


@query("r22_read_responses", W + " SELECT key, response, gold AS gold_ans, CASE WHEN table_context % 2 = 0 THEN question END AS prompt FROM responses")
def r22(spark, d):
    rows = I.responses(spark, d)
    flat = F.to_json(F.struct("key", "response", F.col("gold").alias("gold_ans")))
    keyed = F.to_json(F.create_map("key", F.struct(F.col("question").alias("text"), "response", F.col("gold").alias("gold_ans"))))
    return R.read_responses(rows.select(F.when(F.col("table_context") % 2 == 0, keyed).otherwise(flat).alias("value")))
