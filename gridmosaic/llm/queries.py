"""The operators of this subpackage on the driver tables, with oracle SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from gridmosaic.llm import chat, contamination, extraction, importance, lines, mixing, negatives, ngrams, quality, rules, spots, suffixes, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that must give the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS5 = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, chr(0))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r} AS u FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM totals),
leveled AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS wanted FROM weighed),
ordered AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM leveled),
targets AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, cap / weight) FROM ordered WHERE level <= cap / weight), cap)) AS target FROM ordered),
shared AS (SELECT doc_id, d.source, size, source_size, target, u, CASE WHEN source_size > 0 THEN least(target / source_size * 1.0::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS share
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, floor(share)::BIGINT AS whole, CASE WHEN share - floor(share) > 0 AND size > 0 THEN u * (1 - (share - floor(share)))
    / (u * (1 - (share - floor(share))) + (share - floor(share)) * (1 - u)) END AS rnk FROM shared),
lefts AS (SELECT source, any_value(target) - sum(whole * size) AS lft FROM ranked GROUP BY source),
run AS (SELECT r.*, l.lft, CASE WHEN rnk IS NOT NULL THEN sum(CASE WHEN rnk IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY r.source ORDER BY rnk NULLS LAST, doc_id, size
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM ranked r JOIN lefts l ON r.source IS NOT DISTINCT FROM l.source),
chosen AS (SELECT *, coalesce(upto <= lft, false) AS in_run FROM run),
gaps AS (SELECT source, any_value(target) - sum(size * (whole + in_run::INT)) AS gap FROM chosen GROUP BY source),
extra AS (SELECT source, arg_min(doc_id, o) AS doc_id, min(o) AS o FROM (SELECT c.source, doc_id, row(abs(size - gap), rnk, doc_id, size) AS o FROM chosen c JOIN gaps g ON c.source IS NOT DISTINCT FROM g.source
    WHERE rnk IS NOT NULL AND NOT in_run AND abs(size - gap) < gap) GROUP BY source)
SELECT c.doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM (
    SELECT c.*, (whole + CASE WHEN in_run OR (e.doc_id = c.doc_id) THEN 1 ELSE 0 END)::BIGINT AS copies FROM chosen c LEFT JOIN extra e ON c.source IS NOT DISTINCT FROM e.source) c
"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


LINES_SQL = """
WITH pages AS (SELECT source, string_split(text, chr(10)) AS lines, doc_id, text FROM documents),
totals AS (SELECT source, count(*) AS t FROM documents GROUP BY source),
bad AS (SELECT l.source, line FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM pages) l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
    WHERE length(trim(line, ' ')) > 0 GROUP BY l.source, line, t HAVING count(*) > 0.05 * t AND count(*) >= 5),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM (SELECT p.*, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS kept FROM pages p LEFT JOIN lists b ON p.source IS NOT DISTINCT FROM b.source)
"""


@query("op7_site_lines", LINES_SQL)
def op7_site_lines(spark, sf_dir):
    docs = lines.drop_site_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", "n_lines", "n_dropped", "text")


def _double(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>'), '<msg/>', '<\\msg/>')"


CHAT_SQL = rf"""
WITH all_turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS is_new FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
made AS (SELECT conv_id, count(*)::BIGINT AS n_turns, count_if(is_new)::BIGINT AS n_blocks, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({_double('text')}) + CASE WHEN is_new THEN 4 + length(replace({_double('role')}, ': ', ':\ ')) + 2 + 8 ELSE 6 END)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id)
SELECT * FROM made
"""


@query("op8_format_chat", CHAT_SQL)
def op8_format_chat(spark, sf_dir):
    trap = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), trap.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat.format_conversations(turns).withColumn("read", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    digest = F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return out.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), "n_blocks", digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


MEASURES = {"symbol_share": "n_symbols / word_chars", "mark_share": "n_marks / word_chars", "upper_share": "n_upper / word_chars",
            "repeat_share": "n_repeat_words / n_words", "dup_line_share": "n_dup_lines / n_lines"}
RULES_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS MATERIALIZED (SELECT l.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks FROM l LEFT JOIN cov ON l.doc_id = cov.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS MATERIALIZED (SELECT doc_id, lang, base_failed, unnest([{', '.join(f"{{'measure': '{k}', 'v': coalesce({e}, 0)}}" for k, e in MEASURES.items())}], recursive := true) FROM j),
labelled AS (SELECT v.*, good FROM v JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON v.doc_id = q.doc_id WHERE NOT base_failed),
grid AS (SELECT i + 1 AS j, round(1.0 - 0.02 * i, 2)::DOUBLE AS cutoff FROM range(50) r(i)),
tests AS (SELECT lang, measure, j, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (good AND v > cutoff) AS k_good, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (NOT good AND v > cutoff) AS k_bad
    FROM labelled, grid GROUP BY ALL),
terms AS (SELECT lang, measure, j, sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.01) + (n_good - i) * ln(0.99))) AS tail
    FROM (SELECT *, unnest(generate_series(0, k_good)) AS i FROM tests WHERE k_good < n_good * 0.01) GROUP BY ALL),
judged AS (SELECT t.*, sum((coalesce(x.tail, 1) > 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang, measure FROM tests)))::INT) OVER (PARTITION BY t.lang, t.measure ORDER BY t.j) AS failed,
    CASE WHEN n_bad > 0 THEN k_bad / n_bad ELSE 0 END - CASE WHEN n_good > 0 THEN k_good / n_good END AS gain
    FROM tests t LEFT JOIN terms x ON t.lang IS NOT DISTINCT FROM x.lang AND t.measure = x.measure AND t.j = x.j),
cuts AS (SELECT lang, measure, arg_max(cutoff, row(gain, -j)) AS cutoff FROM judged WHERE failed = 0 AND gain > 0 GROUP BY ALL),
over AS (SELECT DISTINCT doc_id FROM v JOIN cuts c ON v.lang IS NOT DISTINCT FROM c.lang AND v.measure = c.measure AND v.v > c.cutoff)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.doc_id IS NULL AS kept FROM j LEFT JOIN over o ON j.doc_id = o.doc_id
"""


@query("op9_quality_rules", RULES_SQL)
def op9_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = rules.apply_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def url_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list changes drawn from the events: each names the page whose id is its user; the type says what changes."""
    events, pages = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    named = events.join(pages.select("page_id", "url"), F.col("user_id") == F.col("page_id"))
    domain, address = F.concat(F.lit("domain:"), urls.host_of(F.col("url"))), F.concat(F.lit("address:"), urls.address_of(F.col("url")))
    return named.select(
        F.when(F.col("event_type").isin("error", "signup"), "block").otherwise("allow").alias("list"),
        F.when(F.col("event_id") % 2 == 0, domain).otherwise(address).alias("key"), F.col("ts").alias("at"), F.col("event_type").isin("error", "purchase").alias("added"))


URLS_SQL = r"""
WITH parts AS (SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
log AS (SELECT DISTINCT CASE WHEN event_type IN ('error', 'signup') THEN 'block' ELSE 'allow' END AS list, CASE WHEN event_id % 2 = 0 THEN 'domain:' || host ELSE 'address:' || host || path END AS key,
    ts AS changed, event_type IN ('error', 'purchase') AS added FROM events JOIN parts ON user_id = page_id),
valid AS (SELECT list, key, changed AS since, coalesce(lead(changed) OVER (PARTITION BY list, key ORDER BY changed, added), TIMESTAMP '9999-01-01') AS until, added FROM log WHERE key IS NOT NULL),
caps AS (SELECT page_id, url, host, path, make_timestamp((epoch_us(TIMESTAMP '2024-01-01') + ('0x' || substr(md5(url), 1, 8))::BIGINT % 2592000 * 1000000)::BIGINT) AS fetched_at FROM parts),
keys AS (SELECT DISTINCT page_id, url, fetched_at, key FROM (SELECT page_id, url, fetched_at, 'address:' || host || path AS key FROM caps
    UNION ALL SELECT page_id, url, fetched_at, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') FROM (SELECT *, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM caps))),
hit AS (SELECT page_id, count(*) FILTER (list = 'block') AS nb, count(*) FILTER (list = 'allow') AS na, min(k.key) FILTER (list = 'block') AS be, min(k.key) FILTER (list = 'allow') AS ae
    FROM keys k JOIN valid v ON k.key = v.key AND added AND since <= fetched_at AND fetched_at < until AND since < until GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at::TIMESTAMPTZ AS fetched_at, coalesce(nb, 0)::BIGINT AS n_block, coalesce(na, 0)::BIGINT AS n_allow, coalesce(ae, be) AS entry, coalesce(nb, 0) = 0 OR coalesce(na, 0) > 0 AS kept
FROM caps c LEFT JOIN hit h ON c.page_id = h.page_id
"""


@query("op10_url_lists", URLS_SQL)
def op10_url_lists(spark, sf_dir):
    # The pages carry no fetch time: a second of January 2024, fixed by the address.
    second = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % 2592000
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + second).alias("fetched_at"))
    return urls.filter_captures(captures, url_log(spark, sf_dir), bucket_days=1)


@query("op1_quality_gam")
def op1_quality_gam(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS5} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS s FROM i)),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query("op5_phrase_index", CONTAMINATION_SQL)
def op5_phrase_index(spark, sf_dir):
    return contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text")


@query("op3_ngram_join")
def op3_ngram_join(spark, sf_dir):
    return ngrams.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op4_main_text")
def op4_main_text(spark, sf_dir):
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


@query("op6_suffix_repeats")
def op6_suffix_repeats(spark, sf_dir):
    out = suffixes.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


NEGATIVES_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


_COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(spots.COMMON_WORDS))
SPOTS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t)::BIGINT AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS MATERIALIZED (SELECT doc_id, t, n, nx, left(t, n - n // 2) || left(nx, n // 2) AS ed FROM n),
texts AS MATERIALIZED (SELECT text, {_WORDS5} AS w FROM (SELECT t AS text FROM e UNION SELECT ed FROM e)),
parts AS (SELECT text, list_filter(w, lambda x: NOT list_contains([{_COMMON}], x)) AS c FROM texts),
places AS (SELECT text, x, x IN ({_COMMON}) AS anchor, sum((x NOT IN ({_COMMON}))::INT) OVER (PARTITION BY text ORDER BY i) AS k
    FROM (SELECT text, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts)),
chains AS (SELECT text, list_sort(list(DISTINCT substr(md5(x || ' ' || array_to_string(list_slice(c, k::BIGINT + 1, k::BIGINT + 3), ' ')), 1, 8))) AS s
    FROM places JOIN parts USING (text) WHERE anchor AND k + 3 <= len(c) GROUP BY text),
sets AS MATERIALIZED (SELECT text, CASE WHEN text = '' THEN []::VARCHAR[] WHEN s IS NOT NULL THEN s
    ELSE [substr(md5(CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE text END), 1, 8)] END AS s FROM texts LEFT JOIN chains USING (text)),
pairs AS (SELECT doc_id, n, sha256(ed) AS edited_sha256, a.s AS a, b.s AS b, c.s AS c FROM e JOIN sets a ON t = a.text JOIN sets b ON ed = b.text JOIN sets c ON nx = c.text)
SELECT doc_id, n AS n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
    CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS near_edited,
    CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / len(list_distinct(list_concat(a, c))) END AS near_next
FROM pairs
"""


@query("op12_spot_fingerprints", SPOTS_SQL)
def op12_spot_fingerprints(spark, sf_dir):
    return spots.fingerprints(table(spark, sf_dir, "documents"))


# The checksum of a word: its bytes folded through the table of the usual reflected polynomial, which is made by its rule.
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
RESAMPLE_SQL = f"""
WITH RECURSIVE steps AS (SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT byte, {_CRC_STEP.format('c')}, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS tab FROM steps WHERE k = 8),
dw AS MATERIALIZED (SELECT doc_id, unnest({_WORDS5}) AS w FROM documents),
tw AS MATERIALIZED (SELECT unnest({_WORDS5}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM vocabulary, crc),
ds AS (SELECT b, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY b),
ts AS (SELECT b, count(*) AS t FROM tw JOIN hashed USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM ds)::BIGINT + 10000)::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM ts)::BIGINT + 10000)::DOUBLE))) AS g
    FROM ds LEFT JOIN ts USING (b)),
wide AS (SELECT doc_id, count(*)::BIGINT AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN wide USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
