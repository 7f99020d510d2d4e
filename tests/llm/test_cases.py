"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmosaic.llm import chat, contamination, extraction, lines, mixing, ngrams, quality, rules, suffixes, urls

LONG = " ".join(f"w{k * k % 9973}" for k in range(30_000))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_features_of_odd_texts():
    for text in (None, "", " \n\t", "a", "\ud7ff é", LONG):
        values = quality.text_features(text)
        assert len(values) == len(quality.FEATURES) and all(np.isfinite(values))


def test_quality_scores(make, spark):
    docs = make([(None, "x"), (1, None), (2, ""), (2, ""), *[(k, "plain words in a row here" if k % 3 else "### $$$ ###") for k in range(3, 200)]])
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(3, 200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs.withColumn("score", F.lit(9)), labels).collect()
    assert len(out) == 201 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out if (r["doc_id"] or 0) > 2) >= 195
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("text like '#%'").isEmpty()
    none = quality.score_documents(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert quality.score_documents(docs.limit(0), labels).isEmpty()


def test_lookup_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # a pure interaction
    model = quality.fit(x, y, pair_rounds=80, n_pairs=2)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95 and (0, 1) in model.pairs


def test_mix_caps_and_targets(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(totals, (1, 2, 3), 3.0).collect()}
    # weights a 1, b 2, c 3, null 1: a stops at 30, c at 0, the rest 2 to 1
    assert got["a"] == 30 and got["c"] == 0 and got["b"] == pytest.approx(1980 * 2 / 3) and got[None] == pytest.approx(1980 / 3)


def test_mix_cases(make):
    docs = make([(1, None, "a"), (2, "", "a"), (3, "x y z", None), (4, LONG, "b"), (4, LONG, "b"), (None, "u v", "b"), *[(k, "one two three", "a") for k in range(5, 400)]])
    out = mixing.mix_sources(docs.withColumn("size", F.lit("?")).withColumn("rank", F.lit(1)))
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    a = [r for r in got if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 3
    assert rows_of(out) == rows_of(mixing.mix_sources(docs))
    assert mixing.mix_sources(docs.limit(0)).isEmpty()
    weighed = mixing.mix_sources(docs.withColumn("w", F.when(F.col("doc_id") < 100, 5.0).otherwise(0.5)), importance="w").filter("source = 'a'").collect()
    mean = [np.mean([r["copies"] for r in weighed if (r["doc_id"] < 100) == low and r["size"]]) for low in (True, False)]
    assert mean[0] > 2 * mean[1]


def test_site_lines_cases(make):
    rows = [(k, f"head\nown {k}\n\nhead", "h") for k in range(20)] + [(100, None, "h"), (101, "", None), (102, "head\nx", "one page"), (0, "head\nown 0\n\nhead", "h")]
    docs = make(rows).withColumn("n_lines", F.lit("?"))
    out = {(r["doc_id"], r["source"]): r for r in lines.drop_site_lines(docs).collect()}
    assert out[(3, "h")]["text"] == "own 3\n" and out[(3, "h")]["n_dropped"] == 2 and out[(3, "h")]["n_lines"] == 4
    assert out[(100, "h")]["text"] is None and out[(100, "h")]["n_lines"] == 0
    assert out[(101, None)]["text"] == "" and out[(102, "one page")]["text"] == "head\nx"
    assert lines.drop_site_lines(docs).count() == len(rows) and lines.drop_site_lines(docs.limit(0)).isEmpty()


def test_ngram_cases(make):
    base = LONG.split()[:400]
    near = base[:]
    near[200] = "changed"
    rows = [(9, " ".join(base)), (3, " ".join(near)), (5, None), (6, ""), (7, " \n"), (20, "A b"), (21, "a B"), (22, "b a"), (30, LONG), (30, LONG), (None, " ".join(base)), (40, "a a a a a a a"), (41, "a a a a a")]
    docs = make(rows).withColumn("n", F.lit("?")).withColumn("a", F.lit("?"))
    got = {(r["doc_id"]): (r["n_shingles"], r["component_id"]) for r in ngrams.near_duplicates(docs).collect()}
    assert got[9] == (396, 3) and got[3] == (396, 3) and got[None] == (396, 3)
    assert got[5] == (0, 5) and got[6] == (0, 6) and got[7] == (0, 7)
    assert got[20] == (1, 20) and got[21] == (1, 20) and got[22] == (1, 22) and got[40] == (1, 40) and got[41] == (1, 40) and got[30][1] == 30
    assert {r[0] for r in ngrams.one_of_each_group(docs).select("doc_id").collect()} == {3, 5, 6, 7, 20, 22, 30, 40, None}
    assert ngrams.near_duplicates(docs.limit(0)).isEmpty()


def test_ngram_chain_and_common_passage(make):
    """Chains of similar texts whose ends are not similar, and a passage in many otherwise different texts."""
    rng = np.random.default_rng(5)
    words = [f"v{k}" for k in range(300)]
    rows = [(0, " ".join(words))]
    for k in range(1, 25):
        words = words[6:] + [f"n{k}-{j}" for j in range(6)]
        rows.append((k, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(40))
    for k in range(100, 160):
        own = " ".join(f"o{int(x)}" for x in rng.integers(10**9, size=int(rng.integers(5, 120))))
        rows.append((k, f"{passage} {own}"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.near_duplicates(make(rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_filter_size_changes_nothing(make):
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(60):
        w = base[:] if k % 2 else [f"x{int(x)}" for x in rng.integers(1000, size=60)]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"c{int(rng.integers(10**6))}"
        rows.append((k, " ".join(w)))
    want = brute.near_duplicates(rows)
    for bits in (8, 1 << 12):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.near_duplicates(make(rows), bits).collect()} == want
    long_rows = [(k, f"{t} é {t}") for k, t in rows]
    want = brute.repeats(long_rows)
    for bits in (8, 1 << 12):
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.drop_repeats(make(long_rows), filter_bits=bits).collect()} == want


def test_repeat_cases(make):
    once = "é" + LONG[:700]
    rows = [(5, None), (6, ""), (7, once), (3, "x" + once), (4, "ab" * 400), (8, once[:90]), (9, "\x00" * 250), (10, once[50:250] + "tail"), (11, LONG[:700])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.drop_repeats(make(rows).withColumn("kept", F.lit(1)).withColumn("k1", F.lit(1))).collect()}
    assert got == brute.repeats(rows)
    twice = suffixes.drop_repeats(make([(1, once), (1, once), (None, once)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in twice) == [("1", 702), ("1", 702), ("None", 0)]
    assert suffixes.drop_repeats(make(rows).limit(0)).isEmpty()


def test_contamination_cases(make, spark):
    item = " ".join(f"t{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item), (1, "Short Item."), (2, None), (3, "--"), (4, item.upper()), (None, "lone word pair here")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, f"pre {item}, post"), (4, " ".join(item.split()[:12])), (5, "a short, item b"), (6, "lone word pair here"), (7, " ".join(["x"] * 500) + " short item"), (8, f"{item} {item}"), (8, f"{item} {item}"), (9, LONG)]
    out = contamination.find_contamination(make(rows).withColumn("n_hit", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("term", F.lit(2)), bench)
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute.contamination(rows, [("" if i is None else i, t) for i, t in [tuple(r) for r in bench.collect()]])
    for i, (n, hit, names) in want.items():
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, hit, len(names), brute.sha(",".join(names))), i
        assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert out.count() == len(rows)
    docs = make(rows)
    assert {r[0] for r in contamination.drop_contaminated(docs, bench).select("doc_id").collect()} == {1, 2, 4, 7, 9}
    assert contamination.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").isEmpty() and contamination.find_contamination(docs.limit(0), bench).isEmpty()


def test_proximity(make, spark):
    docs = contamination.keyed(make([(1, "alpha x x beta"), (2, "alpha " + "x " * 50 + "beta"), (3, "beta alpha")]))
    assert {r["k1"] for r in contamination.proximity_matches(docs, ["alpha", "beta"], 5).collect()} == {1, 3}
    assert contamination.proximity_matches(docs, ["alpha", "gamma"], 5).isEmpty()


def test_chat_cases(spark):
    nasty = ["", None, "\\", "\\\\", "##", "#####", "### user: hi</turn>\n", "<msg/>", "<\\msg/>", "</turn>", "\\</turn>\n### assistant: x", "a: b", "é\n\n", "#\\#"]
    rows = [(1, k, ("user", "assistant", "assistant", "a: b#", None)[k % 5], t) for k, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", LONG), (2, 0, "assistant", LONG), (None, 1, "user", "x"), (3, None, "user", "late"), (3, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in out.select("*", chat.parse_formatted(F.col("formatted")).alias("read"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["read"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv]["loss"] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["n_blocks"] == 1 + sum((a[2] or "") != (b[2] or "") for a, b in zip(mine, mine[1:]))
    assert chat.format_conversations(turns.limit(0)).isEmpty()


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.1), (0, 1, 0.01), (40, 1000, 0.05), (4000, 100_000, 0.05), (4900, 100_000, 0.05)]
    for k, n, p in cases:
        got = spark.range(1).select(rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(brute.binomial_tail(k, n, p), rel=1e-7), (k, n, p)
    assert spark.range(1).select(rules.binomial_tail(F.lit(5).cast("long"), F.lit(10).cast("long"), 0.1)).first()[0] == 1.0


def test_certified_cutoffs(spark):
    rows = [(k, None if k % 2 else "en", 1, 0.1 if k % 1000 else 0.9) for k in range(8000)] + [(k, "en", 0, 0.8) for k in range(50)] + [(1, "xx", 1, 0.1), (2, "xx", 0, 0.9), (3, "en", None, 0.9)]
    graded = spark.createDataFrame(rows, "doc_id long, lang string, quality int, m double")
    cuts = {r["stratum"]: r for r in rules.certified_cutoffs(graded, cutoffs={"m": (1.0, 0.85, 0.5, 0.05)}).collect()}
    # 4000 good documents each; 0.5 rejects 4 to 8 of them and all bad ones, 0.05 all good ones; the null stratum has no bad documents
    assert cuts["en"]["cutoff"] == 0.5 and cuts["en"]["k_bad"] == 50 and cuts["en"]["tail"] < 0.05 / 3
    assert set(cuts) == {"en"}


def test_rules_cases(make, spark):
    docs = make([(1, None), (2, ""), (3, LONG), (3, LONG), (None, "a b c " * 30), (5, "x\nx\n \nx")]).withColumn("kept", F.lit(1)).withColumn("stratum", F.lit(1))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = rules.apply_rules(docs, labels).collect()
    assert len(out) == 6
    for r in out:
        text = {1: None, 2: "", 3: LONG, None: "a b c " * 30, 5: "x\nx\n \nx"}[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.base_counts(text)
    assert rules.apply_rules(docs.limit(0), labels).isEmpty()


def test_url_cases(spark):
    log = spark.createDataFrame([
        ("block", "domain:b.com", "2024-01-01 00:00:00", True), ("block", "domain:b.com", "2024-01-20 00:00:00", False), ("block", "domain:b.com", "2024-01-20 00:00:00", False),
        ("allow", "address:a.b.com/x", "2024-01-05 00:00:00", True), ("block", "domain:c.com", "2024-01-03 00:00:00", False), ("block", "domain:c.com", "2024-01-03 00:00:00", True),
        ("block", None, "2024-01-01 00:00:00", True), ("block", "domain:d.com", None, True)], "list string, key string, at string, added boolean").withColumn("at", F.col("at").cast("timestamp"))
    rows = [(1, "http://a.b.com/x?q", "2024-01-02 00:00:00"), (1, "http://a.b.com/x?q", "2024-01-02 00:00:00"), (2, "https://u@A.B.COM:80/x#f", "2024-01-05 00:00:00"), (3, "http://b.com./y", "2024-01-19 23:59:59"),
            (4, "http://b.com/y", "2024-01-20 00:00:00"), (5, "http://c.com", "2024-01-03 00:00:00"), (6, None, "2024-01-03 00:00:00"), (7, "http://b.com", None), (8, "no url", "2024-01-03 00:00:00"),
            (9, "http://bb.com/", "2024-01-03 00:00:00"), (10, "http://" + "a." * 300 + "b.com/", "2024-01-03 00:00:00"), (11, "http://b.com/" + "p/" * 5000, "2023-12-31 00:00:00")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("key", F.lit(1)).withColumn("kept", F.lit(1))
    for days in (1, 7, 365):
        out = urls.filter_captures(captures, log, days)
        got = {r["page_id"]: r for r in out.collect()}
        assert {i for i, r in got.items() if not r["kept"]} == {1, 3, 5, 10} and out.count() == len(rows)
        assert got[2]["n_allow"] == 1 and got[2]["entry"] == "address:a.b.com/x" and got[1]["entry"] == "domain:b.com"
        assert urls.filter_captures(captures.limit(0), log, days).isEmpty() and urls.filter_captures(captures, log.limit(0), days).filter("not kept").isEmpty()


def test_url_intervals_against_a_plain_look_up(spark):
    rng = np.random.default_rng(8)
    log = [("block", f"domain:h{int(rng.integers(3))}.com", int(rng.integers(10**6)) * 7, bool(rng.integers(2))) for _ in range(300)]
    caps = [(k, f"http://h{int(rng.integers(4))}.com/", int(rng.integers(10**6)) * 7) for k in range(200)]
    entries = spark.createDataFrame(log, "list string, key string, at long, added boolean").withColumn("at", F.timestamp_seconds("at"))
    captures = spark.createDataFrame(caps, "page_id long, url string, at long").withColumn("fetched_at", F.timestamp_seconds("at"))
    got = {r["page_id"]: r["kept"] for r in urls.filter_captures(captures, entries, 3).collect()}
    for k, url, at in caps:
        past = sorted((t, added) for _, key, t, added in log if key == "domain:" + url[7:-1] and t <= at)
        assert got[k] == (not past or not past[-1][1])


def test_extraction_cases(spark):
    article = "".join(f"<p>Paragraph {k} tells a story, with a clause, and it ends well. It has a second sentence &amp; more.</p>" for k in range(6))
    rows = [(1, "u", None), (2, "u", ""), (3, "u", f"<html><body><nav><ul><li><a href=/x>Home</a></ul></nav><article><h1>A\n &lt;Title&gt;</h1>{article}</article><footer>&copy; x</footer></body></html>"),
            (4, "u", "<p"), (5, "u", "<script>never"), (6, "u", "<div>" * 3000 + "deep" + "</p>" * 10), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    out = extraction.extract_main_text(pages).collect()
    got = {r["page_id"]: r["text"] for r in out if not (r["page_id"] == 3 and r["text"] == "")}
    assert got[1] == got[2] == got[5] == ""
    lines_ = got[3].split("\n")
    assert lines_[0] == "A <Title>" and len(lines_) == 7 and lines_[1].endswith("sentence & more.")
    assert all(r["n_chars"] == len(r["text"]) for r in out) and len(out) == len(rows)
    assert extraction.extract_main_text(pages.limit(0)).isEmpty()


def test_page_tree():
    page = extraction.read_page("<body>a<p>b<p>c<b>d</b><ul><li>e<li>f</ul>g<!-- x --><style>h</style><br>i</body>")
    assert [t for t in page.texts if t] == ["a", "b", "cd", "e", "f", "g i"]
    assert [t for t in extraction.read_page("1 < 2 &amp; 3 > 2 <a title='>'>x</a>").texts if t] == ["1 < 2 & 3 > 2 x"]


def test_formulas_are_text_but_not_their_annotations():
    page = extraction.read_page("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> and more.</p>")
    assert [t for t in page.texts if t] == ["Energy is E=m and more."]


def test_word_weights_and_pages_without_their_article():
    source = '<div class="blurbZone"><p>A b c.</p></div><article id="x"><p>D e f.</p><div class="menu"><p>G</p></div></article>'
    page = extraction.read_page(source)
    label = extraction.marked_labels(page)
    assert [t for t, y in zip(page.texts, label) if y] == ["D e f."]
    bare = page.without_article(None)
    assert [t for t in bare.texts if t] == ["A b c.", "D e f.", "G"] and extraction.GROUPS["article"] not in bare.group
    assert all(0 <= bare.parent[i] < i for i in range(1, len(bare.parent))) and bare.parent.count(0) == 3
    swapped = page.without_article(extraction.GROUPS["section"], extraction.word_buckets('class="q"'))
    assert swapped.parent == page.parent and swapped.group.count(extraction.GROUPS["section"]) == 1 and page.group.count(extraction.GROUPS["article"]) == 1
    weights = extraction.word_weights([page] * 20, [label] * 20)
    (zone,) = extraction.word_buckets("class=zone")
    (own,) = extraction.word_buckets("id=x")
    assert weights[zone] < -1 < 0 < weights[own] and np.count_nonzero(weights) <= 4


def test_node_sums_against_plain_loops():
    page = extraction.read_page('<div class="a"><p>One, two.</p><ul><li><a href=x>three</a><li>four</ul></div><div id="b">five</div>')
    weights = np.zeros(extraction.BUCKETS)
    weights[list(extraction.word_buckets("class=a"))], weights[list(extraction.word_buckets("class=b"))] = 2.0, -1.0
    rows = extraction.node_features(page, weights)

    def above(i):
        return [i] + (above(page.parent[i]) if page.parent[i] >= 0 else [])

    for i in range(len(page.parent)):
        inside = [j for j in range(len(page.parent)) if i in above(j)]
        size = sum(len(page.texts[j]) for j in inside)
        assert rows[i, 2] == len(above(i)) - 1 and np.isclose(rows[i, 7], np.log1p(size))
        assert np.isclose(rows[i, 9], sum(page.linked[j] for j in inside) / max(size, 1))
        own = [sum(weights[w] for w in page.words[j]) for j in above(i)]
        assert rows[i, 14] == min([0, *own]) and rows[i, 15] == max([0, *own])


def test_decode_keeps_no_child_of_a_dropped_node():
    page = extraction.Page()
    for parent in (-1, 0, 1, 1, 0):
        page.add(parent, 7)
    assert extraction.decode(page, np.array([0, -5.0, 2.0, 1.0, -1.0])) == [True, False, False, False, False]
    assert extraction.decode(page, np.array([0, -5.0, 4.0, 2.0, 1.0])) == [True, True, True, True, True]


def test_large_grams_are_split(make):
    """One phrase in a third of the rows, with other words around it each time: its grams are far larger than a shard."""
    rng = random.Random(5)
    phrase = " ".join(rng.choice(LONG.split()) + str(rng.randrange(99)) for _ in range(9))[:70]
    copied = [phrase + " and what follows it in some rows " + "".join(rng.choice("abc ") for _ in range(k)) for k in (20, 60)]

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    rows = [(k, noise(60) + (rng.choice([phrase, phrase, *copied]) + noise(rng.choice([3, 60])) if k % 3 == 0 else "") + noise(60)) for k in range(360)]
    rows += [(1000 + k, rows[3 * k][1][30:]) for k in range(20)]
    want = brute.repeats(rows)
    assert sum(w[1] for w in want.values()) > 2000
    for options in ({"shard_bytes": 400, "sample": 1, "hot_runs": 5}, {"shard_bytes": 3000}):
        out = suffixes.drop_repeats(make(rows), **options)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()} == want


def test_parts_of_a_large_gram():
    """Equal windows keep one key however often a gram is split, and keys of different windows get few."""
    rng = random.Random(6)
    phrase = bytes(rng.randrange(97, 123) for _ in range(60))
    strings = [bytes(rng.randrange(97, 123) for _ in range(60)) + phrase + bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(50)]
    strings += strings[:5]
    raw, bounds = np.frombuffer(b"".join(strings), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    for depth, most in ((2, 55), (4, 40), (0, 2)):
        string, offset, length, key, prints = suffixes.parts_of(raw, bounds, np.zeros(len(strings), dtype=np.int64), 100, 20, depth)
        keys, seen = {}, {}
        for s, o, n, k in zip(string, offset, length, key):
            keys.setdefault(k, set()).add(s)
            for w in range(o, o + n - 99):
                assert seen.setdefault(strings[s][w: w + 100], k) == k
        assert sum(length - 99) == sum(len(s) - 99 for s in strings)
        assert max(map(len, keys.values())) <= most, depth


@pytest.mark.parametrize("name", ["button", "svg", "select", "object", "noscript", "iframe", "audio", "title", "canvas"])
def test_unclosed_elements_lose_no_text(name):
    article = "<p>First.</p><p>Last.</p>"
    for source in (f"<body><p>Top.</p><{name} class='x'>{article}", f"<html><{name}>{article}</html>", f"<p>Top.</p><{name}>in</{name}><{name}>{article}"):
        texts = [t for t in extraction.read_page(source).texts if t]
        assert texts[-2:] == ["First.", "Last."] and "in" not in texts, source


def test_heads_without_end_and_growing_letters():
    def texts(source):
        return [t for t in extraction.read_page(source).texts if t]

    assert texts("<html><head><meta charset=x><title>T</title><style>p{}</style><article><p>One.</p></article>") == ["One."]
    assert texts("<head><title>T</title><p>One.</p><script>x</script><p>Two.") == ["One.", "Two."]
    assert texts("<head><title>T</title><link></head><body><p>One.</p></body>") == ["One."]
    assert texts("<head><style>p{}</head><body><p>One.</p></body>") == ["One."]
    assert texts("<p>One.</p><script>x <p>no</p>") == ["One."]
    grown = "İ" * 40
    for name in ("script", "style", "button", "noscript", "svg"):
        assert texts(f"<p>{grown}</p><{name}>no</{name.upper()}><p>Text after it.</p><{name}>no</{name}><p>More.</p>") == [grown, "Text after it.", "More."]
    assert texts("<svg><svg>a</svg>b</svg><p>x</p>") == ["x"]
    assert texts("<noscript><!-- </noscript> -->no</noscript><p>x</p>") == ["x"]
    assert texts("<svg><style>a</style>b</svg><p>x</p>") == ["x"]


def test_one_of_each_group_with_shared_ids(make):
    """Unlike text under an id whose other row goes stays, and repeated rows of the smallest id leave one."""
    words = LONG.split()
    text, other, third = " ".join(words[:300]), " ".join(words[1000:1300]), " ".join(words[2000:2300])
    rows = [(1, text), (2, text + " more"), (2, other), (3, third), (3, third), (4, third + " end"), (5, ""), (5, ""), (None, text)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in ngrams.one_of_each_group(make(rows)).collect())
    assert got == sorted([("1", text), ("2", other), ("3", third), ("5", ""), ("5", ""), ("None", text)])
    assert ngrams.one_of_each_group(make(rows)).columns == make(rows).columns


def test_stages_give_small_batches_and_restore_the_setting(make, spark):
    from gridmosaic.llm.common import BATCH_ROWS, stage

    def count_rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 25, 1, 1).mapInArrow(count_rows, "n long")
    before = spark.conf.get(BATCH_ROWS)
    assert [r["n"] for r in stage(rows, "batches", 10).collect()] == [10, 10, 5]
    assert [r["n"] for r in stage(rows, "batches").collect()] == [25]
    with pytest.raises(Exception):
        stage(spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), "fails", 10)
    assert spark.conf.get(BATCH_ROWS) == before
