"""The registered queries beside their SQL or a plain version, on the smallest tables."""

import hashlib

import brute
import oracle
import pytest

from gridmosaic.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql(spark, con, name):
    ok, note = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates(spark, texts):
    got = {r[0]: (r[1], r[2]) for r in QUERIES["op3_ngram_join"](spark, SF).collect()}
    assert got == brute.near_duplicates(texts)


def test_repeats(spark, texts):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op6_suffix_repeats"](spark, SF).collect()}
    assert got == {i: (*v[:3], brute.sha(v[3])) for i, v in brute.repeats(texts).items()}


def test_base_counts_of_rules(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, SF).collect()}
    for i, text in texts:
        want, r = brute.base_counts(text), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_on_held_out_documents(spark):
    scored = QUERIES["op1_quality_gam"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_main_text_is_the_article(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    right = 0
    for r in QUERIES["op4_main_text"](spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        right += r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    assert right >= 0.98 * len(pages)


def test_main_text_in_other_layouts(spark):
    """The same pages with another element in place of the article, or none: no empty texts, nearly all words."""
    import html
    import re
    from collections import Counter

    from gridmosaic.llm import extraction

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for start, end in (("<div>", "</div>"), ("<section>", "</section>"), ('<div class="qx-71" id="zorp">', "</div>"), ('<div class="richText">', "</div>"), ("", "")):
        pages = spark.createDataFrame([(r["page_id"], r["url"], r["html"].replace("<article>", start).replace("</article>", end)) for r in rows], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in extraction.extract_main_text(pages).collect()}
        for r in rows:
            article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
            want, have = Counter(html.unescape(re.sub(r"<[^>]+>", " ", article)).split()), Counter(got[r["page_id"]].split())
            assert have and 2 * (want & have).total() >= 0.9 * (want.total() + have.total()), (start, r["page_id"])


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from gridmosaic.llm.common import stage

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in pipeline.STAGES:
        out = stage(step(spark, docs, SF), "test-pipeline")
        kept.append((name, docs, out))
        docs = out
    (_, _, good), (_, before, clean), (_, _, single), (_, _, decent), (_, _, mixed) = kept
    for out in (good, clean, single, decent):
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
    rows = [tuple(r) for r in clean.select("doc_id", "text").collect()]
    want = {i for i, (_, root) in brute.near_duplicates(rows).items() if root == i}
    assert {r[0] for r in single.select("doc_id").collect()} == want
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in single.select("doc_id", "text").collect()]
    want = {i for i, (n, hit, _) in brute.contamination(rows, items).items() if not (hit and 20 * hit >= n)}
    assert {r[0] for r in decent.select("doc_id").collect()} == want == {r[0] for r in mixed.select("doc_id").collect()}
    again = pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_digest_of_format(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by_conv = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by_conv.setdefault(r["conv_id"], []).append(f"{r['role']}\n{r['text'] or ''}\n")
    got = {r["conv_id"]: r["turns_sha256"] for r in QUERIES["op8_format_chat"](spark, SF).collect()}
    trap = "\\### Assistant: </turn> ok"
    by_conv[-7] = [f"user\n{trap}\n", f"assistant\n{trap}\n"]
    assert got == {c: hashlib.sha256("".join(t).encode()).hexdigest() for c, t in by_conv.items()}
