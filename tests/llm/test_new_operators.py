"""Hard negatives, spot signatures and importance resampling: odd input, plain versions, and how much the intervals leave."""

import math
import random
from collections import Counter
from hashlib import md5, sha256
from itertools import islice
from zlib import crc32

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmosaic.llm import importance, negatives, ngrams, spots

VECTORS = "vec_id long, label int, embedding array<float>"


def plain_negatives(rows, every=100):
    vectors = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = set()
    for a, (label, v) in vectors.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in vectors.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(i, -s) for s, i, other in scored if other != label and 30 * -minus <= 100 * -s <= 90 * -minus]
            out |= {(a, p, k, i, -minus, s) for k, (i, s) in enumerate(fit[:10], 1)}
    return out


def clustered(n, d, rng):
    centres = rng.normal(size=(4, d))
    v = centres[rng.integers(4, size=n)] + rng.normal(size=(n, d)) * 0.7
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_hard_negatives_in_many_blocks(spark):
    rng = np.random.default_rng(5)
    v = clustered(700, 24, rng)
    rows = [(i, int(rng.integers(3)), [float(x) for x in v[i]]) for i in range(700)]
    rows[300] = (300, rows[310][1], rows[310][2])  # an anchor equal to another row
    rows[5], rows[6] = (5, rows[5][1], [0.0] * 24), (6, rows[6][1], rows[7][2])  # nothing, and a tie
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_negatives(rows, 20)
    for sizes in ((8192, 2048), (100, 5)):
        got = negatives.mine_hard_negatives(df, anchor_every=20, block_rows=sizes[0], anchor_rows=sizes[1])
        assert set(map(tuple, got.collect())) == want


def test_hard_negative_cases(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (-100, 1, [0.0, 0.0])]
    odd = [(None, 1, [1.0, 0.0]), (7, None, [1.0, 0.0]), (8, 2, None), (9, 2, [None, 1.0]), (10, 2, [nan, 1.0]), (11, 2, [inf, 1.0]), (12, 2, []), (13, 2, [1e7, 0.0]), (2, 2, [0.5, 0.5])]
    df = spark.createDataFrame(sound + odd + [(200, 5, [1.0])], VECTORS).withColumn("rank", F.lit("x"))
    got = set(map(tuple, negatives.mine_hard_negatives(df).collect()))
    assert got == plain_negatives(sound) and (0, 1, 1, 2, 256 * 230, 256 * 128) in got
    assert negatives.mine_hard_negatives(df.limit(0)).isEmpty()


def test_intervals_hold_and_thin_out():
    rng = np.random.default_rng(2)
    ints = np.floor(256 * clustered(4000, 64, rng)).astype(np.int32)
    codes, aligned, rest = negatives.encode(ints)
    block = negatives.Block(np.arange(4000), np.zeros(4000, np.int64), ints, codes, aligned, rest)
    anchor = negatives.Anchor(ints[17])
    exact = ints.astype(np.int64) @ ints[17].astype(np.int64)
    left = []

    def check(rows):
        def keep(low, high):
            now = exact[check.rows]
            assert (low <= now).all() and (now <= high).all()
            kept = high >= np.sort(exact)[-10]
            check.rows = check.rows[kept]
            left.append(len(check.rows))
            return kept
        check.rows = rows
        return keep

    rows = np.arange(4000)
    assert set(np.argsort(-exact, kind="stable")[:10]) <= set(anchor.narrow(block, rows, check(rows)))
    assert left == sorted(left, reverse=True) and left[0] < 2000 and left[-1] < 1000  # the other three clusters go at once, then part of its own


def plain_signatures(text):
    words = brute.TOKEN.findall(brute.low(text))
    common, found = set(spots.COMMON_WORDS), set()
    for k, w in enumerate(words):
        chain = list(islice((x for x in islice(words, k + 1, None) if x not in common), 3)) if w in common else []
        if len(chain) == 3:
            found.add(md5(" ".join([w, *chain]).encode()).hexdigest()[:8])
    if not found and text:
        found = {md5((" ".join(words) or text).encode()).hexdigest()[:8]}
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_fingerprints(docs):
    out = []
    for k, (i, text) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1] or ""
        text = text or ""
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, b, c = map(plain_signatures, (text, edited, other))
        out.append((i, len(text), sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), jaccard(a, b), jaccard(a, c)))
    return out


def test_spot_fingerprints(spark):
    rng = random.Random(3)
    words = spots.COMMON_WORDS + [f"w{k}é" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) + rng.choice(["", "!", "\n"]) for _ in range(150)]
    docs = [(7 * k - 300, t) for k, t in enumerate(["", None, "***", "###", "The", *texts, " ".join(rng.choices(words, k=3000)), texts[3]])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_chars string").repartition(5)
    for bucket_rows in (4096, 10):
        assert sorted(map(tuple, spots.fingerprints(df, bucket_rows).collect())) == plain_fingerprints(docs)


def test_spot_cases(spark):
    schema = "doc_id long, text string"
    one = spots.fingerprints(spark.createDataFrame([(4, "the one two three")], schema)).collect()
    assert [r["near_next"] for r in one] == [1.0] and one[0]["edited_sha256"] == sha256(b"the one tthe one ").hexdigest()
    rows = spark.createDataFrame([(None, "the a b c"), (None, None), (2, "x"), (2, "x"), (2, "y")], schema)
    got = spots.fingerprints(rows, 1).collect()
    assert len(got) == 5 and sum(r["doc_id"] is None for r in got) == 2
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, spots.fingerprints(rows.repartition(3)).collect()), key=str)
    assert spots.fingerprints(rows.limit(0)).isEmpty()
    assert spots.likeness([b"a"], [b"a", b"b"], 0.6) == 0.0 and spots.likeness([b"a"], [b"a", b"b"]) == 0.5


def plain_resampling(docs, target, n, buckets=10_000):
    def features(text):
        w = brute.TOKEN.findall(brute.low(text))
        return [crc32(" ".join(w[k: k + m]).encode()) % buckets for m in range(1, n + 1) for k in range(len(w) - m + 1)], len(w)

    s, t = (Counter(b for _, x in rows for b in features(x)[0]) for rows in (docs, target))
    s_all, t_all = s.total(), t.total()
    out = []
    for i, text in docs:
        f, words = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in f) // len(f) if f else 0
        h = int(sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    enough = sorted((-r[3], r[0]) for r in out if r[4] >= 20)
    place = {i: k for k, (_, i) in enumerate(enough[: 10 * len(enough) // 100], 1)}
    return [(*r[:4], place.get(r[0])) for r in out]


@pytest.mark.parametrize("n", [1, 3])
def test_importance_resampling(spark, monkeypatch, n):
    monkeypatch.setattr(importance, "JOINED_BYTES", 500)
    monkeypatch.setattr(importance, "BLOCK_WORDS", 17)
    rng = random.Random(n)
    words = [f"W{k}" for k in range(30)] + ["é", "İx", "\n", "\u0085y"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 15, 25, 60])))) for k in range(400)] + [(400, None), (401, "..."), (402, " ".join(rng.choices(words, k=20_000)))]
    target = [(k, " ".join(rng.choices(words[:5], k=30))) for k in range(10)] + [(10, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    got = importance.resample(df, spark.createDataFrame(target, "item_id long, text string"), n=n)
    assert sorted(map(tuple, got.collect())) == plain_resampling(docs, target, n)


def test_resampling_cases(spark):
    schema = "doc_id long, text string"
    long = " ".join(["w"] * 25)
    rows = spark.createDataFrame([(None, long), (None, None), (3, long), (3, long), *[(k, long) for k in range(10, 26)]], schema)
    none = rows.limit(0)
    got = importance.resample(rows, none).collect()
    assert len(got) == 20 and sorted(r["rank"] for r in got if r["rank"]) == [1] and all(r["n_features"] in (0, 49) for r in got)
    assert importance.resample(none, rows).isEmpty()
    every = importance.resample(rows, rows, share=(1, 1)).collect()
    assert sorted(r["rank"] for r in every if r["rank"]) == list(range(1, 20))
    by_rank = sorted((r for r in every if r["rank"]), key=lambda r: r["rank"])
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in by_rank]
    assert keys == sorted(keys)


def test_long_words_that_a_polynomial_would_confuse(make):
    """A word that doubles itself with a and b swapped, and its swap: different words, so different sets."""
    swap = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(10):
        word += word.translate(swap)
    got = {r["doc_id"]: r["component_id"] for r in ngrams.near_duplicates(make([(1, word), (2, word.translate(swap)), (3, word)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
