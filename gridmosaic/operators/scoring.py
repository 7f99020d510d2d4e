"""Scores of predictions against gold answers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from gridmosaic.functions import answers as A
from gridmosaic.functions.tags import substitute

# How the published BLEU evaluation parts marks from words.
BLEU_SPLITS = (
    (r"([\{-~\[-` -&\(-\+:-@/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
)
WORD_OR_MARK = r"(?U)\w+|[^\w\s]"
BLEU_ORDER = 4


def score_rows(df: DataFrame, prediction: str = "prediction", gold: str = "gold", numeric: bool = False) -> DataFrame:
    """Match flags, token counts and F1 of each row.

    The two texts are cleaned once each, not once per test.
    """
    p, g = F.col("__p"), F.col("__g")
    cleaned = df.withColumn("__p", A.clean_string(F.col(prediction))).withColumn("__g", A.clean_string(F.col(gold)))

    def words(c: Column) -> Column:
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, " ")))

    exact = p == g
    if numeric:
        exact = exact | A.near_numbers(p, g)
    counts = F.struct(
        F.size(F.array_intersect(words(p), words(g))).cast("bigint").alias("tp"),
        F.size(F.array_except(words(p), words(g))).cast("bigint").alias("fp"),
        F.size(F.array_except(words(g), words(p))).cast("bigint").alias("fn"),
    )
    return (
        cleaned.withColumn("is_exact", exact)
        .withColumn("is_substring", F.col("is_exact") | F.contains(p, g))
        .withColumn("is_literal", A.literal_match(F.col(prediction), F.col(gold)))
        .withColumn("counts", counts)
        .withColumn("f1", A.f1_of_counts(F.col("counts")))
        .drop("__p", "__g")
    )


def scoreboard(
    responses: DataFrame,
    group_cols: Sequence[str] = (),
    error_text: str = A.ERROR_TEXT,
    divide_by: str = "scored",
    style: str = "plain",
    numeric: bool = False,
    rollup: bool = False,
) -> DataFrame:
    """Exact, substring and literal shares and mean F1 per group.

    Rows whose response is ``error_text`` are dropped; ``divide_by`` chooses
    whether shares are over the scored rows or over all rows.
    """
    is_error = F.col("response") == error_text
    total = responses.withColumn("__error", is_error).withColumn(
        "prediction", F.when(~is_error, A.final_answer(F.col("response"), style))
    )
    scored = score_rows(total, numeric=numeric)
    groups = scored.rollup(*group_cols) if rollup else scored.groupBy(*group_cols)
    ok = ~F.col("__error")
    sums = groups.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(ok).alias("n"),
        F.count_if(ok & F.col("is_exact")).alias("exact"),
        F.count_if(ok & F.col("is_substring")).alias("substring"),
        F.count_if(ok & F.col("is_literal")).alias("literal"),
        F.sum(F.when(ok, F.col("f1"))).alias("__f1"),
    )
    base = F.col("n_all") if divide_by == "all" else F.col("n")
    share = {c: F.try_divide(F.col(c).cast("double"), base) for c in ("exact", "substring", "literal")}
    return sums.select(
        *group_cols, "n_all", "n", "exact", "substring", "literal",
        *[F.round(v, 6).alias(f"{k}_share") for k, v in share.items()],
        F.round(F.try_divide("__f1", base), 6).alias("mean_f1"),
    )


def tag_scoreboard(tags: DataFrame, predictions: DataFrame, image_tags: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Score predicted entities of tags against their original strings; a tag
    without a prediction counts as ``error``. Coverage is predicted / all."""
    joined = (
        tags.join(image_tags.select("tag", F.col("original_string").alias("gold")), "tag")
        .join(predictions.select("image_key", "entity", "prediction"), ["image_key", "entity"], "left")
        .withColumn("is_covered", F.col("prediction").isNotNull())
        .withColumn("prediction", F.coalesce("prediction", F.lit("error")))
    )
    sums = score_rows(joined).groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_covered").alias("covered"),
        F.count_if("is_exact").alias("exact"),
        F.count_if("is_substring").alias("substring"),
        F.round(F.avg("f1"), 6).alias("mean_f1"),
    )
    return sums.withColumn("coverage", F.round(F.col("covered").cast("double") / F.col("n"), 6))


def word_tokens(col: Column) -> Column:
    """Words, and every other mark by itself."""
    return F.regexp_extract_all(col, F.lit(WORD_OR_MARK), F.lit(0))


def rouge_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column, n: int, glue: str = " ") -> Column:
    """n-grams of a token array as strings, repeats kept.

    Built by zipping shifted copies, so the array is walked n times and never
    sliced per element.
    """
    grams = tokens
    for k in range(1, n):
        length = F.greatest(F.size(tokens) - k, F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), length), F.slice(tokens, F.lit(k + 1), length), _glued(glue))
    return grams


def _glued(glue: str):
    return lambda a, b: F.concat(a, F.lit(glue), b)


def gram_matches(orders: int):
    """A column function of two token arrays: per order the clipped common
    n-grams, then per order those of the first, then of the second."""

    @pandas_udf(ArrayType(LongType()))
    def count(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a, b) -> list[int]:
            common, in_a, in_b = [], [], []
            for n in range(1, orders + 1):
                p, g = (Counter(zip(*(t[k:] for k in range(n)))) for t in (list(a), list(b)))
                common.append(sum((p & g).values()))
                in_a.append(p.total())
                in_b.append(g.total())
            return common + in_a + in_b

        return pd.Series([one(a, b) for a, b in zip(left, right)])

    return count


def bleu_tokens(col: Column) -> Column:
    """The tokens of the published BLEU evaluation: marks stand alone, but for
    points and commas between digits, hyphens and apostrophes of words."""
    text = substitute(col, [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")])
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, put in BLEU_SPLITS:
        text = F.regexp_replace(text, pattern, put)
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def corpus_bleu(df: DataFrame, key: str = "key", prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """Corpus BLEU with one reference per row and exponential smoothing; 0
    without any match. Counted inside the rows, then summed.

    One row: clipped matches and totals per order, lengths, and the score."""
    counts = df.select(gram_matches(BLEU_ORDER)(bleu_tokens(F.col(prediction)), bleu_tokens(F.col(gold))).alias("c"))
    names = [f"match_{n}" for n in range(1, BLEU_ORDER + 1)] + [f"total_{n}" for n in range(1, BLEU_ORDER + 1)] + ["gold_length"]
    sums = counts.agg(*[F.coalesce(F.sum(F.col("c")[i]), F.lit(0)).alias(name) for i, name in enumerate(names)])
    logs, halvings = F.lit(0.0), F.lit(0)
    for n in range(1, BLEU_ORDER + 1):
        m, t = F.col(f"match_{n}").cast("double"), F.col(f"total_{n}").cast("double")
        halvings = halvings + F.when((m == 0) & (t > 0), 1).otherwise(0)
        logs = logs + F.log(F.when(m > 0, m / t).when(t > 0, 1.0 / (F.pow(F.lit(2.0), halvings) * t)))
    length = F.col("total_1").cast("double")
    penalty = F.when(length >= F.col("gold_length"), F.lit(1.0)).otherwise(F.exp(1 - F.col("gold_length") / length))
    score = F.when(F.col("match_1") > 0, 100 * penalty * F.exp(logs / BLEU_ORDER))
    return sums.withColumn("bleu", F.round(F.coalesce(score, F.lit(0.0)), 6))


def rouge_n_rows(df: DataFrame, key: str = "key", prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """ROUGE-1 and ROUGE-2 F of each row."""
    counted = df.select(key, gram_matches(2)(rouge_tokens(F.col(prediction)), rouge_tokens(F.col(gold))).alias("c"))

    def f(n: int) -> Column:
        both = F.col("c")[n + 1] + F.col("c")[n + 3]
        return F.when(both > 0, 2 * F.col("c")[n - 1].cast("double") / both).otherwise(F.lit(0.0)).alias(f"rouge{n}")

    return counted.select(key, f(1), f(2))


@pandas_udf(LongType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest common subsequence length of two token arrays, by bit vectors."""

    def one(a, b) -> int:
        where: dict[str, int] = {}
        for i, token in enumerate(a):
            where[token] = where.get(token, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for token in b:
            hits = row & where.get(token, 0)
            row = ((row + hits) | (row - hits)) & full
        return len(a) - row.bit_count()

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int64")


def rouge_l_rows(df: DataFrame, key: str = "key", prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """ROUGE-L F of each row."""
    p, g = rouge_tokens(F.col(prediction)), rouge_tokens(F.col(gold))
    base = df.select(key, p.alias("__p"), g.alias("__g"))
    both = F.size("__p") + F.size("__g")
    return base.select(
        key,
        F.when(both == 0, F.lit(0.0)).otherwise(2.0 * lcs_length("__p", "__g") / both).alias("rougeL"),
    )


@pandas_udf(LongType())
def summary_hits(left: pd.Series, right: pd.Series) -> pd.Series:
    """Tokens of the gold lines that lie on a longest common subsequence with
    any line of the prediction, each token as often as both texts have it."""

    def on_path(gold: list[str], line: list[str]) -> set[int]:
        table = [[0] * (len(line) + 1) for _ in range(len(gold) + 1)]
        for i, g in enumerate(gold):
            for j, p in enumerate(line):
                table[i + 1][j + 1] = table[i][j] + 1 if g == p else max(table[i][j + 1], table[i + 1][j])
        found, i, j = set(), len(gold), len(line)
        while i and j:
            if gold[i - 1] == line[j - 1]:
                i, j = i - 1, j - 1
                found.add(i)
            elif table[i][j - 1] > table[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return found

    def one(a, b) -> int:
        lines, golds = [list(x) for x in a], [list(x) for x in b]
        free_p, free_g, hits = Counter(t for x in lines for t in x), Counter(t for x in golds for t in x), 0
        for gold in golds:
            for i in sorted(set().union(*(on_path(gold, line) for line in lines))):
                if free_p[gold[i]] > 0 and free_g[gold[i]] > 0:
                    free_p[gold[i]] -= 1
                    free_g[gold[i]] -= 1
                    hits += 1
        return hits

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int64")


def rouge_lsum_rows(df: DataFrame, key: str = "key", prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """ROUGE-Lsum F of each row: lines are the sentences."""
    p, g = (F.transform(F.split(F.col(c), "\n"), rouge_tokens) for c in (prediction, gold))
    base = df.select(key, p.alias("__p"), g.alias("__g"))
    both = F.size(F.flatten("__p")) + F.size(F.flatten("__g"))
    return base.select(key, F.when(both == 0, F.lit(0.0)).otherwise(2.0 * summary_hits("__p", "__g") / both).alias("rougeLsum"))


def rouge(df: DataFrame, key: str = "key", prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """Mean ROUGE-1, ROUGE-2, ROUGE-L and ROUGE-Lsum F."""
    n = rouge_n_rows(df, key, prediction, gold)
    return n.join(rouge_l_rows(df, key, prediction, gold), key).join(rouge_lsum_rows(df, key, prediction, gold), key).agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")]
    )


def free_text_scores(responses: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """BLEU and ROUGE of free-text answers in one row; a response that speaks of
    an error, in any case, counts as empty. ``responses``: key and both texts."""
    said = F.coalesce(F.col(prediction), F.lit(""))
    kept = responses.select("key", F.when(F.contains(F.lower(said), F.lit("error")), "").otherwise(said).alias("prediction"), F.col(gold).alias("gold"))
    bleu = corpus_bleu(kept).select("bleu")
    return rouge(kept).withColumn("bleu", bleu.scalar())
