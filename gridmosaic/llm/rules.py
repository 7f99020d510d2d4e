"""Quality rules whose cutoffs are certified on labelled documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmosaic.llm.common import WORD, stage

# Measures, from the loosest to the strictest cutoff. A document above the cutoff of its stratum is rejected.
CUTOFFS = {
    "symbol_share": tuple(round(1.0 - 0.02 * i, 2) for i in range(50)),
    "mark_share": tuple(round(1.0 - 0.02 * i, 2) for i in range(50)),
    "upper_share": tuple(round(1.0 - 0.02 * i, 2) for i in range(50)),
    "repeat_share": tuple(round(1.0 - 0.02 * i, 2) for i in range(50)),
    "dup_line_share": tuple(round(1.0 - 0.02 * i, 2) for i in range(50)),
}
TAIL_TERMS = 2000


def _windows(words: Column) -> Column:
    """The 3-word windows as strings: words hold no blank, so joined by one they are equal only if their words are."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    return F.when(F.size(words) >= 3, F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def base_measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts of each whole text; null text counts as empty.

    Equal 3-word windows stand side by side once sorted; the starts of repeated ones, sorted again, each add what lies before
    the next start, 3 at most. Texts without an equal pair skip the sort.

    Returns the columns `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, body.alias("__text")).select(*keep, "__text", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    rows = rows.withColumn("__lines", lines).withColumn("__windows", _windows(F.col("__words")))
    rows = rows.withColumn("__pairs", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))

    def same(x: Column, at: Column) -> Column:
        return F.coalesce(F.get("__pairs", at)["w"] == x["w"], F.lit(False))

    repeated = F.filter("__pairs", lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
    rows = rows.withColumn("__at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(pattern: str) -> Column:
        return F.regexp_count("__text", F.lit(pattern)).cast("long")

    chars = F.length(F.regexp_replace("__text", r"[\x20\x09-\x0D]+", ""))
    return rows.select(
        *keep, F.size("__words").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_upper"), count("!").alias("n_marks"))


def shares(measures: DataFrame) -> DataFrame:
    """The measures of the rules, as shares; 0 where there is nothing to divide by."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return measures.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "mark_share": share("n_marks", "word_chars"), "upper_share": share("n_upper", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines")})


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, brought back by ten factors; exact to about 1e-13."""
    z = n.cast("double") + F.lit(11.0)
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z)
    down = sum((F.log(n.cast("double") + F.lit(float(k))) for k in range(1, 11)), F.lit(0.0))
    return series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), not less than the true value.

    For k below the mean the terms fall from k downwards; the first `TAIL_TERMS` are added, and a geometric
    series bounds the rest. At or above the mean the value is set to 1, which no level of confidence accepts.
    """
    terms = F.sequence(F.lit(1), F.least(k, F.lit(TAIL_TERMS)).cast("int"))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * F.lit(odds)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    summed = F.when(k > 0, F.aggregate(F.when(k > 0, terms), start, step)).otherwise(start)
    rest = F.when(k > TAIL_TERMS, summed["term"] / (1 - k / (n - k + 1) * F.lit(odds))).otherwise(F.lit(0.0))
    log_first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p)
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(log_first + F.log(summed["sum"] + rest)))


def certified_cutoffs(
    labelled: DataFrame, stratum: str = "lang", good: str = "quality", cutoffs: dict[str, tuple[float, ...]] | None = None,
    max_false_rejection: float = 0.05, confidence: float = 0.95,
) -> DataFrame:
    """The cutoff of each measure and stratum, if one is certified.

    `labelled` has the measures, `stratum` and `good` (1: to keep). Each measure gets an equal part a of the
    false rejections allowed in a stratum. A cutoff that rejects k of n good documents is certified if the exact binomial tail
    P(X <= k | n, a) is at most the level, the same as an exact upper bound of the rate below a. Over strata and measures the level is
    divided by their number (Bonferroni); within one, the cutoffs are tested from the loosest on and the tests end at
    the first failure (fixed sequence), which needs no more correction. So with the given confidence
    no stratum loses more than `max_false_rejection` of its good documents. Of certified cutoffs the one with the largest share of
    bad minus share of good documents rejected is taken, the loosest of equals; if none rejects more of the bad than of the good, there is none.

    Counts are sums over a histogram of cutoffs passed, combined before the shuffle. Null labels and measures are left out;
    a null stratum is a stratum. Returns stratum, measure, cutoff, n_good, k_good, n_bad, k_bad, tail.
    """
    cutoffs = cutoffs or CUTOFFS
    part = max_false_rejection / len(cutoffs)
    graded = labelled.filter(F.col(good).isNotNull())
    # How many cutoffs of a measure the document is above: they are in falling order, so it is above the last ones.
    def passed(measure: str, values: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in values]), lambda c: F.col(measure) > c))

    per_measure = [F.struct(F.lit(m).alias("measure"), passed(m, cs).alias("passed")) for m, cs in cutoffs.items()]
    rows = graded.select(F.col(stratum).alias("stratum"), (F.col(good) == 1).alias("is_good"), F.inline(F.array(*per_measure)))
    grid = rows.groupBy("stratum", "measure", "passed").agg(
        F.sum(F.col("is_good").cast("long")).alias("good"), F.sum((~F.col("is_good")).cast("long")).alias("bad"))
    sizes = F.create_map(*[F.lit(x) for m, cs in cutoffs.items() for x in (m, len(cs))])
    values = F.create_map(*[x for m, cs in cutoffs.items() for x in (F.lit(m), F.array(*[F.lit(float(c)) for c in cs]))])
    # Cutoff j (1 = loosest) rejects those that are above at least size - j + 1 cutoffs.
    group = grid.groupBy("stratum", "measure").agg(F.collect_list(F.struct("passed", "good", "bad")).alias("h"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    tests = group.withColumn("size", sizes[F.col("measure")]).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("size"))))

    def above(field: str) -> Column:
        return F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["passed"] >= F.col("size") - F.col("j") + 1, x[field]).otherwise(F.lit(0).cast("long")))

    tests = tests.select("stratum", "measure", "j", values[F.col("measure")][F.col("j") - 1].alias("cutoff"), "n_good", above("good").alias("k_good"), "n_bad", above("bad").alias("k_bad"))
    tests = tests.withColumn("tail", F.when(F.col("n_good") > 0, binomial_tail(F.col("k_good"), F.col("n_good"), part)).otherwise(F.lit(1.0)))
    level = F.lit(1 - confidence) / (F.count(F.lit(1)).over(W.partitionBy("j").orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    tests = tests.withColumn("level", level)
    sequence = W.partitionBy("stratum", "measure").orderBy("j")
    certified = tests.withColumn("failed", F.sum((F.col("tail") > F.col("level")).cast("int")).over(sequence)).filter(F.col("failed") == 0)
    gain = F.when(F.col("n_bad") > 0, F.col("k_bad") / F.col("n_bad")).otherwise(F.lit(0.0)) - F.col("k_good") / F.col("n_good")
    best = certified.withColumn("gain", gain).filter(F.col("gain") > 0)
    row = F.struct("cutoff", "n_good", "k_good", "n_bad", "k_bad", "tail")
    return best.groupBy("stratum", "measure").agg(F.max_by(row, F.struct("gain", -F.col("j"))).alias("r")).select("stratum", "measure", "r.*")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", good: str = "quality", max_false_rejection: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """Base counts and verdict of every document.

    A document fails the base if it has under 50 words or more than half of its words stand in repeated 3-word windows. Else it is
    kept unless a measure is above the certified cutoff of its stratum (`certified_cutoffs` on all labelled documents that pass the base).
    Null text: no words, base_failed. Documents without a label are judged alike. Labels given twice for a document count
    once (the lowest). Other columns are dropped. Empty table: no rows.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum and the shares.
    """
    measured = stage(shares(base_measures(docs.select("doc_id", F.col(stratum).alias("stratum"), "text"), keep=("doc_id", "stratum"))), "rule-measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    graded = labels.filter(F.col(good).isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good"))
    cuts = certified_cutoffs(measured.filter(~F.col("base_failed")).join(graded, "doc_id"), "stratum", "good", None, max_false_rejection, confidence)
    table = cuts.groupBy(F.col("stratum").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("cuts"))
    judged = measured.join(table, F.col("stratum").eqNullSafe(F.col("s")), "left")
    over = F.lit(False)
    for m in CUTOFFS:
        over = over | F.coalesce(F.col(m) > F.col("cuts")[m], F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"), "stratum", *CUTOFFS)
