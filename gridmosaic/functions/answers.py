"""Model responses: slicing, cleaning and pairwise match tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridmosaic.functions.tags import strip, substitute

# Response markers and sentences.
STEP_MARKERS = {"colon": "Step 2:", "plain": "Step 2", "loose": "Step 2"}
LEADING_DROPS = {"colon": (), "plain": (":\n",), "loose": (":\n", ": ")}
ERROR_TEXT = "Error occurred."
ERROR_TEXT_STRICT = "An error occured."
NOT_A_POSTER = "This is not a movie poster"
FENCES = ("```json\n", "\n```", "```JSON\n", "\n```", "```")
MISSING_PREDICTION = "Couldn't predict entity for this tag"


def clean_string(col: Column) -> Column:
    """The form in which answers are compared."""
    text = substitute(F.lower(strip(col)), [("\n", " "), ("\\n", " "), (",", ""), ("-", " "), (":", " ")])
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def tokens(col: Column) -> Column:
    """Distinct tokens of a cleaned string; empty for an empty string."""
    cleaned = clean_string(col)
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(cleaned, " ")))


def exact_match(prediction: Column, gold: Column) -> Column:
    return clean_string(prediction) == clean_string(gold)


def number(col: Column) -> Column:
    """A cleaned text as a number, or null. Signs, digits, a point, an exponent,
    ``nan`` and ``inf`` are read; type suffixes such as ``5f`` are no numbers."""
    plain = col.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$")
    named = F.when(col.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(col.rlike(r"^\+?inf(?:inity)?$"), F.lit(float("inf"))).when(
        col.rlike(r"^-inf(?:inity)?$"), F.lit(float("-inf")))
    return F.when(plain, col.try_cast("double")).otherwise(named)


def near_numbers(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """Both cleaned texts are numbers and closer than ``tol``."""
    x, y = number(a), number(b)
    return F.coalesce((F.abs(x - y) < tol) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def numeric_match(prediction: Column, gold: Column, tol: float = 1e-6) -> Column:
    """Equal strings, or both numbers and closer than ``tol``."""
    return exact_match(prediction, gold) | near_numbers(clean_string(prediction), clean_string(gold), tol)


def contains_match(prediction: Column, gold: Column) -> Column:
    """Cleaned gold inside cleaned prediction; empty gold always matches."""
    return F.contains(clean_string(prediction), clean_string(gold))


def literal_match(prediction: Column, gold: Column) -> Column:
    """Raw gold inside raw prediction."""
    return F.contains(prediction, gold)


def token_counts(prediction: Column, gold: Column) -> Column:
    """Struct(tp, fp, fn) over the token sets."""
    p, g = tokens(prediction), tokens(gold)
    return F.struct(
        F.size(F.array_intersect(p, g)).cast("bigint").alias("tp"),
        F.size(F.array_except(p, g)).cast("bigint").alias("fp"),
        F.size(F.array_except(g, p)).cast("bigint").alias("fn"),
    )


def f1_of_counts(counts: Column) -> Column:
    """2PR / (P + R), which is 2tp / (2tp + fp + fn); 0 without a hit."""
    tp = counts["tp"].cast("double")
    return F.when(counts["tp"] == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + counts["fp"] + counts["fn"]))


def token_f1(prediction: Column, gold: Column) -> Column:
    return f1_of_counts(token_counts(prediction, gold))


def cut_ends(col: Column, n: int) -> Column:
    """Drop n characters at each end."""
    return F.substring(col, F.lit(n + 1), F.greatest(F.length(col) - 2 * n, F.lit(0)))


def final_answer(col: Column, style: str = "plain") -> Column:
    """The answer after the last step marker, list brackets removed.

    Styles: ``colon`` looks for ``Step 2:``; ``plain`` for ``Step 2`` and drops
    a leading colon with a line break; ``loose`` also drops a colon and space.
    """
    text = strip(F.substring_index(col, STEP_MARKERS[style], -1))
    drops = LEADING_DROPS[style]
    if drops:
        starts = [F.startswith(text, F.lit(d)) for d in drops]
        hit = starts[0]
        for s in starts[1:]:
            hit = hit | s
        text = F.when(hit, F.substring(text, F.lit(3), F.length(text))).otherwise(text)
    text = F.when(F.startswith(text, F.lit("['")), cut_ends(text, 2)).otherwise(text)
    return F.when(F.startswith(text, F.lit("[")), cut_ends(text, 1)).otherwise(text)


def gold_text(values: Column) -> Column:
    """A list of answers as one text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ", ")


def json_slice(col: Column) -> Column:
    """Text without code fences, from the first ``{`` to the last ``}``.

    Without an opening brace only a closing brace at the very end is left;
    without a closing one nothing is.
    """
    text = substitute(col, [(f, "") for f in FENCES])
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return (
        F.when(~F.contains(text, F.lit("}")), F.lit(""))
        .when(start == 0, F.when(F.endswith(text, F.lit("}")), F.lit("}")).otherwise(F.lit("")))
        .when(end < start, F.lit(""))
        .otherwise(F.substring(text, start, end - start + 1))
    )


def parse_json_response(col: Column) -> Column:
    """Struct(json_text, parsed, is_parsed): null stays null, unparsed text is kept."""
    poster = F.contains(col, F.lit(NOT_A_POSTER))
    text = F.when(poster, F.lit('{"imagetype": "This is not a movie poster"}')).otherwise(json_slice(col))
    parsed = F.try_parse_json(text)
    return F.when(col.isNotNull(), F.struct(text.alias("json_text"), parsed.alias("parsed"), parsed.isNotNull().alias("is_parsed")))
