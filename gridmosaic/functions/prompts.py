"""Prompt texts built from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Context sentences, prompt layouts, number words.
CONTEXT_STYLES = {
    "captioning": ("{headers} of {title}.", "{title}."),
    "lower": ("Table related to {headers} in context of {title}.", "Table related to the {title}."),
    "upper": ("Table related to {headers} of {title}.", "Table related to the {title}."),
    "picture": ("Table related to {headers}.", "Table related to the {title}."),
}
TABLE_HEAD = "Table context: {context}\n\nTable:\n"
QUESTION_TAILS = {
    "lower": ("\n\nQuestion: {question}\nStep 1: ", "\n\nQuestion: {question}\nStep 1: {reason}\nStep 2: {answer}"),
    "upper": ("\n\nQuestion: {question}\nStep 1: ", "\n\nQuestion: {question}\nStep 1: {reason}\n\nStep 2: {answer}"),
    "captioning": (
        "\n\nEntities predicted:\n{entities}\n\nQuestion: {question}\n\nNow, Steps 1-2 are below for the given question:\n\n"
        "Step 1 Question Answering Reasoning:\n",
        "\n\nEntities predicted:\n{entities}\n\nQuestion: {question}\n\nAnswer:\n{answer}\n",
    ),
}
PICTURE_QUESTION = "Table context: {context}\n\nQuestion: {question}\n "
ONES = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")

SCALES = ((10**9, "billion"), (10**6, "million"), (10**3, "thousand"))


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled by columns; other text is kept."""
    names = "|".join(map(re.escape, values))
    parts = re.split(rf"\{{({names})\}}", template) if values else [template]
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def context_sentence(title: Column, headers: Column, style: str = "lower") -> Column:
    """One sentence on where a table comes from."""
    with_headers, without = CONTEXT_STYLES[style]
    return F.when(headers.isNull(), fill(without, title=title)).otherwise(fill(with_headers, title=title, headers=headers))


def number_word(n: Column) -> Column:
    """English words of a whole number below a trillion, digits beyond:
    hundreds and what follows are joined by ``and``, thousands by a comma."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))

    def small(v: Column) -> Column:
        ten = F.get(tens, (F.floor(v / 10) - 2).cast("int"))
        rest = F.when(v % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), F.get(ones, (v % 10).cast("int"))))
        return F.when(v < 20, F.get(ones, v.cast("int"))).otherwise(F.concat(ten, rest))

    def hundreds(v: Column) -> Column:
        head = F.concat(F.get(ones, F.floor(v / 100).cast("int")), F.lit(" hundred"))
        rest = F.when(v % 100 == 0, F.lit("")).otherwise(F.concat(F.lit(" and "), small(v % 100)))
        return F.when(v < 100, small(v)).otherwise(F.concat(head, rest))

    low = n % 1000
    groups = [F.when(F.floor(n / size) % 1000 > 0, F.concat(hundreds(F.floor(n / size) % 1000), F.lit(f" {name}"))) for size, name in SCALES]
    high = F.concat_ws(", ", *groups)
    tail = F.when(low == 0, F.lit("")).when(low < 100, F.concat(F.lit(" and "), small(low))).otherwise(F.concat(F.lit(", "), hundreds(low)))
    return F.when(n < 1000, hundreds(n)).when(n < 10**12, F.concat(high, tail)).otherwise(n.cast("string"))


def double_braces(col: Column) -> Column:
    """Braces doubled, so that a text survives a later template step."""
    return F.replace(F.replace(col, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def picture_name(table_id: Column) -> Column:
    return F.concat(F.replace(table_id.cast("string"), F.lit("/"), F.lit("_")), F.lit(".jpg"))


def reformatted_example(text: Column, response: Column) -> Column:
    """A saved example as steps: its question, the response, its answer up to ``##``."""
    before = F.split(text, "Answer: ")[0]
    answer = F.split(F.element_at(F.split(text, "Answer: "), -1), "##")[0]
    return F.concat(before, F.lit("Step 1 : "), response, F.lit(" Step 2 : "), answer)
