"""Image and entity tags inside cells, and the small text tests around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gridmosaic.functions.values import once

# The tag formats and the header words of notes columns.
IMAGE_TAG = r"\{IMG-\{.*?\}\}"
ENTITY_IMAGE_TAG = r"\{ENTITY_IMAGE-.*?\}"
ENTITY_TAG = r"\{ENTITY-[0-9]+\}"
NOTES_WORDS = ("note", "comment", "description")
NOTES_WORDS_TEXT_TAGGER = ("note", "comment")


def image_tags(col: Column) -> Column:
    """All image tags of a cell, in order."""
    return F.regexp_extract_all(col, F.lit(IMAGE_TAG), F.lit(0))


def is_image_cell(col: Column) -> Column:
    return col.rlike(IMAGE_TAG)


def entity_tags(col: Column, kind: str = "entity") -> Column:
    """Entity tags: ``kind`` is ``image`` for the captioning form, else ``entity``."""
    pattern = ENTITY_IMAGE_TAG if kind == "image" else ENTITY_TAG
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def image_tag_text(dataset: str, *parts: Column) -> Column:
    """``{IMG-{<dataset>-<part>-...}}``"""
    return F.concat(F.lit("{IMG-{"), F.concat_ws("-", F.lit(dataset), *[p.cast("string") for p in parts]), F.lit("}}"))


def substitute(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, applied one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def strip(col: Column) -> Column:
    """Strip white space, Unicode spaces included."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def clean_cell(col: Column, lower: bool = False) -> Column:
    """Strip, breaks and tabs to spaces, then one pass of two spaces to one."""
    text = F.lower(col) if lower else col
    return substitute(strip(text), [("\n", " "), ("\t", " "), ("\r", " "), ("  ", " ")])


def cell_line_text(col: Column) -> Column:
    """A cell as it stands in table text: no breaks, tabs or pipes."""
    return substitute(col, [("\t", " "), ("\n", " "), ("\\n", " "), ("\\t", " "), ("|", " ")])


def alpha_ratio(col: Column) -> Column:
    """Letters over other characters, spaces removed; 1 without other characters."""
    dense = F.replace(col, F.lit(" "), F.lit(""))
    letters = F.length(F.regexp_replace(dense, r"[^\p{L}]", ""))
    others = F.length(dense) - letters
    return F.when(others == 0, F.lit(1.0)).otherwise(letters.cast("double") / others)


def is_taggable_text(col: Column) -> Column:
    """Long enough and alphabetic enough to be looked for in a cell."""
    return (F.length(col) > 3) & ~((alpha_ratio(col) < 0.5) & (F.length(col) < 4))


def is_notes_header(col: Column, words: tuple[str, ...] = NOTES_WORDS) -> Column:
    return F.coalesce(F.lower(col).rlike("|".join(words)), F.lit(False))


def quoted(needle: Column) -> Column:
    """Make a column safe as a literal inside a regular expression."""
    return F.regexp_replace(needle, r"([\\\[\]{}()*+?.^$|&~#\-])", r"\\$1")


def _group_safe(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def replace_bounded(col: Column, needle: Column, repl: Column) -> Column:
    """Struct(result, is_unchanged): replace a needle, in any case, where no
    ASCII letter or digit touches it. The neighbours are consumed."""
    padded = F.concat(F.lit(" "), col, F.lit(" "))
    pattern = F.concat(F.lit("(?iu)([^a-zA-Z0-9])"), quoted(needle), F.lit("([^a-zA-Z0-9])"))
    replaced = F.regexp_replace(padded, pattern, F.concat(F.lit("$1"), _group_safe(repl), F.lit("$2")))
    return once(replaced, lambda r: F.struct(strip(r).alias("result"), (r == padded).alias("is_unchanged")))


def years(col: Column) -> Column:
    """Four-digit runs that no letter or digit touches."""
    return F.regexp_extract_all(col, F.lit(r"(?<![A-Za-z0-9])[0-9]{4}(?![A-Za-z0-9])"), F.lit(0))


def has_digit(col: Column) -> Column:
    return col.rlike("[0-9]")


def split_visual_key(col: Column) -> Column:
    """Struct(question_id, entity) of ``question:entity``; the entity keeps its colons."""
    parts = F.split(col, ":", 2)
    return F.struct(parts[0].alias("question_id"), F.get(parts, F.lit(1)).alias("entity"))
