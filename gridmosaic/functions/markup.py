"""Cutting landed HTML with splits and short patterns.

A split at the start of an element and a cut at its end walk the text once; no
pattern here can backtrack over a page.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from gridmosaic.functions.values import once

# Names that count without their semicolon, the longest first, as a name may begin with another.
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
NUMBER = r"^#(?:[xX]0*([0-9A-Fa-f]{1,6})|0*([0-9]{1,7}));?"
# Numbers 128 to 159 stand for the characters of windows-1252, where that has one.
OLD_NUMBERS = {k: c for k in range(128, 160) if (c := bytes([k]).decode("cp1252", "ignore"))}


def _names() -> Column:
    """Characters by name, in one map per first letter, so that a look-up reads few names."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        by_letter.setdefault(name[0], {})[name] = value
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def decode_entities(col: Column, in_attribute: bool = False) -> Column:
    """Character references, named and numeric, to their characters; each ``&``
    is looked at once, so what a reference gives is not decoded again.

    All names of the HTML standard count. Old ones count without a semicolon too, the
    longest that fits; but in an attribute not before a letter, a digit or ``=``, where
    they are parts of an address. Unknown names stay as written.
    """
    names = _names()
    old = F.create_map(*[F.lit(x) for pair in OLD_NUMBERS.items() for x in pair])
    open_name = rf"^(?:{'|'.join(OPEN_NAMES)})" + ("(?![A-Za-z0-9=])" if in_attribute else "")

    def named_by(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)

    def one(part: Column, digits: Column) -> Column:
        hexed = F.regexp_extract(digits, r"^#[xX]([0-9A-Fa-f]+)", 1)
        number = F.when(hexed != "", hexed).otherwise(F.conv(F.regexp_extract(digits, r"([0-9]+)", 1), 10, 16))
        code = F.conv(number, 16, 10).cast("bigint")
        is_char = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.coalesce(F.try_element_at(old, code.cast("int")), F.decode(F.unhex(F.lpad(F.conv(number, 16, 16), 8, "0")), "UTF-32"))
        return F.when((digits != "") & is_char, F.concat(char, F.substring(part, F.length(digits) + 1, F.length(part)))).otherwise(
            once(F.regexp_extract(part, r"^[A-Za-z][A-Za-z0-9]*;", 0), lambda name: once(named_by(name), lambda value: by_name(part, name, value)))
        )

    def by_name(part: Column, name: Column, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(value, F.substring(part, F.length(name) + 1, F.length(part)))).otherwise(
            once(F.regexp_extract(part, open_name, 0), lambda start: F.when(
                start != "", F.concat(named_by(start), F.substring(part, F.length(start) + 1, F.length(part)))
            ).otherwise(F.concat(F.lit("&"), part)))
        )

    def decoded(parts: Column) -> Column:
        later = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: once(F.regexp_extract(p, NUMBER, 0), lambda digits: one(p, digits)))
        return F.concat(parts[0], F.array_join(later, ""))

    return once(col, lambda c: F.when(F.contains(c, F.lit("&")), once(F.split(c, "&", -1), decoded)).otherwise(c))


def chunks(html: Column, element: str) -> Column:
    """Texts that each start right after ``<element``."""
    return once(F.split(html, rf"(?i)<{element}\b"), lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))


def until(col: Column, pattern: str) -> Column:
    """Text before the first match."""
    return F.split(col, pattern, 2)[0]


def leaf_elements(html: Column, element: str) -> Column:
    """Whole elements that hold no element of the same name. A last one that is
    not closed ends with the body; an earlier one holds the next."""
    def leaves(found: Column) -> Column:
        return F.filter(found, lambda c, i: c.rlike(rf"(?i)</{element}\b") | (i == F.size(found) - 1))

    return F.transform(
        once(chunks(html, element), leaves),
        lambda c: F.concat(F.lit(f"<{element}"), until(c, rf"(?i)</{element}\b|</body\b|</html\b"), F.lit(f"</{element}>")),
    )


def data_cells(html: Column) -> Column:
    """Attribute text and content of every ``td``; the attributes end at ``>``."""
    return F.transform(chunks(html, "td"), lambda c: until(c, r"(?i)</td\b|<th\b|</tr\b|</table\b"))


def attributes_of(chunk: Column) -> Column:
    return until(chunk, ">")


def attribute(text: Column, name: str) -> Column:
    """Value of an attribute, in double, single or no quotes, or null."""
    pattern = rf"""(?i)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def value(t: Column) -> Column:
        return F.concat(*[F.regexp_extract(t, pattern, g) for g in (1, 2, 3)])

    return once(text, lambda t: F.when(t.rlike(pattern), decode_entities(value(t), in_attribute=True)))


def has_class(chunk: Column, name: str) -> Column:
    """The element's class list holds the name."""
    classes = F.split(F.coalesce(attribute(attributes_of(chunk), "class"), F.lit("")), r"\s+")
    return F.array_contains(classes, name)


def anchors(html: Column) -> Column:
    """Array of struct(href, title, text) of the anchors, in order."""
    def one(body: Column, head: Column) -> Column:
        text = F.regexp_replace(F.substring(body, F.length(head) + 2, F.length(body)), r"<[^>]*>", "")
        return F.struct(
            attribute(head, "href").alias("href"), attribute(head, "title").alias("title"), decode_entities(text).alias("text")
        )

    def read(c: Column) -> Column:
        return once(until(c, r"(?i)</a\b"), lambda body: once(attributes_of(body), lambda head: one(body, head)))

    return F.filter(F.transform(chunks(html, "a"), read), lambda a: a["href"].isNotNull())


def first_src(html: Column) -> Column:
    """``src`` of the first image, or null."""
    images = chunks(html, "img")
    return attribute(attributes_of(F.get(images, F.lit(0))), "src")
