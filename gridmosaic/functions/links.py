"""Links, URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Address formats.
WIKI_HOST = "https://en.wikipedia.org"
WIKI_PAGE = "en.wikipedia.org/wiki/"
FILE_REDIRECT = "https://commons.wikimedia.org/wiki/Special:FilePath/"
FILE_PAGE = "https://commons.wikimedia.org/wiki/File:"
REVISION_START = "2020-09-09T07%3A59%3A00Z"
REVISION_QUERY = (
    "https://en.wikipedia.org/w/api.php?action=query&titles={title}&prop=revisions&rvlimit=500"
    "&rvstart={start}&rvdir=older&format=json&redirects=1"
)
REVISION_PAGE = "https://en.wikipedia.org/w/index.php?title=Page_Title&oldid={revid}"
PAGEVIEWS = (
    "https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/en.wikipedia/all-access/user/{title}/monthly/{start}/{end}"
)
PAGEVIEWS_START, PAGEVIEWS_END = "20181223", "20231223"
SPECIAL_FORMATS = ("tiff", "svg", "tif", "djvu")
SKIPPED_EXTENSION = "mid"
FILE_STEM_LENGTH = 200


def absolute_link(link: Column) -> Column:
    """``/wiki/...`` with the host in front; anything else as it is."""
    return F.when(F.startswith(link, F.lit("/wiki/")), F.concat(F.lit(WIKI_HOST), link)).otherwise(link)


def canonical_link(link: Column) -> Column:
    """Host prefix for relative wiki links, absolute wiki links kept, else null."""
    wiki, https = F.contains(link, F.lit("/wiki/")), F.contains(link, F.lit("https:"))
    return F.when(wiki & ~https, F.concat(F.lit(WIKI_HOST), link)).when(wiki & https, link)


def last_segment(link: Column) -> Column:
    return F.substring_index(link, "/", -1)


def extension(link: Column) -> Column:
    """Lower-case text after the last dot."""
    return F.lower(F.substring_index(link, ".", -1))


def page_title(url: Column) -> Column:
    """Text after the wiki page prefix, or null."""
    return F.when(F.contains(url, F.lit(WIKI_PAGE)), F.get(F.split(url, WIKI_PAGE.replace(".", r"\.")), F.lit(1)))


def _fill(template: str, **values: Column) -> Column:
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


def revision_query_url(url: Column, start: str = REVISION_START) -> Column:
    """Address that lists a page's revisions from a moment back."""
    return _fill(REVISION_QUERY, title=page_title(url), start=F.lit(start))


def revision_page_url(revid: Column) -> Column:
    """Address of one revision of a page."""
    return _fill(REVISION_PAGE, revid=revid.cast("string"))


def pageview_url(url: Column, start: str = PAGEVIEWS_START, end: str = PAGEVIEWS_END) -> Column:
    """Struct(url, error): the page-view address for the path part after ``wiki``."""
    parts = F.split(url, "/")
    title = F.get(parts, F.array_position(parts, "wiki").cast("int"))
    found = F.array_contains(parts, "wiki") & title.isNotNull()
    decoded = F.coalesce(F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B"))), title)
    return F.struct(
        F.when(found, _fill(PAGEVIEWS, title=decoded, start=F.lit(start), end=F.lit(end))).alias("url"),
        F.when(~found, F.lit("no page title in url")).alias("error"),
    )


def image_filename(url: Column) -> Column:
    """Local file name of an image address: no query, stem decoded with blanks
    to ``_`` and cut to 200 characters, extension in lower case."""
    clean = F.regexp_replace(url, r"\?[^?]*$", "")
    name = last_segment(clean)
    dot = F.length(name) - F.instr(F.reverse(name), ".") + 1
    raw = F.when(F.contains(name, F.lit(".")), F.substring(name, F.lit(1), dot - 1)).otherwise(
        F.substring(name, F.lit(1), F.length(name) - 1)
    )
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    stem = F.substring(F.replace(decoded, F.lit(" "), F.lit("_")), 1, FILE_STEM_LENGTH)
    return F.concat(stem, F.lit("."), extension(clean))


def file_redirect(link: Column) -> Column:
    """Redirect address of a file by its name."""
    return F.concat(F.lit(FILE_REDIRECT), last_segment(link))


def is_downloadable(link: Column) -> Column:
    return ~F.startswith(link, F.lit("https://maps")) & (extension(link) != SKIPPED_EXTENSION)
