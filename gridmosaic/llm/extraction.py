"""Main text of web pages: boosted trees over the nodes of the page, decoded along its tree."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridmosaic.llm.boosting import Forest, fit_forest
from gridmosaic.llm.common import hashed_sample

MAX_PAGES = 400  # bound of the pages that training reads
SEED = 7
BUCKETS = 4096  # attribute words are told apart by hash

# Elements by their part in a page.
GROUPS = {
    "p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 4, "ol": 4, "dl": 4, "dt": 3, "dd": 3, "blockquote": 5, "pre": 5, "figure": 5, "figcaption": 5,
    "table": 6, "thead": 6, "tbody": 6, "tfoot": 6, "tr": 6, "td": 6, "th": 6, "caption": 6, "div": 7, "section": 8, "article": 9, "main": 9,
    "nav": 10, "menu": 10, "aside": 11, "header": 12, "footer": 13, "address": 13, "form": 14, "fieldset": 14, "dialog": 14, "details": 7, "summary": 7, "hr": 7, "center": 7, "body": 15, "html": 15,
}
TEXT = 0
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"script", "style", "title", "template", "noscript", "svg", "annotation", "annotation-xml", "select", "textarea", "button", "iframe", "object", "canvas", "audio", "video"}
RAW = {"script", "style", "title", "textarea", "iframe"}  # hold no markup
TO_END = {"script", "style", "textarea"}  # take the rest of the page if never closed
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I | re.A) for name in RAW}
HEAD_END = re.compile(r"</head\s*>", re.I | re.A)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
# Words of class, id and role, by what they speak for.
TOKENS = {
    "body": "article content contents post entry story main text prose body copy",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc",
    "edge": "header masthead topbar footer foot bottom colophon copyright legal",
    "side": "sidebar aside side rail widget related recommended trending popular more tags share social follow author bio",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo banner sponsorship",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "form": "form login search searchbox contact",
    "comment": "comment comments reply replies respond discussion disqus thread reader readers",
}
KINDS = {word: k for k, words in enumerate(TOKENS.values()) for word in words.split()}
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Page:
    """The blocks of a page as a tree in page order; a text is a node of its own. Inline elements leave no node."""

    parent: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)  # bits of the attribute words
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    words: list[tuple[int, ...]] = field(default_factory=list)  # buckets of the attribute words

    def add(self, parent: int, group: int, kinds: int = 0, text: str = "", linked: int = 0, words: tuple[int, ...] = ()) -> int:
        for values, v in ((self.parent, parent), (self.group, group), (self.kinds, kinds), (self.texts, text), (self.linked, linked), (self.words, words)):
            values.append(v)
        return len(self.parent) - 1

    def without_article(self, group: int | None, words: tuple[int, ...] = ()) -> Page:
        """The page with another element in place of its article, or with none: what the article holds moves up."""
        i = self.group.index(GROUPS["article"])
        if group is not None:
            swapped = Page(self.parent, list(self.group), list(self.kinds), self.texts, self.linked, list(self.words))
            swapped.group[i], swapped.kinds[i], swapped.words[i] = group, 0, words
            return swapped
        up = [self.parent[i] if p == i else p for p in self.parent]
        rest = [k for k in range(len(up)) if k != i]
        return Page([up[k] - (up[k] > i) for k in rest], *([x[k] for k in rest] for x in (self.group, self.kinds, self.texts, self.linked, self.words)))


def attribute_words(attributes: str) -> list[str]:
    """The words of class, id and role in lower case, cut at marks and capitals."""
    return [w for found in ATTRIBUTE.findall(attributes) for w in re.split(r"[\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found)).lower()) if w]


def attribute_kinds(attributes: str) -> int:
    bits = 0
    for word in attribute_words(attributes):
        for part in re.split(r"[^a-z]+", word):
            if part in KINDS:
                bits |= 1 << KINDS[part]
    return bits


def word_buckets(attributes: str) -> tuple[int, ...]:
    return tuple(sorted({zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in attribute_words(attributes)}))


def read_page(source: str | None) -> Page:
    """Parse a whole page. Unclosed and misplaced tags close what they must; a `<` that opens no tag is text."""
    source = source or ""
    page = Page()
    stack: list[tuple[str, int]] = [("#page", page.add(-1, GROUPS["html"]))]
    parts: list[str] = []
    linked, links, at = 0, 0, 0
    tags, ends = tags_of(source)

    def end_text() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            page.add(stack[-1][1], TEXT, 0, text, min(linked, len(text)))
        parts.clear()
        linked = 0

    for tag in [*tags, None]:
        if tag is not None and tag.start() < at:
            continue  # inside an element that is not seen
        run = html.unescape(source[at: tag.start() if tag else len(source)])
        if run:
            parts.append(run)
            if links:
                linked += len(run.strip())
        if tag is None:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in UNSEEN:
            at = ends.get(tag.start(), at)
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if tag[1] else 1
        if name not in GROUPS:
            continue
        end_text()
        links = 0
        if tag[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack[-1][0] == "p" or name in ("p",):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "table", "body", "article", "section", "div", "li"):
                    break
        if name in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SCOPES[name]:
                    break
                if stack[k][0] in CLOSES[name]:
                    del stack[k:]
        if name not in VOID:
            stack.append((name, page.add(stack[-1][1], GROUPS[name], attribute_kinds(tag[3]), words=word_buckets(tag[3]))))
    end_text()
    return page


def tags_of(source: str) -> tuple[list[re.Match], dict[int, int]]:
    """The tags and comments of a page in order, and where each element that is not seen ends, by the start of its start tag.

    End tags belong to the last open element of their name. An element that is never closed has no end, so that only its start tag is skipped; but scripts,
    styles and text areas take the rest of the page, or of an open head. What stands inside an element without markup gives no tags.
    One pass, whatever is left open. A head has no end of its own: what it may hold is not seen or holds no text.
    """
    tags: list[re.Match] = []
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    endless: set[str] = set()
    at, in_head = 0, False
    while (tag := MARKUP.search(source, at)) is not None:
        tags.append(tag)
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in ("head", "body"):
            in_head = name == "head" and not tag[1]
        if name not in UNSEEN:
            continue
        if tag[1]:
            if opened.get(name):
                ends[opened[name].pop()] = tag.end()
        elif tag[3].endswith("/"):
            continue
        elif name not in RAW:
            opened.setdefault(name, []).append(tag.start())
        else:
            end = None if name in endless else RAW_END[name].search(source, at)
            if end is not None:
                at = ends[tag.start()] = end.end()
                continue
            endless.add(name)
            if name in TO_END:
                head = HEAD_END.search(source, at) if in_head else None
                at = ends[tag.start()] = head.start() if head else len(source)
    return tags, ends


def node_features(page: Page, weights: np.ndarray) -> np.ndarray:
    """One row per node: its own subtree, its place among its siblings, its parent, all above it, and the learned weights of attribute words."""
    n = len(page.parent)
    parent, group, kinds = np.array(page.parent), np.array(page.group), np.array(page.kinds)
    chars = np.array([len(t) for t in page.texts], dtype=float)
    stops = np.array([sum(map(t.count, ".,;:!?")) for t in page.texts], dtype=float)
    linked, leaves = np.array(page.linked, dtype=float), (chars > 0).astype(float)
    sums = np.stack([chars, stops, linked, leaves, np.ones(n)], axis=1)
    depth, above_kinds, above_groups = np.zeros(n), kinds.copy(), np.zeros(n, dtype=np.int64)
    own = np.array([sum(weights[w] for w in words) for words in page.words])
    lowest, highest = np.minimum(own, 0), np.maximum(own, 0)
    for i in range(1, n):
        p = parent[i]
        lowest[i], highest[i] = min(lowest[i], lowest[p]), max(highest[i], highest[p])
        depth[i] = depth[p] + 1
        above_kinds[i] |= above_kinds[p]
        above_groups[i] = above_groups[p] | (1 << int(group[i]))
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    size, dots, link, blocks, nodes = sums.T
    up = np.maximum(parent, 0)
    children = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
    rank, seen = np.zeros(n), np.zeros(n, dtype=np.int64)
    for i in range(1, n):
        rank[i] = seen[parent[i]]
        seen[parent[i]] += 1
    siblings = np.maximum(children[up], 1)
    alike = np.zeros(n)
    if n > 1:
        key = up * 16 + group
        key[0] = n * 16
        alike = np.bincount(key)[key] / siblings
    before = np.concatenate([[0.0], np.cumsum(chars)[:-1]])
    whole = max(1.0, size[0])
    own_kinds = kinds | np.where(group == TEXT, kinds[up], 0)
    columns = [
        group, group[up], depth, rank, siblings, rank / siblings, alike, np.log1p(size), size / whole, link / np.maximum(size, 1), dots / np.maximum(size, 1), size / np.maximum(nodes, 1),
        size / np.maximum(blocks, 1), np.where(group == TEXT, own[up], own), lowest, highest, np.log1p(size[up]), link[up] / np.maximum(size[up], 1), size[up] / np.maximum(blocks[up], 1), size / np.maximum(size[up], 1), before / whole,
    ]
    columns += [(own_kinds >> k) & 1 for k in range(len(TOKENS))] + [(above_kinds >> k) & 1 for k in range(len(TOKENS))]
    columns += [(above_groups >> g) & 1 for g in (9, 10, 11, 12, 13, 14)]
    return np.stack(columns, axis=1).astype(float)


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the best set in which everything above a kept node is kept.

    From the leaves up, a node is worth its log odds and what its children are worth, but not less than nothing, which means to drop it with all it holds.
    From the page down, a node is kept if its parent is and it is worth something. The page itself is kept.
    """
    worth = log_odds.astype(float).tolist()
    worth[0] = 0.0
    for i in range(len(worth) - 1, 0, -1):
        if worth[i] > 0:
            worth[page.parent[i]] += worth[i]
    kept = [True] * len(worth)
    for i in range(1, len(worth)):
        kept[i] = kept[page.parent[i]] and worth[i] > 0
    return kept


@dataclass(frozen=True)
class Model:
    """Boosted trees, and the weight of each bucket of attribute words that their features use."""

    forest: Forest
    weights: np.ndarray


def main_text(pages: list[Page], model: Model) -> list[str]:
    """The kept texts of each page, one per line."""
    rows = [node_features(p, model.weights) for p in pages]
    odds = model.forest.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p, r in zip(pages, rows):
        kept = decode(p, odds[at: at + len(r)])
        at += len(r)
        out.append("\n".join(t for t, k in zip(p.texts, kept) if k and t))
    return out


# Training.

MARK = "\u2063"  # stands at the end of boilerplate in drawn pages
FALLBACK = ["A first sentence of some length, as articles have. A second one follows it, with a comma.", "Short words.", "Another paragraph tells more, and ends here; nothing is left out."]


def _paragraphs(page: Page) -> list[str]:
    return [t for t in page.texts if t]


def any_word(rng: np.random.Generator) -> str:
    """A class name that says nothing."""
    return "".join(chr(97 + int(k)) for k in rng.integers(26, size=int(rng.integers(2, 9))))


def drawn_page(rng: np.random.Generator, article: list[str], other: list[str]) -> tuple[str, set[str]]:
    """A page around given paragraphs, in one of many layouts, and its main texts. Boilerplate texts are marked, so that labels are sure."""
    def esc(x: str) -> str:
        return html.escape(x, quote=False)

    def words(n: int) -> list[str]:
        w = " ".join(other).split() or ["word"]
        k = int(rng.integers(len(w)))
        return [w[(k + i) % len(w)] for i in range(n)]

    def one(*choices: str) -> str:
        return choices[int(rng.integers(len(choices)))]

    def junk(text: str) -> str:
        return esc(text + MARK)

    def box(tags: tuple[str, ...], classes: tuple[str, ...], inner: str) -> str:
        tag, plain = one(*tags), rng.random() < 0.2 and tags[0] != "div"
        attribute = "" if plain else f' {one("class", "id")}="{one(*classes)}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{junk(" ".join(words(int(rng.integers(1, 6)))))}</a></li>' for k in range(n)) + "</ul>"

    def sentence() -> str:
        return other[int(rng.integers(len(other)))] if other else " ".join(words(8))

    nav = box(("nav", "div"), ("menu", "navbar", "main-nav", "breadcrumb"), links(int(rng.integers(2, 12))))
    if rng.random() < 0.5:
        nav = f"<nav>{links(int(rng.integers(2, 9)))}</nav>"
    advert = box(("div", "aside", "section"), ("ad", "advert", "banner-ad", "sponsored"), junk(sentence()))
    head = box(("header", "div"), ("header", "masthead", "topbar"), junk(" ".join(words(4))))
    notice = box(("div", "section"), ("cookie-notice", "alert", "newsletter popup"), f"<p>{junk(sentence())}</p>")
    side = box(("aside", "div"), ("sidebar", "widget", "related-posts"), f"<h3>{junk(' '.join(words(2)))}</h3>{links(int(rng.integers(1, 8)))}<p>{junk(sentence())}</p>")
    form = box(("form", "div"), ("search-form", "login", "contact-form"), f"<p>{junk(' '.join(words(5)))}</p><input>")
    comments = box(("section", "div"), ("comments", "comment-list", "discussion", "replies"), "".join(
        box(("div", "article", "li"), ("comment", "reply"), f"<p>{junk(sentence())}</p>") for _ in range(int(rng.integers(1, 5)))))
    foot = box(("footer", "div"), ("footer", "site-footer", "copyright"), f"&copy; {junk(' '.join(words(3)) + '. ' + sentence())}")
    if rng.random() < 0.5:
        foot = f"<footer>&copy; x &middot; {junk(sentence())}</footer>"
    block = one("p", "p", "p", "p", "div")
    rare = ("<ul><li>{}</li></ul>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>")
    body = "".join((f"<h1>{esc(p)}</h1>" if k == 0 else one(*rare).format(esc(p)) if rng.random() < 0.06 else f"<{block}>{esc(p)}</{block}>") for k, p in enumerate(article))
    inside = one("", "", "", advert, form, comments, side) if rng.random() < 0.4 else ""
    tag = one("article", "main", "div", "section", "div", "section", "")
    attribute = one("", "", f' class="{one("content", "post-body", "entry", "story", "main text")}"', f' class="{any_word(rng)} {any_word(rng)}"', f' id="{any_word(rng)}"')
    core = f"<{tag}{attribute}>{body}{inside}</{tag}>" if tag else body + inside

    def maybe(x: str, chance: float) -> str:
        return x if rng.random() < chance else ""

    top = maybe(notice, 0.3) + maybe(head, 0.4) + maybe(nav, 0.9) + maybe(advert, 0.6) + maybe(form, 0.2)
    bottom = maybe(side, 0.3) + maybe(comments, 0.4) + maybe(advert, 0.2) + maybe(form, 0.1) + maybe(foot, 0.9)
    wrap = one("{}", "{}", '<div id="page">{}</div>', "<div>{}</div>", f'<div class="{any_word(rng)}"><div id="{any_word(rng)}">{{}}</div></div>')
    return f"<html><body>{wrap.format(top + core + bottom)}</body></html>", {" ".join(p.split()) for p in article}


def marked_labels(page: Page) -> list[float] | None:
    """Labels of the texts of a page that marks its one article, apart from what stands inside it in boilerplate elements; else none."""
    if page.group.count(GROUPS["article"]) != 1:
        return None
    inside, label = [False] * len(page.parent), [0.0] * len(page.parent)
    for i in range(1, len(page.parent)):
        inside[i] = page.group[i] == GROUPS["article"] or inside[page.parent[i]] and page.group[i] not in (10, 11, 12, 13, 14) and page.kinds[i] < 2
        label[i] = float(inside[i] and bool(page.texts[i]))
    return label


def word_weights(pages: list[Page], labels: list[list[float]], ridge: float = 3.0) -> np.ndarray:
    """How much each bucket of attribute words speaks for main text: its log odds over the pages that hold it, less than those of all texts.

    A page counts once per bucket, with the share of main text in the characters below it, so buckets on few pages weigh little and
    unseen ones nothing.
    """
    good, pages_with = np.zeros(BUCKETS), np.zeros(BUCKETS)
    base, counted = 0.0, 0
    for page, label in zip(pages, labels):
        chars = [len(t) for t in page.texts]
        main = [c * y for c, y in zip(chars, label)]
        for i in range(len(chars) - 1, 0, -1):
            chars[page.parent[i]] += chars[i]
            main[page.parent[i]] += main[i]
        if not chars[0]:
            continue
        base, counted = base + main[0] / chars[0], counted + 1
        below: dict[int, list[int]] = {}
        for i, words in enumerate(page.words):
            for w in words if chars[i] else ():
                total = below.setdefault(w, [0, 0])
                total[0] += main[i]
                total[1] += chars[i]
        for w, (m, c) in below.items():
            good[w] += m / c
            pages_with[w] += 1
    share = min(max(base / max(counted, 1), 0.01), 0.99)
    odds = (good + ridge * share) / (pages_with + ridge)
    odds = np.clip(odds, 0.01, 0.99)
    return np.where(pages_with > 0, np.log(odds / (1 - odds)) - np.log(share / (1 - share)), 0.0)


def training_rows(sources: list[str], copies: int = 2, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node features and labels of given pages that mark their article, and of pages drawn around the paragraphs of all; the word weights.

    The element that marks an article gives labels only: in training another element stands in its place, or none. In drawn layouts the labels
    are known: a text is main text if it was put there as such, in an element with a telling name, any name or none. A node is labelled 1 if it
    holds main text. The paragraphs give the lengths, languages and marks of the corpus. The weights of attribute words that a training page sees
    come from the other half of the pages, so a word that stands on one page only weighs nothing there, as it will on new pages.
    """
    rng = np.random.default_rng(seed)
    read = [read_page(s) for s in sources]
    pools = [x for x in map(_paragraphs, read) if x] or [FALLBACK]
    layouts: list[Page] = []
    labels: list[list[float]] = []
    for page in read:
        if (label := marked_labels(page)) is not None:
            group = (None, GROUPS["div"], GROUPS["section"])[int(rng.integers(3))]
            if group is None:
                del label[page.group.index(GROUPS["article"])]
            layouts.append(page.without_article(group, word_buckets(f"class={any_word(rng)}") if rng.random() < 0.5 else ()))
            labels.append(label)
    for k in range(max(len(pools) * copies, 60)):
        article, other = pools[k % len(pools)], pools[int(rng.integers(len(pools)))]
        size = int(rng.integers(1, min(len(article), 40) + 1))
        start = int(rng.integers(0, len(article) - size + 1))
        source, texts = drawn_page(rng, article[start: start + size], other)
        page = read_page(source)
        layouts.append(page)
        labels.append([float(MARK not in t and t in texts) if t else 0.0 for t in page.texts])
    halves = [word_weights(layouts[k::2], labels[k::2]) for k in (0, 1)]
    weights = word_weights(layouts, labels)
    xs, ys = [], []
    for k, (page, label) in enumerate(zip(layouts, labels)):
        for i in range(len(label) - 1, 0, -1):
            label[page.parent[i]] = max(label[page.parent[i]], label[i])
        xs.append(node_features(page, halves[1 - k % 2])[1:])
        ys.append(np.array(label)[1:])
    return np.concatenate(xs), np.concatenate(ys), weights


def fit(sources: list[str]) -> Model:
    x, y, weights = training_rows(sources)
    return Model(fit_forest(x, y), weights)


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Model:
    """Fit on at most `max_pages` pages, those with the smallest hashes, and on layouts drawn around their paragraphs."""
    rows = hashed_sample(pages.filter(F.col("html").isNotNull()).select("page_id", "html"), max_pages, "page_id", "html").collect()
    return fit([r["html"] for r in rows])


def extract_main_text(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The main text of every page.

    Each page is parsed whole into a tree of blocks and texts; boosted trees give each node the log odds of holding main text, from
    its subtree, attribute words, depth and siblings; `decode` picks the best choice without contradictions along the tree. Character references are decoded, white space
    inside a block becomes one space, blocks are joined by a line feed in page order. Pages are independent: no shuffle.

    Null or empty html, or a page of boilerplate: empty text. Repeated rows repeat. Columns other than page_id and url are dropped. Empty table: no rows.
    Returns page_id, url, text, n_chars.
    """
    model = train(pages, max_pages)

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str] = []
            for k in range(0, len(batch), 256):
                out += main_text([read_page(s) for s in batch.iloc[k: k + 256]], model)
            yield pd.Series(out, dtype=object)

    found = pages.select("page_id", "url", texts("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
