"""Main text of HTML pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page becomes a tree of block elements whose leaves are runs of text. Each node has features: tag kind, hashed attribute tokens of itself and its ancestors
(each as the log odds of main text that the fit learned for it), depth, text density and links of its subtree, place among its siblings and their statistics. Boosted trees give each node the log odds of holding main
text. Decoding keeps the set of nodes with the highest sum of log odds in which a kept node's parent is kept too, so a dropped ancestor never has a kept
descendant.

The trees are fitted on a bounded sample of whole pages whose own markup tells the article (an `article` or `main` element), together with pages made anew
from the parts of those: the same texts under other tags, classes and orders, so that the model doesn't hang on one template. Without such pages, the made ones alone
serve, from the longer and shorter runs of text. One task fits on the sample; only the model reaches the driver.
"""

from __future__ import annotations

import pickle
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.llm.boosting import Boosted
from skylark.llm.common import fresh, small_batches, unfold

#: Pages that the model is fitted on, and pages made from each.
SAMPLE_PAGES = 120
REMADE = 3

# Kinds of tags, and tokens of class, id and role attributes.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SILENT = set("script style noscript template svg math iframe object canvas audio video title select option optgroup datalist textarea button map".split())
HEAD = set("title style script noscript template meta link base".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = set("nav header footer aside form menu dialog fieldset search".split())
MAIN_TAGS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = set("p pre blockquote figcaption dd td".split())
LISTS = set("ul ol dl li dt menu".split())
# Names that the training pages give to their parts.
BOILER_TOKENS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs header masthead footer foot copyright legal sidebar side aside widget widgets rail cookie cookies consent gdpr notice notices alert message popup modal overlay newsletter subscribe subscription signup login register form search share sharing social follow related recommended recommendations more trending popular tags tagcloud comment comments commentlist reply replies respond disqus discussion pagination pager skip hidden complementary contentinfo dialog".split()
)
MAIN_TOKENS = set("article articlebody main content contents post posts postbody entry story body text page maincontent storybody prose".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKENS = re.compile(r"[a-z]+")
MARKED = "data-kept"
#: What the parser leaves of a page that ends within a tag or a comment.
UNCLOSED = re.compile(r"<[a-zA-Z/!?]")
#: Buckets of hashed attribute tokens.
BUCKETS = 1 << 14
NO_TOKENS: tuple[int, ...] = ()


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(maxsize=1 << 15)
def buckets_of(value: str) -> tuple[int, ...]:
    """The hashed tokens of an attribute's value."""
    return tuple(sorted({bucket(t) for t in TOKENS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())}))


@lru_cache(maxsize=64)
def either_end(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}\b", re.IGNORECASE)


class Tree(HTMLParser):
    """The page's block elements and runs of text, parents before children; runs have tag '#'.

    A comment or tag that is never closed takes the rest of the page. A head ends where something begins that can't be in it. Text in silent elements (scripts, buttons and the like) isn't read; one that is never closed, script and
    style apart, ends at the next block or with the block around it.
    """

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens, self.text, self.links, self.kept = ["html"], [-1], [NO_TOKENS], [""], [0], [None]
        self.open, self.silent, self.loose, self.in_head, self.anchors, self.run, self.linked = [0], [], False, False, 0, [], 0
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name, but for the root
        self.html, self.lines = html or "", None
        if html:
            self.feed(html)
            if not UNCLOSED.match(self.rawdata):
                self.close()
        self.flush()

    def add(self, tag: str, tokens: tuple[int, ...], text: str = "", links: int = 0, kept: bool | None = None) -> int:
        for column, value in ((self.tag, tag), (self.parent, self.open[-1]), (self.tokens, tokens), (self.text, text), (self.links, links), (self.kept, kept)):
            column.append(value)
        return len(self.tag) - 1

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def shut(self, place: int) -> None:
        """Ends the open element at the place and all within it."""
        for k in self.open[place:]:
            self.places[self.tag[k]].pop()
        del self.open[place:]

    def flush(self) -> None:
        if self.run:
            if text := " ".join("".join(self.run).split()):
                self.add("#", NO_TOKENS, text, min(self.linked, len(text)))
            self.run, self.linked = [], 0

    def never_closed(self, tag: str) -> bool:
        """Whether the next tag of this name isn't an end tag."""
        if self.lines is None:
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.html))]
        line, column = self.getpos()
        found = either_end(tag).search(self.html, self.lines[line - 1] + column + 1)
        return found is None or not found[1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            if tag == "body":
                self.silent = []
                return
            if tag == self.silent[-1]:
                self.silent.append(tag)
                return
            if not (self.loose and tag in BLOCKS):
                return
            self.silent = []
        if tag == "head":
            self.in_head = True
            return
        if tag not in HEAD and tag != "html":
            self.in_head = False
        if tag in SILENT:
            self.silent.append(tag)
            self.loose = tag not in ("script", "style") and self.never_closed(tag)
            return
        if tag not in BLOCKS:
            if tag == "br":
                self.run.append(" ")
            elif tag == "a":
                self.anchors = 1
            return
        self.flush()
        self.anchors = 0
        # A new block closes an open paragraph; a list item, cell or row closes its like within the same list or table.
        if self.tag[self.open[-1]] == "p":
            self.shut(len(self.open) - 1)
        if tag in CLOSES and tag != "p":
            around = self.last(("ul", "ol", "dl", "menu", "table"))
            while (like := self.last(CLOSES[tag])) > around:
                self.shut(like)
        if tag in VOID or tag == "html" or tag == "body" and self.places.get(tag):
            return
        found, kept = NO_TOKENS, None
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                found += buckets_of(value)
            elif name == "hidden" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                found += (bucket("hidden"),)
            elif name == MARKED:
                kept = value == "1"
        self.places[tag].append(len(self.open))
        self.open.append(self.add(tag, found, kept=kept))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)
            if tag in BLOCKS and tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
                return
            if not (self.loose and tag in BLOCKS and self.places.get(tag)):
                return
            self.silent = []
        if tag == "head":
            self.in_head = False
        elif tag == "a":
            self.anchors = 0
        elif tag in BLOCKS:
            self.flush()
            if place := self.last((tag,)):
                self.shut(place)

    def handle_data(self, data: str) -> None:
        if not self.silent and not (self.in_head and data.isspace()):
            self.in_head = False
            self.run.append(data)
            if self.anchors:
                self.linked += len(data.strip())


def features(tree: Tree, token_odds: np.ndarray) -> np.ndarray:
    """A row for every node; token_odds: what was learned of each bucket of attribute tokens."""
    n, tag = len(tree.tag), tree.tag
    parent = np.array(tree.parent)
    length = np.array([len(t) for t in tree.text], float)
    stops = np.array([sum(map(t.count, ".,;:!?")) for t in tree.text], float)
    kinds = np.array([[t in BOILER_TAGS, t in MAIN_TAGS, t in HEADINGS, t in PARAGRAPHS, t in LISTS, t == "#", t in ("div", "section")] for t in tag], float).reshape(n, 7)
    attrs = np.zeros((n, 3))
    for k, tokens in enumerate(tree.tokens):
        if tokens:
            found = token_odds[list(tokens)]
            attrs[k] = found.sum(), found.min(), found.max()
    chars, links, marks, leaves, nodes, holds = length.copy(), np.array(tree.links, float), stops, (length > 0).astype(float), np.ones(n), np.maximum(kinds[:, 1], attrs[:, 2])
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        marks[p] += marks[k]
        leaves[p] += leaves[k]
        nodes[p] += nodes[k]
        holds[p] = max(holds[p], holds[k])
    depth, above_boiler, above_main, above, before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    children: list[list[int]] = [[] for _ in range(n)]
    seen = 0.0
    for k in range(n):
        before[k] = seen
        seen += length[k]
        if k:
            p = parent[k]
            depth[k] = depth[p] + 1
            above_boiler[k] = above_boiler[p] + kinds[p, 0]
            above_main[k] = above_main[p] + kinds[p, 1]
            above[k] = min(above[p], attrs[p, 1])
            children[p].append(k)
    place, many, alike, mean, left, right = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for group in children:
        if group:
            sizes, names = chars[group], [tag[k] for k in group]
            place[group], many[group], mean[group] = np.arange(len(group)) / len(group), len(group), sizes.mean()
            count = {x: names.count(x) for x in set(names)}
            alike[group] = [count[x] / len(group) for x in names]
            left[group[1:]], right[group[:-1]] = sizes[:-1], sizes[1:]
    up = np.maximum(parent, 0)
    total = max(chars[0], 1)
    log = np.log1p
    return np.column_stack(
        [kinds, attrs, kinds[up], attrs[up], above_boiler, above_main, above, holds, np.minimum(depth, 20), log(chars), links / np.maximum(chars, 1), log(chars / nodes), log(chars / np.maximum(leaves, 1)), log(leaves), 100 * marks / np.maximum(chars, 1), chars / total, before / total, place, log(many), alike, log(mean), log(left), log(right), log(chars[up])]
    )


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """The kept nodes: the best set in which every kept node's parent is kept. The root always is."""
    n = len(odds)
    best = odds.astype(float).copy()
    for k in range(n - 1, 0, -1):
        if best[k] > 0:
            best[tree.parent[k]] += best[k]
    kept = np.zeros(n, bool)
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[tree.parent[k]] and best[k] > 0
    return kept


def by_markup(tree: Tree, token_odds: np.ndarray) -> np.ndarray | None:
    """Which nodes hold main text, by the page's own semantic elements or marks; None if it has none.

    Within an article, elements for menus and the like, and those whose tokens speak clearly against main text, hold none.
    """
    marked = any(k is not None for k in tree.kept)
    if not marked and not any(t in MAIN_TAGS for t in tree.tag):
        return None
    n, within = len(tree.tag), [False] * len(tree.tag)
    for k in range(1, n):
        within[k] = within[tree.parent[k]]
        if tree.kept[k] is not None:
            within[k] = tree.kept[k]
        elif tree.tag[k] in BOILER_TAGS or tree.tokens[k] and token_odds[list(tree.tokens[k])].sum() < -1:
            within[k] = False
        elif tree.tag[k] in MAIN_TAGS and not marked:
            within[k] = True
    out = np.array([t == "#" and w for t, w in zip(tree.tag, within, strict=True)])
    for k in range(n - 1, 0, -1):
        out[tree.parent[k]] |= out[k]
    return out


def learned_tokens(trees: list[Tree], labels: list[np.ndarray], inside: bool) -> np.ndarray:
    """Log odds of main text in an element with the token, by bucket; inside: whether unmarked elements within an article count, too."""
    counts = np.ones((2, BUCKETS))
    for tree, y in zip(trees, labels, strict=True):
        article, marked = [False] * len(tree.tag), any(k is not None for k in tree.kept)
        for k in range(1, len(tree.tag)):
            p = tree.parent[k]
            article[k] = article[p] or tree.tag[p] in MAIN_TAGS
            if tree.tokens[k] and (inside or marked or not article[k]):
                counts[int(y[k]), list(set(tree.tokens[k]))] += 1
    return np.clip(np.log(counts[1] / counts[0]), -3, 3)


def remade(pages: list[tuple[list[str], list[str]]], seed: int, times: int) -> list[str]:
    """Pages from the parts (main blocks, other texts) of others, with marks of what is main."""
    draw = random.Random(seed)
    boiler_tokens, main_tokens = sorted(BOILER_TOKENS), sorted(MAIN_TOKENS)
    pages = [p for p in pages if p[0]]
    every = [t for p in pages for t in p[1]] or ["home"]

    def attribute(tokens: list[str]) -> str:
        word = draw.choice(tokens)
        return f' {draw.choice(["class", "class", "id"])}="{draw.choice([word, f"{word}-{draw.choice(["box", "wrap", "list", "inner"])}", f"site-{word}"])}"'

    def boiler() -> str:
        kind = draw.randrange(6)
        tag = draw.choice(sorted(BOILER_TAGS - {"fieldset"}))
        opened = f"<{tag}{draw.choice(['', attribute(boiler_tokens)])}" if draw.random() < 0.5 else f"<{draw.choice(['div', 'div', 'section', 'ul' if kind == 0 else 'div', 'p' if kind == 1 else 'div'])}{attribute(boiler_tokens)}"
        name = opened[1:].split(" ")[0].split(">")[0]
        words = [escape(w) for t in draw.sample(every, min(3, len(every))) for w in t.split()[:6]] or ["x"]
        if kind == 0:
            inner = "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(words))
            inner = inner if name in ("ul", "menu") else f"<ul>{inner}</ul>"
        elif kind == 1:
            inner = escape(draw.choice(every))
        elif kind == 2:
            inner = "".join(f"<a href='#'>{w}</a> " for w in words)
        elif kind == 3:  # as long as an article: readers' comments
            inner = "".join(f"<p>{escape(t)}</p>" if draw.random() < 0.5 else f"<div><b>{words[0]}</b><p>{escape(t)}</p></div>" for t in draw.choice(pages)[0][1:7])
        elif kind == 4:
            inner = f"<h3>{words[0]}</h3><p>{escape(draw.choice(every))}</p>"
        else:
            inner = f"<label>{words[0]}</label><input name=q><p>{' '.join(words)}</p>"
        return f'{opened} {MARKED}="0">{inner}</{name}>'

    out = []
    for main, _ in pages:
        for _ in range(times):
            blocks = [f"<{draw.choice(['p', 'p', 'p', 'p', 'div', 'li', 'blockquote', 'h2' if len(b) < 80 else 'p'])}>{escape(b)}" for b in main[1:]]
            blocks = [b + f"</{b[1:].split('>')[0]}>" for b in blocks]
            blocks = [f"<h1>{escape(main[0])}</h1>", *blocks]
            for _ in range(draw.choice([0, 0, 1, 2])):
                blocks.insert(draw.randrange(len(blocks) + 1), boiler())
            way = draw.randrange(4)
            opened, closed = [("<article", "</article>"), ("<main", "</main>"), (f"<div{attribute(main_tokens)}", "</div>"), (f"<section{attribute(main_tokens)}", "</section>")][way]
            body = f'{opened} {MARKED}="1">{"".join(blocks)}{closed}'
            if draw.random() < 0.5:
                body = f'<div{draw.choice(["", attribute(main_tokens)])} {MARKED}="0">{body}{boiler() if draw.random() < 0.5 else ""}</div>'
            before, after = ([boiler() for _ in range(draw.randrange(4))] for _ in range(2))
            out.append(f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return out


@dataclass
class Model:
    token_odds: np.ndarray
    trees: Boosted

    def odds(self, trees: list[Tree]) -> np.ndarray:
        """Log odds of main text, of the nodes of all trees."""
        return self.trees.odds(np.concatenate([features(t, self.token_odds) for t in trees]))


def parts_of(tree: Tree, y: np.ndarray | None) -> tuple[list[str], list[str]]:
    """(main, other) runs of text; of an unmarked page those of 80 characters or more count as main."""
    main = [len(x) >= 80 for x in tree.text] if y is None else y
    return [x for x, k in zip(tree.text, main, strict=True) if x and k], [x for x, k in zip(tree.text, main, strict=True) if x and not k]


def fitted(pages: list[str], times: int, seed: int) -> Model | None:
    """The model from whole pages; None if they have no text to make training pages from."""
    trees = [Tree(h) for h in pages]
    none = np.zeros(BUCKETS)
    labels = [by_markup(t, none) for t in trees]
    made = [Tree(h) for h in remade([parts_of(t, y) for t, y in zip(trees, labels, strict=True)], seed, times)]
    trees = [t for t, y in zip(trees, labels, strict=True) if y is not None] + made
    if not trees:
        return None
    # First what can be known without looking into articles, then the labels within them, then all.
    known = learned_tokens(trees, [by_markup(t, none) for t in trees], inside=False)
    labels = [by_markup(t, known) for t in trees]
    odds = learned_tokens(trees, labels, inside=True)
    return Model(odds, Boosted(np.concatenate([features(t, odds) for t in trees]), np.concatenate(labels).astype(float)))


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES, times: int = REMADE, seed: int = 5) -> Model | None:
    """The model, from at most `sample` different whole pages by a seeded hash, those with an article or main element if there are any; None if the sample has no text.

    The share of the pages that is looked through for them grows until there are enough. One task holds the sample and fits; the sample's size doesn't depend on the table's.
    """
    n, share, order = pages.count(), 0.0, F.pmod(F.xxhash64(F.lit(seed), F.col(html)), F.lit(1 << 40))
    few = pages.select(F.col(html).alias("html"), order.alias("o")).where(F.length("html") > 0)
    marked = few.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    while share < 1:
        share = min(1.0, 8 * share or 4 * sample / max(1, n))
        part = F.col("o") < F.lit(int(share * (1 << 40)))
        least = [r.o for r in marked.where(part).select("o").distinct().orderBy("o").limit(sample).collect()]
        if len(least) == sample:
            break
    if not least:
        marked = few
        least = [r.o for r in few.select("o").distinct().orderBy("o").limit(sample).collect()]
    if not least:
        return None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {o: h for batch in batches for h, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
        model = fitted([found[o] for o in sorted(found)], times, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    chosen = marked.where(F.col("o") <= least[-1]).dropDuplicates(["o"]).coalesce(1)
    return pickle.loads(chosen.mapInArrow(task, "model binary").first().model)


def extract(html: str | None, model: Model | None, tree: Tree | None = None) -> str:
    """The main text of one page; without a model, all its text."""
    tree = tree or Tree(html)
    return joined(tree, decode(tree, np.ones(len(tree.tag)) if model is None else model.odds([tree])))


def joined(tree: Tree, kept: np.ndarray) -> str:
    return "\n\n".join(t for t, k in zip(tree.text, kept, strict=True) if t and k)


def text_of(html: Column, model: Model | None) -> Column:
    """A struct (text, n_chars) for a column of pages."""

    @F.arrow_udf("text string, n_chars long")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            trees = [Tree(h) for h in batch.to_pylist()]
            if model is None:
                texts = [extract(None, None, t) for t in trees]
            else:
                odds = model.odds(trees) if trees else np.zeros(0)
                ends = np.cumsum([len(t.tag) for t in trees])
                texts = [joined(t, decode(t, odds[e - len(t.tag) : e])) for t, e in zip(trees, ends, strict=True)]
            # Half of a surrogate pair, which a character reference can name, is no character.
            texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n_chars"])

    return main_text(html)


def main_text(pages: DataFrame, model: Model | None, html: str = "html") -> DataFrame:
    """pages with text (blocks joined by an empty line) and n_chars (its code points), instead of columns of these names.

    Null and empty pages, and pages without main text, have an empty text. Every row stays; repeated rows get equal texts. Omitted html, head, body and end tags are
    supplied; a button, list of options or drawing that is never closed ends at the next block; a script or style that is never closed takes the rest of the page. Other columns are not looked at.
    """
    small_batches(pages.sparkSession)
    out = fresh(pages, "_main")
    return unfold(pages.withColumn(out, text_of(F.col(html), model)), out, ["text", "n_chars"])
