"""Operator 4: main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its DOM leaf blocks. Features of a block are its
ancestors' tags and class words and the shape of its text; neighbouring blocks are
tied by transition weights. The field is trained on labelled pages: a bounded
sample of the given pages, whose semantic elements label them, and page layouts
composed of the sample's texts with marked content. Pages are decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import query, ready, sample_rows, table

#: Pages of the sample that the field is trained on.
SAMPLE = 150
LAYOUTS = 600
FEATURE_BITS = 15
STEPS = 150

# The elements of HTML by role.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style noscript template svg iframe object textarea title canvas audio video".split())
#: Any other element, and text, ends an open head: its end tag and the body's start tag may be left out.
HEAD_HOLDS = set("head title base link meta style script noscript noframes template".split())
#: An open element of the first kind ends when one of the second begins.
ENDS = {
    "p": BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPES = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "main", "aside", "nav", "form", "body"}

TELLING = {"nav", "header", "footer", "aside", "form", "article", "main", "menu", "fieldset", "button", "label", "dialog"}

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
MARK = "data-content"


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]
    link_chars: int
    mark: str | None


class Blocks(HTMLParser):
    """Collects the leaf blocks of a page; ``html.parser`` decodes references and skips comments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = [("html", "")]
        self.marks: list[str | None] = [None]
        self.found: list[Block] = []
        self.words: list[str] = []
        self.hidden = self.links = self.link_chars = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.found.append(Block(text, tuple(self.open), self.link_chars, self.marks[-1]))
        self.words, self.link_chars = [], 0

    def _pop(self, upto: int) -> None:
        for tag, _ in self.open[upto:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.open[upto:], self.marks[upto:]

    def _end_implied(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if tag in ENDS.get(name, ()):
                self._pop(k)
                if name not in ("td", "th"):
                    return
            elif name in SCOPES:
                return

    def _end_head(self) -> None:
        while self.open[-1][0] == "head":
            self._pop(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_HOLDS:
            self._end_head()
        if tag in BLOCKS:
            self.flush()
            self._end_implied(tag)
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        given = dict(attrs)
        about = " ".join(v for k in ("class", "id", "role", "itemprop") if (v := given.get(k)))
        self.open.append((tag, about))
        self.marks.append(given.get(MARK, self.marks[-1]))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag or tag in HEADINGS and self.open[k][0] in HEADINGS:
                self._pop(k)
                return
            # The end of an inline element doesn't close blocks around it.
            if tag not in BLOCKS and tag not in HIDDEN and self.open[k][0] in BLOCKS:
                return

    def handle_data(self, data):
        if data.strip(" \t\n\r\f"):
            self._end_head()
        if not self.hidden:
            self.words.append(data)
            if self.links:
                self.link_chars += len(data)


def leaf_blocks(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1)


def _path_features(path: tuple[tuple[str, str], ...]) -> list[int]:
    out = {f"in {tag}" for tag, _ in path[1:]}
    blocks = [tag for tag, _ in path if tag in BLOCKS]
    out |= {f"parent {blocks[-1] if blocks else ''}", f"parents {' '.join(blocks[-2:])}"}
    for tag, about in path:
        for word in _NAME.findall(about):
            word = word.lower()
            out |= {f"word {word}", f"start {word[:4]}", f"{tag} {word}"}
    # The innermost part that says what it is.
    telling = next((f"{tag} {about}" for tag, about in reversed(path) if about or tag in TELLING), "")
    out |= {f"nearest {w.lower()}" for w in _NAME.findall(telling)} | {f"nearest {w.lower()[:4]}" for w in _NAME.findall(telling)}
    return [_number(x) for x in out]


def _text_features(block: Block, at: int, count: int) -> list[int]:
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    out = [
        f"words {words.bit_length()}",
        f"links {min(4, 5 * block.link_chars // size)}",
        f"ends {text[-1] if text[-1] in '.!?:;,' else ''}",
        f"commas {min(3, text.count(','))}",
        f"sentences {min(3, text.count('. '))}",
        f"place {5 * at // count}",
        f"sign {'©' in text or '|' in text or '»' in text or '·' in text}",
        "any",
    ]
    return [_number(x) for x in out]


def features(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all blocks and where each block's begin."""
    by_path: dict[tuple, list[int]] = {}
    numbers, starts = [], []
    for k, b in enumerate(blocks):
        if b.path not in by_path:
            by_path[b.path] = _path_features(b.path)
        starts.append(len(numbers))
        numbers += by_path[b.path]
        numbers += _text_features(b, k, len(blocks))
    return np.array(numbers, dtype=np.int64), np.array(starts, dtype=np.int64)


@dataclass
class Field:
    """Weights of a two-label chain: by feature, by pair of neighbouring labels."""

    weights: np.ndarray  # features x 2
    steps: np.ndarray  # 2 x 2

    def scores(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[numbers], starts, axis=0)

    def decode(self, scores: np.ndarray) -> list[bool]:
        """The best label sequence (Viterbi)."""
        (a00, a01), (a10, a11) = self.steps.tolist()
        rows = scores.tolist()
        (no, yes), back = rows[0], []
        for s0, s1 in rows[1:]:
            from0, from1 = (yes + a10 > no + a00), (yes + a11 > no + a01)
            back.append((from0, from1))
            no, yes = (yes + a10 if from0 else no + a00) + s0, (yes + a11 if from1 else no + a01) + s1
        label = yes > no
        out = [label]
        for from0, from1 in reversed(back):
            label = from1 if label else from0
            out.append(label)
        return out[::-1]


def _marginals(scores: np.ndarray, mask: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (pages x blocks x 2) and expected label pairs, by forward and backward sums."""
    pages, length, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps[None], axis=1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(steps[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
    pair = forward[:, :-1, :, None] + steps + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
    return single, (np.exp(pair) * mask[:, 1:, None, None]).sum((0, 1))


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, rate: float = 0.1, penalty: float = 2e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all pages."""
    pages = sorted(((b, y) for b, y in pages if b), key=lambda page: len(page[0]))
    size = 1 << FEATURE_BITS
    if not pages:
        return Field(np.zeros((size, 2)), np.zeros((2, 2)))
    # Pages of similar length share padded arrays: the span of their blocks, mask and labels.
    lots = []
    numbers, rows, at = [], [], 0
    for _, lot in groupby(pages, key=lambda page: len(page[0]).bit_length() // 2):
        lot = list(lot)
        mask = np.zeros((len(lot), len(lot[-1][0])), dtype=bool)
        truth = np.zeros((*mask.shape, 2))
        begin = at
        for k, (blocks, labels) in enumerate(lot):
            own, starts = features(blocks)
            numbers.append(own)
            rows.append(at + np.searchsorted(starts, np.arange(len(own)), side="right") - 1)
            at += len(blocks)
            mask[k, : len(blocks)] = True
            truth[k, np.arange(len(blocks)), np.array(labels, dtype=int)] = 1
        lots.append((slice(begin, at), mask, truth))
    numbers, rows = np.concatenate(numbers), np.concatenate(rows)
    seen_pairs = sum(np.einsum("pti,ptj->ij", truth[:, :-1], truth[:, 1:]) for _, _, truth in lots)
    parameters = [np.zeros((size, 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(x) for x in parameters], [np.zeros_like(x) for x in parameters]
    starts = np.searchsorted(rows, np.arange(at))
    for step in range(1, steps + 1):
        weights, links = parameters
        every = np.add.reduceat(weights[numbers], starts, axis=0)
        rest, pairs = np.empty_like(every), np.zeros((2, 2))
        for span, mask, truth in lots:
            scores = np.zeros(truth.shape)
            scores[mask] = every[span]
            single, own_pairs = _marginals(scores, mask, links)
            rest[span] = (single - truth)[mask]
            pairs += own_pairs
        slope = np.stack([np.bincount(numbers, weights=rest[rows, y], minlength=size) for y in (0, 1)], axis=1)
        for k, g in enumerate((slope / len(pages) + penalty * weights, (pairs - seen_pairs) / len(pages) + penalty * links)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            parameters[k] = parameters[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(*parameters)


# --------------------------------------------------------- labelled pages

# Class words that pages use for their parts.
CONTENT_NAMES = (
    "content,post,entry-content,article-body,story,post-body,main-content,article,text,body-text,articleBody,page-content,"
    "entry,post-content,story-body,main,prose,reading,chapter"
).split(",")
OTHER_NAMES = {
    "nav": "nav,menu,navbar,breadcrumb,breadcrumbs,site-nav,topmenu,links,navigation,pagination,toc,main-menu,tabs".split(","),
    "header": "header,site-header,masthead,topbar,page-header,logo,branding,tagline".split(","),
    "footer": "footer,site-footer,copyright,legal,bottom,colophon,page-footer,credits".split(","),
    "aside": "sidebar,aside,widget,related,recommended,side,popular,trending,more-stories,rail,tags,author-box,box".split(","),
    "ad": "ad,ads,advert,advertisement,sponsor,sponsored,promo,banner,ad-slot,adbox,promotion,adsense,teaser".split(","),
    "notice": "cookie,cookie-notice,consent,notice,alert,popup,modal,gdpr,message,warning,cookies,overlay,disclaimer,privacy".split(","),
    "form": "form,newsletter,subscribe,search,signup,login,contact-form,search-form,subscription,feedback,poll".split(","),
    "comment": "comments,comment,commentlist,reader-comments,responses,discussion,replies,disqus,comment-list,reviews,user-comments".split(","),
    "share": "share,social,share-bar,follow,social-links,buttons,tools,meta,byline".split(","),
}


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class Layouts:
    """Composes page layouts from texts; what carries ``MARK`` = 1 is content."""

    def __init__(self, texts: list[str], seed: int):
        self.pick, self.texts = random.Random(seed), texts or ["Text of a page, with some words in it."]

    def prose(self) -> str:
        words = self.pick.choice(self.texts).split()
        start = self.pick.randrange(max(1, len(words) - 5))
        return _escaped(" ".join(words[start : start + self.pick.choice((2, 6, 12, 25, 60, 120))]))

    def short(self) -> str:
        words = self.pick.choice(self.texts).split()
        start = self.pick.randrange(max(1, len(words) - 2))
        return _escaped(" ".join(words[start : start + self.pick.randint(1, 4)]))

    def named(self, kind: str) -> str:
        if self.pick.random() < 0.15:
            return ""
        name = self.pick.choice(CONTENT_NAMES if kind == "content" else OTHER_NAMES[kind])
        return f' {self.pick.choice(("class", "class", "id"))}="{name}"'

    def other(self, kind: str) -> str:
        p, n = self.pick, self.named(kind) or f' class="{self.pick.choice(OTHER_NAMES[kind])}"'
        if kind == "nav":
            tag = p.choice(("nav", "nav", "div", "ul", "menu"))
            items = "".join(f'<li><a href="/x">{self.short()}</a></li>' for _ in range(p.randint(2, 8)))
            inner = items if tag in ("ul", "menu") else p.choice((f"<ul>{items}</ul>", items.replace("li>", "span>")))
            return f"<{tag}{n if tag != 'nav' else self.named(kind)}>{inner}</{tag}>"
        if kind == "form":
            tag = p.choice(("form", "form", "div"))
            inner = f"<label>{self.short()}</label><input name=q><select><option>{self.short()}<option>{self.short()}</select><button>{self.short()}</button>"
            inner = p.choice((inner, f"<p>{self.prose()}</p>{inner}", f"<h3>{self.short()}</h3>{inner}", f"<fieldset><legend>{self.short()}</legend>{inner}</fieldset>"))
            return f"<{tag}{self.named(kind) if tag == 'form' else n}>{inner}</{tag}>"
        if kind == "comment":
            tag = p.choice(("section", "div", "ol", "ul"))
            wrap = ("li", "li") if tag in ("ol", "ul") else ("div class=comment", "div")
            one = "".join(f"<{wrap[0]}>{p.choice(('', f'<b>{self.short()}</b>', f'<h4>{self.short()}</h4>'))}<p>{self.prose()}</p></{wrap[1]}>" for _ in range(p.randint(1, 5)))
            head = p.choice(("", f"<h2>{self.short()}</h2>", f"<h3>{self.short()}</h3>")) if tag not in ("ol", "ul") else ""
            return f"<{tag}{n}>{head}{one}</{tag}>"
        tag = {"header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "aside", "div", "section")}.get(kind, ("div", "div", "section", "p"))
        tag = p.choice(tag)
        lines = (self.short(), f"&copy; {self.prose()}", self.prose()) if kind == "footer" else (self.short(), self.prose(), self.prose())
        inner = p.choice(lines)
        if tag != "p":
            wraps = (f"<p>{inner}</p>", inner, f"<h3>{self.short()}</h3><p>{inner}</p>", f"<ul><li><a href=x>{self.short()}</a><li><a href=x>{self.short()}</a></ul>", f"<h1>{inner}</h1>" if kind == "header" else f"<div>{inner}</div>")
            inner = p.choice(wraps)
        semantic = tag in ("header", "footer", "aside")
        return f"<{tag}{self.named(kind) if semantic else n}>{inner}</{tag}>"

    def content(self) -> str:
        p, parts = self.pick, []
        for k in range(p.choice((1, 2, 3, 5, 8, 14))):
            parts.append(
                p.choices(
                    (
                        f"<p>{self.prose()}</p>",
                        f"<p><b>{self.prose()}<br>",
                        f"<h{p.randint(1, 4)}>{self.short()}</h{p.randint(1, 4)}>",
                        f"<ul><li>{self.prose()}<li>{self.prose()}</ul>",
                        f"<blockquote><p>{self.prose()}</p></blockquote>",
                        f"<div>{self.prose()}</div>",
                        f"<table><tr><th>{self.short()}<td>{self.short()}</table>",
                        f"<pre>{self.prose()}</pre>",
                        f"<figure><img src=x><figcaption>{self.short()}</figcaption></figure>",
                        f'<p>{self.short()} <a href="x">{self.short()}</a> {self.prose()}</p>',
                    ),
                    (50, 6, 10, 6, 5, 8, 3, 2, 3, 8),
                )[0]
            )
            if p.random() < 0.12:
                kind = p.choice(("ad", "aside", "form", "share", "notice"))
                parts.append(f"<section {MARK}=0>{self.other(kind)}</section>" if p.random() < 0.1 else self._unmarked(kind))
        if p.random() < 0.7:
            parts.insert(0, f"<h1>{self.short()}</h1>")
        return "".join(parts)

    def _unmarked(self, kind: str) -> str:
        html = self.other(kind)
        end = re.match(r"<\w+", html).end()
        return f"{html[:end]} {MARK}=0{html[end:]}"

    def page(self) -> str:
        p = self.pick
        tag = p.choice(("article", "article", "main", "div", "div", "section"))
        role = ' role="main"' if tag == "div" and p.random() < 0.2 else ""
        name = self.named("content") if tag in ("article", "main") else f' class="{p.choice(CONTENT_NAMES)}"'
        inner = self.content() + (self._unmarked("comment") if p.random() < 0.2 else "")
        body = f"<{tag}{role}{name} {MARK}=1>{inner}</{tag}>"
        if tag != "main" and p.random() < 0.3:
            body = f"<main>{body}{self.other(p.choice(('comment', 'aside', 'share')))if p.random() < 0.5 else ''}</main>"
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if p.random() < 0.45]
        after = [k for k in ("share", "aside", "comment", "ad", "form", "nav", "notice", "footer") if p.random() < 0.4]
        top, rest = "".join(map(self.other, before)), "".join(map(self.other, after))
        if p.random() < 0.4:
            top, rest = f'<div class="{p.choice(("wrapper", "container", "page", "layout", "row", "site"))}">{top}', f"{rest}</div>"
        return f"<html><head><title>{self.short()}</title><style>p{{}}</style></head><body>{top}{body}{rest}</body></html>"


def labelled_layouts(texts: list[str], count: int = LAYOUTS, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    make = Layouts(texts, seed)
    pages = [leaf_blocks(make.page()) for _ in range(count)]
    return [(blocks, [b.mark == "1" for b in blocks]) for blocks in pages]


def semantic_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels of a page whose own elements tell its article; None without one."""
    other = {w for k in ("nav", "ad", "comment", "notice", "form") for name in OTHER_NAMES[k] for w in [name]}
    labels = []
    for b in blocks:
        tags = {t for t, _ in b.path}
        names = {w for _, about in b.path for w in about.split()}
        labels.append(bool(tags & {"article", "main"}) and not tags & {"nav", "aside", "footer", "header", "form"} and not names & other)
    return labels if any(labels) else None


def learn_from_pages(pages: DataFrame, *, key: str = "page_id", html: str = "html", sample: int = SAMPLE, layouts: int = LAYOUTS) -> Field:
    """Train on ``sample`` of the pages (by a hash of the key), each whole, and on ``layouts`` composed of their texts.

    Pages without html are left out; without any page the composed layouts have no texts but short ones.
    """
    rows = pages.where(F.col(f"`{html}`").isNotNull()).select(F.col(f"`{html}`").alias("html"), F.col(f"`{key}`").alias("key"))
    given = [leaf_blocks(r.html) for r in sample_rows(rows, ["key"], sample, salt="extract")]
    texts = [b.text for blocks in given for b in blocks if len(b.text) > 20]
    own = [(blocks, labels) for blocks in given if (labels := semantic_labels(blocks))]
    return train(own + labelled_layouts(texts, layouts))


def main_text(field: Field, html: str) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    labels = field.decode(field.scores(*features(blocks)))
    return "\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extract_main_text(pages: DataFrame, field: Field, *, html: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of each page as ``name`` (replacing a column of that name).

    Blocks that the field takes for content, in page order, one per line; inside a
    block white space is one space and references are decoded. NULL and empty html,
    and pages without a content block, give an empty text. Whole pages are read;
    equal pages give equal texts.
    """
    spark = pages.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(field)

    @F.arrow_udf("string")
    def extract(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            yield pa.array([main_text(shared.value, x.as_py() or "") for x in column], pa.string())

    return pages.withColumn(name, extract(F.col(f"`{html}`")))


@query("op4_main_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = extract_main_text(pages, learn_from_pages(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
