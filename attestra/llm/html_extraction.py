"""Main text of web pages by a linear-chain conditional random field.

A page is read into its DOM leaf blocks (``dom.blocks``). Each block has features of its
ancestors (tags; classes, ids and roles by what their words stand for) and of its text
(length, links, marks, place). Neighbouring blocks are chained: the field has a weight
per feature and one per pair of neighbouring labels (main text or not), is trained by
maximum likelihood on labelled pages, and decodes each page by Viterbi in one pass. The
few hundred weights go to the tasks; pages stay where they are read, nothing is shuffled.

Labelled pages: ``pages`` itself gives a bounded sample of ``FIT_PAGES`` rows of at most
``FIT_BYTES`` each (the first by a hash of page_id; both bounds concern the training only),
of which those that mark an article or main element are labelled by it; as many are
composed by rule from the words of these, in layouts with menus, headers, sidebars,
notices, adverts, forms, comments and footers in varied tags and classes. Pages to decode
are read and decoded whole, in time proportional to their length.

Defined results: null, empty and text-free pages give an empty text and 0 characters. Repeated
rows get a row each; a null page_id or url stays null. Further columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, slices, table, utf8
from .dom import Block, blocks

FIT_PAGES, FIT_BYTES, STEPS, RIDGE = 200, 65_536, 150, 0.02

#: What words of classes, ids and roles stand for.
KINDS = {
    "comment": "comment comments reply replies respond disqus discussion reader",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs",
    "notice": "cookie cookies consent notice alert gdpr subscribe newsletter popup modal overlay paywall message warning",
    "side": "sidebar side aside widget related recommended more trending popular complementary",
    "foot": "footer foot copyright legal colophon contentinfo bottom",
    "head": "header masthead logo brand topbar top",
    "share": "share social follow tags tag meta byline author date",
    "form": "form login search signup register",
    "content": "content article post entry story main body text",
}
_KIND = {w: k for k, words in KINDS.items() for w in words.split()}
TAGS = "article main section nav header footer aside form button fieldset label ul ol li dl p h1 h2 h3 h4 h5 h6 table td th blockquote pre figure figcaption div address details dialog a".split()
_TAGS = frozenset(TAGS)
_NUMBER = {f: i for i, f in enumerate([*(f"tag {t}" for t in TAGS), *(f"name {k}" for k in KINDS), *(f"inner {k}" for k in ("div", "p", "li", "h", "a", "td", "other")), "bias", "no container", *(f"length {k}" for k in range(8)), *(f"links {k}" for k in range(4)), "ends sentence", "copyright sign", "first", "last", "one word", "talks of cookies"])}


def leaves(page: str | None) -> list[Block]:
    return blocks(page, _TAGS, _KIND)


def features(page: list[Block]) -> list[list[int]]:
    out = []
    for i, b in enumerate(page):
        own = {f"tag {t}" for t in b.tags} | {f"name {k}" for k in b.kinds} | {"bias"}
        inner = b.inner or "other"
        own.add(f"inner {inner if inner in ('div', 'p', 'li', 'a', 'td') else 'h' if inner[:1] == 'h' and inner[1:].isdigit() else 'other'}")
        if not b.tags & {"article", "main"}:
            own.add("no container")
        n = len(b.text)
        own.add(f"length {min(7, n.bit_length() - 1)}")
        own.add(f"links {min(3, 4 * b.linked // n)}")
        low = b.text.lower()
        talk = 400 * (low.count("cookie") + low.count("subscribe")) > n  # one such word in 400 characters
        own |= {name for name, yes in (("ends sentence", b.text[-1] in ".!?"), ("copyright sign", "©" in b.text), ("first", i == 0), ("last", i == len(page) - 1), ("one word", " " not in b.text), ("talks of cookies", talk)) if yes}
        out.append([_NUMBER[f] for f in own if f in _NUMBER])
    return out


class Field:
    """Weights of the features for label 1 (label 0 has none), and of label pairs."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        w, ((aa, ab), (ba, bb)) = self.weights, self.pairs.tolist()
        back, zero, one = [], 0.0, 0.0
        for i, r in enumerate(rows):
            e = float(w[r].sum())
            if i == 0:
                zero, one = 0.0, e
                continue
            to_zero, to_one = one + ba > zero + aa, one + bb > zero + ab
            back.append((to_zero, to_one))
            zero, one = max(zero + aa, one + ba), max(zero + ab, one + bb) + e
        if not rows:
            return []
        label = int(one > zero)
        labels = [label]
        for to_zero, to_one in reversed(back):
            label = int(to_one if label else to_zero)
            labels.append(label)
        return labels[::-1]


def train(pages: list[list[list[int]]], labels: list[list[int]], steps: int = STEPS) -> Field:
    """Maximum likelihood with a ridge penalty; all pages move along their chains together."""
    n, longest, f = len(pages), max(map(len, pages)), len(_NUMBER)
    mask = np.arange(longest) < np.array([len(p) for p in pages])[:, None]
    rows = [r for page in pages for r in page]
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    feature, block = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = np.zeros((n, longest), np.int64)
    y[mask] = [v for own in labels for v in own]
    both = mask[:, 1:]
    pairs_seen = np.zeros((2, 2))
    np.add.at(pairs_seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    over = lambda weight: np.bincount(feature, weights=weight[block], minlength=f)  # noqa: E731  a sum for each feature over the blocks that have it
    seen = over(y[mask].astype(float))
    theta = np.zeros(f + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        e = np.zeros((n, longest))
        e[mask] = np.add.reduceat(theta[feature], begin)
        t = theta[f:].reshape(2, 2)
        emit = np.stack([np.zeros_like(e), e], axis=2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for j in range(1, longest):
            ahead[:, j] = np.where(mask[:, j, None], emit[:, j] + np.logaddexp(ahead[:, j - 1, :1] + t[0], ahead[:, j - 1, 1:] + t[1]), ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            nxt = emit[:, j + 1] + behind[:, j + 1]
            behind[:, j] = np.where(mask[:, j + 1, None], np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:]), 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z[:, None])
        joint = np.exp(ahead[:, :-1, :, None] + t + (emit + behind)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grad = np.concatenate([seen - over(one[mask]), (pairs_seen - joint.sum(axis=(0, 1))).ravel()]) / n - RIDGE * theta / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:f], theta[f:].reshape(2, 2))


def marked(page: list[Block]) -> list[int] | None:
    """Labels by the page's own article or main element; None where it has none."""
    inside = [bool({"article", "main"} & b.tags) for b in page]
    if not any(inside):
        return None
    bad = {"nav", "header", "footer", "aside", "form", "button", "dialog"}
    return [int(ok and not bad & b.tags and not b.kinds & {"comment", "advert", "menu", "notice", "side", "foot", "form"}) for ok, b in zip(inside, page)]


def composed(words: list[str], count: int, seed: int = 11) -> Iterator[tuple[list[Block], list[int]]]:
    """Labelled pages composed by rule from the given words."""
    rng = random.Random(seed)
    words = [w for w in words if not set(w) & set("<>&")] or ["text"]  # such words would change as markup

    def say(low: int, high: int, end: str = ".") -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high))).strip(".") + end

    def element(kinds: list[tuple[str, str]], inside: str) -> str:
        tag, name = rng.choice(kinds)
        shown = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{shown}>{inside}</{tag}>"

    def menu() -> str:
        items = "".join(f'<li><a href="/{i}">{say(1, 3, "")}</a></li>' for i in range(rng.randint(2, 8)))
        return element([("nav", ""), ("nav", "menu"), ("div", "navbar"), ("div", "breadcrumb"), ("ul", "menu"), ("div", "navigation")], f"<ul>{items}</ul>" if rng.random() < 0.7 else items)

    def side() -> str:
        return element([("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("section", "widget"), ("div", "popular")], f"<h3>{say(1, 4, '')}</h3>" + "".join(f'<p><a href="#">{say(3, 9)}</a></p>' if rng.random() < 0.5 else f"<p>{say(4, 30)}</p>" for _ in range(rng.randint(1, 4))))

    def advert() -> str:
        return element([("div", "ad"), ("div", "ads"), ("aside", "advertisement"), ("div", "sponsored"), ("section", "promo"), ("div", "banner")], rng.choice([say(3, 30), f"<p>{say(3, 30)}</p>", f'<a href="#">{say(2, 8)}</a>']))

    def notice() -> str:
        return element([("div", "cookie-notice"), ("div", "consent"), ("div", "alert"), ("section", "newsletter"), ("div", "subscribe"), ("dialog", "popup"), ("div", "notice")], f"<p>{say(4, 25)}</p>" + rng.choice(["", "<button>OK</button>"]))

    def form() -> str:
        return element([("form", ""), ("form", "search"), ("form", "login")], f"<label>{say(1, 3, '')}</label><input><button>{say(1, 2, '')}</button>")

    def comments() -> str:
        return element([("section", "comments"), ("div", "comments"), ("div", "discussion"), ("ol", "comment-list"), ("div", "replies")], f"<h3>{say(1, 3, '')}</h3>" + "".join(rng.choice([f"<p>{say(4, 60)}</p>", f'<div class="comment"><b>{say(1, 2, "")}</b><p>{say(4, 60)}</p></div>', f"<li>{say(4, 40)}</li>"]) for _ in range(rng.randint(1, 5))))

    def foot() -> str:
        return element([("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright")], rng.choice([f"&copy; {say(2, 12)}", f"<p>{say(3, 20)}</p>", f"<p>&copy; {say(2, 8)}</p><ul><li><a>{say(1, 2)}</a></li></ul>"]))

    def head() -> str:
        return element([("header", ""), ("header", "masthead"), ("div", "header"), ("div", "topbar")], rng.choice([f"<h1>{say(1, 3, '')}</h1>", f'<a class="logo" href="/">{say(1, 2, "")}</a><p>{say(2, 6)}</p>']))

    for _ in range(count):
        main: list[str] = []

        def text(low: int, high: int, end: str = ".") -> str:
            main.append(say(low, high, end) + f" {rng.randrange(1 << 30)}{end}")
            return main[-1]

        body = f"<h1>{text(2, 9, '')}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 14)):
            body += rng.choice([f"<p>{text(1, 120)}</p>"] * 12 + [f"<h2>{text(1, 6, '')}</h2>", f"<ul><li>{text(2, 15)}</li><li>{text(2, 15)}</li></ul>", f"<blockquote>{text(5, 40)}</blockquote>", f"<div>{text(5, 80)}</div>", f"<table><tr><td>{text(1, 4, '')}</td><td>{text(1, 4, '')}</td></tr></table>", f"<pre>{text(3, 20)}</pre>"]) if rng.random() < 0.93 else rng.choice([advert, notice, form])()
        body += comments() if rng.random() < 0.25 else ""
        article = element([("article", "")] * 6 + [("main", ""), ("article", "post"), ("div", "content"), ("div", "entry-content"), ("div", "article-body"), ("div", "story")], body)
        before = [f() for f in (notice, head, menu, form, advert, side) if rng.random() < 0.5]
        after = [f() for f in (side, comments, advert, form, notice, foot, foot) if rng.random() < 0.45]
        page = leaves(f"<html><body>{''.join(before)}{article}{''.join(after)}</body></html>")
        mine = {" ".join(t.split()) for t in main}
        yield page, [int(b.text in mine) for b in page]


def fit(pages: DataFrame, most: int = FIT_PAGES, most_bytes: int = FIT_BYTES) -> Field:
    """A field trained on ``most`` pages of the table at most, of ``most_bytes`` at most, and on as many composed ones."""
    # the ids are chosen first: no page's text is sorted, and bounded bytes of ``most`` pages reach the driver
    small = pages.where(F.octet_length("html") <= most_bytes).select("page_id", "html")
    ids = small.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    sample = [leaves(r.html) for r in small.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy(F.xxhash64("page_id"), "page_id").collect()]
    words = sorted({w for page in sample for b in page for w in b.text.split()})
    known = [(page, labels) for page in sample if (labels := marked(page)) is not None]
    known += [(page, labels) for page, labels in composed(words, most) if page]
    return train([features(page) for page, _ in known], [labels for _, labels in known])


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    sent = pages.sparkSession.sparkContext.broadcast((field.weights, field.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for batch in batches:
            at, texts = utf8(batch.column(2))[1], []
            for a, b in slices(at):
                for page in batch.column(2).slice(a, b - a).to_pylist():
                    parts = leaves(page)
                    texts.append("\n\n".join(x.text for x, label in zip(parts, own.decode(features(parts))) if label))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(session(spark), sf_dir, "pages")
    return extract(pages, fit(pages))
