"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks.

A page's leaf blocks (runs of text between block-level tags, in page order)
carry features of their ancestors (tags, words of classes and ids) and of their
text (length, share of link text, punctuation, place in the page). A chain
model with two states, article and rest, is fitted on a bounded sample of
labelled pages by maximum likelihood; Viterbi picks the likeliest states of
each page. Labels: blocks under ``article`` or ``main`` markup, outside
navigation, asides, forms and comments; each labelled page is also rewritten
in other layouts (plain ``div`` markup, with sidebars, notices and comments
made of other pages' text), which keeps its labels. A table without such markup
lends its long unlinked blocks as articles to the other layouts. Extraction is one narrow
pass.

Defined results: null and empty pages, and pages without article blocks, give
the empty text; pages are read whole and may nest to any depth; unclosed tags,
comments and quotes end with the page; repeated rows give repeated results; an
empty table gives an empty table; other columns do not enter.
"""

from __future__ import annotations

import html
import random
import re
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FIT_PAGES = 240   # labelled pages that the model is fitted on, at most, before rewriting
ROUNDS = 150
L2 = 1e-3
LAYOUTS = 120     # rewritten pages at least where no page is labelled
_MARKER = "\ue000"
SAMPLE_CHARS = 60_000  # longer pages are no training pages

# Elements of HTML by what they do to text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style template noscript iframe svg math title object canvas audio video select".split())
_ENDLESS = _SKIPPED - frozenset("script style iframe title".split())   # without an end tag only their own tag is passed over
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section "
    "summary table tbody td textarea tfoot th thead tr ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in _SKIPPED | {"textarea"}}
_MARK = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_REST = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_TOKEN = re.compile(r"[A-Za-z]{2,}")
# Markup that names the article, and markup that is never part of it.
_INSIDE = frozenset({"<article>", "<main>"})
_OUTSIDE = frozenset({"<nav>", "<aside>", "<footer>", "<form>", "<menu>", "<button>", "<dialog>", "<fieldset>", "ad", "ads",
                      "comments", "comment", "sidebar", "cookie", "notice", "banner", "menu"})


class Block(NamedTuple):
    text: str
    linked: int            # characters of link text
    tag: str               # nearest block-level element
    marks: frozenset       # tags and name words of all ancestors
    near: tuple            # tags of the nearest ancestors


def parse(page: str) -> list[Block]:
    """Leaf blocks of a page, in order. Linear in its length."""
    blocks: list[Block] = []
    tags, marks, open_tags = ["#"], [frozenset()], {}
    parts: list[str] = []
    links = linked = at = 0
    unended = set()
    size = len(page)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag = next((t for t in reversed(tags[-6:]) if t in _BLOCKS), "#")
                blocks.append(Block(text, min(linked, len(text)), tag, marks[-1], tuple(tags[-4:])))
            parts.clear()
        linked = 0

    def pop():
        nonlocal links
        tag = tags.pop()
        marks.pop()
        open_tags[tag] -= 1
        links -= tag == "a"

    def leave(tag):
        while tags[-1] != tag:
            pop()
        pop()

    while at < size:
        m = _MARK.search(page, at)
        text = page[at:m.start() if m else size]
        if text:
            if open_tags.get("head") and not text.isspace():
                leave("head")
            parts.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        if m[2] is None:      # comment, declaration
            close = "-->" if m[0] == "<!--" else ">"
            end = page.find(close, m.end())
            at = size if end < 0 else end + len(close)
            continue
        rest = _REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1 or size
        tag, at = m[2].lower(), end
        if m[1]:
            if tag in _BLOCKS:
                flush()
            if open_tags.get(tag):
                leave(tag)
            continue
        if tag in _RAW_END:
            if tag in unended or tag in ("svg", "math") and page.endswith("/>", 0, at):
                continue
            stop = _RAW_END[tag].search(page, at)
            if stop:
                at = page.find(">", stop.start()) + 1 or size
            elif tag in _ENDLESS:
                unended.add(tag)
            else:
                at = size
            continue
        if tag == "br" or tag in _VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if open_tags.get("head"):     # its end tag may be left out
            leave("head")
        if tag in _BLOCKS:
            flush()
            closed = _CLOSES.get(tag, ())
            if open_tags.get("p"):
                leave("p")
            elif closed and tags[-1] in closed:
                pop()
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(page, m.end(), end)) if end - m.end() > 4 else ""
        own = {f"<{tag}>"} | {w.lower() for w in _TOKEN.findall(names[:400])}
        tags.append(tag)
        marks.append(marks[-1] if own <= marks[-1] else marks[-1] | own)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out, n, seen_h1 = [], len(blocks), False
    for i, b in enumerate(blocks):
        size = len(b.text)
        f = [f"m:{x}" for x in b.marks]
        f += [f"t:{b.tag}", "n:" + "/".join(b.near[-2:]), f"len:{min(8, size.bit_length())}",
              f"link:{min(4, 4 * b.linked // max(1, size))}", f"place:{3 * i // n}",
              f"end:{b.text[-1] if b.text[-1] in '.!?:,;' else 'x'}", f"commas:{min(3, b.text.count(','))}",
              f"h1:{seen_h1}", f"digits:{min(3, 8 * sum(c.isdigit() for c in b.text[:200]) // min(200, size))}"]
        if i:
            f.append(f"prev:{min(8, len(blocks[i - 1].text).bit_length())}/{blocks[i - 1].tag}")
            f.append(f"same:{blocks[i - 1].near == b.near}")
        if i + 1 < n:
            f.append(f"next:{min(8, len(blocks[i + 1].text).bit_length())}/{blocks[i + 1].tag}")
        out.append(f)
        seen_h1 = seen_h1 or b.tag == "h1"
    return out


def labels(blocks: list[Block]) -> list[int]:
    """1 for the article's blocks, by the page's own markup."""
    return [int(bool(b.marks & _INSIDE) and not b.marks & _OUTSIDE) for b in blocks]


def guessed(blocks: list[Block]) -> list[int]:
    """1 for blocks that can stand for an article where no markup names one: long
    and unlinked ones (else the longest), with unlinked paragraphs and headings beside them."""
    plain = [len(b.text) * (4 * b.linked <= len(b.text) and not b.marks & _OUTSIDE) for b in blocks]
    least = min(80, max(plain, default=0)) or 1
    beside = {(b.near[:-1], b.marks - {f"<{b.tag}>"}) for b, x in zip(blocks, plain) if x >= least}
    return [int(x >= least or x > 0 and b.tag in ("h1", "h2", "h3", "p", "blockquote")
                and (b.near[:-1], b.marks - {f"<{b.tag}>"}) in beside) for b, x in zip(blocks, plain)]


# ------------------------------------------------------------------ training


def _layout(rng: random.Random, article: list[tuple[str, str]], rest: list[str]) -> list[tuple[str, int]]:
    """One page in some layout, as pieces of markup with the label of their text."""
    def some(k):
        return [html.escape(rng.choice(rest))[:rng.choice((30, 60, 150, 400))] for _ in range(k)]

    def box(names, inner):
        tag = rng.choice(("div", "div", "section"))
        attr = rng.choice(("class", "id"))
        return [(f'<{tag} {attr}="{rng.choice(names)}">', 0), *inner, (f"</{tag}>", 0)]

    def linked(words):
        return [(f'<li><a href="/{i}">{" ".join(w.split()[:3])}</a></li>', 0) for i, w in enumerate(words)]

    body = []
    for tag, text in article:
        body.append((f"<{tag}>{html.escape(text)}</{tag}>", 1))
        if rng.random() < 0.08:
            body += box(("ad", "advert", "advertisement", "promo", "sponsored"), [(f"<p>{some(1)[0]}</p>", 0)])
    semantic = rng.random() < 0.5
    if semantic:
        tag = rng.choice(("article", "main"))
        head = [("<header>", 0), body[0], ("</header>", 0)] if rng.random() < 0.4 else body[:1]
        body = [(f"<{tag}>", 0), *head, *body[1:], (f"</{tag}>", 0)]
    else:
        body = box(("content", "post", "entry-content", "article-body", "main", "story", "page text", "c1", "container"), body)
    menu = linked(some(rng.randint(3, 8)))
    menu = [("<nav><ul>", 0), *menu, ("</ul></nav>", 0)] if rng.random() < 0.4 else box(
        ("nav", "menu", "navbar", "topnav", "breadcrumbs", "navigation"), [("<ul>", 0), *menu, ("</ul>", 0)])
    header = [(f"<header><h2>{some(1)[0][:40]}</h2></header>", 0)] if rng.random() < 0.5 else box(
        ("header", "masthead", "site-header", "top"), [(f"<div>{some(1)[0][:60]}</div>", 0)])
    notice = box(("cookie", "cookie-notice", "consent", "notice", "alert", "banner", "gdpr", "popup"),
                 [(f"<p>{some(1)[0]}</p>", 0), ("<button>OK</button>", 0)])
    ad = box(("ad", "ads", "advert", "advertisement", "sponsor", "promo"), [(some(1)[0], 0)])
    side = [("<aside>", 0), *[(f"<p>{x}</p>", 0) for x in some(rng.randint(1, 4))], ("</aside>", 0)]
    if rng.random() < 0.5:
        side = box(("sidebar", "side", "related", "widget", "recommended", "newsletter", "share", "social"), side[1:-1])
    talk = box(("comments", "comment-list", "disqus", "responses", "replies", "discussion"),
               [("<h3>Comments</h3>", 0), *[(f'<div class="comment"><p>{x}</p></div>', 0) for x in some(rng.randint(1, 5))]])
    form = [("<form><label>Name</label><p>Send us a message</p><button>Send</button></form>", 0)]
    foot = [(f"<footer>&copy; {some(1)[0]}</footer>", 0)] if rng.random() < 0.5 else box(
        ("footer", "site-footer", "bottom", "copyright", "legal"), [(f"<p>{x}</p>", 0) for x in some(rng.randint(1, 3))])

    def maybe(x, p):
        return x if rng.random() < p else []

    before, after = [maybe(header, 0.6), maybe(menu, 0.8), maybe(notice, 0.5), maybe(ad, 0.5), maybe(side, 0.3)], [
        maybe(talk, 0.5), maybe(side, 0.4), maybe(form, 0.4), maybe(foot, 0.8), maybe(notice, 0.2), maybe(ad, 0.2)]
    rng.shuffle(before)
    rng.shuffle(after)
    page = sum(before, []) + body + sum(after, [])
    if rng.random() < 0.3:
        page = [('<div class="wrapper">', 0), *page, ("</div>", 0)]
    return page


def rewritten(pages: list[list[Block]], seed: int = 11, label=labels, times: int = 3) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the pages in other layouts."""
    rng = random.Random(seed)
    texts = [b.text for p in pages for b in p][:5000] or ["text"]
    out = []
    for page, own in ((p, label(p)) for p in pages):
        article = [(b.tag if b.tag in ("h1", "h2", "h3", "p", "li", "blockquote") else "p", b.text[:2000])
                   for b, y in zip(page, own) if y][:40]
        for _ in range(times if article else 0):
            # a mark no text has goes before every article piece, to find its blocks again
            pieces = _layout(rng, article, texts)
            marked = "".join(re.sub(r">(?=[^<])", ">" + _MARKER, x, count=1) if y else x for x, y in pieces)
            blocks = parse(marked)
            clean = [b._replace(text=b.text.replace(_MARKER, "") or "x") for b in blocks]
            out.append((features(clean), [int(_MARKER in b.text) for b in blocks]))
    return out


def fit(pages: list[str]) -> dict:
    """Weights of a two-state chain: ``names`` (feature to row), ``w`` (rows by
    state), ``move`` (state by state), ``first``. Maximum likelihood with L2,
    by Adam on all pages at once."""
    parsed = [b for b in map(parse, pages) if b]
    if any(1 in labels(b) for b in parsed):
        data = [(features(b), labels(b)) for b in parsed] + rewritten(parsed)
    else:      # what the pages themselves hold is not known; few pages get more layouts
        data = rewritten(parsed, label=guessed, times=max(3, LAYOUTS // max(1, len(parsed))))
    if not data:
        return {"names": {}, "w": np.zeros((0, 2)), "move": np.zeros((2, 2)), "first": np.zeros(2)}
    names: dict[str, int] = {}
    counts: dict[str, int] = {}
    for x, _ in data:
        for f in x:
            for name in f:
                counts[name] = counts.get(name, 0) + 1
    for name, c in counts.items():
        if c >= 3:
            names[name] = len(names)
    n, longest = len(data), max(len(y) for _, y in data)
    spot = np.array([(p * longest + t, names[name]) for p, (x, _) in enumerate(data) for t, f in enumerate(x)
                     for name in f if name in names])
    y = np.zeros((n, longest), int)
    there = np.zeros((n, longest), bool)
    for p, (_, own) in enumerate(data):
        y[p, :len(own)], there[p, :len(own)] = own, True
    truth = np.stack([(y == s) & there for s in (0, 1)], 2).astype(float)
    pair_truth = np.array([[(truth[:, :-1, a] * truth[:, 1:, b]).sum() for b in (0, 1)] for a in (0, 1)])
    size = len(names) * 2
    theta, m, v = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)

    def logsum(a, axis):
        top = a.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))

    for step in range(1, ROUNDS + 1):
        w, move, first = theta[:size].reshape(-1, 2), theta[size:size + 4].reshape(2, 2), theta[size + 4:]
        score = np.stack([np.bincount(spot[:, 0], weights=w[spot[:, 1], s], minlength=n * longest) for s in (0, 1)], 1)
        score = score.reshape(n, longest, 2)
        ahead, back = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            nxt = logsum(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
            ahead[:, t] = np.where(there[:, t, None], nxt, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = logsum(move + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(there[:, t + 1, None], nxt, 0)
        total = logsum(ahead[:, -1], 1)
        state = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
        pairs = np.exp(ahead[:, :-1, :, None] + move + (score + back)[:, 1:, None, :] - total[:, None, None, None])
        pairs = (pairs * there[:, 1:, None, None]).sum((0, 1))
        error = (state - truth).reshape(-1, 2)
        grad = np.concatenate((np.stack([np.bincount(spot[:, 1], weights=error[spot[:, 0], s], minlength=len(names))
                                         for s in (0, 1)], 1).ravel(), (pairs - pair_truth).ravel(),
                               (state[:, 0] - truth[:, 0]).sum(0))) / n + L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return {"names": names, "w": theta[:size].reshape(-1, 2), "move": theta[size:size + 4].reshape(2, 2),
            "first": theta[size + 4:]}


def viterbi(blocks: list[Block], model: dict) -> list[int]:
    """The likeliest states of a page's blocks."""
    names, w = model["names"], model["w"]
    delta = []
    for f in features(blocks):
        rows = [names[x] for x in f if x in names]
        delta.append(w[rows].sum(0) if rows else np.zeros(2))
    score, move = np.array(delta).tolist(), model["move"].tolist()
    a, b = score[0][0] + model["first"][0], score[0][1] + model["first"][1]
    back = []
    for s0, s1 in score[1:]:
        from0 = (0, a + move[0][0]) if a + move[0][0] >= b + move[1][0] else (1, b + move[1][0])
        from1 = (0, a + move[0][1]) if a + move[0][1] > b + move[1][1] else (1, b + move[1][1])
        back.append((from0[0], from1[0]))
        a, b = from0[1] + s0, from1[1] + s1
    states = [int(b > a)]
    for pair in reversed(back):
        states.append(pair[states[-1]])
    return states[::-1]


def main_text(page: str | None, model: dict) -> str:
    blocks = parse(page) if page else []
    return "\n".join(b.text for b, s in zip(blocks, viterbi(blocks, model)) if s) if blocks else ""


def fit_model(pages: DataFrame) -> dict:
    """The model, fitted on the FIT_PAGES pages of least id hash that carry
    article markup (a bounded sample of bounded pages); if none does, on as many
    of all pages, as far as SAMPLE_CHARS."""
    rows = (pages.filter(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= SAMPLE_CHARS))
            .orderBy(F.xxhash64("page_id"), "html").select("html").limit(FIT_PAGES).collect())
    found = [r.html for r in rows]
    if not any(1 in labels(parse(p)) for p in found):
        found = [r.html for r in pages.filter("html <> ''").orderBy(F.xxhash64("page_id"), "html")
                 .select(F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(FIT_PAGES).collect()]
    return fit(found)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """``page_id, url, text`` of every row of ``page_id, url, html``."""
    model = model or fit_model(pages)
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"),
                "text": pa.array([main_text(p, shipped.value) for p in batch.column("html").to_pylist()], pa.string())})

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id bigint, url string, text string")


def extract_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))
