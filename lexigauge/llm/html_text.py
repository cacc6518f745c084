"""Main text of web pages, by a recurrent labeller of their blocks.

A page becomes its sequence of leaf blocks, each with the tags, classes and ids above it and its
words. A bidirectional LSTM in numpy reads the whole sequence and decides for every block whether it
belongs to the article. It is trained on pages made from templates, where that is known.
"""

from __future__ import annotations

import html
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lexigauge.llm.common import Shared, map_pieces, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATH_BUCKETS = 512
WORD_BUCKETS = 32
NUMBERS = 6
INPUTS = PATH_BUCKETS + WORD_BUCKETS + NUMBERS
HIDDEN = 12
TRAIN_PAGES = 500
EPOCHS = 12
RATE = 0.02
SEED = 3
# Blocks that are labelled at once, or one page, and those whose inputs are held at once.
LABEL_BLOCKS = 20_000
INPUT_BLOCKS = 4_096

DIGEST = "page_id bigint, url string, text string, n_chars bigint"

# Attributes as a browser reads them: a quote opens a value only after an equals sign; one that is never
# closed is part of a value that ends at a blank or at the end of the tag. Nothing is read twice.
_ATTRS = r"(?>=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*+"
# Tags that end a list of options whose end tag is left out.
_BLOCK = r"</?(?:article|aside|body|div|footer|form|h[1-6]|header|html|main|nav|ol|p|section|select|table|td|tr|ul)(?=[\s/>])"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])(?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*(?=[\s>])))*/>"
    rf"|<select(?=[\s/>]){_ATTRS}>(?:(?!{_BLOCK}).)*+(?:</select\s*>)?"
    rf"|<(?P<raw>script|style|noscript|template|title|textarea|svg|iframe)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Elements inside a line of text; every other one ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Void elements inside a line, of which a line break is white space.
INLINE_VOID = VOID - {"hr", "col"}
# Elements that a new one of the same kind, or a block for p, closes where the end tag is left out.
OPTIONAL = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_SCOPES = frozenset("ul ol table div section article body nav aside main footer header form dl".split())


class Block:
    __slots__ = ("path", "text", "link", "label")

    def __init__(self, path, text, link, label):
        self.path, self.text, self.link, self.label = path, text, link, label


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: tags, classes and ids above, text with single spaces, characters in
    links, and the label of a template page. Scripts, styles, comments and what a head may hold are no
    blocks; a head ends at the first tag or text that may not stand in it, with an end tag or without."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str | None]] = []
    parts: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        text = " ".join("".join(parts).split())
        if text:
            path, label = [], None
            for tag, names, mark in stack:
                if tag != "part":  # which templates put where pages have nothing
                    path.append(tag)
                    path += names
                label = mark or label
            out.append(Block(path, text, min(1.0, link / len(text)), label))
        parts.clear()
        link = 0

    def add(raw: str) -> None:
        nonlocal link
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if any(tag == "a" for tag, _, _ in stack):
                link += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() == "title":
                flush()
            continue
        if tag in INLINE_VOID:
            parts.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
        if tag == "head":  # all that may stand in it is dropped wherever it stands
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag not in INLINE:
            # what the new block closes: open inline elements, and a paragraph or item without end tag
            closes = OPTIONAL.get(tag, ()) or ("p",)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPES:
                    break
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        names, mark = [], None
        if m["attrs"].strip():
            for a in _ATTRIBUTE.finditer(m["attrs"]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-label":
                    mark = value
                else:
                    names += [f".{p.lower()}" for p in _PARTS.findall(value)]
        stack.append((tag, tuple(names), mark))
    add(page[at:])
    flush()
    return out


def block_inputs(blocks: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """One row for each block of a page from ``start`` to ``end``: hashed path, hashed words (all of them), and
    lengths, links, marks and place."""
    n, rows = len(blocks), blocks[start:end]
    x = np.zeros((len(rows), INPUTS), np.float32)
    for k, b in enumerate(rows):
        x[k, [zlib.crc32(p.encode()) % PATH_BUCKETS for p in b.path]] = 1
        words = b.text.split()
        hashed = np.fromiter((zlib.crc32(w.encode()) for w in b.text.lower().split()), np.int64) % WORD_BUCKETS
        x[k, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = np.bincount(hashed, minlength=WORD_BUCKETS) / len(words)
        ends = sum(b.text.count(c) for c in ".!?,;")
        x[k, -NUMBERS:] = (np.log1p(len(words)) / 5, b.link, min(1.0, ends / len(words)), (start + k) / n, np.log1p(n) / 6, float(b.path[-1:] == ["p"]))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Labeller:
    """Bidirectional LSTM; for each direction input (INPUTS, 4H), recurrent (H, 4H) and bias, gates in the order
    input, forget, output, new; output (2H) and its constant."""

    def __init__(self, seed: int = SEED):
        draw, h = np.random.default_rng(seed), HIDDEN
        self.p = {"out": draw.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        for d in "fb":
            self.p[f"wx{d}"] = draw.normal(0, 0.15, (INPUTS, 4 * h))
            self.p[f"wh{d}"] = draw.normal(0, 0.2, (h, 4 * h))
            self.p[f"b{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])

    def run(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: bool):
        """States (T, lanes, H); gates (T, lanes, 4H)."""
        h, w = HIDDEN, self.p[f"wh{d}"]
        steps = range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1)
        state = cell = np.zeros((gates.shape[1], h), gates.dtype)
        states, kept = np.empty((*gates.shape[:2], h), gates.dtype), {}
        for t in steps:
            g = gates[t] + state @ w
            ifo, new = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            i, f, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :]
            after = (f * cell + i * new) * mask[t][:, None]
            squashed = np.tanh(after)
            if keep:
                kept[t] = (state, cell, i, f, o, new, squashed)
            cell = after
            state = states[t] = o * squashed * mask[t][:, None]
        return states, kept

    def gates(self, blocks: list[Block]) -> np.ndarray:
        """What the inputs of a page's blocks add to the gates (T, 2, 4H); the inputs of INPUT_BLOCKS at a time."""
        weights = np.concatenate([self.p["wxf"], self.p["wxb"]], axis=1)
        bias = np.concatenate([self.p["bf"], self.p["bb"]])
        parts = [block_inputs(blocks, k, k + INPUT_BLOCKS) @ weights + bias for k in range(0, len(blocks), INPUT_BLOCKS)]
        return np.concatenate(parts).reshape(len(blocks), 2, -1)

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = [self.run(d, gates[:, :, k], mask, False)[0] for k, d in enumerate("fb")]
        return np.concatenate(both, axis=2) @ self.p["out"] + self.p["c"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Loss over all blocks, and gradients."""
        p, h = self.p, HIDDEN
        runs = {d: self.run(d, x @ p[f"wx{d}"] + p[f"b{d}"], mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        prob, n = _sigmoid(both @ p["out"] + p["c"]), mask.sum()
        loss = -(mask * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / n
        dl = (prob - y) * mask / n
        g = {"out": np.einsum("tl,tlh->h", dl, both), "c": np.array([dl.sum()])}
        for k, d in enumerate("fb"):
            kept, w = runs[d][1], p[f"wh{d}"]
            dgates, gw = np.zeros((*x.shape[:2], 4 * h)), np.zeros_like(w)
            carry, cell_carry = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                state, cell, i, f, o, new, squashed = kept[t]
                dh = (dl[t][:, None] * p["out"][k * h : (k + 1) * h] + carry) * mask[t][:, None]
                dcell = (dh * o * (1 - squashed**2) + cell_carry) * mask[t][:, None]
                dg = np.concatenate([dcell * new * i * (1 - i), dcell * cell * f * (1 - f), dh * squashed * o * (1 - o), dcell * i * (1 - new**2)], axis=1)
                dgates[t] = dg
                gw += state.T @ dg
                carry, cell_carry = dg @ w.T, dcell * f
            flat = dgates.reshape(-1, 4 * h)
            g[f"wh{d}"], g[f"wx{d}"], g[f"b{d}"] = gw, x.reshape(-1, INPUTS).T @ flat, flat.sum(axis=0)
        return loss, g

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which of its blocks are article; pages of like length run side by side."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, k = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i])), 0
        while k < len(order):
            end = k + 1
            while end < len(order) and (end - k + 1) * len(pages[order[end]]) <= LABEL_BLOCKS:
                end += 1
            found = self.logits(*pad([self.gates(pages[i]) for i in order[k:end]])) > 0
            for lane, i in enumerate(order[k:end]):
                out[i] = found[: len(pages[i]), lane]
            k = end
        return out


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest, kind = max(len(r) for r in rows), rows[0].dtype
    x, mask = np.zeros((longest, len(rows), *rows[0].shape[1:]), kind), np.zeros((longest, len(rows)), kind)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


# Names that templates give to what is not the article: kind, tags, classes and ids.
BOILERPLATE = """
menu | nav ul div | nav menu navbar navigation topnav breadcrumb breadcrumbs tabs
header | header div | header masthead top site-header page-header branding logo topbar
footer | footer div | footer bottom site-footer copyright colophon legal
sidebar | aside div section | sidebar side widget rail related recommended trending popular tags archive
notice | div section aside | cookie cookies consent notice banner alert gdpr popup modal newsletter subscribe paywall
advert | div aside section | ad ads advert advertisement sponsor sponsored promo promotion adbox adsense
form | form div | search login signup contact form subscribe-form
comments | section div ol | comments comment comment-list discussion replies responses disqus
share | div ul | share social sharing follow buttons toolbar meta byline-tools
"""
CONTENT = "content main article post entry story body text article-body post-content entry-content main-content page blog column"
NEUTRAL = "container wrapper row inner outer layout grid box block section col left right center wide clearfix"


def template_page(draw: np.random.Generator) -> str:
    """A page of random words whose parts carry the label 1 (article) or 0."""
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er in".split()]
    word = lambda: "".join(draw.choice(syllables, draw.integers(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(draw.integers(a, b)))
    chance = lambda p: draw.random() < p
    one = lambda names: str(draw.choice(names.split()))
    sentence = lambda: some(3, 20).capitalize() + "."

    def attributes(names: str) -> str:
        noise = f" {word()}" if chance(0.2) else ""
        key = "class" if chance(0.7) else "id"
        return f' {key}="{names}{noise}"'

    def part(line: str) -> str:
        kind, tags, names = (x.strip() for x in line.split("|"))
        tag = one(tags)
        own = attributes(one(names)) if tag in ("div", "section", "ul", "ol", "aside") or chance(0.4) else ""
        if kind in ("menu", "share"):
            items = [f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(draw.integers(3, 8))]
            inner = "".join(items) if tag in ("ul", "ol") else f"<ul>{''.join(items)}</ul>"
        elif kind == "form":
            inner = f"<label>{some(1, 4)}</label><input name=q><button>{word()}</button>" + (f"<p>{sentence()}</p>" if chance(0.4) else "")
        elif kind == "comments":
            inner = "".join(f"<div class=comment><b>{word()}</b><p>{' '.join(sentence() for _ in range(draw.integers(1, 4)))}</p></div>" for _ in range(draw.integers(1, 5)))
        else:
            piece = lambda: draw.choice([sentence(), f"<p>{sentence()}</p>", f"<p>{' '.join(sentence() for _ in range(draw.integers(1, 4)))}</p>", f'<a href="#">{some(1, 6)}</a>', f"<h3>{some(1, 4)}</h3>", f"&copy; {word()} &middot; {sentence()}", f"<h1>{some(1, 5)}</h1>" if kind == "header" else f"<span>{some(1, 8)}</span>"])
            inner = "".join(str(piece()) for _ in range(draw.integers(1, 4)))
        return f'<{tag}{own} data-label="0">{inner}</{tag}>'

    kinds = BOILERPLATE.strip().splitlines()
    pick = lambda kind: part(next(x for x in kinds if x.startswith(kind)))
    inside = lambda p: str(draw.choice([pick(k) for k in ("advert", "share", "sidebar", "form", "notice", "comments", "footer", "menu")])) if chance(p) else ""

    def paragraph() -> str:
        text = " ".join(sentence() for _ in range(draw.integers(1, 7))) if chance(0.85) else some(1, 4)
        if chance(0.2):
            text = f"<b>{text}<br>" if chance(0.5) else text.upper()
        if chance(0.1):
            text = f'{text} <a href="/{word()}">{some(1, 3)}</a>'
        shape = draw.random()
        if shape < 0.75:
            return f"<p>{text}</p>" if chance(0.85) else f"<p>{text}"
        if shape < 0.83:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>"
        if shape < 0.88:
            return f"<h2>{some(2, 6)}</h2>"
        if shape < 0.92:
            return f"<blockquote>{text}</blockquote>"
        if shape < 0.95:
            return f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>"
        return f"<div>{text}</div>"

    shape = draw.random()
    head = f"<h1>{some(2, 8)}</h1>" if chance(0.8) else ""
    body = head + "".join(paragraph() + inside(0.04) for _ in range(draw.integers(1, 14)))
    if shape < 0.55:
        article = f'<article data-label="1"{attributes(one(CONTENT)) if chance(0.3) else ""}>{body}</article>'
    elif shape < 0.7:
        article = f'<main data-label="1">{body}</main>'
    elif shape < 0.9:
        article = f'<{one("div section")} data-label="1"{attributes(one(CONTENT))}>{body}</div>'
    else:
        tag = one("div part")
        article = f'<{tag} data-label="1">{body}</{tag}>'
    if chance(0.3):
        article = f"<div{attributes(one(NEUTRAL))}>{article}{inside(0.5)}</div>"
    before = [pick(k) for k in ("header", "menu", "notice", "advert", "form") if chance(0.5)]
    after = [pick(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice") if chance(0.3)] + ([pick("footer")] if chance(0.85) else [])
    draw.shuffle(before)
    return f"<html><head><title>{some(1, 6)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    """Labeller of so many template pages."""
    draw, net = np.random.default_rng(seed), Labeller(seed)
    made = [b for b in (blocks_of(template_page(draw)) for _ in range(pages)) if b]
    x = [block_inputs(b).astype(float) for b in made]
    y = [np.array([float(b.label == "1") for b in page]) for page in made]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    order, step, total = np.argsort([len(r) for r in x]), 0, EPOCHS * -(-len(x) // 25)
    for _ in range(EPOCHS):
        chunks = np.array_split(order, -(-len(order) // 25))
        draw.shuffle(chunks)
        for chunk in chunks:
            step += 1
            rows, mask = pad([x[i] for i in chunk])
            want = np.zeros(mask.shape)
            for lane, i in enumerate(chunk):
                want[: len(y[i]), lane] = y[i]
            _, g = net.gradient(rows, mask, want)
            for k, v in g.items():
                v = np.clip(v, -0.5, 0.5)
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                rate = RATE * (1 - step / (total + 1))
                net.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    return net


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page.

    ``text`` joins the blocks labelled article by one space. A null or empty page, or one without an
    article block, has an empty text. Text outside of any tag is a block too. Repeated rows each get their
    row; other columns are not looked at.
    """
    shared = Shared(pages.sparkSession, labeller)

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        made = [blocks_of(t.decode("utf-8", "replace")) if t else [] for t in texts_of(piece, "html")]
        texts = [" ".join(b.text for b, keep in zip(page, label, strict=True) if keep) for page, label in zip(made, shared.value.label(made), strict=True)]
        return pa.RecordBatch.from_arrays(
            [piece.column("page_id").cast(pa.int64()), piece.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    return map_pieces(pages.select("page_id", "url", "html"), f, DIGEST, "html")
