"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block has features of its ancestors (tags, and
words of class, id and role) and of its text (length, words, links, punctuation); neighbours are coupled, more strongly
if they are siblings. The field is trained on labelled pages from ``labelled_pages`` and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.storage import light_batches

# Element kinds of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 head header hgroup html label legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot "
    "th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN_TAGS = frozenset("head title script style xmp iframe noembed noframes noscript template svg math object canvas audio video".split())
#: Tags that close an open element of the same kind.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol table dl td th body html".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
UNENDED = re.compile("<[!?/]")
#: A tag that the end of the page cuts off.
CUT_TAG = re.compile("<[/!?]?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
END_MARK = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*\Z")
RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved|alle rechte|tous droits|derechos", re.I)


def element_key(tag: str, attributes: str) -> str:
    """Tag and the words of class, id, role and itemprop: what the ancestor features see of an element."""
    names = []
    if "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "style":
                names += ["hidden"] if re.search(r"display\s*:\s*none", value) else []
            elif name in ("hidden", "aria-hidden"):
                names += ["hidden"] if value != "false" else []
            else:
                names += WORD.findall(value)
    return " ".join([tag, *names])


#: Nearest block-level ancestors of a block that give features.
NEAREST = 32

Block = tuple[tuple[str, ...], str, float]


def leaf_blocks(page: str) -> list[Block]:
    """(keys of the ``NEAREST`` block-level ancestors, text, share of link text) of each leaf block with text, in page order.

    Character references are decoded and white space is one space. Comments, scripts, styles and other elements that
    show no text are skipped; open elements are closed as browsers do it, as far as blocks need it. The work is in proportion
    to the page, however deep it nests and whatever it leaves open."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    around: list[str] = []  # keys of the open block-level elements
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = hidden = links = 0
    at, size = 0, len(page)
    last_end = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((tuple(around[-NEAREST:]), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[index:]:
            hidden -= tag in HIDDEN_TAGS
            links -= tag == "a"
            opened[tag] -= 1
            if tag in BLOCK_TAGS:
                around.pop()
        del stack[index:]

    while at < size:
        # Behind the last ">" no tag ends: what stands there is text, up to a comment or the like, or to a tag that was cut.
        m = TOKEN.search(page, at) if at <= last_end else UNENDED.search(page, at)
        end = m.start() if m else size
        if at > last_end and (cut := CUT_TAG.search(page, at, end)):
            end = cut.start()
        if end > at and not hidden:
            parts.append(page[at:end])
            if links:
                linked += end - at
        if not m:
            break
        if at > last_end:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1) if opened.get(tag) else ():
                if stack[k][0] == tag:
                    if tag in BLOCK_TAGS:
                        flush()
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    break
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" and not hidden else "")
            continue
        if tag in BLOCK_TAGS or tag == "hr":
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in SELF_CLOSING.get(tag, ()):
                    pop_to(k)
                    break
                if stack[k][0] in SCOPES or (stack[k][0] in BLOCK_TAGS and tag not in SELF_CLOSING):
                    break
        if tag in VOID_TAGS or m[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:
            close = RAW_END[tag].search(page, at)
            at = close.start() if close else size
            if tag == "textarea":
                continue
        stack.append((tag, element_key(tag, m[3])))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in BLOCK_TAGS:
            around.append(stack[-1][1])
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
    flush()
    return out


#: Elements that give a page its sections.
SECTIONS = frozenset("article aside body details dialog fieldset footer form header main menu nav section".split())


def path_features(path: tuple[str, ...]) -> list[str]:
    """Features of the ancestors: tags, words of their attributes and the words' first four letters, the own tag alone and
    with the one above, and the nearest section with and without its words."""
    tags = [key.split(" ")[0] for key in path]
    near = next((k for k in range(len(path) - 1, -1, -1) if tags[k] in SECTIONS), None)
    out = [f"depth={min(len(path), 8)}", "pair=" + ">".join(tags[-2:])]
    if near is not None:
        out += [f"near={tags[near]}", f"near={tags[near]}, {'named' if ' ' in path[near] else 'bare'}"]
    for k, key in enumerate(path):
        tag, *names = key.split(" ")
        out.append(f"in={tag}")
        out += [f"word={x}" for x in names] + [f"stem={x[:4]}" for x in names]
        if k == len(path) - 1:
            out.append(f"own={tag}")
    return list(dict.fromkeys(out))


def text_features(text: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    return [
        f"chars={min(len(text).bit_length(), 11)}", f"words={min(words.bit_length(), 8)}", f"links={0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.8 else 3}",
        f"end={bool(END_MARK.search(text))}", f"rights={bool(RIGHTS.search(text))}",
    ]


def labelled_pages(count: int = 1000, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with the text of their article blocks: the training set, made from page layouts in common use.

    Words are invented, so that the field learns layout and not vocabulary."""
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que dos sch ung ein eau ment pré".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=3, b=14: phrase(a, b).capitalize() + rng.choice("....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    pick = rng.choice

    def wrap(names: list[str], inner: str, tags: tuple[str, ...] = ("div",), bare: float = 0.15) -> str:
        tag = pick(tags)
        if rng.random() < bare and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {pick(["class", "id", "class"])}="{pick(names)}">{inner}</{tag}>'

    def links(a: int, b: int) -> str:
        if rng.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"
        return " ".join(f'<a href="/{word()}">{phrase(1, 2)}</a>' for _ in range(rng.randint(a, b)))

    def menu() -> str:
        if rng.random() < 0.12:
            return wrap(["menu", "nav", "navigation", "toolbar"], "<tr>" + "".join(f'<td><a href="/{word()}">{phrase(1, 2)}</a></td>' for _ in range(rng.randint(2, 6))) + "</tr>", ("table",), 0.4)
        return wrap(["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "topnav"], links(3, 9), ("nav", "nav", "div"))

    def header() -> str:
        return wrap(["header", "masthead", "site-header", "banner", "top"], f"<{pick(['p', 'div', 'h2', 'span'])}>{phrase(1, 5)}</p>", ("header", "header", "div"))

    def advert() -> str:
        inner = pick([sentence(), prose(1, 2), f"<p>{prose(1, 2)}</p>", f'<a href="/x">{phrase(2, 6)}</a>'])
        return wrap(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"], inner, ("div", "div", "aside", "section"), 0.0)

    def notice() -> str:
        return wrap(["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "newsletter", "subscribe"], f"<p>{prose(1, 3)}</p>" + pick(["", "<button>OK</button>"]), ("div", "div", "section", "aside"), 0.0)

    def sidebar() -> str:
        inner = f"<h3>{phrase(1, 4)}</h3>" + pick([links(3, 8), f"<p>{prose(1, 3)}</p>", f"<p>{prose(1, 2)}</p>" + links(2, 5)])
        return wrap(["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "share", "social"], inner, ("aside", "aside", "div", "section"))

    def form() -> str:
        return wrap(["search", "login", "signup", "contact", "comment-form"], f"<label>{phrase(1, 3)}</label><input name=q><select><option>{word()}<option>{word()}</select><textarea>{phrase(1, 4)}</textarea><p>{sentence()}</p><button>{word()}</button>", ("form",))

    def comments() -> str:
        one = lambda: pick([wrap(["comment", "reply", "comment-body"], f"<b>{word()}</b><p>{prose(1, 4)}</p>", ("div", "li", "article")), f"<p>{prose(1, 4)}</p>", f"<li><p>{prose(1, 3)}</p></li>"])
        return wrap(["comments", "comment-list", "responses", "disqus", "discussion", "replies"], pick(["", f"<h3>{phrase(1, 3)}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 6))) + pick(["", form()]), ("section", "div", "ol", "div"), 0.0)

    def footer() -> str:
        return wrap(["footer", "site-footer", "bottom", "copyright", "legal"], pick([f"&copy; {phrase(1, 3)} &middot; {prose(1, 3)}", f"<p>Copyright {phrase(1, 5)}</p>" + links(2, 5), prose(1, 2), f"<p>{prose(1, 3)}</p>"]), ("footer", "footer", "div"))

    def share() -> str:
        return wrap(["share", "social", "tags", "author-box", "post-meta"], pick([links(2, 4), phrase(1, 3), f"<p>{phrase(1, 4)}</p>"]), ("div", "footer", "div"), 0.0)

    def aside() -> str:
        return f"<aside>{pick([sentence(), f'<p>{prose(1, 2)}</p>', f'<h3>{phrase(1, 3)}</h3>' + links(2, 5)])}</aside>"

    pages = []
    for _ in range(count):
        wanted: list[str] = []

        def keep(text: str, wanted: list[str] = wanted) -> str:
            wanted.append(SPACE.sub(" ", text).strip())
            return text

        def paragraph(keep=keep) -> str:
            kind = rng.random()
            text = keep(prose(1, 7) if kind < 0.7 else phrase(1, 4) + pick([".", "", "!"]) if kind < 0.9 else " | ".join(phrase(1, 2) for _ in range(rng.randint(3, 30))))
            cut = text.find(" ")
            if rng.random() < 0.2 and cut > 0:
                return f"<p>{text[:cut]} <{pick(['b', 'i', 'em', 'strong'])}>" + text[cut + 1 :] + pick(["</b></i></em></strong></p>", "<br>", "</p>"])
            if rng.random() < 0.15 and cut > 0:
                return f'<p><a href="/{word()}">{text[:cut]}</a>{text[cut:]}</p>'
            return f"<p>{text}" + pick(["</p>", "</p>", ""])

        def body(keep=keep, paragraph=paragraph) -> str:
            parts = [f"<h1>{keep(phrase(2, 10) + pick(['', '.']))}</h1>"] if rng.random() < 0.85 else []
            if parts and rng.random() < 0.12:
                parts = ["<header>" + parts[0] + "</header>"]
            # Some articles have sections, with or without names.
            grouped = rng.random() < 0.2
            section, inside = pick(["section", "section", "div"]), False
            for _ in range(rng.randint(1, 14)):
                if grouped and rng.random() < 0.35:
                    named = "" if rng.random() < 0.6 else f' class="{pick(["section", "chapter", "body", "text", "content", "lead", "intro"])}"'
                    parts.append((f"</{section}>" if inside else "") + f"<{section}{named}>")
                    inside = True
                kind = rng.random()
                if kind < 0.70:
                    parts.append(paragraph())
                elif kind < 0.76:
                    parts.append(f"<{(t := pick(['h2', 'h3']))}>{keep(phrase(1, 6))}</{t}>")
                elif kind < 0.80:
                    parts.append("<ul>" + "".join(f"<li>{keep(pick([phrase(1, 8), prose(1, 2)]))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
                elif kind < 0.83:
                    parts.append(f"<blockquote><p>{keep(prose(1, 3))}</p></blockquote>")
                elif kind < 0.85:
                    parts.append(f"<table><tr><td>{keep(phrase(1, 4))}</td><td>{keep(phrase(1, 4))}</td></tr></table>")
                elif kind < 0.87:
                    parts.append(f"<pre>{keep(phrase(3, 12))}</pre>")
                elif kind < 0.89:
                    parts.append(f"<figure><img src=x><figcaption>{keep(phrase(2, 9))}</figcaption></figure>")
                else:
                    parts.append(pick([advert, notice, sidebar, form, form, share, aside])())
            return "".join(parts) + (f"</{section}>" if inside else "")

        article = pick(["article", "article", "article", "main", "div", "section"])
        name = "" if article in ("article", "main") and rng.random() < 0.7 else f' {pick(["class", "id"])}="{pick(["content", "article", "post", "entry", "story", "main", "post-content", "article-body", "text"])}"'
        inner = body()
        if rng.random() < 0.15:
            inner += comments()
        top = "".join(f() for f in rng.sample([menu, header, advert, notice, sidebar, form], rng.randint(0, 4)))
        tail = "".join(f() for f in rng.sample([sidebar, comments, advert, form, menu, notice], rng.randint(0, 3))) + (footer() if rng.random() < 0.9 else "")
        middle = f"<{article}{name}>{inner}</{article}>"
        if rng.random() < 0.08:
            middle = inner
        elif rng.random() < 0.3:
            middle = f'<{pick(["main", "div"])} class="{pick(["container", "wrapper", "page", "layout", "row"])}">{middle}{pick(["", sidebar()])}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{phrase(2, 8)}</title><style>p{{margin:0}}</style></head><body>{top}{middle}{tail}</body></html>", wanted))
    return pages


def block_labels(blocks: list[Block], wanted: list[str]) -> list[int]:
    """1 for each block that is, in order, a block of the article."""
    out, at = [], 0
    for _, text, _ in blocks:
        hit = at < len(wanted) and text == wanted[at]
        out.append(int(hit))
        at += hit
    return out


class Field:
    """Weights of a feature for "article" against "other"; of a change or stay between neighbours, by sibling or not."""

    def __init__(self, weights: dict[str, float], edges: np.ndarray, ends: np.ndarray) -> None:
        self.weights, self.edges, self.ends = weights, edges.tolist(), ends.tolist()
        self.paths: dict[tuple[str, ...], float] = {}

    def unary(self, block: Block) -> float:
        path, text, linked = block
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            known = self.paths[path] = sum(self.weights.get(f, 0.0) for f in path_features(path))
        return known + sum([self.weights.get(f, 0.0) for f in text_features(text, linked)])

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not blocks:
            return []
        (start0, start1), (end0, end1) = self.ends
        a, b = start0, start1 + self.unary(blocks[0])
        back = []
        for k in range(1, len(blocks)):
            (s00, s01), (s10, s11) = self.edges[blocks[k][0] == blocks[k - 1][0] or blocks[k][0][:-1] == blocks[k - 1][0][:-1]]
            from0, from1 = a + s01 > b + s11, a + s00 >= b + s10
            back.append((0 if from1 else 1, 0 if from0 else 1))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + self.unary(blocks[k])
        out = [int(b + end1 > a + end0)]
        for steps in reversed(back):
            out.append(steps[out[-1]])
        return out[::-1]


def train(pages: list[tuple[str, list[str]]], rounds: int = 200, ridge: float = 1e-3, rate: float = 0.1) -> Field:
    """Fit the field on labelled pages by the gradient of the log-likelihood (forward-backward over all pages at once)."""
    examples = []
    names: dict[str, int] = {}
    for page, wanted in pages:
        blocks = leaf_blocks(page)
        if blocks:
            features = [[names.setdefault(f, len(names)) for f in path_features(b[0]) + text_features(b[1], b[2])] for b in blocks]
            sibling = [0] + [int(x[0] == y[0] or x[0][:-1] == y[0][:-1]) for x, y in zip(blocks[1:], blocks[:-1], strict=True)]
            examples.append((features, block_labels(blocks, wanted), sibling))
    n, steps = len(examples), max(len(x[0]) for x in examples)
    label, sibling, live = (np.zeros((n, steps), np.int64) for _ in range(3))
    cell, index = [], []
    for k, (features, labels, sib) in enumerate(examples):
        size = len(labels)
        label[k, :size], sibling[k, :size], live[k, :size] = labels, sib, 1
        for t, some in enumerate(features):
            cell += [k * steps + t] * len(some)
            index += some
    cell, index = np.array(cell), np.array(index)
    last = live.sum(axis=1) - 1
    rows = np.arange(n)
    w, edges, ends = np.zeros(len(names)), np.zeros((2, 2, 2)), np.zeros((2, 2))
    total = live.sum()
    state = [np.zeros(len(names) + 12) for _ in range(2)]
    for step in range(1, rounds + 1):
        unary = np.zeros((n, steps, 2))
        unary[:, :, 1] = np.bincount(cell, w[index], n * steps).reshape(n, steps)
        forward, backward = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        forward[:, 0] = ends[0] + unary[:, 0]
        for t in range(1, steps):
            forward[:, t] = np.logaddexp(forward[:, t - 1, 0, None] + edges[sibling[:, t], 0], forward[:, t - 1, 1, None] + edges[sibling[:, t], 1]) + unary[:, t]
        backward[rows, last] = ends[1]
        for t in range(steps - 2, -1, -1):
            after = backward[:, t + 1] + unary[:, t + 1]
            value = np.logaddexp(edges[sibling[:, t + 1], :, 0] + after[:, 0, None], edges[sibling[:, t + 1], :, 1] + after[:, 1, None])
            backward[:, t] = np.where((t < last)[:, None], value, backward[:, t])
        partition = np.logaddexp(*(forward[rows, last] + ends[1]).T)
        marginal = np.exp(forward + backward - partition[:, None, None])
        gradient = np.bincount(index, ((label - marginal[:, :, 1]) * live).ravel()[cell], len(names))
        edge_gradient, end_gradient = np.zeros((2, 2, 2)), np.zeros((2, 2))
        for t in range(1, steps):
            on = np.flatnonzero(live[:, t])
            s = sibling[on, t]
            np.add.at(edge_gradient, (s, label[on, t - 1], label[on, t]), 1)
            for x in (0, 1):
                for y in (0, 1):
                    p = np.exp(forward[on, t - 1, x] + edges[s, x, y] + unary[on, t, y] + backward[on, t, y] - partition[on])
                    np.add.at(edge_gradient, (s, x, y), -p)
        for y in (0, 1):
            end_gradient[0, y] = (label[:, 0] == y).sum() - marginal[:, 0, y].sum()
            end_gradient[1, y] = (label[rows, last] == y).sum() - marginal[rows, last, y].sum()
        full = np.concatenate([gradient, edge_gradient.ravel(), end_gradient.ravel()]) / total - ridge * np.concatenate([w, edges.ravel(), ends.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * full
        state[1] = 0.999 * state[1] + 0.001 * full * full
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w += move[: len(names)]
        edges += move[len(names) : len(names) + 8].reshape(2, 2, 2)
        ends += move[len(names) + 8 :].reshape(2, 2)
    return Field({name: float(w[k]) for name, k in names.items()}, edges, ends)


@lru_cache(maxsize=1)
def trained_field() -> Field:
    """The field of the built-in training pages."""
    return train(labelled_pages(), ridge=1e-5)


def extract_text(pages: DataFrame, field: Field, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars, n_blocks, n_kept.

    ``text`` is the blocks that the field takes for the article, in page order, joined by a line feed; n_chars counts its
    code points. Null or empty html gives an empty text. Rows may repeat, null ids and urls are kept, other columns are
    ignored, an empty table gives an empty result. Every page is read whole.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    light_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType for c in (id_column, url_column)]
    schema = pa.schema([("id", to_arrow_type(kinds[0])), ("url", to_arrow_type(kinds[1])), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int32()), ("n_kept", pa.int32())])
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for page in batch.column("html"):
                blocks = leaf_blocks(page.as_py() or "")
                kept = [b[1] for b, y in zip(blocks, field.decode(blocks), strict=True) if y]
                text = "\n".join(kept)
                for column, value in zip(out, (text, len(text), len(blocks), len(kept)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[2:], strict=True))], schema=schema)

    chosen = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return chosen.mapInArrow(extract, f"id {kinds[0].simpleString()}, url {kinds[1].simpleString()}, text string, n_chars long, n_blocks int, n_kept int")
