"""Main text of HTML pages: a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks: the text between two boundaries of block
elements.  Each block has features of its ancestors (tags, class and id words) and of
its text; a chain of two labels, article or not, is trained on labelled pages by
exact forward-backward gradients and decoded by Viterbi.  The labelled pages are
drawn from page layouts with the parts that articles come with: menus, headers,
footers, sidebars, notices, adverts, forms and reader comments.

What an ancestor's name says depends on where it stands.  Names on html and body, and on
a wrapper that holds most of the page's text with its h1, main or only article, say
nothing.  Marks from outside the nearest article or main are features of their own, and
so are names on a paragraph, a heading or a list item.

Defined cases: null and empty pages give an empty text; pages of any length and depth
of nesting are read whole; labellings of one score (ties) leave a block out; comments, scripts and
styles have no blocks; an unclosed element ends with its parent or the page; a
tag cut off at the page's end is dropped; rows that repeat a page_id are
extracted each; null page_id and url pass through; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|(?P<empty><svg(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?<=/)>)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_LETTERS = re.compile(r"[a-z]+")

# Elements that end a run of text, and those without an end tag.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
_ENDS_P = BLOCKS - {"p", "body", "html", "head", "title", "button", "option", "select"}
_STOPS = frozenset("ul ol table article section div nav aside main body form footer header".split())


# Names that page layouts give to the parts around an article.
_AROUND = {
    "menu": ("nav", "menu navbar navigation topnav breadcrumb breadcrumbs tabs"),
    "header": ("header", "header masthead banner topbar site branding"),
    "footer": ("footer", "footer bottom colophon legal copyright"),
    "sidebar": ("aside", "sidebar related widget recommended trending popular more"),
    "notice": ("div", "notice cookie consent alert gdpr paywall subscribe popup modal"),
    "advert": ("div", "ad ads advert advertisement sponsored promo promotion banner"),
    "form": ("form", "form newsletter signup search login contact"),
    "comments": ("section", "comments comment discussion replies responses disqus thread"),
    "share": ("div", "share social sharing toolbar tags meta"),
}
_PART_OF = {name: part for part, (_, names) in _AROUND.items() for name in names.split()}


# Elements that hold parts; a name on another one says little of what is in it.
_HOLDERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption blockquote figcaption option legend summary".split())
#: The share of a page's text that makes an element with its h1, main or only article a wrapper.
WRAPPER = 0.6


def marks(tag: str, attributes: str | None) -> tuple[set[str], set[str]]:
    """(names of the features that an element gives to all blocks in it by its class, id and role, and by its tag)."""
    names = {w for x in _NAMES.findall(attributes) for w in _LETTERS.findall(x.lower())} if attributes else ()
    own = {f"named {w}" for w in names} | {f"part {_PART_OF[w]}" for w in names if w in _PART_OF}
    if any(w in _PART_OF for w in names):
        own.add("part")
    if tag not in _HOLDERS:
        own = {f"leaf {m}" for m in own}
    return own, {f"in {tag}"} if tag in BLOCKS else set()


class _Marked:
    """Elements that give marks, in the order of their start tags; each after the one around it."""

    def __init__(self) -> None:
        self.up, self.tag, self.names, self.tags, self.chars, self.tops = [-1], [""], [set()], [set()], [0], [[0, 0]]

    def add(self, up: int, tag: str, names: set[str], tags: set[str]) -> int:
        self.up.append(up)
        self.tag.append(tag)
        self.names.append(names)
        self.tags.append(tags)
        self.chars.append(0)
        self.tops.append([int(tag == "article"), int(tag == "main")])
        return len(self.up) - 1

    def inherited(self, known: frozenset[str] | None) -> list[frozenset[str]]:
        """The marks of the blocks in each element, only those in `known` if it is given."""
        for k in range(len(self.up) - 1, 0, -1):
            self.chars[self.up[k]] += self.chars[k]
            for j in (0, 1):
                self.tops[self.up[k]][j] += self.tops[k][j]
        enough = WRAPPER * self.chars[0]
        out = [frozenset()]
        for k in range(1, len(self.up)):
            above, own = out[self.up[k]], self.tags[k]
            articles, tops = self.tops[k]
            wraps = self.tag[k] in ("html", "body") or self.tag[k] not in ("article", "main") and self.chars[k] >= enough and (tops or articles == 1)
            if not wraps:
                own = own | self.names[k]
            if self.tag[k] in ("article", "main") and above:
                outer = (m if m.startswith("outer ") else f"outer {m}" for m in above)
                above = frozenset(m for m in outer if known is None or m in known)
            if known is not None:
                own = own & known
            out.append(above if own <= above else above | own)
        return out


def blocks(page: str, known: frozenset[str] | None = None) -> list[tuple[str, tuple[frozenset[str], str], float]]:
    """(text, (ancestors' marks, nearest block element), share of linked characters) of the leaf blocks, in page order.

    Marks are handed down from element to element, only those in `known` if it is given, so
    neither time nor memory grows with the depth of nesting.
    """
    stack: list[tuple[str, int, str]] = []
    last: dict[str, list[int]] = {}  # places in the stack of each open tag, and of those that stop a search
    stops: list[int] = []
    marked = _Marked()
    out, parts, linked, at = [], [], 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, element, under = stack[-1] if stack else ("", 0, "")
            marked.chars[element] += len(text) if "title" not in last or not last["title"] else 0
            out.append((text, element, under, linked / max(1, sum(map(len, parts)))))
        parts, linked = [], 0

    def pop_to(k: int) -> None:
        for tag, _, _ in stack[k:]:
            last[tag].pop()
        del stack[k:]
        while stops and stops[-1] >= k:
            stops.pop()

    def innermost(tag: str) -> int:
        return last[tag][-1] if last.get(tag) else -1

    for m in _PART.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if last.get("a"):
                linked += m.start() - at
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] or m["empty"]:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            parts.append(" ")
        stop = stops[-1] if stops else -1
        if m["close"]:
            k = innermost(tag)
            if k >= 0 and (tag in BLOCKS or k > stop):
                pop_to(k)
            continue
        if tag in VOID:
            continue
        closes = _CLOSES.get(tag, frozenset()) | ({"p"} if tag in _ENDS_P else frozenset())
        k = max(map(innermost, closes), default=-1)
        if k > stop:
            pop_to(k)
        _, element, under = stack[-1] if stack else ("", 0, "")
        names, tags = marks(tag, m["attributes"])
        if tag == "h1":
            marked.tops[element][1] += 1
        if names or not tags <= marked.tags[element] or tag in ("article", "main"):
            element = marked.add(element, tag, names, tags)
        last.setdefault(tag, []).append(len(stack))
        if tag in _STOPS:
            stops.append(len(stack))
        stack.append((tag, element, tag if tag in BLOCKS else under))
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) * bool(last.get("a"))
    flush()
    inherited = marked.inherited(known)
    return [(text, (inherited[element], under), share) for text, element, under, share in out]


def features(found: list) -> list[list[str]]:
    """Names of the features that each block of a page has."""
    out = []
    for k, (text, (inherited, under), linked) in enumerate(found):
        words = text.count(" ") + 1
        stops = sum(text.count(c) for c in ".,;!?")
        own = {*inherited, f"under {under}"}
        own.add(f"words {min(6, words.bit_length())}")
        own.add(f"linked {int(linked * 3.99)}")
        own.add(f"stops {min(4, (4 * stops) // words)}")
        own.add("ends" if text[-1] in ".!?\"'”" else "open")
        if "©" in text:
            own.add("copyright sign")
        if k == 0 or k == len(found) - 1:
            own.add("first" if k == 0 else "last")
        out.append(sorted(own))
    return out


# ---- labelled pages -------------------------------------------------------

_SYLLABLES = "ka lo mi ter an den sol vi ra ne pul fo er ing ist om".split()

def labelled_pages(n: int, seed: int = 3) -> list[tuple[str, list[str]]]:
    """(page, texts of its article's blocks) drawn from many layouts."""
    draw = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(draw.choices(_SYLLABLES, k=draw.randint(1, 3))) for _ in range(draw.randint(a, b)))

    def sentence() -> str:
        return words(3, 18).capitalize() + draw.choice(".....,!?")

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(draw.randint(a, b)))

    def around(kind: str) -> str:
        tag, names = _AROUND[kind]
        name = draw.choice(names.split())
        if draw.random() < 0.35:
            tag = draw.choice(("div", "section", tag))
            attribute = f' {draw.choice(("class", "id"))}="{name}"'
        else:
            attribute = f' class="{name}"' if tag == "div" or draw.random() < 0.4 else ""
            attribute = attribute or (f' class="{name}"' if tag in ("section", "div") else "")
        if kind == "menu":
            inner = "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 2)}</a></li>' for k in range(draw.randint(2, 8))) + "</ul>"
        elif kind == "footer":
            inner = draw.choice((f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>&copy; 20{draw.randint(10, 30)} {words(1, 4)}</p>", f"<p>{prose(1, 2)}</p><a href='/x'>{words(1, 2)}</a>"))
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button>" + (f"<p>{sentence()}</p>" if draw.random() < 0.4 else "")
        elif kind == "comments":
            box = draw.choice(("div class='comment'", "div class='comment'", "article class='comment'", "article", "li"))
            inner = f"<h3>{words(1, 3)}</h3>" + "".join(f"<{box}><b>{words(1, 2)}</b><p>{prose(1, 4)}</p></{box.split()[0]}>" for _ in range(draw.randint(1, 4)))
        elif kind in ("advert", "notice"):
            inner = draw.choice((prose(1, 3), f"<p>{prose(1, 2)}</p>", f"<a href='/x'>{words(2, 6)}</a>"))
        elif kind == "sidebar":
            inner = f"<h3>{words(1, 3)}</h3>" + draw.choice((f"<p>{prose(1, 2)}</p>", "<ul>" + "".join(f"<li><a href='/x'>{words(2, 7)}</a></li>" for _ in range(4)) + "</ul>"))
        elif kind == "header":
            inner = draw.choice((f"<a href='/'>{words(1, 3)}</a>", f"<h2>{words(1, 4)}</h2><p>{words(2, 6)}</p>", f"<p>{prose(1, 1)}</p>"))
        else:
            inner = "".join(f"<a href='/x'>{words(1, 2)}</a> " for _ in range(3))
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def any_name() -> str:
        # no names of comments: those do tell what is in them
        kind = draw.choice([k for k in _AROUND if k != "comments"])
        return draw.choice(_AROUND[kind][1].split())

    def item() -> tuple[str, list[str]]:
        kind = draw.random()
        name = f' class="{any_name()}"' if draw.random() < 0.08 else ""
        if kind < 0.66:
            text = prose(1, 6) if draw.random() < 0.8 else words(1, 5)
            linked = f'{text} <a href="/y">{(tail := words(1, 3))}</a>' if draw.random() < 0.15 else text
            return (f"<p{name}>{linked}</p>", [text if linked == text else f"{text} {tail}"])
        if kind < 0.76:
            text = words(1, 8)
            return (f"<h2{name}>{text}</h2>", [text])
        if kind < 0.86:
            text = prose(1, 3)
            return (f"<blockquote>{text}</blockquote>", [text])
        if kind < 0.95:
            lines = [words(2, 12) for _ in range(draw.randint(2, 4))]
            return ("<ul>" + "".join(f"<li>{x}</li>" for x in lines) + "</ul>", lines)
        text = prose(1, 2)
        return (f"<p><b>{text}<br></p>", [text])

    pages = []
    for _ in range(n):
        title = words(2, 10)
        truth, inner = [], ""
        if draw.random() < 0.9:
            inner, truth = f"<h1>{title}</h1>", [title]
        for _ in range(draw.choice((1, 1, 2, 4, 8, 14))):
            piece, texts = item()
            inner += piece
            truth += texts
            if draw.random() < 0.12:
                inner += around(draw.choice(("advert", "share", "form", "notice")))
        body = draw.choice(("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="article">{}</div>', '<div class="post entry">{}</div>', '<section class="story body">{}</section>')).format(inner)
        before = "".join(around(k) for k in ("header", "menu", "notice", "advert", "share") if draw.random() < 0.5)
        after = "".join(around(k) for k in ("share", "sidebar", "form", "comments", "advert", "footer") if draw.random() < 0.5)
        if draw.random() < 0.2:  # a wrapper with a telling name, around the article or around all
            tag = draw.choice(("div", "div", "section"))
            wrapped = f'<{tag} {draw.choice(("class", "id"))}="{any_name()}">'
            before, body, after = draw.choice(((before, f"{wrapped}{body}</{tag}>", after), (f"{wrapped}{before}", body, f"{after}</{tag}>")))
        page = f"<body{f' class={chr(34)}{any_name()} {any_name()}{chr(34)}' if draw.random() < 0.2 else ''}>{before}{body}{after}</body>"
        bare = draw.random()
        if bare < 0.08:  # text without any element, or nothing but divs
            lines = [prose(1, 5) for _ in range(draw.randint(1, 5))]
            links = lambda: f"<div><a href='/x'>{words(1, 2)}</a> <a href='/y'>{words(1, 2)}</a></div>"
            if bare < 0.03:
                page, truth = " ".join(lines), [" ".join(lines)]
            else:
                page, truth = (links() if draw.random() < 0.6 else "") + "".join(f"<div>{x}</div>" for x in lines) + (links() if draw.random() < 0.6 else ""), lines
                page = f"<body>{page}</body>"
        head = f"<head><title>{title}</title></head>" if bare >= 0.03 else ""
        pages.append((f"<html>{head}{page}</html>" if head else page, truth))
    return pages


# ---- the chain ------------------------------------------------------------


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=2)
def trained(pages: int = 400, steps: int = 160, decay: float = 1e-4) -> tuple[dict[str, float], np.ndarray]:
    """(weight of label `article` for each feature, 2 x 2 transition scores) from labelled pages."""
    data = []
    for page, truth in labelled_pages(pages):
        found = blocks(page)
        left, labels = list(truth), []
        for text, (inherited, _), _ in found:
            hit = bool(left) and text == left[0] and "in title" not in inherited
            if hit:
                left.pop(0)
            labels.append(int(hit))
        data.append((features(found), np.array(labels)))
    names = sorted({f for rows, _ in data for row in rows for f in row})
    number = {f: k for k, f in enumerate(names)}
    longest = max(len(y) for _, y in data)
    x = np.zeros((len(data), longest, len(names)), np.float32)
    y, real = np.zeros((len(data), longest), np.int64), np.zeros((len(data), longest), bool)
    for k, (rows, labels) in enumerate(data):
        for j, row in enumerate(rows):
            x[k, j, [number[f] for f in row]] = 1
        y[k, : len(labels)], real[k, : len(labels)] = labels, True
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    n = real.sum()
    for step in range(1, steps + 1):
        score = np.zeros((len(data), longest, 2))
        score[:, :, 1] = x @ w
        score[~real] = 0
        ahead, back = score.copy(), np.zeros_like(score)
        for j in range(1, longest):  # padded places come last and pass their score on unchanged
            ahead[:, j] = np.where(real[:, j, None], _log_sum(ahead[:, j - 1, :, None] + t, 1) + score[:, j], ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            back[:, j] = np.where(real[:, j + 1, None], _log_sum(t + (score + back)[:, j + 1, None, :], 2), 0)
        whole = _log_sum(ahead[:, -1], 1)
        p = np.exp(ahead + back - whole[:, None, None])
        g_node = ((p[:, :, 1] - y) * real).astype(np.float32)
        g_w = np.einsum("kj,kjf->f", g_node, x) / n + decay * w
        g_t = np.zeros((2, 2))
        for j in range(1, longest):
            pair = np.exp(ahead[:, j - 1, :, None] + t + (score + back)[:, j, None, :] - whole[:, None, None])[real[:, j]]
            g_t += pair.sum(axis=0)
            np.add.at(g_t, (y[real[:, j], j - 1], y[real[:, j], j]), -1)
        g = np.concatenate([g_w, (g_t / n + decay * t).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:-4], t - move[-4:].reshape(2, 2)
    return dict(zip(names, w.tolist())), t


def decode(found: list, model: tuple[dict[str, float], np.ndarray]) -> list[int]:
    """Viterbi labels of a page's blocks."""
    weights, t = model
    (t00, t01), (t10, t11) = t.tolist()
    a0, a1, steps = 0.0, 0.0, []
    for k, row in enumerate(features(found)):
        s = sum(weights.get(f, 0.0) for f in row)
        if k == 0:
            a0, a1 = 0.0, s
            continue
        from0, from1 = a0 + t00 < a1 + t10, a0 + t01 < a1 + t11
        a0, a1 = max(a0 + t00, a1 + t10), max(a0 + t01, a1 + t11) + s
        steps.append((from0, from1))
    label = int(a1 > a0)
    labels = [label]
    for back in reversed(steps):
        label = int(back[label])
        labels.append(label)
    return labels[::-1] if found else []


def main_text(page: str | None, model) -> str:
    found = blocks(page or "", frozenset(model[0]))
    return "\n".join(b[0] for b, label in zip(found, decode(found, model)) if label)


def _text_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py(), model) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(partial(_text_rows, model=trained()), "page_id long, url string, text string, n_chars long")
