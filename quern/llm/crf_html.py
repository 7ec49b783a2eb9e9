"""Main-text extraction by a linear-chain conditional random field over leaf blocks.

A page is cut into its leaf blocks of text, in order. Each block has features of its
ancestors (tags, and what their class, id and role names speak of) and of its text
(length, share of link text, punctuation). The field has two labels, article and
other; its weights are trained by gradient ascent on labelled pages and a page is
decoded by Viterbi. ``training_pages`` writes the labelled pages: varied layouts whose
every block is known to be article or not, with the signals spread so that no single
one decides (articles without an <article>, notices inside it, long comments).
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import only, table

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Element groups of the HTML standard. In raw ones there is no markup; the
# text of a page does not show in them.
_RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
#: Elements that begin a block; all others, unknown ones too, are inline.
_BLOCK = _CLOSES_P | frozenset("html head title body p li dt dd tr td th thead tbody tfoot caption colgroup legend summary dialog select option optgroup button noscript template object canvas svg video audio picture center frameset search map base input link meta".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img math".split())
_KNOWN = _BLOCK | _INLINE
_SELF_CLOSING = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
# What names in class, id and role attributes speak of.
_TOPICS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "head": "header masthead banner topbar logo branding".split(),
    "foot": "footer foot copyright legal colophon contentinfo".split(),
    "side": "sidebar aside related recommended recommendations widget rail complementary more popular trending tags share social".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad dfp".split(),
    "notice": "cookie cookies consent notice notices alert popup modal newsletter subscribe subscription gdpr paywall signup message warning".split(),
    "comment": "comment comments reply replies respond discussion disqus".split(),
    "form": "form login search signin register contact".split(),
    "body": "article content post main entry story body text page single".split(),
}
_TOPIC_OF = {word: topic for topic, words in _TOPICS.items() for word in words}
_NAME = re.compile(r"[a-z]+(?:-ad)?")
_CACHE = 20_000


def _attribute_topics(attributes: str) -> frozenset[str]:
    found = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            for word in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower()):
                if topic := _TOPIC_OF.get(word):
                    found.add("c=" + topic)
        elif name == "hidden" or name == "aria-hidden" and "true" in values or name == "style" and "none" in "".join(values):
            found.add("hidden")
    return frozenset(found)


class _Parser:
    """Leaf blocks of pages; remembers what an element adds to its ancestors' features."""

    def __init__(self):
        self.steps: dict[tuple, frozenset[str]] = {}

    def _below(self, above: frozenset[str], tag: str, attributes: str) -> frozenset[str]:
        key = (above, tag, attributes)
        found = self.steps.get(key)
        if found is None:
            if len(self.steps) > _CACHE:
                self.steps.clear()
            found = self.steps[key] = above | {"t=" + (tag if tag in _KNOWN else "other")} | _attribute_topics(attributes)
        return found

    def blocks(self, page: str) -> list[tuple[frozenset[str], str, str, float]]:
        """(ancestor features, block tag, text, share of link text) of each leaf block, in linear time."""
        out = []
        stack = _Stack()
        text: list[str] = []
        linked = 0

        def flush():
            nonlocal linked
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined:
                    tag, above = stack.block()
                    out.append((above, tag, joined, min(1.0, linked / len(joined))))
                text.clear()
            linked = 0

        for kind, value, attributes in _tokens(page):
            if kind == "text":
                text.append(value)
                if stack.open_at("a"):
                    linked += len(value)
            elif kind == "end":
                at = stack.open_at(value)
                # an inline end tag does not close the blocks around it
                if at and (value in _BLOCK or at > stack.last_block()):
                    if value in _BLOCK:
                        flush()
                    stack.close(at)
            elif kind == "raw":
                text.append(" ")
            elif value in ("br", "wbr", "img"):
                text.append(" " if value == "br" else "")
            else:
                if value in _BLOCK:
                    flush()
                    if value in _CLOSES_P and stack.block()[0] == "p":
                        stack.close(stack.last_block())
                    if value in _SELF_CLOSING and (at := stack.open_at(value)) > max(map(stack.open_at, _SELF_CLOSING[value])):
                        stack.close(at)
                if value not in _VOID and not attributes.endswith("/"):
                    stack.push(value, self._below(stack.features(), value, attributes))
        flush()
        return out


class _Stack:
    """Open elements; where the last of each tag and the last block stand is known without a search."""

    def __init__(self):
        self.tags: list[tuple[str, frozenset[str]]] = [("", frozenset())]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, tag: str, features: frozenset[str]) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in _BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append((tag, features))

    def close(self, at: int) -> None:
        while len(self.tags) > at:
            tag, _ = self.tags.pop()
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def open_at(self, tag: str) -> int:
        """Place of the innermost open element of a tag; 0 if there is none."""
        found = self.at.get(tag)
        return found[-1] if found else 0

    def last_block(self) -> int:
        return self.blocks[-1]

    def block(self) -> tuple[str, frozenset[str]]:
        return self.tags[self.blocks[-1]]

    def features(self) -> frozenset[str]:
        return self.tags[-1][1]


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start" or "end", tag, attributes) and ("raw", tag, ""), in order.

    A quote that is never closed is an ordinary sign, a ``<`` that begins no tag is text, and
    a raw element without an end hides the rest of the page, as the standard has it.
    """
    at, last = 0, page.rfind(">")
    quotes = True  # until a quoted value would hide every tag end that is left
    while at < len(page):
        start = page.find("<", at)
        if start < 0 or start > last:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        name = _TAG.match(page, start + 1)
        if not name:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
            else:
                yield "text", "<", ""
                at = start + 1
            continue
        end = name.end()
        while True:
            sign = _TAG_END.search(page, end)
            if sign[0] == ">":
                break
            closing = page.find(sign[0], sign.end()) if quotes else -1
            if closing > last:
                quotes, closing = False, -1
            end = (closing if closing >= 0 else sign.start()) + 1
            if end > last:
                # nothing closes this tag: it ends at the first sign that can
                sign = re.compile(">").search(page, name.end())
                break
        tag, attributes, at = name[2].lower(), page[name.end() : sign.start()], sign.end()
        if name[1]:
            yield "end", tag, ""
        elif tag in _RAW and not attributes.endswith("/"):
            ending = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            at = ending.end() if ending else len(page)
            yield "raw", tag, ""
        else:
            yield "start", tag, attributes


def _text_features(tag: str, text: str, linked: float) -> tuple[str, ...]:
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 60 else 4
    share = 0 if linked == 0 else 1 if linked < 0.5 else 2
    ends = "e=stop" if text[-1] in ".!?:\"'”»)" else "e=none"
    special = ("copyright",) if "©" in text or "(c) " in text.lower() else ()
    return ("p=" + tag, f"w={size}", f"l={share}", ends, f"wl={size}{share}", f"wp={size}{tag}", "comma" if "," in text else "plain", *special)


class Field:
    """Weights of article against other, and of two labels in a row."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start, step
        self.known: dict[frozenset[str], float] = {}

    def emission(self, block) -> float:
        above, tag, text, linked = block
        base = self.known.get(above)
        if base is None:
            if len(self.known) > _CACHE:
                self.known.clear()
            base = self.known[above] = sum(self.weights.get(f, 0.0) for f in above)
        get = self.weights.get
        return base + sum(get(f, 0.0) for f in _text_features(tag, text, linked))

    def decode(self, blocks: list) -> list[bool]:
        """Viterbi: the most likely labels of a page's blocks."""
        if not blocks:
            return []
        (oo, oa), (ao, aa) = self.step.tolist()
        other, article = self.start.tolist()
        back = []
        for i, b in enumerate(blocks):
            if i:
                from_other, from_article = other + oa > article + aa, other + oo > article + ao
                back.append((from_article, from_other))
                other, article = (other + oo if from_article else article + ao), (other + oa if from_other else article + aa)
            article += self.emission(b)
        label = article > other
        out = [label]
        for to_other, to_article in reversed(back):
            label = not (to_article if label else to_other)
            out.append(label)
        return out[::-1]


def train(pages: list[list[tuple[tuple, bool]]], rounds: int = 160, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of the labels; ``pages`` hold (block, is article)."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in (*sorted(b[0]), *_text_features(*b[1:]))] for b, _ in page] for page in pages]
    longest = max(map(len, rows))
    n = len(rows)
    x = np.zeros((n, longest, len(names)), np.float32)
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    for i, page in enumerate(rows):
        for j, features in enumerate(page):
            x[i, j, features] = 1
            mask[i, j], gold[i, j] = True, int(pages[i][j][1])
    flat = x[mask]
    w = np.zeros(len(names) + 6)  # emissions, then two starts and four steps
    m, v = np.zeros_like(w), np.zeros_like(w)
    both = mask[:, 1:]
    want = np.zeros_like(w)
    want[: len(names)] = flat.T @ gold[mask]
    np.add.at(want, len(names) + gold[:, 0], 1)
    np.add.at(want, len(names) + 2 + (gold[:, :-1] * 2 + gold[:, 1:])[both], 1)
    for t in range(1, rounds + 1):
        e = np.zeros((n, longest, 2))
        e[..., 1][mask] = flat @ w[: len(names)]
        start, step = w[len(names) : len(names) + 2], w[len(names) + 2 :].reshape(2, 2)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = start + e[:, 0]
        for j in range(1, longest):
            ahead[:, j] = np.where(mask[:, j, None], np.logaddexp.reduce(ahead[:, j - 1, :, None] + step, axis=1) + e[:, j], ahead[:, j - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        behind = np.zeros((n, longest, 2))
        for j in range(longest - 2, -1, -1):
            behind[:, j] = np.where(mask[:, j + 1, None], np.logaddexp.reduce(step + (e[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2), 0)
        p = np.exp(ahead + behind - total[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + step + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])[both].sum(axis=0)
        has = np.concatenate([flat.T @ p[..., 1][mask], p[:, 0].sum(axis=0), pair.reshape(-1)])
        g = (want - has) / n - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()}, w[len(names) : len(names) + 2], w[len(names) + 2 :].reshape(2, 2))


def training_pages(n: int = 240, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """Labelled pages of many layouts: (html, is article, block by block)."""
    rng = random.Random(seed)
    syllables = "an be con de er fi ga ho in ka le mo ne or pa qui re sa ti un ve wo".split()

    def words(low, high, stop=False):
        found = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(low, high))]
        return (" ".join(found).capitalize() + (rng.choice([".", ".", "!", "?"]) if stop else "")).replace(" ", ", ", rng.randrange(2) if stop else 0)

    out = []
    for _ in range(n):
        labels: list[bool] = []

        def put(label, text, labels=labels):
            labels.append(label)
            return text

        def name(*topics):
            kind = rng.choice(["class", "id", "role", ""])
            return f' {kind}="{rng.choice(rng.choice([_TOPICS[t] for t in topics]))}"' if kind else ""

        def menu(low, high):
            return "<ul>" + "".join(f'<li><a href="/{i}">{put(False, words(1, 4))}</a>' + rng.choice(["</li>", ""]) for i in range(rng.randrange(low, high))) + "</ul>"

        def box(tag, topic, *inner):
            return f"<{tag}{name(topic)}>" + "".join(inner) + f"</{tag}>"

        def named(topic, *inner):
            return f'<div {rng.choice(["class", "id"])}="{rng.choice(_TOPICS[topic])}">' + "".join(inner) + "</div>"

        def loose():
            kind = rng.randrange(8)
            if kind == 0:
                return named("ad", f"<{(t := rng.choice(['p', 'div', 'span']))}>{put(False, words(2, 30, True))}</{t}>")
            if kind == 1:
                return named("ad", put(False, words(2, 25, True)))
            if kind == 2:
                return named("notice", put(False, words(5, 30, True)), "<button>", put(False, words(1, 3)), "</button>")
            if kind == 3:
                return named("side", f"<h3>{put(False, words(1, 4))}</h3>", menu(2, 5))
            if kind == 4:
                return box("aside", "side", *(f"<p>{put(False, words(4, 40, True))}</p>" for _ in range(rng.randrange(1, 3))))
            if kind == 5:
                return f'<form{name("form")}><label>{put(False, words(1, 4))}</label><input type="text"><button>' + put(False, words(1, 2)) + "</button></form>"
            if kind == 6:
                return named("notice", f"<p>{put(False, words(8, 40, True))}</p>")
            return box("nav", "nav", menu(2, 6))

        head = f"<!DOCTYPE html><html><head><title>{put(False, words(2, 7))}</title><style>p{{a:b}}</style></head><body>"
        parts = [head]
        if rng.random() < 0.5:
            parts.append(rng.choice([lambda: box("header", "head", f"<h1>{put(False, words(1, 4))}</h1>", box("nav", "nav", menu(2, 6)) if rng.random() < 0.5 else ""), lambda: named("head", put(False, words(1, 8)))])())
        if rng.random() < 0.8:
            parts.append(rng.choice([lambda: box("nav", "nav", menu(3, 9)), lambda: named("nav", menu(3, 9))])())
        parts += [loose() for _ in range(rng.randrange(0, 3))]
        opening, closing = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f'<div class="{rng.choice(_TOPICS["body"])}">', "</div>"), (f'<div id="{rng.choice(_TOPICS["body"])}">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>")])
        parts.append(opening)
        if rng.random() < 0.8:
            parts.append(rng.choice([lambda t: f"<h1>{t}</h1>", lambda t: f"<header><h1>{t}</h1></header>", lambda t: f"<h2>{t}</h2>"])(put(True, words(2, 9))))
        for _ in range(rng.randrange(1, 14)):
            kind = rng.random()
            if kind < 0.66:
                text = put(True, words(1, 90, True))
                if rng.random() < 0.3:
                    text = text.replace(" ", f' <a href="/x">{words(1, 3)}</a> ', 1)
                parts.append(rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"]))
            elif kind < 0.75:
                parts.append(f"<h2>{put(True, words(1, 6))}</h2>")
            elif kind < 0.83:
                parts.append("<ul>" + "".join(f"<li>{put(True, words(2, 15, True))}</li>" for _ in range(rng.randrange(2, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{put(True, words(5, 30, True))}</p></blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{put(True, words(1, 4))}</td><td>{put(True, words(1, 4))}</td></tr>" for _ in range(2)) + "</table>")
            else:
                parts.append(loose())
        parts.append(closing)
        if rng.random() < 0.4:
            parts.append(named("comment", f"<h3>{put(False, words(1, 3))}</h3>" if rng.random() < 0.5 else "", *(f"<{(t := rng.choice(['p', 'div', 'li']))}>{put(False, words(3, 60, True))}</{t}>" for _ in range(rng.randrange(1, 6)))))
        parts += [loose() for _ in range(rng.randrange(0, 3))]
        if rng.random() < 0.85:
            parts.append(rng.choice([lambda: box("footer", "foot", f"{put(False, '&copy; ' + words(2, 30, True))}"), lambda: box("footer", "foot", f"<p>{put(False, words(2, 30, True))}</p>", menu(2, 4)), lambda: named("foot", put(False, words(2, 12)))])())
        out.append(("".join(parts) + "</body></html>", labels))
    return out


@functools.cache
def default_field() -> Field:
    parser = _Parser()
    pages = []
    for page, labels in training_pages():
        blocks = parser.blocks(page)
        if len(blocks) != len(labels):
            raise AssertionError("a training page and its labels disagree")
        pages.append(list(zip(blocks, labels, strict=True)))
    return train(pages)


def main_text(page: str | None, field: Field, parser: _Parser | None = None) -> str:
    blocks = (parser or _Parser()).blocks(page or "")
    return "\n".join(b[2] for b, keep in zip(blocks, field.decode(blocks), strict=True) if keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """``(id, url, text, n_chars)`` for each page, from the whole html.

    Character references are decoded, white space inside a block becomes one blank,
    blocks are joined by a line feed in page order. A null, empty or text-free page
    gives an empty text. Repeated rows are all returned, null ids and urls kept. Pages are
    read whole in linear time, however long or broken. An empty table gives an empty
    result; other columns are not read, whatever their names.
    """
    field = field or default_field()
    weights = (field.weights, field.start, field.step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, parser = Field(*weights), _Parser()
        for batch in batches:
            texts = [main_text(page.as_py(), mine, parser) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = only(df, id=id_col, url=url_col, html=html_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op5_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
