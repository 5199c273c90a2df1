"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between block-level tags, with its open ancestors. A
block's features are its ancestor tags, words of their class and id attributes, and properties of
the text; the field has one weight per feature and label and one per pair of neighbouring labels.
It is trained on a bounded sample of pages whose own markup labels them (text in an article or
main element is main text unless boilerplate markup is nearer), each also with that markup hidden,
and decoded by Viterbi. Each page is parsed and decoded whole.

Null and empty pages, and pages without text, give an empty text. Without labelled pages in the
table the decision is that of the boilerplate and content features alone (`PRIOR`).
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import common

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A start tag ends an open element of the same kind, up to its container.
ENDS_OWN = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
    "th": ("tr", "table"), "option": ("select",),
}
#: Elements and words of class or id that mark what is not main text, and what is.
BOILERPLATE_TAGS = set("nav header footer aside form menu button select dialog".split())
BOILERPLATE_WORDS = set(
    "ad ads advert alert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disclaimer disqus footer form gdpr header login menu menus modal nav navbar navigation"
    " newsletter notice notices popup promo promoted promotion related reply replies share sharing sidebar signup social sponsor"
    " sponsored subscribe toolbar widget".split()
)
CONTENT_TAGS = {"article", "main"}
CONTENT_WORDS = set("article body content entry main post story text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*)([^>]*)>",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:\A|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")

#: Hash buckets of features.
WIDTH = 1 << 12
LABELS = 2


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, frozenset], ...]  # ancestor tags with the words of their class and id
    linked: int  # characters within links


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order: text between block-level tags."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    parts: list[str] = []
    links, linked, shape = 0, 0, ()

    def text_in(raw: str) -> None:
        nonlocal linked, shape
        value = entities.unescape(raw) if "&" in raw else raw
        if not parts or not shape:
            shape = tuple(e for e in stack)
        parts.append(value)
        if links:
            linked += len(value.strip())

    def flush() -> None:
        nonlocal linked, shape
        text = _BLANK.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(Block(text, shape, linked))
        parts.clear()
        linked, shape = 0, ()

    at, n = 0, len(page)
    lowered = None
    while at < n:
        opened = page.find("<", at)
        if opened < 0:
            text_in(page[at:])
            break
        if opened > at:
            text_in(page[at:opened])
        m = _TAG.match(page, opened)
        if not m:
            text_in("<")
            at = opened + 1
            continue
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue  # a comment or declaration
        name = name.lower()
        inline = name in INLINE
        if closing:
            if not inline:
                flush()
            if name == "p" and not any(t == "p" for t, _ in stack):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            links = sum(t == "a" for t, _ in stack)
            continue
        if name in RAW_TEXT and not attributes.rstrip().endswith("/"):
            if lowered is None:
                lowered = page.lower() if page.isascii() else _ascii_lower(page)
            end = lowered.find("</" + name, at)
            at = n if end < 0 else end
            if name != "textarea":
                flush_at = page.find(">", at)
                at = n if flush_at < 0 else flush_at + 1
            flush()
            continue
        if name in VOID:
            if name == "br":
                if parts:
                    parts.append(" ")
            elif not inline:
                flush()
            continue
        if not inline:
            flush()
            _close_implied(stack, name)
        stack.append((name, _words_of(attributes)))
        links += name == "a"
    flush()
    return blocks


def _ascii_lower(page: str) -> str:
    """Lower case without a change of length."""
    return page.translate({i: i + 32 for i in range(65, 91)})


def _close_implied(stack: list, name: str) -> None:
    if name in ENDS_P:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "p":
                del stack[k:]
                break
            if stack[k][0] not in INLINE:
                break
    for k in range(len(stack) - 1, -1, -1) if name in ENDS_OWN else ():
        if stack[k][0] == name:
            del stack[k:]
            break
        if stack[k][0] in ENDS_OWN[name]:
            break


def _words_of(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return frozenset(_WORDS.findall(found.lower()))


def _is_boilerplate(tag: str, words: frozenset) -> bool:
    found = words & BOILERPLATE_WORDS
    if found == {"header"} and words & CONTENT_WORDS:
        return False  # the heading part of an article
    return tag in BOILERPLATE_TAGS or bool(found)


def marked(block: Block) -> int | None:
    """What the markup says: 1 main text, 0 boilerplate, None nothing. The nearest ancestor decides."""
    label = None
    for tag, words in block.path:
        if tag in CONTENT_TAGS:
            label = 1 if label is None else label
        elif tag == "header":
            label = label or 0  # a header within an article has its title
        elif _is_boilerplate(tag, words):
            return 0
    return label


def feature_names(block: Block, hidden: bool = False) -> list[str]:
    """Features of a block; `hidden` leaves out the markup that labels pages."""
    path = [(t, w) for t, w in block.path if not (hidden and t in CONTENT_TAGS)]
    tags = {t for t, _ in path}
    words = frozenset().union(*(w for _, w in path)) if path else frozenset()
    size = len(block.text)
    out = ["bias", f"size={min(size, 1023).bit_length()}", f"links={(4 * block.linked) // max(size, 1)}"]
    out += [f"tag={t}" for t in sorted(tags)]
    out += [f"name={w}" for w in sorted(words)]
    own = next((t for t, _ in reversed(path) if t not in INLINE), "none")
    out.append(f"own={own}")
    inner = [(t, w) for k, (t, w) in enumerate(path)
             if not (t == "header" and any(x in CONTENT_TAGS or v & CONTENT_WORDS for x, v in path[:k]))]
    if any(_is_boilerplate(t, w) for t, w in inner):
        out.append("boilerplate")
    elif tags & CONTENT_TAGS or words & CONTENT_WORDS:
        out.append("content")
    else:
        out.append("bare")
    out.append("ends" if block.text[-1] in ".!?:;\"'”»…" else "open")
    if block.text[0] in "©®" or "©" in block.text:
        out.append("rights")
    return out


def _slot(name: str) -> int:
    value = 2166136261
    for byte in name.encode():
        value = ((value ^ byte) * 16777619) & 0xFFFFFFFF
    return value % WIDTH


@dataclass(frozen=True)
class Field:
    """Weights of the chain: WIDTH x 2 for features and 2 x 2 for neighbours. Fixed in size."""

    unary: np.ndarray
    pair: np.ndarray

    def scores(self, names: list[list[str]]) -> np.ndarray:
        return np.array([self.unary[[_cached_slot(x) for x in own]].sum(axis=0) for own in names])

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi."""
        best = scores[0]
        back = []
        for row in scores[1:]:
            reach = best[:, None] + self.pair
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0) + row
        label = int(best.argmax())
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


_SLOTS: dict[str, int] = {}


def _cached_slot(name: str) -> int:
    slot = _SLOTS.get(name)
    if slot is None:
        if len(_SLOTS) > 50000:
            _SLOTS.clear()
        slot = _SLOTS[name] = _slot(name)
    return slot


def prior() -> Field:
    unary = np.zeros((WIDTH, LABELS))
    unary[_slot("boilerplate"), 0] = 6.0
    unary[_slot("content"), 1] = 3.0
    unary[_slot("own=p"), 1] = 1.0
    unary[_slot("ends"), 1] = 0.5
    unary[_slot("rights"), 0] = 3.0
    return Field(unary, np.zeros((LABELS, LABELS)))


#: Used when no page of the table has labels.
PRIOR = prior()


def train(pages: list[list[tuple[list[str], int]]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood by adaptive gradient steps; forward-backward on all chains at once."""
    if not pages:
        return PRIOR
    length = max(map(len, pages))
    n = len(pages)
    rows, columns, labels = [], [], np.full((n, length), -1)
    for i, page in enumerate(pages):
        for j, (names, label) in enumerate(page):
            labels[i, j] = label
            own = [_slot(x) for x in names]
            rows += [i * length + j] * len(own)
            columns += own
    rows, columns = np.array(rows), np.array(columns)
    there = labels >= 0
    gold = np.zeros((n, length, LABELS))
    gold[there, labels[there]] = 1
    unary, pair = PRIOR.unary.copy(), PRIOR.pair.copy()
    base = PRIOR.unary
    seen_u, seen_p = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)
    both = there[:, 1:] & there[:, :-1]
    gold_pair = np.einsum("ija,ijb->ab", gold[:, :-1] * both[..., None], gold[:, 1:])
    for _ in range(rounds):
        score = np.zeros((n * length, LABELS))
        for label in range(LABELS):
            score[:, label] = np.bincount(rows, unary[columns, label], minlength=n * length)
        score = score.reshape(n, length, LABELS)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for j in range(1, length):
            step = np.logaddexp.reduce(ahead[:, j - 1, :, None] + pair, axis=1) + score[:, j]
            ahead[:, j] = np.where(there[:, j, None], step, ahead[:, j - 1])
        for j in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(pair + (score[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(there[:, j + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None]) * there[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + pair + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
        grad_u = np.zeros_like(unary)
        miss = (gold - chance).reshape(-1, LABELS)
        for label in range(LABELS):
            grad_u[:, label] = np.bincount(columns, miss[rows, label], minlength=WIDTH)
        grad_u = grad_u / n - decay * (unary - base)
        grad_p = (gold_pair - (joint * both[..., None, None]).sum(axis=(0, 1))) / n - decay * pair
        seen_u += grad_u ** 2
        seen_p += grad_p ** 2
        unary += rate * grad_u / np.sqrt(seen_u)
        pair += rate * grad_p / np.sqrt(seen_p)
    return Field(unary, pair)


def labelled_chains(page: str) -> list[list[tuple[list[str], int]]]:
    """The page's chain, plain and with the labelling markup hidden; nothing if it has no main text."""
    blocks = leaf_blocks(page)
    labels = [marked(b) for b in blocks]
    if 1 not in labels:
        return []
    known = [label or 0 for label in labels]
    return [[(feature_names(b, hidden), y) for b, y in zip(blocks, known)] for hidden in (False, True)]


def extract(page: str | None, field: Field) -> str:
    """The main text of one page: its main blocks joined by line feeds."""
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    chosen = field.decode(field.scores([feature_names(b) for b in blocks]))
    return "\n".join(b.text for b, label in zip(blocks, chosen) if label)


def fit_field(pages: DataFrame, bound: int = 300, chars: int = 20000, page: str = "html") -> Field:
    """Trains on at most `bound` labelled pages of at most `chars` characters, by smallest hash.

    The bounds keep the driver's training set small; extraction itself reads every page whole.
    """
    fit = pages.select(F.col(page).alias("html"), F.xxhash64(page).alias("place")).where(
        F.length("html").between(1, chars))
    sample = common.smallest(fit, "place", ["html"], bound).select("html").collect()
    chains = [chain for r in sample for chain in labelled_chains(r["html"])]
    return train(chains)


def extract_pages(pages: DataFrame, field: Field | None = None, page: str = "html", into: str = "text") -> DataFrame:
    """Adds the main text of every page; all other columns stay."""
    shared = pages.sparkSession.sparkContext.broadcast(field or fit_field(pages, page=page))

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([extract(p, shared.value) for p in column], dtype="object")

    return pages.withColumn(into, run(F.col(page)))
