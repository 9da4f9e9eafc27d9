"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words, which score positive, and tags, which score negative, with
weights learned from labelled pages. One linear scan finds the contiguous stretch of the largest
total: the content region. The weight of a token depends on its kind: a word in plain text, in a
headline, in a short line that ends no sentence, or in a link; a tag of running text, of a list or
table, or another. Elements whose name says
that they are never content (scripts, menus, forms and the like), and containers of which a whole
class, id or role says so (adverts, comments and the like), count as one low-scoring token each, and
their text is left out. Where such a word is only part of a container's class, its start, end and
words score low, but its text is kept if the region has it; a container of over half of the page's
words isn't taken for one of these. If an edge of the region falls
inside an article element, the region is grown to the whole of it. It never shrinks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.arrays import batch
from stratavec.llm.bpe import groups_of
from stratavec.llm.labelled_pages import PAGES
from stratavec.session import pick, ready

#: Element names of HTML by their role.
RAW = frozenset("script style noscript template textarea title svg iframe object select option canvas audio video head xmp plaintext".split())
NEVER = frozenset("nav header footer aside form button dialog menu".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("div section ul ol dl table span".split())
LISTS = frozenset("ul ol li dl dt dd table tr td th tbody thead tfoot".split())
NEVER_WORDS = r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?\w*|consent|disqus|footer|form|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|recommended|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)"
#: A class, id or role that is such a word is one of an element that is never content; one that has it as a part only hints at that.
NEVER_CLASS = re.compile(rf"(?:^|\s){NEVER_WORDS}(?:$|\s)", re.I)
HINT = re.compile(rf"(?:^|[\s_-]){NEVER_WORDS}(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in RAW}
KINDS = ("word", "link_word", "inline_tag", "text_tag", "list_tag", "other_tag", "skipped", "hinted_word", "head_word", "short_word")
WORD, LINK_WORD, INLINE_TAG, TEXT_TAG, LIST_TAG, OTHER_TAG, SKIPPED, HINTED_WORD, HEAD_WORD, SHORT_WORD = range(len(KINDS))
WORDS = (WORD, LINK_WORD, HINTED_WORD, HEAD_WORD, SHORT_WORD)
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
SHORT = 8
ENDS_SENTENCE = tuple(".!?…:;\"'”“»)。！？")
#: Without an end tag, these run to the end of the page; of others only the tag itself is left out.
ENDLESS = frozenset("script style xmp plaintext".split())
HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())


def _named(pattern: re.Pattern[str], name: str, attributes: str) -> bool:
    return name in CONTAINERS and "=" in attributes and any(pattern.search(m.strip("\"'")) for m in NAMED.findall(attributes))


def _never(name: str, attributes: str) -> bool:
    return name in NEVER or _named(NEVER_CLASS, name, attributes)


def tokens(page: str) -> Iterator[tuple[int, int, str | None, str, int]]:
    """kind, number of words, text (None for tags), element name, +1 / -1 / 0 for its start, end, or neither."""
    at, skipping, link, inner, hinted, articles, endless = 0, [], 0, 0, [], 0, set()
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not skipping:
            text = entities.unescape(page[at:end])
            yield LINK_WORD if link else WORD, len(text.split()), text, "", 0
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        name, close = m[2].lower(), bool(m[1])
        if not close and name in RAW:
            alone = m[3].rstrip().endswith("/")
            e = RAW_END[name].search(page, at) if not alone and name not in endless else None
            if e is None:
                endless.add(name)
            if name == "head" and e is None:
                continue
            at = e.end() if e else (size if name in ENDLESS and not alone else at)
            if not skipping:
                yield SKIPPED, 0, None, name, 0
            continue
        if skipping:
            if name in VOID:
                continue
            if name in ARTICLE and not close:  # an unclosed menu doesn't swallow the article
                skipping.clear()
            elif close and name in skipping:
                while skipping and skipping.pop() != name:
                    pass
                continue
            elif not close:
                if name not in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                    skipping.append(name)
                continue
            else:
                continue
        if name in ARTICLE:
            articles = max(0, articles + (-1 if close else 1))
        if not close and name not in VOID and _never(name, m[3]) and not (name == "header" and articles):
            skipping.append(name)
            yield SKIPPED, 0, None, name, 0
            continue
        if name == "a":
            link, inner = int(not close and bool(HREF.search(m[3]))), 0
        elif link and name not in INLINE and name not in VOID:  # a link ends with the block that it began in
            inner += -1 if close else 1
            link = int(inner >= 0)
        if hinted and name == hinted[-1][0]:
            hinted[-1][1] += -1 if close else 1
        elif not close and _named(HINT, name, m[3]):
            hinted.append([name, 1])
            yield SKIPPED, 0, None, name, 1
            continue
        if hinted and not hinted[-1][1]:
            hinted.pop()
            yield SKIPPED, 0, None, name, -1
            continue
        kind = INLINE_TAG if name in INLINE else TEXT_TAG if name in TEXT_TAGS else LIST_TAG if name in LISTS else OTHER_TAG
        yield kind, 0, None, name, 0 if name in VOID else -1 if close else 1


def kinds_of(found: list[tuple[int, int, str | None, str, int]], wrappers: bool = True) -> list[int]:
    """The kinds of tokens, with words in hinted containers as such; with wrappers, not in one that holds over half of the page's words."""
    words, opened, spans = np.cumsum([0] + [t[1] for t in found]), [], []
    for i, (kind, _, _, _, step) in enumerate(found):
        if kind == SKIPPED and step > 0:
            opened.append(i)
        elif kind == SKIPPED and step < 0:
            spans.append((opened.pop(), i))
    depth = np.zeros(len(found) + 1, int)
    for a, b in spans + [(i, len(found)) for i in opened]:
        if not wrappers or 2 * (words[b] - words[a]) <= words[-1]:
            depth[a] += 1
            depth[b] -= 1
    kinds = [HINTED_WORD if t[0] == WORD and d else t[0] for t, d in zip(found, np.cumsum(depth)[:-1].tolist(), strict=True)]
    block, head = [], False
    for i, (kind, _, text, name, step) in enumerate([*found, (OTHER_TAG, 0, None, "", 0)]):
        if text is not None:
            block.append(i)
        elif name not in INLINE and name != "br":
            n, line = sum(found[j][1] for j in block), "".join(found[j][2] for j in block).rstrip()
            short = n < SHORT and not line.endswith(ENDS_SENTENCE)
            for j in block if head or short else ():
                if kinds[j] == WORD:
                    kinds[j] = HEAD_WORD if head else SHORT_WORD
            block = []
            head = step > 0 if name in HEADS else head and step >= 0 and kind != SKIPPED
    return kinds


def train(pages: list[str] = PAGES) -> np.ndarray:
    """A weight for each kind: the smoothed log odds of standing inside the content, with words kept positive and tags negative."""
    inside, outside = np.ones(len(KINDS)), np.ones(len(KINDS))
    for page in pages:
        before, _, rest = page.partition("[[")
        content, _, after = rest.partition("]]")
        for part, counts in ((before, outside), (content, inside), (after, outside)):
            found = list(tokens(part))
            for kind, (_, words, text, _, _) in zip(kinds_of(found, False), found, strict=True):
                counts[kind] += words if text is not None else 1
    odds = np.log(inside / inside.sum()) - np.log(outside / outside.sum())
    low, high = np.full(len(KINDS), -8.0), np.full(len(KINDS), -0.05)
    low[[WORD, HEAD_WORD]], high[[WORD, HEAD_WORD]] = 0.2, 6.0
    low[[LINK_WORD, HINTED_WORD, SHORT_WORD]], high[[LINK_WORD, HINTED_WORD, SHORT_WORD]] = -6.0, 0.1
    return np.clip(odds, low, high)


def region(kinds: list[int], words: list[int], weights: np.ndarray) -> tuple[int, int]:
    """The contiguous stretch of the largest positive total, the first of equals: one scan. Empty if no word scores."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, (k, n) in enumerate(zip(kinds, words, strict=True)):
        score = weights[k] * (n if k in WORDS else 1)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: np.ndarray) -> str:
    """The main text: white space within a block as one space, blocks joined by a line feed."""
    found = list(tokens(page or ""))
    kinds, words = kinds_of(found), [t[1] for t in found]
    lo, hi = region(kinds, words, weights)
    if lo == hi:  # a page of short lines only
        lo, hi = region([WORD if k == SHORT_WORD else k for k in kinds], words, weights)
    if lo == hi:
        return ""
    depth, spans = [], []
    for i, (_, _, _, name, step) in enumerate(found):
        if name in ARTICLE:
            if step > 0:
                depth.append(i)
            elif step < 0 and depth:
                spans.append((depth.pop(), i + 1))
    spans += [(i, len(found)) for i in depth]
    outer = [(a, b) for a, b in spans if a < hi and b > lo and not any(c <= a and b <= d and (c, d) != (a, b) for c, d in spans)]
    for a, b in outer:
        lo, hi = (a if a < lo < b else lo), (b if a < hi < b else hi)
    blocks, now = [], []
    for kind, _, text, name, _ in found[lo:hi]:
        if kind == SKIPPED and (name in RAW or name == "button"):  # gone without a break
            continue
        if text is not None:
            now.append(text)
        elif name == "br":
            now.append(" ")
        elif name not in INLINE and now:
            blocks.append(now)
            now = []
    blocks.append(now)
    return "\n".join(line for b in blocks if (line := " ".join("".join(b).split())))


RESULT = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}


def extract_task(weights: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [extract(p, weights) for some in groups_of(part.column(2)) for p in some]
                yield batch(RESULT, part.column(0), part.column(1), found, [len(t) for t in found])

    return task


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without words, give an empty text. Markup may be broken or cut
    off. Null and repeated ids each give their row; an empty table gives an empty result. Other
    columns are ignored.
    """
    ready(pages.sparkSession)
    rows = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return rows.mapInArrow(extract_task(train()), "page_id long, url string, text string, n_chars long")
