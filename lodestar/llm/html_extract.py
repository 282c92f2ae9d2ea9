"""Main-text extraction from HTML by tag-path ratios.

A page is read into blocks (runs of text between block-level tags), each with its root-to-leaf tag
path. Per path the unlinked text length and punctuation of all its blocks are added up; the
text-to-path and punctuation-to-path ratios are smoothed along the page, neighbours counting by
how much of their paths they share, and fused; the mean over a path's blocks is the path's score.
Paths above a share of the page's best are selected, and in the article or main element, or else
the smallest container that holds most of the selected text, a lower share is enough, so that
headings and short paragraphs stay there while link lists and stubs do not. Elements that by name,
class, id or role are page furniture are never content, unless a form or a marked element wraps
what the page is about.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import read

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""", re.S)
#: Elements without content: those that leave a word as it is, and those that end a block.
UNSEEN = frozenset("area base col embed img input link meta param source track wbr".split())
BREAKS = frozenset("br hr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math object canvas audio video".split())
#: Those of them that may close themselves.
FOREIGN = frozenset("svg math".split())
CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
#: Elements that are page furniture wherever they stand.
FURNITURE = frozenset("head nav footer aside button select option menu dialog".split()) | RAW
#: Furniture unless they hold the page's text, as do elements with MARKS.
FORMS = frozenset("form fieldset".split())
#: ... and class, id or role words that say the same: some as any part of a name, others, which may
#: as well say what a text is about, only alone or before the name of a page's part.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promos?|cookies?|consent|menu|nav|navbar|navigation|sidebar|footer|breadcrumbs?|comments|respond|"
    r"sharing|social|subscribe|newsletter|popup|modal|login|signup|toolbar|pagination|contentinfo|complementary|masthead)(?:$|[\s_-])|"
    r"(?:^|\s)(?:notice|alert|comment|reply|replies|related|share|search|banner|popular|disclaimer)"
    r"(?:$|\s|[_-](?:area|bars?|block|box|buttons?|container|form|icons?|items?|links?|list|panel|posts?|articles?|stories|section|thread|tools?|widget|wrap|wrapper)(?:$|[\s_-]))", re.I)
#: Words that say what an element has or lacks, not what it is.
HAVING = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[-_]\S+", re.I)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?\"'()¿¡«»…–—。，、！？；：]")
#: An open one of these ends where one of the same set begins.
SIBLINGS = {t: frozenset(s.split()) for s in ("li", "dt dd", "tr", "td th", "option", "thead tbody tfoot") for t in s.split()}
LIMITS = frozenset("ul ol dl table tr body html article section div main aside td th".split())
#: A path's share of the best score that selects it, and that keeps it within the container.
SELECT_SHARE = 0.3
INSIDE_SHARE = 0.05
#: A form or marked element with at least such a share of the page's text holds the page, and so does a container of the selected text.
HOLDS = 0.75
SMOOTH = (0.25, 0.5, 0.25)


class Page:
    """A page's blocks. Paths are nodes of a tree, so deep nesting costs no more than its tags.

    Of path p: ``parent[p]``, ``depth[p]`` and whether it is in an article or a main element. Marks (forms and marked elements)
    are a tree too, ``above[m]``. A block is (path, text, linked characters, mark, outer): the mark around it,
    and the one around its article or main element; 0 is none.
    """

    def __init__(self, html: str):
        self.parent, self.depth, self.article, self.main = [0], [0], [False], [False]
        self.above = [0]
        self.blocks: list[tuple[int, str, int, int, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        paths: dict[tuple[int, str], int] = {}
        #: tag, path, furniture from here on, mark, outer, place of the nearest element that ends a list
        stack: list[tuple[str, int, bool, int, int, int]] = [("", 0, False, 0, 0, 0)]
        places: dict[str, list[int]] = {}  # where each tag is open
        text: list[str] = []
        linked, in_link = 0, False
        last = html.rfind(">") + 1  # no tag begins behind it
        at, search = 0, TAG.search

        def flush() -> None:
            nonlocal linked
            if text:
                _, path, bad, mark, outer, _ = stack[-1]
                if not bad:
                    said = " ".join(entities.unescape("".join(text)).split())
                    if said:
                        self.blocks.append((path, said, min(linked, len(said)), mark, outer))
                text.clear()
            linked = 0

        def close(place: int) -> None:
            while len(stack) > place:
                places[stack.pop()[0]].pop()

        while True:
            m = search(html, at, last)
            piece = html[at : m.start()] if m else html[at:]
            if piece:
                text.append(piece)
                if in_link:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if tag in INLINE:
                if tag == "a":
                    in_link = not closing
                continue
            if tag in UNSEEN:
                continue
            if tag in RAW and not closing:
                if not (tag in FOREIGN and CLOSED.search(attributes)):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            flush()
            in_link = False
            if tag in BREAKS:
                continue
            if closing:
                if places.get(tag):
                    close(places[tag][-1])
                continue
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in SIBLINGS:
                open_ = max((places[t][-1] for t in SIBLINGS[tag] if places.get(t)), default=0)
                if open_ and (open_ >= stack[-1][5] or tag in ("td", "th") and stack[stack[-1][5]][0] in ("td", "th") and open_ == stack[-1][5]):
                    close(open_)
            _, path, bad, mark, outer, limit = stack[-1]
            names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if attributes else ""
            within = self.article[path] or self.main[path]
            bad = bad or tag in FURNITURE or (tag == "header" and not within) or bool(attributes and HIDDEN.search(attributes))
            if tag in FORMS or (names and tag not in ("html", "body", "article", "main") and MARKS.search(HAVING.sub(" ", names))):
                self.above.append(mark)
                mark = len(self.above) - 1
            if tag in ("article", "main") and not within:
                outer = mark
            key = path, f"{tag}.{names.split()[0]}" if names else tag
            if key not in paths:
                paths[key] = len(self.parent)
                self.parent.append(path)
                self.depth.append(self.depth[path] + 1)
                self.article.append(self.article[path] or tag == "article")
                self.main.append(self.main[path] or tag == "main")
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, paths[key], bad, mark, outer, len(stack) if tag in LIMITS else limit))
        flush()

    def content(self) -> list[tuple[int, str, int, int, int]]:
        """The blocks that are not furniture.

        Marked elements do not count around an article or main element that has more text than is
        unmarked, if no unmarked text is in such an element, nor where they hold most of the page.
        """
        clean = [b for b in self.blocks if not b[3]]
        if len(clean) == len(self.blocks):
            return clean
        freed = [True] + [False] * (len(self.above) - 1)
        if not any(self.article[b[0]] or self.main[b[0]] for b in clean):
            inner = [b for b in self.blocks if b[4] and b[3] == b[4]]
            if any(self.main[b[0]] for b in inner) or sum(len(b[1]) for b in inner) > sum(len(b[1]) for b in clean):
                for b in inner:
                    freed[b[4]] = True
                for mark in range(len(freed) - 1, 0, -1):  # what is around it as well
                    freed[self.above[mark]] |= freed[mark]
            held = [0] * len(self.above)
            for b in self.blocks:
                held[b[3]] += len(b[1])
            for mark in range(len(held) - 1, 0, -1):
                held[self.above[mark]] += held[mark]
            for mark in range(1, len(held)):
                freed[mark] |= held[mark] >= HOLDS * held[0]
        for mark in range(1, len(freed)):
            freed[mark] &= freed[self.above[mark]]
        return [b for b in self.blocks if freed[b[3]]]

    def shared(self, a: int, b: int) -> float:
        """The share of the longer of two paths that both have; the climb is as long as the tags between them."""
        most = max(self.depth[a], self.depth[b])
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return (1 + self.depth[a]) / (1 + most)

    def scores(self, found: list) -> dict[int, float]:
        """Each path's text and punctuation ratios, smoothed along the page and fused."""
        sums: dict[int, list[int]] = {}
        for path, text, linked, *_ in found:
            s = sums.setdefault(path, [0, 0, 0])
            s[0] += 1
            s[1] += len(text) - linked
            s[2] += len(PUNCTUATION.findall(text))
        ratio = {p: math.log1p(t / n) * (1 + math.log1p(q / n)) for p, (n, t, q) in sums.items()}
        line = np.array([ratio[b[0]] for b in found])
        near = np.array([self.shared(a[0], b[0]) for a, b in zip(found, found[1:])])
        before, after = SMOOTH[0] * np.concatenate([[0], near]), SMOOTH[2] * np.concatenate([near, [0]])
        smooth = (SMOOTH[1] * line + before * np.concatenate([[0], line[:-1]]) + after * np.concatenate([line[1:], [0]])) / (SMOOTH[1] + before + after)
        fused = np.sqrt(smooth * line)
        total: dict[int, float] = dict.fromkeys(sums, 0.0)
        for b, f in zip(found, fused.tolist()):
            total[b[0]] += f
        return {p: total[p] / n for p, (n, _, _) in sums.items()}

    def container(self, found: list, score: dict[int, float], bar: float) -> list[bool]:
        """Of every path, whether it is in the element that holds the selected text."""
        weight = [0] * len(self.parent)
        best: dict[int, float] = {}
        for path, text, *_ in found:
            if score[path] >= bar:
                weight[path] += len(text)
            best[path] = best.get(path, 0) + len(text) * score[path]
        for inside in (self.article, self.main):
            if any(w for w, i in zip(weight, inside) if i):
                return inside
        for path in range(len(weight) - 1, 0, -1):
            weight[self.parent[path]] += weight[path]
        top = max(best, key=best.get)
        while weight[top] < HOLDS * weight[0]:
            top = self.parent[top]
        inside = [False] * len(weight)
        inside[top] = True
        for path in range(top + 1, len(weight)):  # a path follows its parent
            inside[path] = inside[self.parent[path]]
        return inside


def extract(html: str) -> str:
    """The main text of one page; empty if it has none."""
    page = Page(html)
    found = page.content()
    if not found:
        return ""
    score = page.scores(found)
    best = max(score.values())
    inside = page.container(found, score, SELECT_SHARE * best)
    named = inside is page.article or inside is page.main
    keep = {p: (inside[p] and s >= INSIDE_SHARE * best) or (not named and s >= SELECT_SHARE * best) for p, s in score.items()}
    return " ".join(b[1] for b in found if keep[b[0]])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null or empty html gives empty text; malformed markup is read as far as it goes; repeated
    rows repeat; other columns are not looked at. One page is handled at a time.
    """
    def run(batches):
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))
