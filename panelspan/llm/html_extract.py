"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the text they hold outside links and boilerplate; the best one votes for its path,
the tags and classes from the root with numbers generalised.  Spark counts the votes per host.  Every page is then read
again: its text is what lies in the containers of the host's most voted path that the page has, or of its own best
container where it has none of them.  A container is left for one inside it only if no heading and no block that is mostly
unlinked text stays outside, and the voted containers are widened to the one that holds all such blocks beside them.  Only
the page's frame (html and body) is left for a container with more than ``SHARE`` of its text, unless such blocks lie in it
directly; other containers beside that one in the frame count as the host's furniture.

Boilerplate, by tag, role or class and id words, is never part of a text: menus, headers outside the article, footers,
sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments.  A word or a form alone does not make
boilerplate of a wrapper that holds the page's main or article or most of its unlinked text.  Block elements end a block; white
space inside a block becomes one space; blocks are joined by an empty line.

Defined results: null and empty pages give an empty text; a page without any container gives its whole body; a missing
or odd url counts as a host of its own name; repeated rows are extracted one by one; nothing is cut off; other columns
are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspan.llm import common

PATHS = 8                   # most voted paths of a host that are tried in turn
SHARE = 0.6                 # of an element's text that a child must hold to be the better container; see above for what may stay outside

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav footer aside button select option datalist "
                    "fieldset svg canvas object applet audio video dialog menu map".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                  "hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
CONTAINER = frozenset("article main section div td body center".split())
SCOPE = CONTAINER | {"blockquote"}                          # a paragraph around it is not ended by what is inside
FRAME = frozenset(["", "html", "body"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
#: Class, id and role words of boilerplate.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
NOISE = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline consent "
                  "contentinfo cookie cookies disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
                  "overlay pager pagination popup promo promos promotion related recommended search share sharing sidebar sidebars signup "
                  "social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets complementary alert".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "path", "parent", "first", "last", "chars", "linked", "noise", "words", "closed")

    def __init__(self, tag: str, path: str, parent: int, first: int, noise: bool, words: frozenset[str] | set[str] = frozenset()):
        self.tag, self.path, self.parent, self.first, self.last = tag, path, parent, first, -1
        self.chars, self.linked, self.noise, self.words = 0, 0, noise, words     # words: boilerplate by these, unless it is a wrapper


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


def _is_noise(tag: str, have: dict[str, str], in_article: bool) -> bool:
    """Whether an element is boilerplate whatever it holds."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if "hidden" in have or have.get("aria-hidden") == "true" or "display:none" in have.get("style", "").replace(" ", "").lower():
        return True
    return False


def _noise_words(tag: str, have: dict[str, str], in_article: bool) -> set[str]:
    """What makes an element boilerplate unless it is a wrapper: words of its class, id and role, or being a form."""
    if tag in ("html", "body", "article", "main"):
        return set()
    words = {w.lower() for key in ("class", "id", "role") if key in have for w in _WORD.findall(have[key])}
    if in_article and tag == "header" or tag in ("h1", "h2"):
        words -= {"header", "banner", "masthead"}
    return words & NOISE | ({"form"} if tag == "form" else set())


class Page:
    """Elements of a page in order, and its pieces of text with the element each lies in."""

    def __init__(self, source: str):
        self.elements = [Element("", "", -1, 0, False)]
        self.pieces: list[tuple[int, str, bool]] = []          # element, text, whether a block begins here
        self._parse(source)
        for e in self.elements:
            if e.last < 0:
                e.last = len(self.pieces)
        if any(e.words for e in self.elements):
            self._drop_noise()
        for i, piece, _ in self.pieces:
            self.elements[i].chars += len(piece.strip())
        for i in range(len(self.elements) - 1, 0, -1):
            e = self.elements[i]
            up = self.elements[e.parent]
            if not e.noise:
                up.chars += e.chars
                up.linked += e.chars if e.tag == "a" else e.linked
        self._count_blocks()

    def _drop_noise(self) -> None:
        """Drop what is boilerplate by its words, after clearing the words of wrappers."""
        elements = self.elements
        n = len(elements)
        linked, under, said, text = [False] * n, [False] * n, [False] * n, [0] * n
        for i, e in enumerate(elements[1:], 1):
            linked[i] = linked[e.parent] or e.tag == "a"
            under[i] = under[e.parent] or bool(e.words)
            said[i] = said[e.parent] or not e.words.isdisjoint(COMMENTS)
        for i, piece, _ in self.pieces:
            if not linked[i]:
                text[i] += len(piece.strip())
        clean = sum(x for x, u in zip(text, under) if not u)
        plain = sum(x for x, c in zip(text, said) if not c)
        total, whole = sum(text), list(text)
        for i in range(n - 1, 0, -1):
            whole[elements[i].parent] += whole[i]
        # the page's main, and an article with more text than lies outside all boilerplate, or most of all among comments
        named = [i for i, e in enumerate(elements) if e.tag in ("article", "main") and not e.noise and whole[i]]
        for tag in ("main", "article"):
            same = [i for i in named if elements[i].tag == tag]
            i = max([i for i in same if not said[i]] or same, key=lambda i: (whole[i], -i), default=0)
            if tag == "main" or whole[i] > clean and (not said[i] or 2 * whole[i] > total):
                while i > 0:
                    elements[i].words = frozenset()
                    i = elements[i].parent

        is_comments = lambda i: not elements[i].words.isdisjoint(COMMENTS)

        def wrappers(of: int, comments: bool) -> list[int]:
            """What holds more than half of so much text outside other boilerplate, the innermost first."""
            found, held = [], list(text)
            for i in range(n - 1, 0, -1):
                if elements[i].words and 2 * held[i] > of and (comments or not is_comments(i)):
                    found.append(i)
                elif elements[i].words:
                    continue
                held[elements[i].parent] += held[i]
            return found

        # reader comments are the page only if one of them holds most of it and no article lies outside
        found = wrappers(total, True) if all(said[i] for i in named) else []
        if not any(map(is_comments, found)):
            found = wrappers(plain, False)
        for i in found:
            elements[i].words = frozenset()
        for e in elements[1:]:
            e.noise = e.noise or bool(e.words) or elements[e.parent].noise
        kept, at, begun = [], [0], False
        for i, piece, begins in self.pieces:
            begun |= begins
            if not elements[i].noise:
                kept.append((i, piece, begun))
                begun = False
            at.append(len(kept))
        self.pieces = kept
        for e in elements:
            e.first, e.last = at[e.first], at[e.last]

    def _count_blocks(self) -> None:
        """``texts``: how many pieces before each belong to headings or to blocks that are mostly unlinked text; ``own``: how many of them lie in each container directly."""
        linked, heading = [False], [False]
        for e in self.elements[1:]:
            linked.append(linked[e.parent] or e.tag == "a")
            heading.append(heading[e.parent] or e.tag in HEADING)
        starts = [k for k, (_, _, begins) in enumerate(self.pieces) if begins or k == 0]
        self.texts, self.own = [0], [0] * len(self.elements)
        for a, b in zip(starts, [*starts[1:], len(self.pieces)]):
            block = self.pieces[a:b]
            sizes = [0, 0]
            for i, piece, _ in block:
                sizes[linked[i] and not heading[i]] += len(piece.strip())
            text = sizes[0] > sizes[1] and any(c.isalnum() for i, piece, _ in block if heading[i] or not linked[i] for c in piece)
            for i, _, _ in block:
                self.texts.append(self.texts[-1] + text)
                self.own[i if self._holds(i) else self.container_of(i)] += text

    def _holds(self, i: int) -> bool:
        return self.elements[i].tag in CONTAINER

    def container_of(self, i: int) -> int:
        """The innermost container around an element; 0 is the whole page."""
        up = self.elements[i].parent
        while up > 0 and not self._holds(up):
            up = self.elements[up].parent
        return max(up, 0)

    def beside(self, now: int, chosen: list[int]) -> bool:
        """Whether text of this container would be lost if only the chosen ones inside it were kept."""
        if self.elements[now].tag in FRAME:
            return self.own[now] > 0
        within = lambda i: self.texts[self.elements[i].last] - self.texts[self.elements[i].first]
        return within(now) > sum(map(within, chosen))

    def whole(self, chosen: list[int]) -> list[int]:
        """The chosen containers, or the outermost one that has text beside them."""
        if any(self.elements[i].tag in ("article", "main") for i in chosen):
            return chosen
        last = max(self.elements[i].last for i in chosen)
        now, level = chosen[0], chosen
        while now > 0:
            now = self.container_of(now)
            if self.elements[now].last < last:
                continue                                        # does not hold all of them
            if self.beside(now, level):
                chosen = [now]
            if self.elements[now].tag in ("article", "main"):
                break
            level = [now]
        return chosen

    def _parse(self, source: str) -> None:
        stack, at, begins = [0], 0, True
        articles = forms = 0
        elements, pieces = self.elements, self.pieces

        def text(raw: str) -> None:
            nonlocal begins
            if raw and not elements[stack[-1]].noise:
                now = html.unescape(raw) if "&" in raw else raw
                pieces.append((stack[-1], now, begins))
                begins = False

        def close(depth: int) -> None:
            nonlocal begins, articles, forms
            while len(stack) > depth:
                e = elements[stack.pop()]
                e.last = len(pieces)
                begins |= e.tag in BLOCK
                articles -= e.tag in ("article", "main")
                forms -= e.tag == "form"

        length = len(source)
        while at < length:
            m = _TOKEN.search(source, at)
            if m is None:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at: m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                if m.group().startswith("<![CDATA["):
                    text(m.group()[9:-3])
                continue
            tag = name.lower()
            if m.group(1) or m.group(4):                        # an end tag
                for depth in range(len(stack) - 1, 0, -1):
                    if elements[stack[depth]].tag == tag:
                        close(depth)
                        break
                    if elements[stack[depth]].tag in ("td", "th", "table", "article", "main", "body") and tag not in BLOCK:
                        break
                if tag in BLOCK:
                    begins = True
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in VOID:
                begins |= tag == "hr"
                continue
            if tag in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if elements[stack[depth]].tag == "p":
                        close(depth)
                        break
                    if elements[stack[depth]].tag in SCOPE:
                        break
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag, "td", "th") if tag == "tr" else (tag,)
                for depth in range(len(stack) - 1, 0, -1):
                    if elements[stack[depth]].tag in same:
                        close(depth)
                        if tag != "tr":
                            break
                    elif elements[stack[depth]].tag in ("ul", "ol", "dl", "table", "select"):
                        break
            attributes = m.group(3) or m.group(6) or ""
            if tag == "body" and any(e.tag == "head" for e in (elements[i] for i in stack)):
                close(next(d for d, i in enumerate(stack) if elements[i].tag == "head"))
            up = elements[stack[-1]]
            have = _attributes(attributes) if attributes and not attributes.isspace() else {}
            # a label outside the article is a form's, one without a form is text
            noise = up.noise or _is_noise(tag, have, articles > 0) or tag == "label" and forms > 0 and not articles
            words = _noise_words(tag, have, articles > 0) if not noise and (have or tag == "form") else frozenset()
            path = up.path
            if tag in BLOCK:
                begins = True
                classes = ".".join(sorted(_DIGITS.sub("#", have.get("class", "")).split()))
                path = f"{path}>{tag}.{classes}" if classes else f"{path}>{tag}"
            elements.append(Element(tag, path, stack[-1], len(pieces), noise, words))
            if tag in RAW:                                      # its content is no markup
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                elements[-1].last = len(pieces)
                at = end.end() if end else length
                continue
            if attributes.endswith("/") and tag in ("svg", "path", "use"):
                elements[-1].last = len(pieces)
                continue
            stack.append(len(elements) - 1)
            articles += tag in ("article", "main")
            forms += tag == "form"
        close(0)

    def best(self) -> int:
        """The container that holds the article; 0 is the whole page."""
        score = [e.chars - e.linked for e in self.elements]
        named = [i for i, e in enumerate(self.elements) if e.tag in ("article", "main") and not e.noise and score[i] > 0]
        now = 0
        if named:
            top = max(score[i] for i in named)
            now = min(i for i in named if score[i] == top)
        children: dict[int, list[int]] = {}
        for i, e in enumerate(self.elements):
            if i and e.tag in CONTAINER and not e.noise:
                children.setdefault(self.container_of(i), []).append(i)
        while self.elements[now].tag != "article":              # an article's parts all belong to it
            inner = [i for i in children.get(now, ()) if score[i] > SHARE * score[now] and not self.beside(now, [i])]
            if not inner:
                break
            now = inner[0]
        return now

    def text(self, chosen: list[int]) -> str:
        """Text of these elements, in page order."""
        blocks: list[list[str]] = []
        done = 0
        for i in sorted(chosen, key=lambda i: self.elements[i].first):
            e = self.elements[i]
            first = True
            for _, piece, begins in self.pieces[max(e.first, done): e.last]:
                if begins or first:
                    blocks.append([])
                first = False
                blocks[-1].append(piece)
            done = max(done, e.last)
        return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))

    def at(self, path: str) -> list[int]:
        return [i for i, e in enumerate(self.elements) if e.path == path and e.tag in CONTAINER and not e.noise and e.chars > 0]


def extract(source: str | None, paths: list[str] | None = None) -> str:
    """Main text of one page, by the first of the paths that it has or by its own best container."""
    page = Page(source or "")
    for path in paths or ():
        chosen = page.at(path)
        if chosen:
            return page.text(page.whole(chosen))
    return page.text([page.best()])


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n: how many pages of the host have their best container there."""
    common.ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            hosts, paths = [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source or "")
                best = page.best()
                if page.elements[best].path and page.elements[best].chars:
                    hosts.append(host)
                    paths.append(page.elements[best].path)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    counted = common.staged(votes(rows), "votes")
    best = Window.partitionBy("host").orderBy(F.desc("n"), "path")
    ranked = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PATHS)
    winners = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path")))["path"].alias("paths"))

    def run(batches):
        for batch in batches:
            texts = [extract(source, paths) for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return rows.join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")
