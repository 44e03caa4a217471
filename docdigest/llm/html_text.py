"""Main text of HTML pages by the container path that a host's pages agree on."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdigest.llm.common import cut, lean, small
from docdigest.llm.url_filter import host_of

# Elements by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
DROPPED = frozenset("nav footer aside form button select dialog menu svg object head canvas audio video fieldset".split())
CONTAINERS = frozenset("article main div section td body".split())
MARKED = frozenset("div section ul ol dl table tbody tr td aside nav header footer form center span".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
# Words of a class or an id that mark a container that is not the article, and words that may stand beside them.
NEGATIVE = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead comment comments disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer search".split()
)
BESIDE = frozenset("site page main top bottom left right box block area bar list items links posts articles section container wrapper wrap inner outer unit slot form thread row col global primary secondary sticky".split())
# Classes that mark a paragraph or a piece of one as an advert, and roles of what is not the article.
ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
ROLES = frozenset("navigation banner search alert contentinfo complementary".split())
# Words that an article's own sections are named by, too, and elements of text that may bear one as their only word.
TOPICS = frozenset("alert banner copyright header login menu navigation notice notices promotion recommended recommendations related search share sharing signup social widget".split())
TEXTUAL = frozenset("section table tbody tr td dl ol".split())
#: Characters of a path that are shown at most; paths are compared by digest.
SHOWN = 400

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I) for name in RAW}


def tags(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, in one pass; a closing tag's name starts with a slash, a comment's is empty. Scripts and the like end where their closing tags do.

    A quote after ``=`` hides ``>`` up to the next such quote; one that never ends hides nothing.
    """
    at, last = 0, {q: source.rfind(q) for q in "\"'"}
    while (at := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), at):
            mark = "-->" if source.startswith("<!--", at) else ">"
            end = source.find(mark, at + 2)
            end = len(source) if end < 0 else end + len(mark)
            yield at, end, "", ""
            at = end
        elif not (m := _NAME.match(source, at)):
            at += 1
        else:
            end = m.end()
            while stop := _STOP.search(source, end):
                end = stop.end()
                if stop[0] == ">":
                    break
                if (quote := stop[0][-1]) and end <= last[quote]:
                    end = source.find(quote, end) + 1
            else:
                end = len(source)
            name, closing, attributes = m[1].lower(), source[at + 1] == "/", source[m.end() : end].rstrip(">")
            if name in RAW and not closing:
                close = _RAW_END[name].search(source, end)
                end = close.end() if close else len(source)
            yield at, end, f"/{name}" if closing else name, attributes
            at = end


def _marks(word: str, topic: bool = False) -> bool:
    """Whether a class or an id names what is no article: all its words do, or may stand beside such a word. Where it may name a ``topic``, a single word that can be one does not."""
    parts = set(_WORD.findall(word.lower()))
    return bool(parts & NEGATIVE) and parts <= NEGATIVE | BESIDE and not (topic and len(parts) == 1 and parts <= TOPICS)


class Page:
    """A page's elements and its blocks of text. Elements: parent, tag, path digest; 0 is the page. Blocks: element, text, text inside links."""

    def __init__(self, source: str, dropped: frozenset[str] = DROPPED) -> None:
        self.dropped = dropped
        self.parent, self.tag, self.name, self.key, self.out, self.inside, self.block = [-1], [""], [""], [b""], [False], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        stack, open_, text = [0], {}, []
        owner = linked = in_link = at = 0

        def flush() -> None:
            nonlocal text, linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((owner, joined, linked))
                text, linked = [], 0

        def say(piece: str) -> None:
            nonlocal owner, linked
            if piece and not self.out[stack[-1]]:
                if not text:
                    owner = self.block[stack[-1]]
                piece = entities.unescape(piece)
                text.append(piece)
                linked += len(piece) if in_link else 0

        def close(last: int) -> None:
            nonlocal in_link
            while True:
                x = stack.pop()
                open_[self.tag[x]] -= 1
                in_link -= self.tag[x] == "a"
                if self.tag[x] in BLOCKS or self.tag[x] in DROPPED:
                    flush()
                if x == last:
                    return

        for start, end, name, attributes in tags(source):
            say(source[at:start])
            at = end
            if not name or name in RAW or name[1:] in RAW:
                continue
            if name[0] == "/":
                if open_.get(name[1:]):
                    close(next(x for x in reversed(stack) if self.tag[x] == name[1:]))
                continue
            if name == "br":
                say(" ")
            if name in BLOCKS:
                flush()
                while (x := self.block[stack[-1]]) and (self.tag[x] == "p" or self.tag[x] in ENDS.get(name, ())):
                    close(x)
            if name in VOID or attributes.endswith("/") and name not in BLOCKS:
                continue
            stack.append(self._open(stack[-1], name, attributes))
            open_[name] = open_.get(name, 0) + 1
            in_link += name == "a"
        say(source[at:])
        flush()

    def _open(self, up: int, name: str, attributes: str) -> int:
        found = {}
        if attributes.strip():
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(key.lower(), a or b or c)
        classes = entities.unescape(found.get("class", "")).lower().split()
        inside = self.inside[up] or name in ("article", "main")
        out = self.out[up] or name in self.dropped or "hidden" in found or found.get("role", "").lower() in ROLES or name == "header" and not inside
        if name in MARKED and not out:
            named = found.get("id", "").lower()
            marked = [w for w in classes if _marks(w, self.inside[up] and name in TEXTUAL)] + [named] * _marks(named, self.inside[up])
            own = inside or {"article", "post", "entry"} & {x for w in classes for x in _WORD.findall(w)}
            out = any(not (own and "header" in w) for w in marked)
        elif name in ("p", "a", "figure") and not out:
            out = bool(ADVERT & set(classes))
        x = len(self.tag)
        self.parent.append(up)
        self.tag.append(name)
        self.name.append(name + "".join(f".{w}" for w in sorted({"-".join(_WORD.findall(w)) for w in classes} - {""})))
        self.key.append(xxhash.xxh3_128_digest(self.key[up] + b"/" + self.name[x].encode()))
        self.out.append(out)
        self.inside.append(inside)
        self.block.append(x if name in BLOCKS else self.block[up])
        return x

    def path(self, x: int) -> str:
        """The generalised path, its end if it is long."""
        names, n = [], 0
        while x > 0 and n < SHOWN:
            names.append(self.name[x])
            n += len(names[-1]) + 1
            x = self.parent[x]
        return "/" + "/".join(reversed(names))

    def _weigh(self) -> None:
        """For each element, the text inside it less twice that of links, and its heaviest child. A block that is half links or more, as menus are, weighs nothing."""
        n = len(self.tag)
        self.weight, self.heavy = [0] * n, [0] * n
        for owner, text, linked in self.blocks:
            self.weight[owner] += max(0, len(text) - 2 * linked)
        for x in range(n - 1, 0, -1):
            up = self.parent[x]
            self.weight[up] += self.weight[x]
            if not self.heavy[up] or self.weight[x] >= self.weight[self.heavy[up]]:
                self.heavy[up] = x

    def best(self) -> int:
        """The smallest container that has all of the page's text but blocks of links; nothing inside an article is looked at."""
        self._weigh()
        best = x = 0
        while self.weight[0] and self.tag[x] != "article" and self.weight[self.heavy[x]] == self.weight[0] and (x := self.heavy[x]):
            if self.tag[x] in CONTAINERS and (self.tag[best] != "main" or self.tag[x] == "article"):
                best = x
        return best

    def text(self, key: bytes) -> str | None:
        """The blocks inside elements of that path; None if there are none, or if any text of the page but blocks of links is not in them."""
        inside, weight = [False] * len(self.tag), 0
        for x in range(len(self.tag)):
            own = self.key[x] == key and (self.tag[x] in CONTAINERS or x == 0) and not self.out[x]
            weight += self.weight[x] if own and not (x and inside[self.parent[x]]) else 0
            inside[x] = own or (x > 0 and inside[self.parent[x]])
        if weight < self.weight[0]:
            return None
        return "\n\n".join(t for owner, t, _ in self.blocks if inside[owner]) or None


#: Characters outside of links from which on the text of a form is taken for an article's, on a page that has no other.
FORM_TEXT = 200


def read_page(source: str | None) -> tuple[Page, int]:
    """A page and its smallest container of the text. A page that has all of its text in a form, as some systems make them, is read with it."""
    page = Page(source or "")
    if not page.blocks and source and "<form" in source.lower():
        whole = Page(source, DROPPED - {"form"})
        x = whole.best()
        if whole.weight[0] >= FORM_TEXT:
            return whole, x
    return page, page.best()


@lean
def _votes(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, bytes], list] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page, x = read_page(source.as_py())
            if page.blocks:
                votes.setdefault((host, page.key[x]), [0, page.path(x)])[0] += 1
        columns = [pa.array([h for h, _ in votes], pa.string()), pa.array([k for _, k in votes], pa.binary()), pa.array([v[1] for v in votes.values()], pa.string()), pa.array([v[0] for v in votes.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "key", "path", "votes"])


@lean
def _texts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source, key in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            page, x = read_page(source.as_py())
            out.append((page.text(key) if key is not None else None) or page.text(page.key[x]) or "\n\n".join(t for _, t, _ in page.blocks))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.string())], [*batch.schema.names[2:], "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, key, path, votes)``: the container path with the most votes of each host's pages, of equals the greatest digest.

    A page with text has one vote, for the smallest container that has all its text but blocks of links. Votes are summed in
    tasks before they shuffle.
    """
    votes = pages.select(host_of(F.col("url").cast("string")).alias("host"), "html").mapInArrow(_votes, "host string, key binary, path string, votes long")
    votes = votes.groupBy("host", "key").agg(F.sum("votes").alias("votes"), F.max("path").alias("path"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "key", "path")).alias("v")).select("host", "v.key", "v.path", "v.votes")


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages(page_id, url, html)``.

    The text has the blocks of the host's winning containers, or of the page's own one where the page lacks those or has text
    elsewhere, so that only links stand outside: white space in a block becomes one space, blocks are joined by an empty line. Menus, headers, footers,
    sidebars, notices, adverts, forms (but one that has all of a page's text), scripts, styles and comments are left out. Null html has the empty text; null URLs share one host.
    """
    won = small(cut(host_paths(pages)).select(F.col("host").alias("__host"), F.col("key").alias("__key")), "__host")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url").cast("string")).alias("__h"))
    rows = rows.join(won, F.col("__h") == F.col("__host"), "left").select("html", "__key", "page_id", "url")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)
    return rows.mapInArrow(_texts, f"{schema}, text string").withColumn("n_chars", F.length("text").cast("long"))
