"""Main text of web pages by consensus host paths.

Each page's containers are scored: characters of text outside links and outside menus, adverts, forms, comments and
the like, weighted by what the tag and class say. A page votes for the path of its best container, where a path is the
whole chain of tags with all generalised marks (words of class, id and role; digits dropped, lower case, in order of
the alphabet), held as a digest of fixed length. Votes are summed per host in Spark and each host's winning path is used
to extract all of its pages again; a page without that path uses its own best container.

Tags like nav and footer and hidden elements are always left out. An element whose class, id or role has an unwanted
word is judged after the scan. It stays if it holds main, or an article (not one inside another, nor in comments) with a
share of SMALL of the page's text outside links or more. Otherwise it goes if a mark is nothing but an unwanted word or
names comments; if the word is only part of a mark, as in content-sidebar-wrap, it goes where its own share is under
SMALL. Headings go only for whole marks. Where nothing but links would be left, the page is taken without this rule.

Defined results: null or empty html gives an empty text; a page without container gives all of its text outside the
excluded parts; hosts are compared in lower case, and pages without a host form one host; ties between paths go to
more characters, then to the least digest; repeated pages vote like others; an empty table gives an empty result;
columns other than id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, texts
from kindred.plans.session import cut

#: Winning paths of up to this many hosts, those with most votes, are broadcast (a path is PATH_BYTES as hex digits).
BROADCAST_HOSTS = 100_000
PATH_BYTES = 16
#: An element with an unwanted word in a part of its marks goes below this share of the page's text outside links.
SMALL = 0.25

#: Elements by their role, from the HTML standard.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
EXCLUDED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "fieldset", "svg", "canvas", "object", "dialog", "menu", "audio", "video", "map", "math"}
CONTAINERS = {"body", "article", "main", "section", "div", "td", "center"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of classes, ids and roles that mark what isn't the article.
_WORDS = (
    r"(?:ad|ads|advert|adverts|advertisement|adbox|banner|sponsor|sponsored|promo|promoted|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|rail|widget|widgets|header|masthead|footer|foot|comment|comments|commentlist|disqus|reply|replies|respond|discussion|"
    r"share|sharing|social|related|recommended|toolbar|search|skip|complementary|contentinfo|tags|byline-social)"
)
UNWANTED = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])")
_COMMENTS = r"(?:comment|comments|commentlist|disqus|reply|replies|respond|discussion)"
#: Marks that are an unwanted word, and marks that name comments at their beginning or end but don't say whether there are any.
WHOLE = re.compile(rf"{_WORDS}[_-]*")
ON_COMMENTS = re.compile(rf"{_COMMENTS}[_-]*|{_COMMENTS}[_-](?!(?:enabled|disabled|open|closed|on|off|allowed)$).*|(?!(?:has|no|with|without|show|hide|allow)[_-]).*[_-]{_COMMENTS}[_-]*")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WANTED = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|text|body|page)(?:$|[\s_-])")
WEIGHTS = {"article": 3.0, "main": 2.5, "body": 0.6, "center": 0.8, "td": 0.9}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_DIGITS = re.compile(r"[0-9]+")


def path_of(parent: str, name: str, marks: str) -> str:
    """Digest of the chain that ends in a tag with these marks, below the chain `parent`."""
    # names and marks hold no white space, so different chains are different bytes
    return blake2b(" ".join([parent, name, *sorted(marks.split())]).encode("utf-8", "surrogatepass"), digest_size=PATH_BYTES).hexdigest()


class Page:
    """What one scan of a page finds: pieces of kept text and the containers around them.

    `pieces` holds (text, container number); a container is [path, parent number, characters, link characters,
    weight]. Container 0 stands for the whole page. Doubtful elements, (number of the one around it, whether a mark
    is whole, whether it is on comments), are numbered from 1 and judged when the scan is over.
    """

    def __init__(self, source: str):
        self.containers: list[list] = [["", -1, 0, 0, 0.1]]
        self.doubtful: list[tuple[int, bool, bool]] = [(0, False, False)]
        # articles and main by container number, with the doubtful element around them
        self.bodies: list[tuple[int, int, str]] = []
        found: list[tuple[str, int, int]] = []
        self.counts: dict[tuple[int, int], list[int]] = {}
        # open elements: tag, container number, whether excluded, whether inside a link, path, number of the doubtful element
        stack: list[tuple[str, int, bool, bool, str, int]] = [("", 0, False, False, "", 0)]
        at, n = 0, len(source)
        while at < n:
            tag = _TAG.search(source, at)
            upto = tag.start() if tag else n
            if upto > at:
                self._text(found, source[at:upto], stack[-1])
            if not tag:
                break
            at = tag.end()
            name = (tag[2] or "").lower()
            if not name:
                continue
            if tag[1]:
                self._close(found, stack, name)
                continue
            if name not in INLINE:
                found.append((" ", stack[-1][1], 0))
            if name in CLOSES_P and any(e[0] == "p" for e in stack[-4:]):
                self._close(found, stack, "p")
            for other in CLOSES_ITSELF.get(name, ()):
                if stack[-1][0] == other:
                    stack.pop()
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(source, at)
                at = end.start() if end else n
                continue
            if name in VOID or tag[3].endswith("/"):
                continue
            self._open(stack, name, tag[3])
        gone = self._judge()
        self.pieces = [(text, number) for text, number, doubt in found if not gone[doubt]]
        for (number, doubt), (count, links) in self.counts.items():
            if not gone[doubt]:
                self.containers[number][2] += count
                self.containers[number][3] += links
        self._to_parents(self.containers, 2, 3)

    @staticmethod
    def _to_parents(containers: list[list], *fields: int) -> None:
        for c in reversed(containers):
            if c[1] >= 0:
                for k in fields:
                    containers[c[1]][k] += c[k]

    def _around(self, doubt: int, name: str) -> Iterator[int]:
        """Doubtful elements that a body inside them speaks for: an article does so up to the first one on comments."""
        while doubt and (name == "main" or not self.doubtful[doubt][2]):
            yield doubt
            doubt = self.doubtful[doubt][0]

    def _judge(self) -> list[bool]:
        """Whether each doubtful element goes."""
        gone = [False] * len(self.doubtful)
        if len(gone) == 1:
            return gone
        plain = [["", c[1], 0] for c in self.containers]
        for (number, _), (count, links) in self.counts.items():
            plain[number][2] += count - links
        self._to_parents(plain, 2)
        # elements that hold a body with text, however small it is
        holds = {k for number, doubt, name in self.bodies if plain[number][2] for k in self._around(doubt, name)}
        # shares leave out what goes in any case: whole marks that hold no body
        out, share, text = [False] * len(gone), [0] * len(gone), 0
        for k, (outer, whole, _) in enumerate(self.doubtful):
            out[k] = out[outer] or (whole and k not in holds)
        for (_, doubt), (count, links) in self.counts.items():
            if not out[doubt]:
                share[doubt] += count - links
                text += count - links
        for k in range(len(gone) - 1, 0, -1):
            share[self.doubtful[k][0]] += share[k]
        stays = {k for number, doubt, name in self.bodies if plain[number][2] and (name == "main" or plain[number][2] >= SMALL * text) for k in self._around(doubt, name)}
        for k in range(1, len(gone)):
            outer, whole, _ = self.doubtful[k]
            gone[k] = gone[outer] or not (k in stays or (not whole and share[k] and share[k] >= SMALL * text))
        if not any(count > links for (_, doubt), (count, links) in self.counts.items() if not gone[doubt]):
            return [False] * len(gone)
        return gone

    def _open(self, stack: list, name: str, attributes: str) -> None:
        _, number, excluded, linked, path, doubt = stack[-1]
        marks, hidden, unwanted = "", False, False
        if attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            marks = _DIGITS.sub("", " ".join(found.get(k, "") for k in ("class", "id", "role")).lower())
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        if name in EXCLUDED or hidden:
            excluded = True
        if marks.strip() and not excluded:
            unwanted = bool(UNWANTED.search(marks))
            if unwanted and name not in ("html", "body", "article", "main"):
                comments = any(ON_COMMENTS.fullmatch(m) for m in marks.split())
                whole = comments or any(WHOLE.fullmatch(m) for m in marks.split())
                if whole or name not in HEADINGS:
                    self.doubtful.append((doubt, whole, comments))
                    doubt = len(self.doubtful) - 1
        if name not in INLINE:
            path = path_of(path, name, marks)
        if name in CONTAINERS and not excluded:
            weight = WEIGHTS.get(name, 1.0)
            if name not in WEIGHTS and (WANTED.search(marks) or "main" in marks):
                weight = 2.0
            self.containers.append([path, number, 0, 0, weight])
            number = len(self.containers) - 1
            if name == "main" or (name == "article" and not unwanted and not any(e[0] == "article" for e in stack)):
                self.bodies.append((number, doubt, name))
        stack.append((name, number, excluded, linked or name == "a", path, doubt))

    def _close(self, found: list, stack: list, name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                if any(e[0] not in INLINE for e in stack[k:]):
                    found.append((" ", stack[k][1], 0))
                del stack[k:]
                return
            if stack[k][0] in CONTAINERS and name in INLINE | {"p"}:
                return

    def _text(self, found: list, text: str, inside: tuple) -> None:
        _, number, excluded, linked, _, doubt = inside
        if excluded:
            return
        if "&" in text:
            text = entities.unescape(text)
        found.append((text, number, doubt))
        count = len(text) - text.count(" ")
        counts = self.counts.setdefault((number, doubt), [0, 0])
        counts[0] += count
        counts[1] += count * linked

    def best(self) -> tuple[str, float]:
        """Path and score of the best container; ties go to the outer one, which comes first."""
        top = max(self.containers, key=lambda c: (c[2] - c[3]) * c[4])
        return top[0], (top[2] - top[3]) * top[4]

    def text(self, path: str) -> str:
        """Kept text of the containers with this path; of the best container if the page has none with it."""
        if not any(c[0] == path and c[2] for c in self.containers):
            path = self.best()[0]
        inside = []
        for c in self.containers:
            inside.append(c[0] == path or (c[1] >= 0 and inside[c[1]]))
        return " ".join("".join([t for t, c in self.pieces if inside[c]]).split())


def host_of(url):
    """Host of a URL in lower case, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, pages: the path with most votes among the pages (page_id, host, html) of each host, and how many voted."""

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        best = [Page(x).best() if x else ("", 0.0) for x in texts(batch.column("html"))]
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], ["host", "path", "score"])

    votes = map_batches(pages.select("host", "html"), "host string, path string, score double", vote).where("score > 0")
    summed = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.floor("score")).alias("chars"))
    # least path last: negated order isn't there for text, so the winner is the minimum of negated counts
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("chars"), "path")).alias("path"), F.sum("votes").alias("pages"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, path of each page."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    paths = cut(host_paths(rows))
    schema = "page_id long, url string, text string, path string"

    def result(batch: pa.RecordBatch, chosen: list[str]) -> pa.RecordBatch:
        out = [Page(x).text(p) if x else "" for x, p in zip(texts(batch.column("html")), chosen, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(chosen, pa.string())], ["page_id", "url", "text", "path"])

    # the hosts with most pages, never more than the bound: only pages of the others are shuffled, to hosts that are small
    top = paths.orderBy(F.desc("pages"), "host").limit(broadcast_hosts)
    held = pages.sparkSession.sparkContext.broadcast({r.host: r.path for r in top.toLocalIterator()})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch, [held.value.get(h, "") for h in batch.column("host").to_pylist()])

    if paths.count() <= broadcast_hosts:
        return rows.mapInArrow(local, schema)
    known = cut(top.select("host"))
    most = rows.join(F.broadcast(known), "host", "left_semi").select("page_id", "url", "html", "host").mapInArrow(local, schema)
    others = rows.join(F.broadcast(known), "host", "left_anti").join(paths.select("host", "path"), "host", "left")
    return most.unionByName(map_batches(others.select("page_id", "url", "html", F.coalesce("path", F.lit("")).alias("path")), schema, lambda b: result(b, b.column("path").to_pylist())))
