"""The main text of web pages, by paths that the pages of a host agree on.

Each page is read into block elements and the runs of text between their borders. A page's containers are
scored by the text below them: links count against it, and what a container calls itself (tag, class, id, role) for or against
it. The page votes for the path of its best container, and says of each container below whether it looks like a list of links.
A path is the chain of tags with their classes, generalised: numbers of three digits and more in class names are left out, as are ids and places.
Spark sums the votes by host and path. In a second pass each page takes its text from the host's path with the
most votes that it has, and leaves out what most pages of the host hold for links at that path; where it has none of the host's paths, its own best
container stands in. So a page with a long comment thread or a short article is read as its neighbours are.

Left out are scripts, styles and other elements that show no text, navigation, footers, asides, forms, page headers (of a header
within the article headings stay), and containers that call themselves menus, sidebars, notices, adverts or comments,
or that a heading such as "Comments" opens. All else below the chosen container stays, in page order: a block is the text
between two borders of block elements, with character references decoded and white space made one blank; a line break is white space.

Scale: votes are summed in the tasks before they are shuffled, so a host with a third of all pages is no hot key. A host
keeps the paths that a tenth of its pages have (so at most ten, and for links ten times those of a page), in a table that is joined by host:
Spark sends it to the tasks where its files are small and deals the pages by host, with skewed ones split, where
they aren't. Pages are parsed twice, and no page is shuffled in the first case.

Defined cases: null and empty html have no text; a null url, or one without `://`, has an empty host, whose pages vote
together; repeated rows vote and are extracted each; broken markup is read as it comes (open elements end with those around
them, an unclosed comment or script runs to the end); html of any length and depth is read whole, in time in line with its length; an empty
table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, staged
from .url_filter import split_url

#: The part of a host's pages that must have a path, for it to count for the host.
SUPPORT = 0.1
#: Paths whose votes a task holds before it hands them on.
HELD = 100_000
ROWS, BYTES = 256, 4 << 20

# Elements of HTML by how they show.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style xmp iframe noembed noframes textarea title template noscript svg canvas audio video object select button datalist head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that end when another of the first kind begins, unless one of the last kind is nearer.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}

CONTAINERS = frozenset("article body center div main section td".split())
LISTS = CONTAINERS | frozenset("ul ol dl table p".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
#: What containers that aren't the article call themselves, in class, id or role.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion teaser teasers banner nav navbar navi navigation menu menus menubar breadcrumb breadcrumbs crumbs sidebar "
    "sidebars side sidenav aside rail footer foot foots colophon contentinfo complementary comment comments commentlist commenting disqus reply replies respond response responses discussion share shares sharing social related "
    "recommended recommendations newsletter subscribe subscription signup signin login register cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox widget widgets tagcloud pagination pager "
    "paging toolbar search searchbox skip copyright legal disclaimer form feedback".split()
)
HEADERS = frozenset("header head masthead topbar".split())
GOOD = frozenset("article articlebody body content entry main post story text".split())
_COMMENTS = re.compile(r"\s*(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|replies|responses|discussion|leave a (?:comment|reply)|kommentare?|leserkommentare|commentaires?|comentarios?|réactions)\b[\s:(\d)]*$", re.I)

# a quote stands for one after an equals sign only; a tag whose quotes never close ends at the next angle bracket
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_LOOSE = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|(?!)(.)(.)(.)|<[!?/][^>]*+>""", re.S)
_OPEN = re.compile(r"<[A-Za-z/!?]")
_ATTRS = re.compile(r"""(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


@dataclass(slots=True)
class Kind:
    """What a start tag says of its element, by itself: its name in paths; whether it is no article, a header, an article."""

    name: str
    noise: bool
    header: bool
    good: float


def kind_of(tag: str, attrs: str) -> Kind:
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRS.finditer(attrs)} if "=" in attrs else {}
    classes = [c for c in given.get("class", "").split() if not re.match(r"(?:has|with|no|is)[-_]", c, re.I)]
    said = {p.lower() for c in [*classes, given.get("id", ""), given.get("role", ""), given.get("itemprop", "")] for p in _PARTS.findall(c)}
    names = sorted({re.sub(r"\d{3,}", "", c) for c in classes} - {""})
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs, re.I)) or given.get("aria-hidden", "").lower() == "true" or bool(_HIDES.search(given.get("style", "")))
    top = tag in ("html", "body", "main")
    header = not top and (tag == "header" or bool(said & HEADERS))
    noise = hidden or (not top and (tag in FURNITURE or bool(said & NOISE)))
    good = {"article": 1.3, "main": 1.2, "body": 0.6, "html": 0.5, "": 0.5}.get(tag, 1.0) * (1.2 if not top and said & GOOD else 1.0)
    return Kind(".".join([tag, *names]), noise, header, good)


@dataclass(slots=True)
class Page:
    """Block elements in page order, each after the one around it, and runs of text with the element they stand in."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    kind: list[Kind] = field(default_factory=lambda: [Kind("", False, False, 0.5)])
    path: list[int] = field(default_factory=lambda: [0])
    #: Whether what is below is left out.
    noise: list[bool] = field(default_factory=lambda: [False])
    text: list[str] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)  # number and letters


class Reader:
    """Parses pages; remembers what start tags and paths stand for, up to a bound."""

    KNOWN = 50_000

    def __init__(self) -> None:
        self._kinds: dict[tuple[str, str], Kind] = {}
        self._paths: dict[tuple[int, str], int] = {}

    def _kind(self, tag: str, attrs: str) -> Kind:
        got = self._kinds.get((tag, attrs))
        if got is None:
            if len(self._kinds) >= self.KNOWN:
                self._kinds.clear()
            got = kind_of(tag, attrs)
            if len(attrs) < 200:
                self._kinds[tag, attrs] = got
        return got

    def _path(self, above: int, name: str) -> int:
        got = self._paths.get((above, name))
        if got is None:
            if len(self._paths) >= self.KNOWN:
                self._paths.clear()
            got = self._paths[above, name] = int.from_bytes(hashlib.blake2b(f"{above}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        return got

    def read(self, html: str) -> Page:
        page = Page()
        stack, depth, run = [0], {"": 1}, []
        anchors, letters, in_link, hidden = 0, 0, 0, []  # hidden: open elements that show no text

        def flush() -> None:
            nonlocal run, anchors, letters
            if run:
                text = " ".join("".join(run).split())
                if text:
                    page.text.append(text)
                    page.of.append(stack[-1])
                    page.links.append((anchors, letters))
                run, anchors, letters = [], 0, 0

        def say(raw: str) -> None:
            nonlocal letters
            if raw and not hidden:
                run.append(unescape(raw) if "&" in raw else raw)
                if in_link:
                    letters += len(raw)

        def shut(number: int) -> None:
            """Ends open elements until so many are left."""
            nonlocal in_link
            flush()
            while len(stack) > number:
                depth[page.tag[stack.pop()]] -= 1
            in_link = 0

        def end(tags: set[str], stop: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                t = page.tag[stack[k]]
                if t in tags:
                    shut(k)
                elif t in stop or t in CONTAINERS and not tags & {"tr", "td"}:
                    return

        at, last, token = 0, html.rfind(">"), _TOKEN
        while at <= last and (m := token.search(html, at)):
            say(html[at : m.start()])
            at = m.end()
            if m[5]:  # quotes are broken from here on: they aren't followed again, so that time stays in line with length
                token = _LOOSE
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = (m[1] or m[4]) == "/"
            if hidden:  # only its own end, or another of its kind, counts
                if tag == hidden[-1]:
                    hidden.pop() if closing else hidden.append(tag)
                continue
            if closing:
                if tag == "a":
                    in_link = 0
                elif tag in BLOCKS:
                    if depth.get(tag):
                        k = len(stack) - 1
                        while page.tag[stack[k]] != tag:
                            k -= 1
                        shut(k)
                    else:
                        flush()
                continue
            if tag in RAW:
                stop = _RAW_END[tag].search(html, at)
                at = stop.end() if stop else len(html)
                continue
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link, anchors = 1, anchors + 1
            elif tag in HIDDEN and tag not in BLOCKS:
                if not (m[3] or m[6] or "").endswith("/"):
                    hidden.append(tag)
            elif tag in BLOCKS:
                if depth.get("p"):
                    for k in range(len(stack) - 1, 0, -1):
                        if page.tag[stack[k]] == "p":
                            shut(k)
                        elif page.tag[stack[k]] in CONTAINERS:
                            break
                if tag in ENDS:
                    end(*ENDS[tag])
                flush()
                if tag in VOID:
                    continue
                above = stack[-1]
                kind = self._kind(tag, m[3] or m[6] or "")
                page.parent.append(above)
                page.tag.append(tag)
                page.kind.append(kind)
                page.path.append(self._path(page.path[above], kind.name))
                page.noise.append(page.noise[above] or kind.noise or tag == "head")
                depth[tag] = depth.get(tag, 0) + 1
                stack.append(len(page.tag) - 1)
        cut = _OPEN.search(html, at)  # a tag or comment that never ends
        say(html[at : cut.start()] if cut else html[at:])
        flush()
        _judge(page)
        return page


def _judge(page: Page) -> None:
    """Leaves out what a heading shows to be comments, and headers but for headings within an article."""
    n = len(page.tag)
    opened = [False] * n  # whether a run of text was met below
    comments = [False] * n
    for text, e in zip(page.text, page.of, strict=True):
        title, x, seen = page.tag[e] in HEADINGS and len(text) < 60 and _COMMENTS.match(text), e, False
        while x > 0 and not opened[x]:
            opened[x] = True
            if title and page.tag[x] in ("div", "section", "article"):
                seen = comments[x] = True
            x = page.parent[x]
        if seen:
            opened[x] = True
    inside, header = [False] * n, [False] * n  # an article around it, a header around it
    for e in range(1, n):
        up = page.parent[e]
        inside[e] = inside[up] or page.tag[up] in ("article", "main") or page.kind[up].good > 1
        header[e] = header[up] or page.kind[e].header
        lost = header[e] and not (inside[e] and page.tag[e] in HEADINGS) and not page.noise[up]
        page.noise[e] = page.noise[e] or page.noise[up] or comments[e]
        if lost and page.tag[e] in HEADINGS | {"p", "li"} or header[e] and not inside[e]:
            page.noise[e] = True


def weigh(page: Page) -> tuple[list[float], list[bool]]:
    """Each element's score as a container, and whether it looks like a list of links."""
    n = len(page.tag)
    good, bad, count, letters, size = [0.0] * n, [0.0] * n, [0] * n, [0] * n, [0] * n
    for text, e, (anchors, linked) in zip(page.text, page.of, page.links, strict=True):
        if page.noise[e]:
            continue
        part = min(1.0, linked / len(text))
        good[e] += len(text) * (1 - part) if part < 0.5 else 0
        bad[e] += len(text) * part
        count[e], letters[e], size[e] = count[e] + anchors, letters[e] + linked, size[e] + len(text)
    for e in range(n - 1, 0, -1):
        for x in (good, bad, count, letters, size):
            x[page.parent[e]] += x[e]
    scores = [(g - b / 2) * k.good if t in CONTAINERS or not t else 0.0 for g, b, k, t in zip(good, bad, page.kind, page.tag, strict=True)]
    links = [t in LISTS and c >= 3 and 5 * a > 4 * s and s < 40 * c for t, c, a, s in zip(page.tag, count, letters, size, strict=True)]
    return scores, links


def best_container(page: Page, scores: list[float]) -> int:
    """The element with the highest score, or one around it that has the heading and little else."""
    best = max(range(len(scores)), key=lambda e: (scores[e] if not page.noise[e] else -1.0, e))
    titles = [e for e, t in enumerate(page.tag) if t == "h1" and not page.noise[e]]
    if not titles:
        return best
    around = set()  # of the first heading
    e = titles[0]
    while e >= 0:
        around.add(e)
        e = page.parent[e]
    up = best
    while up > 0 and up not in around:
        up = page.parent[up]
    raw = lambda x: scores[x] / page.kind[x].good
    if up != best and up > 0 and page.tag[up] not in ("body", "html") and page.tag[up] in CONTAINERS and raw(up) <= 1.2 * raw(best):
        return up
    return best


def path_text(page: Page, e: int) -> str:
    names = []
    while e > 0:
        names.append(page.kind[e].name)
        e = page.parent[e]
    return "/".join(reversed(names))


def text_below(page: Page, chosen: list[int], links: set[int], own: list[bool], known: set[int]) -> str:
    """Text of the chosen elements without what is left out: by itself, or because the host's pages hold its path for
    links; of paths that the host doesn't know the page's own view counts."""
    n = len(page.tag)
    inside, out = [False] * n, [False] * n
    top = set(chosen)
    for e in range(n):
        up = page.parent[e]
        inside[e] = e in top or (up >= 0 and inside[up])
        is_links = page.path[e] in links or (own[e] and page.path[e] not in known)
        out[e] = page.noise[e] or (up >= 0 and out[up] and e not in top) or (is_links and inside[e] and e not in top)
    return "\n".join(t for t, e in zip(page.text, page.of, strict=True) if inside[e] and not out[e])


def matching(page: Page, path: int, scores: list[float]) -> list[int]:
    """The elements at a path that aren't left out: all, if they are articles, else the best."""
    found = [e for e, p in enumerate(page.path) if p == path and not page.noise[e]]
    if len(found) > 1 and page.tag[found[0]] != "article":
        return [max(found, key=lambda e: (scores[e], -e))]
    return found


def extract(reader: Reader, html: str | None, paths: list[int], links: list[int], known: list[int]) -> str:
    """A page's text by its host's paths, best first."""
    if not html:
        return ""
    page = reader.read(html)
    scores, own = weigh(page)
    for p in paths:
        if found := matching(page, p, scores):
            if text := text_below(page, found, set(links), own, set(known)):
                return text
    return text_below(page, [best_container(page, scores)], set(links), own, set(known))


def host_votes(pages: DataFrame, *, html_col: str = "html", url_col: str = "url", held: int = HELD) -> DataFrame:
    """host, path, path_text, votes (pages whose best container it is), seen (pages that have it) and links (of these, those
    that hold it for a list of links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, votes = Reader(), {}

        def take() -> pa.RecordBatch:
            keys, rows = list(votes), list(votes.values())
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([r[3] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], ["host", "path", "path_text", "votes", "seen", "links"])
            votes.clear()
            return out

        for b in sliced(batches, ROWS, BYTES):
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not html:
                    continue
                host, page = split_url(url)[0], reader.read(html)
                scores, links = weigh(page)
                best = best_container(page, scores)
                seen = {p: False for e, p in enumerate(page.path) if page.tag[e] in LISTS and not page.noise[e]}
                for e, p in enumerate(page.path):
                    if links[e] and p in seen:
                        seen[p] = True
                for p, is_links in seen.items():
                    row = votes.setdefault((host, p), [0, 0, 0, None])
                    row[1] += 1
                    row[2] += is_links
                row = votes.setdefault((host, page.path[best]), [0, 0, 0, None])
                row[0] += 1
                row[3] = row[3] or path_text(page, best)
            if len(votes) >= held:
                yield take()
        if votes:
            yield take()

    votes = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "host string, path long, path_text string, votes long, seen long, links long")
    return votes.groupBy("host", "path").agg(F.max("path_text").alias("path_text"), *[F.sum(c).alias(c) for c in ("votes", "seen", "links")])


def host_paths(votes: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, paths (most votes first), links and known: the host's paths that at least `support` of its pages vote for,
    hold for links for the most part, or have."""
    pages = votes.groupBy(F.col("host").alias("_host")).agg(F.sum("votes").alias("_pages"))
    v = votes.join(pages, F.col("host") == F.col("_host")).drop("_host").where((F.col("votes") >= support * F.col("_pages")) | (F.col("seen") >= support * F.col("_pages")))
    main = F.when((F.col("votes") > 0) & (F.col("votes") >= support * F.col("_pages")), F.struct(-F.col("votes"), "path"))
    return v.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(main)), lambda x: x["path"]).alias("paths"), F.collect_list(F.when(2 * F.col("links") > F.col("seen"), F.col("path"))).alias("links"), F.collect_list(F.when(F.col("seen") >= support * F.col("_pages"), F.col("path"))).alias("known"))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", support: float = SUPPORT) -> DataFrame:
    """id, url, text and n_chars of each page, under the names id_col and url_col."""
    votes = staged(host_votes(pages, html_col=html_col, url_col=url_col), "html-votes")
    hosts = staged(host_paths(votes, support), "html-hosts").withColumnRenamed("host", "_known_host")
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    mine = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).cast("string").alias("_html"), host.alias("_host"))
    joined = mine.join(hosts, F.col("_host") == F.col("_known_host"), "left").select(id_col, url_col, "paths", "links", "known", "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in sliced(batches, ROWS, BYTES):
            paths, links, known, html = (b.column(i).to_pylist() for i in range(2, 6))
            text = [extract(reader, h, p or [], x or [], k or []) for h, p, x, k in zip(html, paths, links, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [id_col, url_col, "text", "n_chars"])

    schema = joined.select(id_col, url_col, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return joined.mapInArrow(run, schema)
