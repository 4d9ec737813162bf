"""Main text of web pages by consensus host paths (operator 9)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, rebatched, small_batches

_WS = " \t\n\f\r"
_PLAIN_TAG = re.compile(rf"<(/?)([a-zA-Z][^{_WS}/>]*+)[{_WS}]*+/?>")
_TAG_NAME = re.compile(rf"</?([a-zA-Z][^{_WS}/>]*+)")
_ATTR = re.compile(rf"[{_WS}/]*+(?:(>)|(=?[^{_WS}/>=]*+)[{_WS}]*+(?:(=)[{_WS}]*+)?)")
_UNQUOTED = re.compile(rf"[^{_WS}>]*+")
#: Elements whose content is not markup, or is not shown; they end at their own end tag alone.
_RAW = {t: re.compile(rf"</{t}(?=[{_WS}/>])", re.I) for t in "script style textarea title noscript template iframe xmp noembed noframes".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
_CONTAINER = frozenset("article main section div td body blockquote".split())
#: Elements that end an open one of the kinds named, which may be left open; and what keeps an open one out of reach.
_ENDS = {t: ("p",) for t in _BLOCK - {"br", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body"}}
_ENDS |= {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS |= {t: ("tr", "tbody", "thead", "tfoot") for t in ("tbody", "thead", "tfoot")}
_CELLS = frozenset("tr td th tbody thead tfoot".split())
_OPEN_ENDED = _CELLS | {"p", "li", "dt", "dd", "option"}
_STOPS_ITEMS = _BLOCK - {"address", "div", "p", "li", "dt", "dd", "br", "hr"}
_STOPS_P = frozenset("table td th caption object button".split())
#: Elements and roles that are not the article.
_DROP_TAGS = frozenset("nav footer aside form button select option input label svg canvas object embed head audio video map dialog menu fieldset script style".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Containers whose class or id may say that they are not the article. Words that say so wherever they stand
#: in a name, words that say so alone or beside others that do, and words that say nothing.
_NAMED = frozenset("div section ul ol dl table td aside article figure details blockquote center".split())
_SURE_WORDS = frozenset(
    "advert adverts advertisement advertisements advertising adbox breadcrumb breadcrumbs consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter overlay pager pagination popup promo promotion respond sidebar sponsor sponsored subscribe "
    "subscription toolbar topbar".split()
)
_WEAK_WORDS = frozenset(
    "ad ads alert aside banner copyright disclaimer discussion header hidden legal login more notice notices notification recommendations recommended "
    "related replies reply search share sharing signup skip social widget".split()
)
_NEUTRAL_WORDS = frozenset("area bar bottom box block container inner items left links list outer page posts right row section site top wrap wrapper".split())
_HOLDS_PAGE = frozenset("content main article post entry page story has with layout no".split())
_COMMENTS = frozenset("comment comments commentlist".split())
_WORD = re.compile(r"[A-Za-z]+")
_NUMBERS = re.compile(r"\d+")
_GOOD = re.compile(r"article|content|post|entry|story|main|body|text", re.I)
_HEADINGS = ("h1", "h2", "h3")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user and port; empty where there is none."""
    named = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(F.trim(named)), r"[\[\]]", "")


def attributes(page: str, at: int) -> tuple[int, dict[str, str]]:
    """The attributes from ``at`` on and the place behind the tag; the page's end if the tag does not end.

    As browsers read them: a quote only counts at the start of a value, and a value that is not quoted
    goes up to white space or the tag's end. Each character is passed once.
    """
    named: dict[str, str] = {}
    size = len(page)
    while True:
        m = _ATTR.match(page, at)
        at = m.end()
        if m[1]:
            return at, named
        if at >= size:
            return size + 1, named
        value = ""
        if m[3]:
            quote = page[at]
            if quote in "\"'":
                end = page.find(quote, at + 1)
                if end < 0:
                    return size + 1, named
                value, at = page[at + 1 : end], end + 1
            else:
                end = _UNQUOTED.match(page, at).end()
                value, at = page[at:end], end
        named.setdefault(m[2].lower(), value)


def _not_article(names: list[str]) -> bool:
    """Whether classes and ids name something beside the article.

    A name says so by a sure word, or by weak words and such as say nothing. A container that is also
    called the content, or a name that says so beside such a word, stays; comments always go.
    """
    said = False
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        if not _COMMENTS.isdisjoint(words):
            return True
        holds = not _HOLDS_PAGE.isdisjoint(words)
        if holds and _HOLDS_PAGE.issuperset(words):
            said = None
        if said is False and not holds:
            sure = not _SURE_WORDS.isdisjoint(words)
            said = sure or (not _WEAK_WORDS.isdisjoint(words) and all(w in _WEAK_WORDS or w in _NEUTRAL_WORDS for w in words))
    return bool(said)


def _describe(tag: str, named: dict[str, str]) -> tuple[str, bool]:
    """The element's step in a path (numbers generalised), and whether it is not part of an article."""
    if not named:
        return tag, tag in _DROP_TAGS
    classes = html.unescape(named.get("class", "")).split()
    step = ".".join([tag, *sorted({_NUMBERS.sub("#", c) for c in classes})])
    drop = (
        tag in _DROP_TAGS
        or named.get("role", "").strip().lower() in _DROP_ROLES
        or "hidden" in named
        or named.get("aria-hidden", "").lower() == "true"
        or "display:none" in named.get("style", "").replace(" ", "").lower()
        or (tag in _NAMED and _not_article([*classes, named.get("id", "")]))
    )
    return step, drop


class Paths:
    """Paths of open block elements as numbers: 0 is the page, and a path's number is above its parent's."""

    def __init__(self):
        self.parent, self.step, self._known = [-1], [""], {}

    def below(self, parent: int, step: str) -> int:
        n = self._known.setdefault((parent, step), len(self.step))
        if n == len(self.step):
            self.parent.append(parent)
            self.step.append(step)
        return n

    def text(self, n: int) -> str:
        steps = []
        while n:
            steps.append(self.step[n])
            n = self.parent[n]
        return " > ".join(reversed(steps))


def blocks_of(page: str, paths: Paths) -> Iterator[tuple[int, str, float]]:
    """(path, text, share of it in links) of each block of a page in order.

    Blocks of menus, adverts and the like are left out. Of a header only headings inside an article
    stay. What holds for an element is worked out when it opens, so the time grows with the page alone.
    """
    # tag, path, dropped here or above, inside a header, inside a heading, inside a link, places of open-ended elements
    stack: list[tuple] = [("", 0, False, False, False, False, {})]
    count: dict[str, int] = {}
    article = 0
    parts: list[str] = []
    linked = 0

    def close(upto: int) -> None:
        nonlocal article
        for e in stack[upto:]:
            count[e[0]] -= 1
            article -= e[0] in ("article", "main")
        del stack[upto:]

    at, size = 0, len(page)
    while at <= size:
        start = page.find("<", at)
        top = stack[-1]
        if start != at:
            piece = page[at : size if start < 0 else start]
            if piece and not top[2] and (top[4] or not top[3]):
                if "&" in piece:
                    piece = html.unescape(piece)
                parts.append(piece)
                if top[5]:
                    linked += len(piece)
        if start < 0:
            break
        m = _PLAIN_TAG.match(page, start)
        named: dict[str, str] = {}
        if m:
            end, tag, at = m[1], m[2].lower(), m.end()
        elif m := _TAG_NAME.match(page, start):
            end, tag = page[start + 1] == "/", m[1].lower()
            at, named = attributes(page, m.end())
            if at > size:
                break  # a tag without an end swallows the rest
        elif page.startswith("<!--", start):
            close_at = start + 4 if page.startswith((">", "->"), start + 4) else page.find("-->", start + 4)
            at = size + 1 if close_at < 0 else page.index(">", close_at) + 1
            continue
        elif page.startswith(("<!", "<?", "</"), start):
            close_at = page.find(">", start)
            at = size + 1 if close_at < 0 else close_at + 1
            continue
        else:  # not markup
            if not top[2] and (top[4] or not top[3]):
                parts.append("<")
            at = start + 1
            continue
        block = tag in _BLOCK
        if block and parts:
            text = " ".join("".join(parts).split())
            if text:
                yield top[1], text, min(1.0, linked / len(text))
            parts.clear()
            linked = 0
        if end:
            if count.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in _ENDS:
            near = top[6]
            open_ = [near[t] for t in _ENDS[tag] if t in near]
            if open_:
                close(min(open_))
        if tag in _RAW:
            ended = _RAW[tag].search(page, at)
            at = size + 1 if not ended else attributes(page, ended.end())[0]
            continue
        if tag in _VOID:
            continue
        above = stack[-1]
        step, drop = _describe(tag, named)
        header = above[3]
        if tag == "header":
            header, drop = True, drop or not article
        near = above[6]
        if tag in _OPEN_ENDED or (near and (tag in _STOPS_ITEMS or tag in _STOPS_P)):
            if tag == "table":
                near = {}
            elif tag in _STOPS_ITEMS or tag in _STOPS_P:
                gone = {"li", "dt", "dd"} | ({"p", "option"} if tag in _STOPS_P else set())
                near = {k: v for k, v in near.items() if k not in gone}
            if tag in _OPEN_ENDED:
                near = near | {tag: len(stack)}
        path = paths.below(above[1], step) if block else above[1]
        stack.append((tag, path, above[2] or drop, header, above[4] or tag in _HEADINGS, above[5] or tag == "a", near))
        count[tag] = count.get(tag, 0) + 1
        article += tag in ("article", "main")
    text = " ".join("".join(parts).split())
    if text:
        yield stack[-1][1], text, min(1.0, linked / len(text))


def containers(page: str) -> tuple[Paths, list[float]]:
    """The page's paths and each one's score, -1 if it is no container: text outside links, more for tags and classes of articles."""
    paths = Paths()
    chars: dict[int, float] = {}
    for path, text, share in blocks_of(page, paths):
        chars[path] = chars.get(path, 0.0) + len(text) * (1 - share)
    score, depth = [chars.get(n, 0.0) for n in range(len(paths.step))], [0] * len(paths.step)
    for n in range(len(score) - 1, 0, -1):
        score[paths.parent[n]] += score[n]
    for n, step in enumerate(paths.step):
        if n:
            depth[n] = depth[paths.parent[n]] + 1
        tag, _, classes = step.partition(".")
        if n and tag not in _CONTAINER:
            score[n] = -1.0
            continue
        bonus = {"article": 2.5, "main": 1.6, "body": 0.5, "": 0.5}.get(tag, 1.0) * (1.3 if _GOOD.search(classes) else 1.0)
        score[n] *= bonus * (1 + 0.05 * min(depth[n], 10))
    return paths, score


def best_path(page: str) -> str:
    """The path of the page's best container (of equal ones the first to open); "" is the whole page."""
    paths, score = containers(page)
    return paths.text(max(range(len(score)), key=lambda n: (score[n], -n)))


def extract(page: str, path: str) -> str | None:
    """The blocks inside the elements of a path joined by newlines; None if the page has no such block."""
    want, paths, lines = path.split(" > ") if path else [], Paths(), []
    agrees = [0]  # the steps of each path that agree with the wanted ones, or -1
    for n, text, _ in blocks_of(page, paths):
        for m in range(len(agrees), len(paths.step)):
            k = agrees[paths.parent[m]]
            agrees.append(k if k in (-1, len(want)) else k + 1 if paths.step[m] == want[k] else -1)
        if agrees[n] == len(want):
            lines.append(text)
    return "\n".join(lines) if lines else None


def vote(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path): of each host the path that most of its pages name; of equal ones the first in order."""

    def run(batches):
        for batch in rebatched(batches):
            paths = [best_path(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = pages.select(host_of(F.col(url).cast("string")).alias("host"), F.col(page).cast("string").alias("html")).mapInArrow(run, "host string, path string")
    counts = votes.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    return counts.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path"))["path"].alias("path"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    Each page is read along its host's winning path, or where it has no such element along its own
    best one. A null, empty or boilerplate-only page gives the empty text; pages without a host vote
    together; of paths with equal votes the first in order wins; repeated rows each vote and each get a
    row; an empty table gives no rows. Pages of any length and depth are read whole, in time in
    proportion to their length. Extra columns are not read, whatever they are called.
    """
    small_batches(pages.sparkSession)
    winners = materialize(vote(pages, url, page), "host-paths")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"), host_of(F.col(url).cast("string")).alias("host"))
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")

    def run(batches):
        for batch in rebatched(batches):
            texts = []
            for h, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
                text = extract(h, path) if h and path else None
                texts.append((extract(h, best_path(h)) or "") if text is None and h else text or "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ids, urls = (joined.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return joined.mapInArrow(run, f"page_id {ids}, url {urls}, text string, n_chars long")
