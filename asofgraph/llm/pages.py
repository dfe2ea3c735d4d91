"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one a block element, menus and footers included. Its lines are aligned, by
longest common subsequence, with those of the pages of the same host whose URL paths are nearest on
either side. A line that the neighbours share is template and goes; where markup says that it is article text, that
takes four neighbours. Alignment can't see template that no neighbour repeats, so markup is a prior for the other lines: those
of elements that say what they are (nav, footer, aside, form and so on) go, and where an article
is marked, so do lines outside it. Scripts, styles and titles make no lines.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofgraph.llm.common import materialize, pieces, read_table, small_batches

RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
CHROME = frozenset("head nav footer aside form button select menu dialog svg math object canvas audio video map datalist".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words that mark what isn't the article where a whole class or id is made of them.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments commentlist disqus respond reply replies widget toolbar pagination pager skip".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[a-z]+(?:[-_][a-z]+)*", re.IGNORECASE)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_]")


@dataclass
class Line:
    text: str
    chrome: bool
    article: bool  # inside the page's one article


@dataclass
class _State:
    open: list[tuple[str, bool, int]] = field(default_factory=list)  # name, chrome, number of the marked element or 0
    chrome: int = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


def _is_chrome(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in CHROME or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in CHROME_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return any(_NAME.fullmatch(n) and all(w.lower() in CHROME_WORDS for w in _HUMP.split(n)) for n in names)


def _article(marks: list[tuple[str, int]], size: dict[int, int]) -> int:
    """The number of the one marked element that is the article: the article with most text, the earlier on a tie.

    The main element around the only article counts with it, and one without articles alone. 0: none is marked.
    """
    articles = [k for k, (name, inside) in enumerate(marks, 1) if name == "article" and not (inside and marks[inside - 1][0] == "article")]
    mains = [k for k, (name, _) in enumerate(marks, 1) if name == "main"]
    best = max(articles or mains, key=lambda k: (size.get(k, 0), -k), default=0)
    if len(articles) == 1 and (around := marks[best - 1][1]):
        return around
    return best


def lines_of(page: str) -> list[Line]:
    """Text lines in page order, references decoded, white space single."""
    state, out = _State(), []
    parts: list[str] = []
    marks: list[tuple[str, int]] = []  # kind of each marked element and the number of the one around it
    within: list[tuple[int, ...]] = []  # of each line

    def around() -> tuple[int, ...]:
        return tuple(x[2] for x in state.open if x[2])

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(text, state.chrome > 0, False))
            within.append(around())
        parts.clear()

    def close(to: int) -> None:
        while len(state.open) > to:
            _, chrome, _ = state.open.pop()
            if chrome and state.chrome == 1:
                flush()
            state.chrome -= chrome

    def say(a: int, b: int) -> None:
        if a < b:
            parts.append(entities.unescape(page[a:b]))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(at, size)
            break
        say(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if m[1]:
            found = next((k for k in range(len(state.open) - 1, -1, -1) if state.open[k][0] == name), None)
            if found is not None:
                close(found)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        attributes = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if name in VOID:
            continue
        if name in BLOCKS and state.open and state.open[-1][0] == "p":
            close(len(state.open) - 1)
        elif name in BLOCKS:  # an open paragraph ends here, with what is open inside it
            top = next((k for k in range(len(state.open) - 1, -1, -1) if state.open[k][0] in BLOCKS), None)
            if top is not None and state.open[top][0] == "p":
                close(top)
        if name in ("article", "main", "body"):
            stray = next((k for k, x in enumerate(state.open) if x[0] in ("nav", "head")), None)
            if stray is not None:  # never closed
                close(stray)
        inside = around()
        chrome = _is_chrome(name, attributes, bool(inside))
        kind = "article" if name == "article" or attributes.get("itemprop") == "articleBody" else "main" if name == "main" or attributes.get("role") == "main" else ""
        if m[3].endswith("/") and name in ("svg", "math", "object", "canvas"):
            continue
        if kind and not chrome and not state.chrome:
            marks.append((kind, inside[-1] if inside else 0))
        else:
            kind = ""
        if chrome and not state.chrome:
            flush()
        state.open.append((name, chrome, len(marks) if kind else 0))
        state.chrome += chrome
    flush()
    size: Counter[int] = Counter()
    for line, marked in zip(out, within, strict=True):
        if not line.chrome:
            size.update(dict.fromkeys(marked, len(line.text)))
    if root := _article(marks, size):
        for line, marked in zip(out, within, strict=True):
            line.article = not line.chrome and root in marked
    return out


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence, by increasing runs of matching places."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    last: list[tuple[int, int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k], last[k] = j, link
    out, at = [], last[-1] if last else None
    while at is not None:
        out.append(at[:2])
        at = at[2]
    return out[::-1]


def line_hash(text: str) -> int:
    """64 bits, the lowest of them zero: an outline keeps there whether the line is article text."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63) & ~1


def outline_of(lines: list[Line]) -> list[int]:
    return [line_hash(x.text) | x.article for x in lines]


def template_of(own: list[int], near: list[list[int]], further: list[list[int]] = ()) -> set[int]:
    """Places of the lines that the nearest pages, one on either side, share.

    A page that has every line of this one, or none, tells nothing apart and isn't asked. That a line is article
    text here is overruled only where there are two pages on either side and all show it outside
    their articles: fewer may have the same sentence by chance.
    """
    shared: set[int] | None = None
    plain = [x & ~1 for x in own]
    for other in near:
        found = {i for i, _ in common_subsequence(plain, [x & ~1 for x in other])}
        if 0 < len(found) < len(own):
            shared = found if shared is None else shared & found
    shared = shared or set()
    marked = {k for k in shared if own[k] & 1}
    if marked:
        others = [*near, *further] if len(near) == len(further) == 2 else [[]]
        for other in others:
            marked &= {i for i, j in common_subsequence(plain, [x & ~1 for x in other]) if not other[j] & 1}
    return {k for k in shared if not own[k] & 1 or k in marked}


def candidates(lines: list[Line]) -> list[int]:
    """Places of the lines that markup leaves: none of chrome and, where an article is marked, those inside it."""
    marked = any(x.article for x in lines)
    return [k for k, x in enumerate(lines) if not x.chrome and (x.article or not marked)]


def main_text(lines: list[Line], *others: list[int]) -> str:
    """The lines that markup leaves, without what is template by the other pages, the two nearest first."""
    shared = template_of(outline_of(lines), list(others[:2]), list(others[2:]))
    return "\n".join(lines[k].text for k in candidates(lines) if k not in shared)


def url_key(url: str | None) -> tuple[str | None, str]:
    """(host, path with query) for nearness; host null where there is none."""
    try:
        found = urlsplit(url or "")
        host = (found.hostname or "").lower()
    except ValueError:
        host = ""
    if not host:
        return None, ""
    return host, found.path + (f"?{found.query}" if found.query else "")


_OUTLINES = "host string, path string, page_id long, outline array<long>, places array<int>"
_LINES = "host string, page_id long, url string, outline array<long>, places array<int>, lines string"


def _parsed(schema: str):
    """The outline of all lines, and the places and texts of the candidates, a line each: what ``schema`` has of it."""
    names = [column.split()[0] for column in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            keys = [url_key(u) for u in batch["url"].to_pylist()]
            found = [lines_of(h or "") for h in batch["html"].to_pylist()]
            places = [candidates(lines) for lines in found]
            columns = {
                "host": pa.array([k[0] for k in keys], pa.string()), "path": pa.array([k[1] for k in keys], pa.string()), "page_id": batch["page_id"], "url": batch["url"],
                "outline": pa.array([outline_of(lines) for lines in found], pa.list_(pa.int64())), "places": pa.array(places, pa.list_(pa.int32())),
            }
            if "lines" in names:
                columns["lines"] = pa.array(["\n".join(lines[k].text for k in at) for lines, at in zip(found, places, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
    return run


_GONE = "key long, gone array<int>"


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page that loses any: the places of the candidates that are template."""
    for batch in batches:
        keys, gone = [], []
        for key, outline, places, near, further in zip(*(batch[c].to_pylist() for c in ("key", "outline", "places", "near", "further")), strict=True):
            shared = template_of(outline, *([x for x in others if x is not None] for others in (near, further)))
            if lost := sorted(shared.intersection(places)):
                keys.append(key)
                gone.append(lost)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])


def neighbours(outlines: DataFrame) -> DataFrame:
    """For rows of key, host, path, page_id, outline and places: key, outline, places, near, further, the latter two arrays of outlines.

    near are the pages next to each on either side in order of (host, path), further those behind them; null where
    the host ends. Rows are dealt by ranges of that order, so a host with a third of all pages spreads over many
    tasks; ranges see the two rows at either end of the next through a table of four rows a range.
    """
    order = ["host", "path", "page_id", "key"]
    count = int(outlines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = outlines.repartitionByRange(count, *order).sortWithinPartitions(*order)
    placed = materialize(dealt.select("key", "places", F.struct("host", "outline").alias("page"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place")), "placed")
    inside = Window.partitionBy("range").orderBy("place")
    rows = placed.withColumns({f"{name}{k}": move("page", k).over(inside) for name, move in (("b", F.lag), ("a", F.lead)) for k in (1, 2)})
    edge = lambda end, other: F.max(F.when(F.col(f"{end}1").isNull(), F.struct("page", F.col(f"{other}1").alias("next"))))
    ends = rows.groupBy("range").agg(edge("b", "a").alias("first"), edge("a", "b").alias("last"))
    whole = Window.orderBy("range")
    ends = ends.select("range", F.lag("last").over(whole).alias("left"), F.lead("first").over(whole).alias("right"))
    rows = rows.join(F.broadcast(ends), "range")
    same = lambda page: F.when(page.host == F.col("page.host"), page.outline)
    near = F.array(*(same(F.coalesce(f"{n}1", f"{edge}.page")) for n, edge in (("b", "left"), ("a", "right"))))
    further = F.array(*(same(F.coalesce(F.col(f"{n}2"), F.when(F.col(f"{n}1").isNotNull(), F.col(f"{edge}.page")).otherwise(F.col(f"{edge}.next")))) for n, edge in (("b", "left"), ("a", "right"))))
    return rows.select("key", "page.outline", "places", near.alias("near"), further.alias("further"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text. Pages of a host with the same lines are one page when neighbours
    are sought, at the first of their paths, so a neighbour is never a copy; each gets its own result. A
    page without a host, or alone on its host, is not compared. Of two neighbours both have to share a line for it to
    go, but one that has all lines of the page or none has no say. Pages of the same path are ordered by
    page_id. Repeated rows give a result each. Other columns are ignored.

    Pages are read and parsed twice, first for outlines and then for texts, so that texts are neither stored nor, unless
    many pages lose lines, shuffled.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    key = F.xxhash64("host", "outline")
    places = F.array_distinct(F.flatten(F.collect_set("places")))  # pages with the same lines may differ in their candidates
    outlines = pages.mapInArrow(_parsed(_OUTLINES), _OUTLINES).filter("host IS NOT NULL").withColumn("key", key)
    first = outlines.groupBy("key").agg(F.min(F.struct("path", "page_id", "host", "outline")).alias("page"), places.alias("places"))
    gone = neighbours(first.select("key", "page.*", "places")).mapInArrow(_gone, _GONE)
    gone = materialize(gone, "gone")  # of known size: where few pages lose lines, texts needn't be shuffled
    lines = pages.mapInArrow(_parsed(_LINES), _LINES).withColumn("key", F.when(F.col("host").isNotNull(), key).otherwise(F.xxhash64("page_id", "url")))
    kept = F.filter(F.split("lines", "\n"), lambda _, k: ~F.array_contains("gone", F.get("places", k)))
    text = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.array_join(kept, "\n"))
    texts = lines.join(gone, "key", "left").select("page_id", "url", text.alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
