"""Main text of web pages: structure, and a suffix array of each host's page furniture."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import broadcast_if_small, materialize, spread
from tidemark.llm.tokens import GOLD, coded_words, mix

#: Words in a run that counts as repeated and in its fingerprints; distinct page streams of a host
#: that must hold a run, and distinct articles where the run stands in an article.
RUN, FINGER, PAGES, ARTICLES = 12, 5, 2, 3
#: Share of a host's pages that must hold a run of an article: furniture stands on most pages, a quoted passage on few.
SHARE = 0.4
#: An article is a copy when this share of its suffixes is repeated.
COPIED = 0.5
#: Pages that are worked on at a time.
PAGE_ROWS = 512
PRIME = np.uint64(0x100000001B3)

# Fixed values of HTML: elements whose text is never shown or never part of an article, elements
# that break lines, and words in class, id and role that name page furniture.
SKIP = frozenset("script style noscript template svg math iframe object canvas head title select option button textarea audio video".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
CONTENT = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav(?:bar|igation)?|"
    r"newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)",
)
#: Parts that may stand beside such a word in a class that still names furniture (comments-area); share-price has another.
BESIDE = re.compile(
    r"\d*|area|bars?|block|body|bottom|box|boxes|buttons?|col|column|container|content|desktop|fixed|form|global|group|icons?|inner|items?|left|links?|list|main|media|mobile|outer|overlay|page|panel|"
    r"primary|right|row|secondary|section|site|sticky|text|thread|title|toggle|top|unit|wrap|wrapper",
)
#: Furniture that may hold articles of its own, and classes that make an article one of these.
HOLDS_ARTICLES = re.compile(r"comments?|commentlist|disqus|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|promo\w*|widget")
NO_ARTICLE = re.compile(r"comments?|reply|replies|related|promo|sponsored|advert|ad|widget")
#: First parts of a class that tell of a page's layout, not of the element; parts that tell of a state.
LAYOUT = frozenset("has no not with without is".split())
STATES = frozenset("open opened closed on off enabled disabled active inactive visible none left right".split())
#: Elements around a page's text, whose classes and ids describe the page.
AROUND = frozenset("html body article main".split())
#: Of these, parts that an article may have of its own.
OWN_PARTS = frozenset(("header", "masthead", "banner", "footer"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<(?:svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<=/)>|<(script|style|noscript|template|textarea|title|svg|math|iframe|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|[^<]+|<",
    re.S | re.I,
)
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: LOOSE is dropped unless an article or main element stands in it; ASIDE is an article that goes where the page has another.
OPEN, KEEP, DROP, LOOSE, ASIDE = 0, 1, 2, 3, 4


def _told(name: str, attrs: str, zone: int) -> int | None:
    """What an element's attributes tell: DROP or LOOSE for furniture, OPEN where that is unsure, ASIDE for a comment in an article element.

    A class or id names furniture when it begins with such a word and its other parts are
    neutral (comments-area). One that has the word further on (site-footer), with a state
    (comments-open) or with a word of its own (share-price) is unsure.
    """
    told = None
    for attr, a, b, c in ATTR.findall(attrs):
        value, attr = (a or b or c).strip().lower(), attr.lower()
        if attr == "class" and name == "article" and any(NO_ARTICLE.fullmatch(x) for x in value.split()):
            told = ASIDE
        if attr in ("class", "id"):
            for token in value.split() if name not in AROUND else ():
                parts = re.split("[_-]+", token.strip("_-"))
                named = [i for i, x in enumerate(parts) if FURNITURE.fullmatch(x) and (zone != KEEP or x not in OWN_PARTS)]
                if not named or parts[0] in LAYOUT:
                    continue
                if named[0] == 0 and STATES.isdisjoint(parts) and all(i in named or BESIDE.fullmatch(x) for i, x in enumerate(parts)):
                    return DROP if HOLDS_ARTICLES.fullmatch(parts[0]) else LOOSE
                told = OPEN
        if attr == "role" and value in ROLES or attr == "hidden" or attr == "aria-hidden" and value == "true":
            return DROP
        if attr == "style" and re.search(r"display\s*:\s*none", value):
            return DROP
    return told


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of the visible blocks in page order.

    A zone is DROP inside furniture, KEEP inside an article or main element, else OPEN. The
    innermost of these elements decides, except that inside furniture only a main element is
    kept, and an article where the furniture is a form, a navigation (one that was never closed)
    or a class that holds no articles of its own. Articles with a class of comments go where the
    page has another. White space inside a block is one space; a line break element is white space.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}  # so that an end tag without its element costs no search
    zone, parts = OPEN, []

    def flush():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((zone, text))

    def pop(depth: int) -> int:
        for n, _ in stack[depth:]:
            opened[n] -= 1
        del stack[depth:]
        return stack[-1][1] if stack else OPEN

    for m in MARKUP.finditer(html):
        name = m[3]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if opened.get(name) else None
            if name in BLOCK:
                flush()
            if depth is not None:
                if any(n in BLOCK for n, _ in stack[depth:]):
                    flush()
                zone = pop(depth)
        else:
            if name in BLOCK:
                flush()
            if name in ENDS and stack and stack[-1][0] in ENDS[name]:
                zone = pop(len(stack) - 1)
            if name in VOID:
                continue
            inner, told = zone, _told(name, m[4], zone)
            # the header of an article holds its title
            if told == DROP or name in SKIP:
                inner = DROP
            elif name in CHROME and not (name == "header" and zone in (KEEP, ASIDE)):
                inner = LOOSE if name in ("form", "nav", "menu") and zone != DROP else DROP
            elif told == LOOSE:
                inner = DROP if zone == DROP else LOOSE
            elif name == "main" or name == "article" and zone != DROP:
                inner = ASIDE if told == ASIDE or zone == ASIDE else KEEP
            elif told == OPEN and zone == KEEP:
                inner = OPEN
            if inner != zone:
                flush()
            stack.append((name, inner))
            opened[name] = opened.get(name, 0) + 1
            zone = inner
    flush()
    final = {LOOSE: DROP, ASIDE: DROP if any(z == KEEP for z, _ in out) else KEEP}
    return [(final.get(z, z), t) for z, t in out]


HOST = r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*).*$"


def host_of(url: str | None) -> str:
    return re.sub(HOST, r"\1", url or "", flags=re.S).lower()


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Names of the windows of `size` words: equal windows have equal names.

    Names of 2k words come from two names of k words (prefix doubling); a size between powers
    overlaps two of the largest. Empty when there are fewer words.
    """
    names, k = words.copy(), 1
    while 2 * k <= size:
        names = mix(names[: len(names) - k] * PRIME + names[k:]) if len(names) > k else names[:0]
        k *= 2
    if k < size:
        names = mix(names[: len(names) - size + k] * PRIME + names[size - k :]) if len(names) > size - k else names[:0]
    return names


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows (row, url, html) to the suffixes of their streams that have RUN words or more.

    name: the first RUN words; mark: the place of the smallest name of FINGER words in them, the
    same for all suffixes with these words; finger: that name. Names hold the host.
    """
    every = RUN - FINGER + 1
    for batch in batches:
        for at in range(0, batch.num_rows, PAGE_ROWS):
            part = batch.slice(at, PAGE_ROWS)
            found = [[(z, t) for z, t in blocks(h or "") if z != DROP] for h in part.column(2).to_pylist()]
            codes, ends, hashes = coded_words(pa.array([t for page in found for _, t in page], pa.string()))
            words = hashes[codes]
            if len(words) < RUN:
                continue
            zones = np.repeat(np.array([z == KEEP for page in found for z, _ in page], np.int64), np.diff(ends))
            bounds = ends[np.concatenate([[0], np.cumsum([len(page) for page in found])])]
            page = np.repeat(np.arange(len(found)), np.diff(bounds))
            place = np.arange(len(words)) - bounds[page]
            hosts = np.array([xxhash.xxh3_64_intdigest(host_of(u).encode("utf-8", "surrogatepass")) for u in part.column(1).to_pylist()], np.uint64)
            full = np.flatnonzero(np.diff(bounds))
            streams = np.zeros(len(found), np.uint64)
            streams[full] = mix(np.bitwise_xor.reduceat(mix(words + place.astype(np.uint64) * GOLD), bounds[full]))
            i = np.flatnonzero(place[: len(words) - RUN + 1] + RUN <= np.diff(bounds)[page[: len(words) - RUN + 1]])
            if not len(i):
                continue
            fingers, kept = windows(words, FINGER), np.concatenate([[0], np.cumsum(zones)])
            mark = i + np.lib.stride_tricks.sliding_window_view(fingers, every)[i].argmin(axis=1)
            yield {
                "row": np.asarray(part.column(0))[page[i]], "stream": (streams[page[i]] >> np.uint64(33)).astype(np.int32), "place": place[i].astype(np.int32),
                "name": mix(windows(words, RUN)[i] ^ hosts[page[i]]).view(np.int64), "finger": mix(fingers[mark] ^ hosts[page[i]]).view(np.int64), "mark": mark,
                "kept": kept[i + RUN] > kept[i], "open": kept[i + RUN] - kept[i] < RUN, "whole": (kept[bounds[1:]] - kept[bounds[:-1]])[page[i]].astype(np.int32),
            }


def _fingers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(finger, stream): each fingerprint of a page, at each place once."""
    for x in _suffixes(batches):
        new = np.append(True, x["mark"][1:] != x["mark"][:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x["finger"][new]), pa.array(x["stream"][new])], ["finger", "stream"])


GROUPS = "row long, stream int, whole int, finger long, place array<int>, name array<long>, kept array<boolean>, open array<boolean>"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GROUPS: the suffixes of a page, those under one fingerprint together."""
    for x in _suffixes(batches):
        begin = np.flatnonzero(np.append(True, x["mark"][1:] != x["mark"][:-1]))
        offsets = pa.array(np.append(begin, len(x["mark"])), pa.int32())
        flat = [pa.array(x[c][begin]) for c in ("row", "stream", "whole", "finger")]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[c])) for c in ("place", "name", "kept", "open")]
        yield pa.RecordBatch.from_arrays(flat + lists, ["row", "stream", "whole", "finger", "place", "name", "kept", "open"])


def on_several(rows: DataFrame, key: str, pages: int = PAGES) -> DataFrame:
    """The keys that stand in at least `pages` distinct streams; counted before the shuffle where two are enough."""
    if pages <= 2:
        return rows.groupBy(key).agg(F.min("stream").alias("lo"), F.max("stream").alias("hi")).filter("lo <> hi").select(key)
    return rows.select(key, "stream").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= pages).select(key)


def repeated_runs(pages: DataFrame) -> DataFrame:
    """(row, runs, common) per page row with repeats, from (row, url, html).

    runs: where substrings of RUN words begin that distinct page streams of the host share and
    that reach into open blocks; a longer repeat is the union of these. common: those that reach
    into articles and are shared by ARTICLES distinct streams or more, and by a SHARE of the
    host's pages, copied articles left out.

    The page streams of a host, one behind the other, have one suffix array; suffixes with a
    common prefix of RUN words or more are neighbours in it. These neighbourhoods are formed by
    name (prefix doubling) and Spark's shuffle, not by one sort of a host in one task: their
    fingerprints first rule out suffixes that stand alone, then the others meet by name. Both
    counts are pre-aggregated, so neither a large host nor a very common run gathers in a task.
    Pages with one stream (copies of a page) count once.
    """
    often = materialize(on_several(pages.mapInArrow(_fingers, "finger long, stream int"), "finger"), "fingerprints")
    near = pages.mapInArrow(_groups, GROUPS).join(broadcast_if_small(often), "finger", "left_semi")
    cells = F.explode(F.arrays_zip("place", "name", "kept", "open")).alias("x")
    each = materialize(near.select("row", "stream", "whole", cells).select("row", "stream", "whole", "x.*"), "suffixes")
    twice = materialize(on_several(each, "name"), "repeats")
    shared = each.join(broadcast_if_small(twice), "name", "left_semi")
    # an article half of whose suffixes are repeated is a copy of another, not furniture
    copies = shared.filter("kept").groupBy("row", "place", "whole").agg(F.lit(1)).groupBy("row", "whole").agg(F.count(F.lit(1)).alias("n"))
    copies = materialize(copies.filter(F.col("n") >= COPIED * (F.col("whole") - RUN + 1)).select("row"), "copies")
    articles = materialize(shared.filter("kept").join(broadcast_if_small(copies), "row", "left_anti"), "articles")
    host = F.lower(F.regexp_replace(F.coalesce("url", F.lit("")), "(?s)" + HOST, "$1"))
    hosts = pages.select("row", host.alias("host")).distinct()
    found = articles.groupBy("name", "stream").agg(F.min("row").alias("row")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    often = broadcast_if_small(materialize(found.filter(F.col("n") >= ARTICLES), "shared-names"))
    sizes = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    wide = hosts.join(often, "row").join(sizes, "host").filter(F.col("n") >= SHARE * F.col("n_pages")).select("name")
    common = articles.join(wide, "name", "left_semi").select("row", F.lit(None).cast("int").alias("run"), F.col("place").alias("common"))
    runs = shared.filter("open").select("row", F.col("place").alias("run"), F.lit(None).cast("int").alias("common"))
    return materialize(runs.union(common).groupBy("row").agg(F.collect_set("run").alias("runs"), F.collect_set("common").alias("common")), "covered")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, runs, common) to (page_id, url, text, n_chars, n_blocks, n_removed, n_run_removed)."""
    for batch in batches:
        for start in range(0, batch.num_rows, PAGE_ROWS):
            out = []
            for page, url, html, runs, common in zip(*(c.to_pylist() for c in batch.slice(start, PAGE_ROWS).columns)):
                found, at, kept, by_runs = blocks(html or ""), 0, [], 0
                cover = {OPEN: _covered(runs), KEEP: _covered(common)}
                for zone, text in found:
                    if zone == DROP:
                        continue
                    if not (runs or common):
                        kept.append(text)
                        continue
                    words = text.encode("utf-8", "surrogatepass").split()
                    gone = cover[zone].intersection(range(at, at + len(words)))
                    if not gone:
                        kept.append(text)
                        at += len(words)
                        continue
                    covered = np.zeros(len(words), bool)
                    covered[np.fromiter(gone, int, len(gone)) - at] = True
                    left = [w for w, cut in zip(words, covered if covered.all() else _long_runs(covered)) if not cut]
                    at += len(words)
                    if len(left) == len(words) or zone == KEEP and left:
                        kept.append(text)
                        continue
                    by_runs += 1
                    if left:  # the runs go, what only this page has stays
                        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                text = "\n".join(kept)
                out.append((page, url, text, len(text), len(found), len(found) - len(kept), by_runs))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "url", "text", "n_chars", "n_blocks", "n_removed", "n_run_removed"])


def _long_runs(covered: np.ndarray) -> np.ndarray:
    """The covered stretches of RUN words or more; a shorter one reaches in from the next block and may be chance."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    out = np.zeros(len(covered), bool)
    for start, end in zip(edges[::2], edges[1::2]):
        out[start:end] = end - start >= RUN
    return out


def _covered(starts: list[int] | None) -> set[int]:
    return {w for s in starts or () for w in range(s, s + RUN)}


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text per page: page_id, url, text, n_chars, n_blocks, n_removed, n_run_removed.

    Blocks inside page furniture go by their markup. Of all others, the host's suffix array
    decides: from an open block the runs of RUN words or more that distinct pages of the host
    share are cut and its own runs stay, and it goes when runs cover it whole; a block of an article goes when runs that ARTICLES
    distinct articles share, and a SHARE of the host's pages, cover it whole. Articles that are
    copies of one another keep their text. n_run_removed counts the blocks that lost runs.

    Null html: empty text. Null url: a host of its own. Repeated rows each get a row and count
    as one stream. Markup that is cut off or never closed ends with the page. Empty table: no
    rows. Other columns of `pages` are ignored. A page is parsed three times and never stored.
    """
    slim = spread(pages.select("page_id", "url", "html")).withColumn("row", F.xxhash64("page_id", "url", "html"))
    covered = repeated_runs(slim.select("row", "url", "html"))
    cut = "page_id long, url string, text string, n_chars long, n_blocks long, n_removed long, n_run_removed long"
    return slim.join(broadcast_if_small(covered), "row", "left").select("page_id", "url", "html", "runs", "common").mapInArrow(_cut, cut)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
