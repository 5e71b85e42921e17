"""Main text of web pages with nearest-URL page differencing (operator 5).

1. A page is read into text lines (blocks).  Markup says what a line is surely not part of
   the article (menus, footers, sidebars, notices, adverts, forms, comments, scripts) and
   what it surely is (an article, main or content container).
2. Pages of one host are sorted by URL path.  Each is compared with the nearest page on
   either side that is not a copy of it: their lines are aligned by a longest common
   subsequence, and lines shared with such a neighbour are deleted.  This decides on all
   lines that are not surely outside.  The page's surest container is evidence only: if it
   holds at least half of that text, its lines stay even when shared.

A copy tells nothing, for it shares the article too.  Copies are told by what is left: the
characters of lines not surely outside (of the container, if it holds half of them) that
the other page has neither as a line nor, by its first or last three words, as an edited
line.  A page is another one if at least a fifth of the shorter page is left.  It is
looked for up to the ends of the host.  Where a host has none on either side, all its pages
share most of their text; then the nearest with something of its own (``OWN_SHARE`` on both
pages) shows the site's furniture.  Where there is none of these either, nothing is deleted.

Lines travel as 64-bit digests.  The sort is a range partitioning with a number for every
page, cut into blocks of ``BLOCK`` neighbours plus ``REACH`` pages at either end, so a host
with a third of all pages is spread like any other.  The k-th occurrence of a line can only match
the k-th occurrence of the same line, which makes the alignment n log n and exact wherever
a page's lines differ from each other.

Most pages meet their neighbours within ``REACH`` pages.  Those that do not, with lines in
question and more of their host to come, look on in tiles of ``TILE`` pages asking and
``TILE`` asked: the nearest tiles first, then twice as many each round, until another page or
the host's end is met.  In a tile the shared characters of many pairs are taken at once.
A run of n near copies costs n * n / 2 pairs that way, spread over tiles of one size.

Null or empty pages have no text; null URLs share an empty host; repeated rows get equal
results; the order of neighbours with equal paths is by their content's digest.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxora.llm.common import map_rows, staged

BLOCK = 256
REACH = 64
TILE = 512
PART = 128  # pages of a tile asked at once
COPY_SHARE = 0.8
OWN_SHARE = 0.05

# What stands in a tag behind its name: attributes with values in quotes, without quotes (these
# may hold quotes), or without a value.  The groups give nothing back, so time stays linear.
INSIDE_TAG = (
    r"""(?>[^>"']*+(?=>)|(?>[\s/]+|[^\s/>=]+(?>\s*=\s*(?>"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?|=)*+)"""
)
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|canvas|object|select|textarea|button|title)(?![^\s/>])"
    + INSIDE_TAG + r">.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?![^\s/>])(" + INSIDE_TAG + r")>"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("nav footer aside menu dialog head".split())
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary dialog alert menu menubar".split()
)
FORMS = frozenset("form fieldset search".split())  # tags and roles
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar "
    "aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
    "disqus reply replies respond related recommended recommendations share sharing social "
    "widget toolbar pagination pager login search skip header topbar".split()
)
# Of the names above, those of lists of other texts, which may be articles themselves.
OTHERS_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments disqus "
    "reply replies respond related recommended recommendations".split()
)
# Of the names above, those that texts of an article are called by as well.
AMBIGUOUS_NAMES = frozenset(
    "notice notices alert social search skip header topbar menu pager banner overlay modal popup aside "
    "respond reply replies comment widget toolbar login consent subscribe signup sponsor "
    "recommended recommendations nav footer".split()
)
COMMENT_ARTICLES = frozenset("comment comment-body reply ad sponsored related".split())
INSIDE_NAMES = frozenset("article content main post entry story articlebody".split())
NAME = re.compile(r"[^a-z0-9]+")


# Marks: surely outside, named as other texts, named or a form; inside an article, a name alone.
SURE, OTHERS, LAYOUT, WEAK = 3, 2, 1, 4


def traits(tag: str, attributes: str, in_article: bool) -> tuple[int, int]:
    """The mark of an element as outside (0: none), and how surely it is inside (0 to 3)."""
    values = {}
    if attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            values[m[1].lower()] = (m[2] or m[3] or m[4] or "").lower()
    role = values.get("role", "")
    given = set(f"{values.get('class', '')} {values.get('id', '')}".split())
    names = {n for g in given for n in NAME.split(g)}
    if tag == "article":
        # Whole names only: "post related-posts" and "comment-policy-post" are articles.
        return SURE if given & COMMENT_ARTICLES else 0, 3
    if tag == "main" or role == "main" or values.get("itemprop") == "articlebody":
        return 0, 2
    if tag in ("body", "html"):
        return 0, 0
    if tag in OUTSIDE or tag == "header" and not in_article:
        return SURE, 0
    hidden = "hidden" in values or "display:none" in values.get("style", "").replace(" ", "")
    if hidden or role in OUTSIDE_ROLES:
        return SURE, 0
    marks = names & OUTSIDE_NAMES
    if tag == "header" or in_article:
        marks = marks - {"header"}
    if in_article and tag not in FORMS and role not in FORMS:
        if len(marks) == 1 and not marks & given - AMBIGUOUS_NAMES:
            return WEAK, 0
    if marks or tag in FORMS or role in FORMS:
        return OTHERS if marks & OTHERS_NAMES else LAYOUT, 0
    return 0, 1 if tag in ("div", "section", "td") and names & INSIDE_NAMES else 0


Marks = tuple[tuple[int, int], ...]  # number and kind of each marked element around a line


def layout_of(containers: list[Marks]) -> set[int]:
    """Marked elements that hold a container: they are the page's layout.

    Of those named as lists of other texts only the ones around the containers with the
    fewest of them: beside an article that stands alone, a teaser or comment stays outside.
    """
    others = [sum(kind == OTHERS for _, kind in marks) for marks in containers]
    least = min(others, default=0)
    return {n for marks, k in zip(containers, others) if k == least for n, _ in marks}


def agrees(text: str, linked: int) -> bool:
    """Does a line look like furniture: mostly link text, or a few words that say so?"""
    if 2 * linked > len(text):
        return True
    words = NAME.split(text.lower())
    told = OUTSIDE_NAMES - AMBIGUOUS_NAMES - {"ad", "ads"}
    return len(words) <= 8 and not told.isdisjoint(words)


def lines_of(page: str) -> list[tuple[str, bool, int]]:
    """(text, surely outside, how surely inside) of each block, in page order.

    Marks that are sure hold for all below them.  A class name or form around an article or
    main container does not: see :func:`layout_of`.  Beside a container without any mark
    around it, what stands in such a wrapper is kept, but not as surely inside.  Inside an
    article one word of a name marks a line only if the line agrees: see :func:`agrees`.
    """
    found: list[tuple[str, Marks, int]] = []
    stack: list[tuple[str, Marks, int]] = []  # tag, marks and inside of it and all above
    containers: list[Marks] = []
    pieces: list[str] = []
    count = linked = 0
    in_link = False

    def end_line() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(markup.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                marks = stack[-1][1] if stack else ()
                if any(kind == WEAK for _, kind in marks) and not agrees(text, linked):
                    marks = tuple(m for m in marks if m[1] != WEAK)
                found.append((text, marks, stack[-1][2]) if stack else (text, (), 0))
            linked = 0

    at = 0
    for m in PIECE.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            linked += m.start() - at if in_link else 0
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            in_link = not m[2]
        if tag in BLOCKS:
            end_line()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "body", "nav", "footer", "aside") and tag not in (
                    "article", "body", "html", "main", "div", "section", "nav", "footer", "aside",
                ):
                    break
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        above = stack[-1] if stack else ("", (), 0)
        mark, inside = traits(tag, m[4] or "", above[2] >= 2)
        marks = above[1]
        if mark:
            count += 1
            marks = (*marks, (count, mark))
        elif inside >= 2 and above[2] < 2 and all(kind != SURE for _, kind in marks):
            containers.append(marks)
        stack.append((tag, marks, max(above[2], inside)))
    if at < len(page):
        pieces.append(page[at:])
    end_line()
    layout = layout_of(containers)
    free = () in containers
    return [
        (text, any(n not in layout for n, _ in marks), 0 if marks and free else inside)
        for text, marks, inside in found
    ]


def digest(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def place_of(url: str | None) -> tuple[str, str]:
    """Host (lower case) and path of a URL, without query and fragment."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", url or "")
    rest = rest[2:] if rest.startswith("//") else "/" + rest.lstrip("/")
    host, slash, path = re.split(r"[?#]", rest, maxsplit=1)[0].partition("/")
    return host.lower(), slash + path


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""

    def marked(seq: list[int]) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        out = []
        for x in seq:
            seen[x] = seen.get(x, 0) + 1
            out.append((x, seen[x]))
        return out

    where = {x: j for j, x in enumerate(marked(b))}
    ends: list[int] = []  # smallest end in b of an increasing run of each length
    last: list[int] = []  # its place in a
    before: dict[int, int] = {}
    for i, x in enumerate(marked(a)):
        j = where.get(x)
        if j is None:
            continue
        k = bisect_left(ends, j)
        before[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(j)
            last.append(i)
        else:
            ends[k], last[k] = j, i
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def pack(lines: list[tuple[str, bool, int]]) -> bytes:
    """Lines with their marks; of lines surely outside the mark alone."""
    marked = ["o" if outside else f"{inside}{text}" for text, outside, inside in lines]
    return zlib.compress("\n".join(marked).encode("utf-8", "replace"), 6)


def container(lines: list[tuple[str, bool, int]]) -> int:
    """The level of the surest container if it holds half of the text not outside, else 0."""
    best = max((inside for _, outside, inside in lines if not outside), default=0)
    held = sum(len(text) for text, outside, inside in lines if not outside and inside == best)
    return best if 2 * held >= sum(len(text) for text, outside, _ in lines if not outside) else 0


def main_lines(packed: bytes, shared: list[int]) -> tuple[list[str], int]:
    """The article's lines, and how many lines were deleted because they are shared."""
    marked = zlib.decompress(packed).decode().split("\n")
    lines = [("", True, 0) if m in ("", "o") else (m[1:], False, int(m[0])) for m in marked]
    level = container(lines)
    deleted = {
        i for i in shared if not lines[i][1] and not (level and lines[i][2] == level)
    }
    kept = [text for i, (text, outside, _) in enumerate(lines) if not outside and i not in deleted]
    return kept, len(deleted)


def edges(line: str) -> int:
    """The first and the last three words of a line of six and more, as one number."""
    words = line.split()
    if len(words) < 6:
        return 0
    head, tail = (zlib.crc32(" ".join(x).encode("utf-8", "replace")) for x in (words[:3], words[-3:]))
    return (head << 32 | tail) - (1 << 63)


def evidence(lines: list[tuple[str, bool, int]]) -> tuple[list[int], list[int], list[int]]:
    """Characters and edges of the lines that tell copies (0 for all others), and the places
    of the lines that may be deleted."""
    level = container(lines)
    told = [not outside and (not level or inside == level) for _, outside, inside in lines]
    return (
        [len(text) if t else 0 for t, (text, _, _) in zip(told, lines)],
        [edges(text) if t else 0 for t, (text, _, _) in zip(told, lines)],
        [i for i, (_, outside, inside) in enumerate(lines) if not outside and not (level and inside == level)],
    )


class Text:
    """What tells whether a page is a copy of another."""

    def __init__(self, digests: list[int], chars: list[int], marks: list[int]) -> None:
        self.lines = [(d, n, m) for d, n, m in zip(digests, chars, marks) if n]
        self.size = sum(n for _, n, _ in self.lines)
        self.known = set(digests)
        self.heads = {m >> 32 for _, _, m in self.lines if m}
        self.tails = {m & 0xFFFFFFFF for _, _, m in self.lines if m}

    def left(self, other: Text) -> int:
        """Characters of lines that the other page has neither so nor edited."""
        return sum(
            n
            for d, n, m in self.lines
            if d not in other.known
            and not (m and (m >> 32 in other.heads or m & 0xFFFFFFFF in other.tails))
        )


OTHER, OWN, COPY = 0, 1, 2


def relation(a: Text, b: Text) -> int:
    """Another page, one with something of its own, or a copy (or a page without text)."""
    if not a.size or not b.size:
        return COPY
    left_a, left_b = a.left(b), b.left(a)
    left, size = (left_a, a.size) if a.size <= b.size else (left_b, b.size)
    if size - left <= COPY_SHARE * size:
        return OTHER
    return OWN if left_a >= OWN_SHARE * a.size and left_b >= OWN_SHARE * b.size else COPY


def nearest(
    i: int, step: int, hosts: list[str], texts: list[Text], reach: int
) -> tuple[int | None, int | None, bool]:
    """On one side of page ``i`` the nearest other page, the nearest with something of its
    own before that, and whether the host goes on beyond ``reach`` without another page."""
    own = None
    for j in range(i + step, i + step * (reach + 1), step):
        if not 0 <= j < len(hosts) or hosts[j] != hosts[i]:
            return None, own, False
        kind = relation(texts[i], texts[j])
        if kind == OTHER:
            return j, own, False
        if kind == OWN and own is None:
            own = j
    beyond = i + step * (reach + 1)
    return None, own, 0 <= beyond < len(hosts) and hosts[beyond] == hosts[i]


def met(pages: list[Text], asked: list[Text]) -> np.ndarray:
    """Characters of each page's lines that each asked page has, so or edited."""

    def places(sets: list[set[int]]) -> tuple[dict[int, int], np.ndarray]:
        index: dict[int, int] = {}
        at = [(index.setdefault(x, len(index)), j) for j, s in enumerate(sets) for x in s]
        table = np.zeros((len(index) + 1, len(sets)), dtype=bool)  # the last row: not there
        if at:
            table[tuple(np.array(at).T)] = True
        return index, table

    known, has = places([t.known for t in asked])
    heads, has_head = places([t.heads for t in asked])
    tails, has_tail = places([t.tails for t in asked])
    out = np.zeros((len(pages), len(asked)), dtype=np.int64)
    for i, t in enumerate(pages):
        if t.lines:
            hit = has[[known.get(d, -1) for d, _, _ in t.lines]]
            hit |= has_head[[heads.get(m >> 32, -1) if m else -1 for _, _, m in t.lines]]
            hit |= has_tail[[tails.get(m & 0xFFFFFFFF, -1) if m else -1 for _, _, m in t.lines]]
            out[i] = np.array([n for _, n, _ in t.lines], dtype=np.int64) @ hit
    return out


def relations(pages: list[Text], asked: list[Text]) -> np.ndarray:
    """:func:`relation` of every page with every asked page."""
    a = np.array([t.size for t in pages], dtype=np.int64)[:, None]
    b = np.array([t.size for t in asked], dtype=np.int64)[None, :]
    met_a, met_b = met(pages, asked), met(asked, pages).T
    other = np.where(a <= b, met_a <= COPY_SHARE * a, met_b <= COPY_SHARE * b)
    own = (a - met_a >= OWN_SHARE * a) & (b - met_b >= OWN_SHARE * b)
    return np.where((a > 0) & (b > 0), np.where(other, OTHER, np.where(own, OWN, COPY)), COPY)


PARSED = (
    "row_key long, page_id long, url string, host string, path string, packed binary, "
    "digests array<long>, chars array<int>, edges array<long>, open array<int>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """The lines of each page, packed, and their digests."""
    rows = pages.select(
        F.col("`page_id`").cast("long").alias("page_id"),
        F.col("`url`").alias("url"),
        F.col("`html`").alias("html"),
        F.xxhash64("`page_id`", "`url`", "`html`").alias("row_key"),
    )

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            out = []
            columns = ("row_key", "page_id", "url", "html")
            for key, page_id, url, page in zip(*(batch.column(c).to_pylist() for c in columns)):
                lines = lines_of(page or "")
                host, path = place_of(url)
                chars, marks, unsure = evidence(lines)
                out.append(
                    {
                        "row_key": key, "page_id": page_id, "url": url, "host": host, "path": path,
                        "packed": pack(lines), "digests": [digest(t) for t, _, _ in lines],
                        "chars": chars, "edges": marks, "open": unsure,
                    }
                )
            return out

        return work

    return map_rows(rows, make, PARSED)


def numbered(light: DataFrame) -> DataFrame:
    """``light`` with ``at``: its place in the order (host, path, row_key), from 0."""
    order = ["host", "path", "row_key"]
    parts = light.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = staged(
        light.repartitionByRange(int(parts), *order)
        .sortWithinPartitions(*order)
        .withColumn("mark", F.monotonically_increasing_id()),
        "pages",
    ).withColumn("part", F.shiftright("mark", 33))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition: their number is the session's, not the data's.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "part").withColumn("at", place).drop("part", "mark", "base")


LIGHT = ("row_key", "host", "digests", "chars", "edges", "open", "at")
# For a page and a side: the places shared with the nearest other page and with the nearest
# that has something of its own, whether the search goes on, and how many tiles away it was.
SIDES = "row_key long, at long, side int, other array<int>, own array<int>, on boolean, tiles long"


def unpacked(cell: pd.DataFrame) -> list[list]:
    return [
        [x if isinstance(x, str) else x.tolist() for x in cell[c]]
        for c in ("host", "digests", "chars", "edges", "open")
    ]


def side_rows(rows: list[tuple]) -> pd.DataFrame:
    keys, at, sides, other, own, on, tiles = zip(*rows) if rows else ((),) * 7
    return pd.DataFrame(
        {
            "row_key": pd.Series(keys, dtype="int64"), "at": pd.Series(at, dtype="int64"),
            "side": pd.Series(sides, dtype="int32"), "other": pd.Series(other, dtype=object),
            "own": pd.Series(own, dtype=object), "on": pd.Series(on, dtype=bool),
            "tiles": pd.Series(tiles, dtype="int64"),
        }
    )


def shared_places(lines: list[int], other: list[int], unsure: list[int]) -> list[int]:
    return sorted(set(aligned(lines, other)).intersection(unsure))


def look_on(rows: DataFrame, open_sides: DataFrame, tile: int, reach: int) -> DataFrame:
    """What the open sides find beyond ``reach``, whatever the distance."""
    asking = rows.select(*LIGHT).join(open_sides.select("at", "side"), "at")
    ends = (
        rows.join(asking.select("host").distinct(), "host", "left_semi")
        .groupBy("host").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    )
    asking = staged(
        asking.join(ends, "host").withColumns(
            {
                "block": F.floor(F.col("at") / tile),
                # How many tiles away the last page of the host lies on this side.
                "far": F.when(
                    F.col("side") > 0, F.floor(F.col("last") / tile) - F.floor(F.col("at") / tile)
                ).otherwise(F.floor(F.col("at") / tile) - F.floor(F.col("first") / tile)),
            }
        ).drop("first", "last"),
        "asking",
    )
    asked = staged(
        rows.select(*LIGHT).join(asking.select("host").distinct(), "host", "left_semi")
        .withColumn("tile", F.floor(F.col("at") / tile)),
        "asked",
    )

    def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours) or not len(theirs):
            return side_rows([])
        side = int(ours["side"].iloc[0])
        tiles = abs(int(ours["to"].iloc[0]) - int(ours["block"].iloc[0]))
        theirs = theirs.sort_values("at", ascending=side > 0).reset_index(drop=True)
        hosts, lines, chars, marks, unsure = unpacked(ours)
        their_hosts, their_lines, their_chars, their_marks, _ = unpacked(theirs)
        texts = [Text(*x) for x in zip(lines, chars, marks)]
        at, their_at = ours["at"].to_numpy(), theirs["at"].to_numpy()
        host_names, their_names = np.array(hosts, dtype=object), np.array(their_hosts, dtype=object)
        other: dict[int, int] = {}
        own: dict[int, int] = {}
        live = list(range(len(ours)))
        for begin in range(0, len(theirs), PART):
            live = [i for i in live if i not in other]
            if not live:
                break
            part = slice(begin, begin + PART)
            far = (their_at[part][None, :] - at[live][:, None]) * side > reach
            fits = far & (host_names[live][:, None] == their_names[part][None, :])
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            them = [Text(*x) for x in zip(their_lines[part], their_chars[part], their_marks[part])]
            kinds = np.where(fits[some], relations([texts[live[k]] for k in some], them), COPY)
            for k, kind in zip(some, kinds):
                i = live[k]
                for found, wanted in ((other, OTHER), (own, OWN)):
                    hits = np.flatnonzero(kind == wanted)
                    if len(hits):
                        found.setdefault(i, begin + int(hits[0]))
        keys = ours["row_key"].tolist()
        return side_rows([
            (
                keys[i], int(at[i]), side,
                *(
                    shared_places(lines[i], their_lines[f[i]], unsure[i]) if i in f else None
                    for f in (other, own)
                ),
                False, tiles,
            )
            for i in range(len(ours)) if i in other or i in own
        ])

    out = None
    low, high = 0, 2
    while not asking.isEmpty():
        pairs = asking.select(
            "*",
            F.explode(
                F.transform(
                    F.sequence(F.lit(low).cast("long"), F.least(F.col("far"), F.lit(high - 1))),
                    lambda k: F.col("block") + F.col("side") * k,
                )
            ).alias("to"),
        )
        key, theirs = ["block", "to", "side"], ["by", "tile", "way"]
        wanted = pairs.select(*[F.col(a).alias(b) for a, b in zip(key, theirs)]).distinct()
        tiles = asked.join(wanted, "tile")
        found = staged(
            pairs.groupBy(*key).cogroup(tiles.groupBy(*theirs)).applyInPandas(compare, SIDES), "looked-on"
        )
        out = found if out is None else out.unionByName(found)
        settled = found.filter("other IS NOT NULL").select("at", "side").distinct()
        asking = staged(
            asking.filter(F.col("far") >= high).join(settled, ["at", "side"], "left_anti"), "asking"
        )
        low, high = high, high * 2
    return out


def shared_lines(
    light: DataFrame, block: int = BLOCK, tile: int = TILE, reach: int = REACH
) -> DataFrame:
    """row_key and places of the lines shared with the nearest URLs of the host that may be
    deleted; pages without such lines have no row."""
    rows = numbered(light)
    # One page more than the reach, so that a side knows whether its host goes on.
    first, last = (F.floor((F.col("at") + k) / block) for k in (-reach - 1, reach + 1))
    blocks = F.sequence(F.greatest(first, F.lit(0)), last)
    cells = rows.select(*LIGHT, F.explode(blocks).alias("block"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("at").reset_index(drop=True)
        hosts, lines, chars, marks, unsure = unpacked(cell)
        real = (cell["at"] // block == cell["block"]).to_numpy()
        own = [i for i in real.nonzero()[0].tolist() if unsure[i]]
        texts = [Text(*x) for x in zip(lines, chars, marks)] if own else []
        keys, at = cell["row_key"].tolist(), cell["at"].tolist()
        out = []
        for i in own:
            for side in (-1, 1):
                *found, on = nearest(i, side, hosts, texts, reach)
                places = [None if j is None else shared_places(lines[i], lines[j], unsure[i]) for j in found]
                out.append((keys[i], at[i], side, *places, on, -1))
        return side_rows(out)

    sides = staged(cells.groupBy("block").applyInPandas(compare, SIDES), "sides")
    open_sides = sides.filter("on")
    if not open_sides.isEmpty():
        sides = sides.unionByName(look_on(rows, open_sides, tile, reach))
    # The nearest of each kind: pages looked at first lie nearer.
    by_side = sides.groupBy("row_key", "at", "side").agg(
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col("tiles"))).alias(c)
            for c in ("other", "own")
        ]
    )
    found = by_side.groupBy("row_key", "at").agg(
        *[F.collect_list(c).alias(c) for c in ("other", "own")]
    )
    best = F.when(F.size("other") > 0, F.col("other")).otherwise(F.col("own"))
    return found.select(
        "row_key", F.array_sort(F.array_distinct(F.flatten(best))).alias("shared")
    ).filter(F.size("shared") > 0)


SCHEMA = "page_id long, url string, text string, n_chars long, n_shared long, n_deleted long"


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page with its main text.

    n_shared counts the lines that were found on a neighbour and may be deleted, n_deleted
    those that were.
    """
    # Written once: the order of the pages, their comparison and the texts all read it.
    rows = staged(parsed(pages), "parsed")
    # Rows with one key are equal in all columns, so one of them speaks for all.
    shared = shared_lines(
        rows.select("row_key", "host", "path", "digests", "chars", "edges", "open")
    ).groupBy("row_key").agg(
        F.max("shared").alias("shared")
    )
    # Written, so that Spark knows its size before it decides how the texts meet it.
    shared = staged(shared, "shared")
    joined = rows.select("row_key", "page_id", "url", "packed").join(shared, "row_key", "left")

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            out = []
            columns = ("page_id", "url", "packed", "shared")
            for page_id, url, packed, places in zip(*(batch.column(c).to_pylist() for c in columns)):
                kept, gone = main_lines(packed, places or [])
                text = "\n\n".join(kept)
                out.append(
                    {
                        "page_id": page_id, "url": url, "text": text, "n_chars": len(text),
                        "n_shared": len(places or []), "n_deleted": gone,
                    }
                )
            return out

        return work

    return map_rows(joined.select("page_id", "url", "packed", "shared"), make, SCHEMA)
