"""Main text of web pages: nearest-URL page differencing over a page's text lines.

A page is cut into blocks, one text line each. Lines in containers that HTML or
their class, id or role names as page furniture (navigation, header, footer,
sidebar, notice, advert, form, comments, ...) are out, as are, outside a marked main
text, lines that are links only, unless a page has no others; a form around a whole
page or around its marked text is none of these. Then every page is differenced:
pages stand in the order of host and URL path, each is paired with the pages before
and after it on its host, the lines of a pair are aligned by longest common
subsequence, and the lines they share are deleted. A neighbour that shares nearly
all lines is a copy of the page, not another page in its template, and is passed
over. Where the page marks its main text (article, main, a role or class that says
so), the marks check this afterwards: what lies outside them goes, and a line comes
back that one neighbour alone shares, or that an article holds beside lines of its
own, for those are copied or common passages of the text itself. Marked regions of
which both neighbours share every line are template, as are such lines outside
articles.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table
from .graph import components

#: A neighbour that shares more than this part of the open lines is a copy.
COPY = 0.8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|textarea|select|object|audio|video|canvas)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
FURNITURE = frozenset("head title nav header footer aside form menu dialog button fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail complementary widget widgets related recommended recommendations "
    "share sharing social comment comments commentary commentlist discussion disqus reply replies respond "
    "footer contentinfo header masthead topbar toolbar pagination pager search login form dialog skip disclaimer".split()
)
MAIN_WORDS = frozenset("article content post entry story main".split())
CLOSERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def marks(attributes: str) -> tuple[set[str], bool, bool]:
    """The words of class, id and role that name furniture, whether they name the main text, and whether role does."""
    furniture, main, role = set(), False, False
    for name, *values in NAMES.findall(attributes):
        words = {w.lower() for w in WORDS.findall("".join(values))}
        furniture |= words & NAMED
        main |= not words.isdisjoint(MAIN_WORDS)
        role |= name.lower() == "role" and "main" in words
    return furniture, main, role


class Block(NamedTuple):
    """A text line of a page.

    out: it is furniture for sure; form: it stands in a form that nothing else marks;
    linked: it is nothing but links; rank: the highest main-text mark around it (0 none,
    1 class, 2 main, 3 article); region: the number of the outermost main or article
    around it, or else of the outermost element whose class says so, or else 0.
    """

    line: str
    out: bool
    form: bool
    linked: bool
    rank: int
    region: int


#: Furniture within: none, for sure, that of an article's own header (its headings stay), a form.
CLEAR, SURE, LEAD, FORM = range(4)


def blocks(page: str) -> list[Block]:
    """The text lines of a page in order."""
    out: list[Block] = []
    #: tag, furniture, main rank, region
    stack: list[tuple[str, int, int, int]] = [("", CLEAR, 0, 0)]
    run: list[str] = []
    heading = link = False
    regions = 0
    #: whether the running line has text outside links
    plain = [False]

    def flush() -> None:
        if run:
            line = " ".join("".join(run).split())
            run.clear()
            if line:
                _, furniture, rank, region = stack[-1]
                out.append(Block(line, furniture == SURE or furniture == LEAD and not heading, furniture == FORM, not plain[0], rank, region))
        plain[0] = False

    def text(piece: str) -> None:
        if piece:
            run.append(unescape(piece) if "&" in piece else piece)
            plain[0] = plain[0] or not link and not piece.isspace()

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, end, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in INLINE or tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            elif tag in INLINE:
                link = not end if tag == "a" else link
                if end:
                    if stack[-1][0] == tag:
                        flush()
                        stack.pop()
                elif attributes and (marks(attributes)[0] or UNSEEN.search(attributes)) and tag != "a":
                    flush()
                    stack.append((tag, SURE, *stack[-1][2:]))
            continue
        flush()
        if end:
            heading = heading and tag not in HEADINGS
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        while stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] == "head" and tag not in ("title",) or stack[-1][0] in HEADINGS:
            heading = heading and stack[-1][0] not in HEADINGS
            stack.pop()
        if tag in CLOSERS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSERS[tag]:
                    break
                if stack[i][0] == tag or tag in ("dt", "dd") and stack[i][0] in ("dt", "dd") or tag in ("td", "th") and stack[i][0] in ("td", "th"):
                    del stack[i:]
                    break
        _, furniture, rank, region = stack[-1]
        named, main, role = marks(attributes) if attributes else (set(), False, False)
        strong = 3 if tag == "article" else 2 if tag == "main" or role else 0
        if furniture == FORM and strong:
            furniture = CLEAR  # a form around the main text is the page's, not a reader's
        if attributes and UNSEEN.search(attributes):
            furniture = SURE
        elif tag == "form" and named <= {"form"}:
            furniture = furniture or FORM
        elif tag in FURNITURE or named and tag not in ("html", "body", "main"):
            furniture = LEAD if tag == "header" and rank >= 2 and furniture == CLEAR else furniture if furniture in (SURE, LEAD) else SURE
        if furniture in (CLEAR, FORM):
            own = strong or int(main and tag not in ("html", "body", "form"))
            if strong and rank < 2 or own and rank == 0:
                regions += 1
                region = regions
            rank = max(rank, own)
        heading = tag in HEADINGS
        stack.append((tag, furniture, rank, region))
    text(page[at:])
    flush()
    return out


def clear(found: list[Block]) -> list[int]:
    """Places of the lines that may be the page's text. Lines in forms count if there are no others."""
    at = [i for i, b in enumerate(found) if not (b.out or b.form) and (b.rank or not b.linked)]
    return at or [i for i, b in enumerate(found) if not b.out and (b.rank or not b.linked)] or [i for i, b in enumerate(found) if not b.out]


def picked(lines: list[str], ranks: list[int], regions: list[int], shared: list[list[int]]) -> list[int]:
    """Which of a page's clear lines are its text; shared: those that each neighbour shares.

    A page's marked regions are its outermost main and article elements, or those whose
    class says so, whichever kind has the longest region: a class that names the story
    beats articles that only tease others (less than half as long). All of a main element
    counts, a title or lead before its article too. Template is what both neighbours share.
    """
    if not any(ranks):
        gone = set().union(*shared)
        return [k for k in range(len(lines)) if k not in gone]
    template = set(shared[0]).intersection(*shared[1:]) if len(shared) > 1 else set()
    length: dict[tuple[bool, int], int] = {}
    for own in ([k for k in range(len(lines)) if k not in template], range(len(lines))):
        for k in own:
            if ranks[k]:
                length[ranks[k] > 1, regions[k]] = length.get((ranks[k] > 1, regions[k]), 0) + len(lines[k])
        if length:
            break
        template = set()  # nothing is left without it
    most = [max((n for (strong, _), n in length.items() if strong == kind), default=0) for kind in (False, True)]
    strong = 2 * most[True] >= most[False]
    return [k for k, (rank, region) in enumerate(zip(ranks, regions, strict=True)) if rank and (rank > 1) == strong and (strong, region) in length and (k not in template or rank == 3)]


def chosen(found: list[Block]) -> tuple[list[int], bool]:
    """Places of the lines that are the text of a page without neighbours, and whether a mark says that they are."""
    at = clear(found)
    ranks = [found[i].rank for i in at]
    return [at[k] for k in picked([found[i].line for i in at], ranks, [found[i].region for i in at], [])], any(ranks)


def common(a: list[int], b: list[int]) -> list[int]:
    """Indices in a of a longest common subsequence of a and b, by bit-parallel rows."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < min(n, m) - lo and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    inner_b = set(b[lo : m - tail])
    at = [i for i in range(lo, n - tail) if a[i] in inner_b]
    inner_a = {a[i] for i in at}
    other = [y for y in b[lo : m - tail] if y in inner_a]
    where: dict[int, int] = {}
    for k, i in enumerate(at):
        where[a[i]] = where.get(a[i], 0) | 1 << k
    full = (1 << len(at)) - 1
    row, rows = full, [full]
    for y in other:
        hit = row & where[y]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, k = [], len(at)
    for j in range(len(other), 0, -1):
        # bits cleared among the lowest k count the subsequence; step back while a row adds nothing
        while k and (rows[j] >> (k - 1)) & 1:
            k -= 1
        if not k:
            break
        if not (rows[j - 1] >> (k - 1)) & 1 and _cleared(rows[j - 1], k) == _cleared(rows[j], k):
            continue
        found.append(at[k - 1])
        k -= 1
    return [*range(lo), *reversed(found), *range(n - tail, n)]


def _cleared(row: int, k: int) -> int:
    return k - (row & ((1 << k) - 1)).bit_count()


def address(url: str | None) -> tuple[str, str]:
    """Host, and path with query for ordering; the fragment and a last slash are dropped."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\??[^#]*)", url or "")
    return (m[1].lower(), m[2].rstrip("/") + m[3]) if m else ("", url or "")


def line_hash(line: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


PARSED = "page_id long, url string, host string, path string, packed binary, ranks array<int>, regions array<int>, open binary, hashes array<long>"
_INTS = pa.list_(pa.int32())
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("packed", pa.binary()), ("ranks", _INTS), ("regions", _INTS), ("open", pa.binary()), ("hashes", pa.list_(pa.int64()))])


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """packed: the clear lines, compressed, as they are shuffled once; open: a byte for each line, 1 for a clear one; hashes: of all lines."""
    for whole in batches:
        for first in range(0, whole.num_rows, 512):
            batch = whole.slice(first, 512)
            rows = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                found = blocks(html or "")
                at = clear(found)
                own, places = [found[i] for i in at], set(at)
                rows.append((page_id, url, *address(url), zlib.compress("\n".join(b.line for b in own).encode(), 6), [b.rank for b in own], [b.region for b in own], bytes(i in places for i in range(len(found))), [line_hash(b.line) for b in found]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _PARSED.types, strict=True)], schema=_PARSED)


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text that differencing and the marks leave of each page."""
    for batch in batches:
        texts = []
        for packed, ranks, regions, shared in zip(*(batch.column(c).to_pylist() for c in ("packed", "ranks", "regions", "shared")), strict=True):
            lines = zlib.decompress(packed).decode().split("\n") if ranks else []
            texts.append("\n".join(lines[k] for k in picked(lines, ranks, regions, shared or [])))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def against(own: list[int], flags: bytes, other: list[int]) -> tuple[list[int], bool]:
    """The open lines that a page shares with another, and whether they are too many to tell furniture from text; then none are named."""
    is_open = [i for i, flag in enumerate(flags) if flag]
    shared = set(common(own, other)).intersection(is_open)
    copy = len(shared) > COPY * len(is_open)
    return [k for k, i in enumerate(is_open) if i in shared and not copy], copy


_MET = pa.schema([("uid", pa.int64()), ("step", pa.int32()), ("rank", pa.int64()), ("gone", _INTS), ("copy", pa.bool_())])
MET = "uid long, step int, rank long, gone array<int>, copy boolean"


def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page shares with the one at rank; copy: it shares too much."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("uid", "step", "rank", "hashes", "open", "other"))
        rows = [(uid, step, rank, *against(own, flags, other)) for uid, step, rank, own, flags, other in zip(*columns, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _MET.types, strict=True)], schema=_MET)


def differ_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages that stand side by side share, for both; rows come by group and rank."""
    last = None
    for batch in batches:
        rows = []
        for page in zip(*(batch.column(c).to_pylist() for c in ("group", "rank", "host", "uid", "open", "hashes")), strict=True):
            if last and last[0] == page[0] and last[1] + 1 == page[1] and last[2] == page[2]:
                for step, own, other in ((1, last, page), (-1, page, last)):
                    if own[4]:
                        rows.append((own[3], step, other[1], *against(own[5], own[4], other[5])))
            last = page
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _MET.types, strict=True)], schema=_MET)


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a page and the one before it are copies, each of the other."""
    for batch in batches:
        same = []
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("hashes", "other")), strict=True):
            n = len(common(a, b))
            same.append(n > COPY * max(len(a), len(b)))
        yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array(same, pa.bool_())], ["rank", "same"])


#: Pages that go to a task together; the first goes to the group before it too.
GROUP = 64


def differenced(lined: DataFrame) -> DataFrame:
    """uid, shared: for each side, the open lines that a page shares with the nearest page on its host that is not a copy.

    Pages side by side meet in groups of consecutive ranks, so that their lines are
    shuffled once for both sides. A page whose neighbour is a copy goes on to the page
    beyond that one's run of copies, until no page has a copy left to pass.
    """
    group = F.floor(F.col("rank") / GROUP)
    dealt = lined.withColumn("group", F.explode(F.when(F.col("rank") % GROUP == 0, F.array(group, group - 1)).otherwise(F.array(group))))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "rank").select("group", "rank", "host", "uid", "open", "hashes")
    met = table(dealt.transform(mapped, differ_next, MET), "met")
    found, bounds = met.where("not copy").select("uid", "gone"), None
    while True:
        passed = met.where("copy").select("uid", "step", F.col("rank").alias("at"))
        if passed.isEmpty():
            break
        if bounds is None:
            bounds = run_bounds(lined)
        beyond = F.when(F.col("step") < 0, F.col("low") - 1).otherwise(F.col("high") + 1)
        passed = passed.join(bounds, F.col("at") == F.col("place")).select("uid", "step", beyond.alias("to"))
        wanted = table(lined.select("uid", "host", "hashes", "open").join(passed, "uid"), "wanted")
        near = lined.select(F.col("rank").alias("to"), F.col("host").alias("near_host"), F.col("hashes").alias("other"))
        met = wanted.join(near.hint("merge"), "to").where(F.col("host") == F.col("near_host"))
        met = table(met.select("uid", "step", F.col("to").alias("rank"), "hashes", "open", "other").transform(mapped, differ, MET), "met")
        found = found.unionAll(met.where("not copy").select("uid", "gone"))
    return found.groupBy("uid").agg(F.collect_list("gone").alias("shared"))


def run_bounds(lined: DataFrame) -> DataFrame:
    """place, low, high: the first and last rank of the run of copies that holds a rank."""
    before = lined.select((F.col("rank") + 1).alias("rank"), F.col("host").alias("near_host"), F.col("hashes").alias("other"))
    pairs = lined.join(before, "rank").where(F.col("host") == F.col("near_host")).select("rank", "hashes", "other")
    pairs = table(pairs.transform(mapped, alike, "rank long, same boolean"), "alike").where("same")
    edges = pairs.select((F.col("rank") - 1).alias("a"), F.col("rank").alias("b"))
    run = components(edges).select(F.col("node").alias("rank"), F.col("component").alias("low"))
    runs = lined.select("rank").join(run, "rank", "left").withColumn("low", F.coalesce("low", "rank"))
    ends = runs.groupBy("low").agg(F.max("rank").alias("high"))
    return table(runs.join(ends, "low").select(F.col("rank").alias("place"), "low", "high"), "run-bounds")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page.

    pages: page_id, url, html; other columns are ignored. Character references are
    decoded, white space within a block becomes one space, blocks are joined in page
    order by one newline. A null or empty page has an empty text. A null url, or one
    without a host, belongs to the host "". Repeated rows and repeated page_ids each
    give a row. Pages without furniture, neighbours or marks keep all their lines.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = table(rows.transform(mapped, parse, PARSED).withColumn("uid", F.monotonically_increasing_id()), "parsed")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = parsed.select("uid", "page_id", "host", "path", "open", "hashes")
    # lines go with the order; a row's number has its partition above 33 bits of its place
    ordered = slim.repartitionByRange(parts, "host", "path", "page_id", "uid").sortWithinPartitions("host", "path", "page_id", "uid")
    ordered = table(ordered.select("uid", "host", "open", "hashes", F.monotonically_increasing_id().alias("spot")), "ordered")
    part = F.shiftright("spot", 33).cast("int")
    counts = dict(ordered.groupBy(part.alias("part")).count().collect())  # a number for each partition
    firsts, total = [], 0
    for at in sorted(counts):
        firsts.append((at, total))
        total += counts[at]
    # a row for each partition is broadcast
    starts = pages.sparkSession.createDataFrame(firsts, "part int, first long")
    place = F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    lined = ordered.withColumn("part", part).join(F.broadcast(starts), "part").select("uid", "host", "open", "hashes", (F.col("first") + place).alias("rank"))
    # this join's sides grow with the pages, so none is broadcast while it is small
    shared = differenced(lined)
    rows = parsed.select("uid", "page_id", "url", "packed", "ranks", "regions").join(shared.hint("merge"), "uid", "left").drop("uid")
    out = rows.transform(mapped, finish, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
