"""Main text of web pages by nearest-URL page differencing, and by structure.

A page is read into lines, the text blocks in page order. Pages are sorted by
host, URL path and id, and each is paired on both sides with the nearest page
of its host that is no copy. The line lists of a pair are aligned by a longest
common subsequence, and lines that both share are deleted: what a host repeats
from page to page is its frame. All lines of a page are compared; where it
marks its article, lines in the article are compared with such lines alone, and
the others with the others.

Structure deletes more lines, and restores none: those outside the marked
article, and those in elements that frame by their nature (menus, headers,
footers, asides, forms, scripts; adverts, notices and comments by class or id).
A frame may differ from page to page, as menus of random links do.

Articles quote and repeat each other, so a line in a marked article that a
neighbour has too is deleted only if at least USUAL_SHARE of the REACH pages on
both sides have it, and two of them. Versions of the page, which share nine
tenths of its LONG_LINEs, are no evidence for that, so an article in many
versions stays. Elsewhere a page that shares nine tenths of the shorter one's
lines is a copy and tells nothing about the frame. Lines that most of the REACH
pages on both sides have do not count for that: a page may be nearly all frame.
More than half of these pages being versions of one text look like a frame, and
what they share goes; a host of two unequal pages has no third one to tell, so
copies stay whole.

Pages of a host with equal lines are one page. Rows are numbered in order and
dealt in blocks of equal size, so a host with a third of all pages spreads over
as many tasks as its pages fill; only line hashes are sorted. A block also gets
the REACH rows before and after it, so results do not depend on where blocks
are cut.

Nulls: a null html is empty and gives an empty text; a null url is an own
empty host and path. Repeated rows come back as often as they occur. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textarrays import tidied
from tracemill.operators.batches import numbered
from tracemill.scratch import materialize, ship_package

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never article text.
FRAMES = frozenset("aside button dialog footer form head menu nav".split())
#: Words of a class, id or role that mark a frame.
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion reactions related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these, words that frame also as the first part of a name inside a marked article; there other words must be a whole name, as
#: an article has its own header, notices and shares.
ARTICLE_FRAME_WORDS = frozenset("ad ads advert advertisement advertising comment comments cookie disqus newsletter promo related sidebar sponsored".split())
#: How a line is framed: not at all, by a form alone, which may wrap a whole page, or otherwise.
OPEN, IN_FORM, FRAMED = 0, 1, 2
COPY_SHARE = 0.9
#: Pages on each side that are looked at.
REACH = 8
#: The share of these that makes a line in a marked article frame.
USUAL_SHARE = 0.75
#: Characters of a line that tells versions of an article apart from a host's short lines.
LONG_LINE = 60
#: Bytes of the shared-line bits that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
RANGE_ROWS = 1000


class Page:
    """lines: the text blocks in order; framed: how each stands in a frame; marked: whether it stands in the article element."""

    def __init__(self, source: str):
        self.lines: list[str] = []
        self.framed: list[int] = []
        self.marked: list[bool] = []
        self._parts: list[str] = []
        # open elements: name, how it or one above it frames, and whether it is in the article
        self._open: list[tuple[str, int, bool]] = []
        self._read(source)

    def _flush(self) -> None:
        if self._parts:
            line = " ".join("".join(self._parts).split())
            if line:
                _, framed, marked = self._open[-1] if self._open else ("", OPEN, False)
                self.lines.append(line)
                self.framed.append(framed)
                self.marked.append(marked)
            self._parts = []

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            m = TOKEN.search(s, at)
            if m is None:
                self._parts.append(html.unescape(s[at:]))
                break
            if m.start() > at:
                self._parts.append(html.unescape(s[at : m.start()]))
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(s, at)
                at = end.end() if end and not m[3].endswith("/") else at if m[3].endswith("/") else n
            elif name in VOID:
                if name == "br":
                    self._parts.append("\n")
                elif name in BLOCKS:
                    self._flush()
            else:
                self._begin(name, m[3])
        self._flush()

    def _begin(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
            if any(x[0] == "p" for x in self._open[-8:]):  # a block ends an open paragraph
                self._pop("p")
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._implied(name)
        _, framed, marked = self._open[-1] if self._open else ("", OPEN, False)
        if name in ("article", "main") and framed <= IN_FORM:
            framed, marked = OPEN, True
        if framed != FRAMED and name not in ("html", "body"):
            if name in FRAMES and name != "form" or (name == "header" and not marked) or (attributes.strip() and self._frame_by_attributes(attributes, marked)):
                framed = FRAMED
            elif name == "form":
                framed = FRAMED if marked else IN_FORM
        self._open.append((name, framed, marked))

    @staticmethod
    def _frame_by_attributes(attributes: str, marked: bool) -> bool:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
            if key in ("class", "id", "role"):
                for word in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                    parts = [x for x in re.split(r"[^a-z]+", word) if x]
                    if not FRAME_WORDS.isdisjoint(parts) and (not marked or len(parts) == 1 or parts[0] in ARTICLE_FRAME_WORDS):
                        return True
        return False

    def _implied(self, name: str) -> None:
        """A list item, row or cell ends the one before it in the same list or table."""
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == name:
                del self._open[k:]
                return
            if self._open[k][0] in ("ul", "ol", "dl", "table", "menu", "select") or (name in ("td", "th") and self._open[k][0] == "tr"):
                return

    def _pop(self, name: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == name:
                del self._open[k:]
                return

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        self._pop(name)

    @property
    def compared(self) -> np.ndarray:
        """Which lines are text unless the host repeats them: marked lines outside frames, or, without a mark, all outside frames."""
        framed = np.array(self.framed, np.int8)
        # without any line outside frames, forms frame nothing: the page stands in one
        outside = framed == OPEN if (framed == OPEN).any() else framed <= IN_FORM
        marked = outside & np.array(self.marked, bool)
        return marked if marked.any() else outside

    def text(self, shared: np.ndarray) -> str:
        """The article: the lines that no neighbour shares and that structure leaves."""
        return "\n\n".join(self.lines[k] for k in np.flatnonzero(self.compared & ~shared))


#: Bits of alignment rows that are kept at once; longer lists are split.
ROW_BITS = 1 << 28


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """For every prefix of y the length of its longest common subsequence with the whole of x."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for value in x:
        u = v & where.get(value, 0)
        v = ((v + u) | (v - u)) & full
    zeros = np.unpackbits(np.frombuffer((full & ~v).to_bytes(-(-len(y) // 8), "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(zeros)])


def _align(x: list[int], y: list[int], at_x: int, at_y: int, in_x: np.ndarray, in_y: np.ndarray) -> None:
    """Mark the items of a longest common subsequence: bit-parallel rows, read back from the end; lists whose rows would be too many are halved first."""
    if not x or not y:
        return
    if len(x) > 1 and len(x) * len(y) > ROW_BITS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        _align(x[:half], y[:cut], at_x, at_y, in_x, in_y)
        _align(x[half:], y[cut:], at_x + half, at_y + cut, in_x, in_y)
        return
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [full], full
    for value in x:
        u = v & where.get(value, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            in_x[at_x + i] = in_y[at_y + j] = True


def common_lines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items of both lists are in a longest common subsequence."""
    n, m = len(a), len(b)
    in_a, in_b = np.zeros(n, bool), np.zeros(m, bool)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    in_a[:head] = in_b[:head] = True
    in_a[n - tail :] = in_b[m - tail :] = True
    _align(a[head : n - tail].tolist(), b[head : m - tail].tolist(), head, head, in_a, in_b)
    return in_a, in_b


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path
    except ValueError:
        return "", url or ""


def line_hashes(pages: DataFrame) -> DataFrame:
    """page_key, host, path, alike (a digest of the rest), marked (whether an article is), lines and others of each page: hashes of the
    lines that structure leaves and of all others, the lowest bit set for long ones."""
    ship_package(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = Page(source or "")
                host, path = host_and_path(url)
                compared = page.compared
                every = np.array([((xxhash.xxh3_64_intdigest(x) - (1 << 63)) & ~1) | (len(x) >= LONG_LINE) for x in page.lines], np.int64)
                lines, others = every[compared], every[~compared]
                marked = bool(compared.any()) and page.marked[int(compared.argmax())]
                alike = xxhash.xxh3_128_digest(host.encode("utf-8", "replace") + (b"\1" if marked else b"\0") + len(lines).to_bytes(8, "little") + lines.tobytes() + others.tobytes())
                rows.append((host, path, alike, marked, lines, others))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["page_key", "host", "path", "alike", "marked", "lines", "others"])

    return pages.select("page_key", "url", "html").mapInArrow(tidied(read), "page_key long, host string, path string, alike binary, marked boolean, lines array<long>, others array<long>")


def frame_lines(lines: list[np.ndarray], marked: list[bool], own: list[bool]) -> list[np.ndarray]:
    """For each own page of a host, in order, which lines the nearest pages that are no copies have too."""
    held = [set(x.tolist()) for x in lines]
    long = [{v for v in x if v & 1} for x in held]
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    shared = [np.zeros(len(x), bool) for x in lines]
    near, lo, hi = Counter(), 0, 0
    for i in range(len(lines)):
        while hi < min(len(lines), i + REACH + 1):
            near.update(held[hi])
            hi += 1
        while lo < i - REACH:
            near.subtract(held[lo])
            lo += 1
        if not own[i]:
            continue
        n, frame = hi - lo, None
        usual = lambda v: near[v] == n >= 3 or near[v] >= max(4, n // 2 + 1)  # noqa: E731, B023
        mine = {v for v in held[i] if not usual(v)}

        def copy(j: int) -> bool:
            if marked[i]:  # noqa: B023
                both = len(long[i] & long[j])  # noqa: B023
                return both > 0 and both >= COPY_SHARE * min(len(long[i]), len(long[j]))  # noqa: B023
            both = len(mine & held[j])  # noqa: B023
            return both > 0 and both >= COPY_SHARE * min(len(mine), sum(not usual(v) for v in held[j]))  # noqa: B023

        if marked[i]:
            if all(near[v] < 3 for v in held[i]):
                continue
            others = [j for j in range(lo, hi) if j != i and not copy(j)]
            has = Counter(v for j in others for v in held[i] & held[j])
            frame = [v for v, c in has.items() if c >= max(2, USUAL_SHARE * len(others))]
            if not frame:
                continue
        for side in (range(i - 1, lo - 1, -1), range(i + 1, hi)):
            j = next((j for j in side if not copy(j)), None)
            if j is not None:
                a, b = sorted((i, j))
                if (a, b) not in pairs:
                    pairs[a, b] = common_lines(lines[a], lines[b])
                shared[i] |= pairs[a, b][i == b]
        if frame:
            shared[i] &= np.isin(lines[i], frame)
        pairs = {k: v for k, v in pairs.items() if k[1] > i}
    return shared


def shared_lines(hashed: DataFrame) -> DataFrame:
    """page_key, shared (a bit for each line, packed: lines that structure leaves, then all others) of the pages of which lines are frame."""
    spark = hashed.sparkSession
    ship_package(spark)
    one = hashed.where(F.size("lines") + F.size("others") > 0).groupBy("alike").agg(F.first("host").alias("host"), F.min(F.struct("host", "path", "page_key")).alias("place"), F.first("marked").alias("marked"), F.first("lines").alias("lines"), F.first("others").alias("others"))
    rows = numbered(one, "place").drop("place")
    blocks = F.sequence(F.floor(F.greatest(F.lit(0), F.col("row_no") - REACH) / RANGE_ROWS), F.floor((F.col("row_no") + REACH) / RANGE_ROWS))
    size = RANGE_ROWS

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row_no")
        block = key[0].as_py()
        hosts, alike, marked = (table.column(c).to_pylist() for c in ("host", "alike", "marked"))
        own = [k // size == block for k in table.column("row_no").to_pylist()]
        ends = [0, *(k for k in range(1, len(hosts)) if hosts[k] != hosts[k - 1]), len(hosts)]
        found = []
        for column, marks in (("lines", marked), ("others", [False] * len(marked))):
            lines = [np.array(x, np.int64) for x in table.column(column).to_pylist()]
            found.append([x for a, b in zip(ends[:-1], ends[1:], strict=True) for x in frame_lines(lines[a:b], marks[a:b], own[a:b])])
        shared = [np.concatenate(x) for x in zip(*found, strict=True)]
        some = [k for k in range(len(hosts)) if own[k] and shared[k].any()]
        return pa.table({"alike": pa.array([alike[k] for k in some], pa.binary()), "shared": pa.array([np.packbits(shared[k]).tobytes() for k in some], pa.binary())})

    found = rows.withColumn("block", F.explode(blocks)).groupBy("block").applyInArrow(compare, "alike binary, shared binary")
    return hashed.select("page_key", "alike").dropDuplicates(["page_key"]).join(_small(materialize(found, "frames")), "alike").select("page_key", "shared")


def _small(bits: DataFrame) -> DataFrame:
    held = bits.agg(F.coalesce(F.sum(F.octet_length("shared") + 24), F.lit(0)).alias("bytes")).first().bytes
    return F.broadcast(bits) if held <= BROADCAST_BYTES else bits


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, and how many of its lines differencing deleted and only structure did; see the module's head."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    small = _small(materialize(shared_lines(materialize(line_hashes(rows), "lines")), "shared"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, differenced, structural = [], [], []
            for source, bits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = Page(source or "")
                compared = page.compared
                shared = np.zeros(len(page.lines), bool)
                if bits:
                    flags = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(shared)].astype(bool)
                    shared[np.concatenate([np.flatnonzero(compared), np.flatnonzero(~compared)])] = flags
                texts.append(page.text(shared))
                differenced.append(int(shared.sum()))
                structural.append(int((~compared & ~shared).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(differenced, pa.int64()), pa.array(structural, pa.int64())], ["page_id", "url", "text", "n_chars", "n_differenced", "n_structural"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.join(small, "page_key", "left").select("page_id", "url", "html", "shared").mapInArrow(tidied(extract), f"page_id {kind}, url string, text string, n_chars long, n_differenced long, n_structural long")
