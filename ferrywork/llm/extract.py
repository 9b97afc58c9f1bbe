"""Main text of web pages by differencing pages of neighbouring URLs.

Pages are sorted by host and URL path over all tasks, so that a host of any size is spread and neighbours lie side by side.  Each
page is aligned with the nearest pages before and after it on its host whose lines differ, line by line, by the longest common subsequence; lines that both have are
furniture of the site and go.  Where a neighbour shares most lines of a page, the nearest page beyond it that shares fewer is asked too: what the neighbour
shares beyond that furniture is a copy, which tells nothing, if it is most of what remains.
Markup says the rest: elements that are menus, forms, comments and the like are left out; within an article,
paragraphs, headings and list items stay even when a neighbour repeats them (a licence line belongs to its text), other lines go as outside.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.frames import SLICE_BYTES, rows_of, slices, written
from ferrywork.llm.urlfilter import parts

# HTML's element kinds, and words that name furniture in class, id and role.
_TAG = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(%s)>"
# A quoted value may hold the sign that ends a tag; the second form is for a page whose quotes do not close.
TOKEN = re.compile(_TAG % r"(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+", re.S)
PLAIN = re.compile(_TAG % "[^>]*", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas", "math"}
OFF = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "header"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "tr"}
BLOCKS = TEXT_BLOCKS | OFF | MAIN | {"div", "section", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "body", "html", "figure", "address", "hr", "br", "details", "summary", "fieldset"}
FURNITURE = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice notices popup modal "
    "comment comments replies reply disqus share sharing social related breadcrumb breadcrumbs newsletter subscribe signup login search contentinfo complementary dialog toolbar pagination pager widget".split()
)
#: Names that an article's own parts bear too.
HEADS = {"header", "masthead", "banner"}
COPY_SHARE, BOUND_ROWS, RANGES, TABLE_BITS = 0.8, 50, 4, 1 << 28
ORDER = ("host", "path", "page_id")
ZONES = {"t": "text", "l": "loose", "o": "open"}


def _named_furniture(attributes: str, inside: bool) -> bool:
    """Whether class, id or role names furniture: by any word of a name outside an article, by a whole name inside one."""
    for found in NAMED.finditer(attributes):
        value = (found[1] or found[2] or found[3] or "").lower()
        names = set(value.split()) - HEADS if inside else set(re.split(r"[^a-z]+", value))
        if names & FURNITURE:
            return True
    return False


class _Open:
    """Elements that are open, with their zones, and how many there are of each name."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.count: dict[str, int] = {}
        self.mains = self.texts = 0

    @property
    def zone(self) -> str:
        return self.stack[-1][1] if self.stack else "open"

    def push(self, tag: str, zone: str) -> None:
        self.stack.append((tag, zone))
        self._counted(tag, 1)

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self._counted(tag, -1)
        return tag

    def close(self, tag: str) -> None:
        """Close the innermost element of this name and what is open in it; a close without one is passed over."""
        while self.count.get(tag) and self.pop() != tag:
            pass

    def _counted(self, tag: str, step: int) -> None:
        self.count[tag] = self.count.get(tag, 0) + step
        self.mains += step * (tag in MAIN)
        self.texts += step * (tag in TEXT_BLOCKS)


def lines_of(page: str) -> list[tuple[str, str]]:
    """Blocks of a page in order, as ``(zone, text)``; furniture by markup is left out.

    Zones: ``text`` in an article's text elements, ``loose`` elsewhere in an article and in its text elements that bear a name of furniture, ``open`` outside.
    One pass forward: a page of any length, however deep its elements and wherever its tags and quotes fail to close, takes time in proportion to its length.
    """
    open_, out, pending = _Open(), [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        pending.clear()
        here = open_.zone
        if text and here != "off":
            if here in ("main", "doubt"):
                here = "text" if here == "main" and open_.texts else "loose"
            out.append((here, text))

    at, size, pattern, last = 0, len(page), TOKEN, page.rfind(">")
    while at < size:
        begin = page.find("<", at)
        if begin < 0 or begin > last:  # no tag ends after this
            if begin >= 0 and page.startswith("<!--", begin):
                size = begin
            pending.append(page[at:size])
            break
        found = pattern.match(page, begin)
        if not found and pattern is TOKEN and re.compile("</?[a-zA-Z]").match(page, begin):
            pattern = PLAIN
            found = pattern.match(page, begin)
        pending.append(page[at : begin if found else begin + 1])
        at = found.end() if found else begin + 1
        if not found or not found[2]:
            continue
        tag, closing, attributes = found[2].lower(), bool(found[1]), found[3]
        if tag in HIDDEN and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last + 1)
                at = end.end() if end else size
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if closing:
            open_.close(tag)
            continue
        if tag in BLOCKS and tag not in ("td", "th"):
            if open_.stack and open_.stack[-1][0] == "p":  # a block ends an open paragraph
                open_.pop()
            if tag == "li" and open_.stack and open_.stack[-1][0] == "li":
                open_.pop()
        here, inside = open_.zone, open_.mains > 0
        if here != "off":
            if tag in MAIN:
                here = "main"
            elif tag in OFF and not (tag == "header" and inside):
                here = "off"
            if tag not in ("html", "body", *MAIN) and attributes and _named_furniture(attributes, inside):
                here = "doubt" if inside and tag in TEXT_BLOCKS and here != "off" else "off"
        if tag in BLOCKS or here != open_.zone:
            open_.push(tag, here)
    flush()
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b``."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for line in a:
        u = row & where.get(line, 0)
        row = ((row + u) | (row - u)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in ``a`` and in ``b`` of one longest common subsequence, by bit-parallel rows.

    Where the rows would take too much memory, ``a`` is halved and ``b`` cut where the halves' subsequences are longest together.
    """
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        (left, right), (later, after) = common(a[:half], b[:cut]), common(a[half:], b[cut:])
        return left | {i + half for i in later}, right | {j + cut for j in after}
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for line in a:
        u = row & where.get(line, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    left, right, i, j = set(), set(), len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            left.add(i)
            right.add(j)
    return left, right


def _share(own: list, other: list) -> bool:
    """Whether ``other`` has so many lines of ``own`` that it may be a copy."""
    return len(common(own, other)[0]) > COPY_SHARE * len(own)


def furniture(own: list, partners: list[list]) -> set[int]:
    """Positions of the lines of ``own`` that ``partners`` show to be furniture.

    The partner with the fewest common lines goes first.  Each other one is a copy, and left out, if it shares most of what remains on either page.
    Where every partner may be a copy, the lines are taken as furniture all the same, unless fewer than two lines would remain (an edited copy).
    """
    found = sorted(((common(own, other)[0], other) for other in partners), key=lambda x: len(x[0]))
    found = [x for x in found if x[0]]
    if not found:
        return set()
    known = found[0][0]
    if len(known) > COPY_SHARE * len(own) and len(own) - len(known) < 2:
        return set()
    for shared, other in found[1:]:
        lines = {own[k] for k in known}
        rest = min(len(own) - len(known), sum(line not in lines for line in other))
        if len(shared - known) <= COPY_SHARE * rest:
            known = known | shared
    return known


class _Run:
    """Pages that follow each other with the same lines: ``left`` and ``right`` are the lines of their partners."""

    def __init__(self, host: str, lines: list, before: _State | None):
        self.host, self.lines, self.pages, self.right = host, lines, [], []
        self.state = reached(before, lines)
        _, near, far = self.state
        self.left = [] if near is None else [near, far] if far is not None and _share(lines, near) else [near]


# Of the last run of a host so far: its lines, those of the run before it, and those of the nearest run before that one which is no copy of it.
_State = tuple[list, list | None, list | None]


def reached(state: _State | None, lines: list) -> _State:
    """The state after one more page with ``lines``."""
    if state is None:
        return lines, None, None
    last, near, far = state
    if last == lines:
        return state
    return lines, last, far if near is None or _share(last, near) else near


def _edge(runs: list[list]) -> tuple:
    """The first run, and the state after all ``runs`` of a host as far as these alone tell it."""
    if len(runs) == 1:
        return runs[0], runs[0], None, None
    far = next((runs[k - 1] for k in range(len(runs) - 2, 0, -1) if not _share(runs[k], runs[k - 1])), None)
    return runs[0], runs[-1], runs[-2], far


def _carried(parts: list[tuple[str, tuple, str, tuple, bool]]) -> list[_State | None]:
    """The state that each part finds before it, from ``(first host, its edge, last host, its edge, whether that is the same stretch)`` of all."""
    found, host, state = [], None, None
    for first_host, first_edge, last_host, last_edge, single in parts:
        before = state if first_host and first_host == host else None
        found.append(before)
        first, last, near, far = last_edge
        if single and before is not None:
            begun = reached(before, first)
            # Where no run of the part but the first has a partner that is no copy, that of the first one holds.
            state = begun if near is None else (last, near, far if far is not None else reached(begun, [None])[2])
        else:
            state = (last, near, far)
        host = last_host
    return found


def _judged(lines: list[tuple[str, str]], shared: set[int]) -> str:
    article = any(zone in ("text", "loose") for zone, _ in lines)
    wanted = {"text", "loose"} if article else {"open"}
    return "\n".join(text for k, (zone, text) in enumerate(lines) if zone in wanted and (zone == "text" or k not in shared))


def _line_hashes(lines: str) -> list[int]:
    return [xxhash.xxh64_intdigest(x) for x in lines.split("\n")] if lines else []


def _signed(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text), signed=True)


def _ranges(lines: DataFrame) -> tuple[list[tuple], int]:
    """Bounds that part the pages by host and path into ranges of about equal size, and the number of tasks: each gets some ranges."""
    count = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, lines.count() // (count * BOUND_ROWS))
    keys = lines.where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(step)) == 0).select(*ORDER).collect()
    keys = sorted((r.host.encode(), r.path.encode(), r.page_id is not None, r.page_id or 0) for r in keys)
    return sorted({keys[len(keys) * k // (RANGES * count)] for k in range(1, RANGES * count)} if keys else set()), count


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of each row of ``pages``.

    Null and empty pages give an empty text.  Pages without host are not paired.  Repeated rows are kept; copies of each other delete nothing and have the same partners.
    A page that is alone on its host has no partner.  The answer does not depend on how pages are dealt to tasks: what lies before and after each range of
    pages is found first, from hashes of lines.  Other columns are not read.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url").cast("string"))
    source = pages.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = pa.schema([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("zones", pa.string()), ("lines", pa.string()), ("tie", pa.int64())])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def parse(batches):
        for part in slices(batches, "html"):
            found = [lines_of(page or "") for page in part.column("html").to_pylist()]
            # A line holds no white space but single blanks.
            texts = ["\n".join(text for _, text in x) for x in found]
            yield rows_of(parsed, [*[part.column(c) for c in ("host", "path", "page_id", "url")], ["".join(zone[0] for zone, _ in x) for x in found], texts, [_signed(t) for t in texts]])

    lines = written(source.mapInArrow(parse, "host string, path string, page_id long, url string, zones string, lines string, tie long"), "page_lines")
    bounds, count = _ranges(lines)

    def ranged(columns: list[str], packed) -> DataFrame:
        """``columns`` and the packed lines of the pages of a range in order, the number of the range first; pages of one key are in the order of their lines."""
        columns = [*columns, "lines"]
        marked = pa.schema([("part", pa.int32()), *[parsed.field(c) for c in (*ORDER, "tie", *columns)]])
        marked = marked.set(len(marked) - 1, pa.field("lines", pa.binary()))

        def mark(batches):
            for batch in slices(batches, "lines"):
                at = {c: batch.column(c) for c in batch.schema.names}
                at["lines"] = [packed(x) for x in at["lines"].to_pylist()]
                keys = zip(*[at[c].to_pylist() for c in ORDER])
                number = [bisect_right(bounds, (h.encode(), p.encode(), k is not None, k or 0)) for h, p, k in keys]
                yield rows_of(marked, [number, *[at[c] for c in (*ORDER, "tie", *columns)]])

        kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
        dealt = lines.select(*ORDER, "tie", *columns).mapInArrow(mark, ", ".join(f"`{f.name}` {kinds[f.type]}" for f in marked))
        return dealt.repartition(count, "part").sortWithinPartitions("part", *ORDER, "tie", *[c for c in columns if c != "lines"])

    def stretches(batches):
        """For each range: the edges of the first and of the last host, forwards and backwards."""

        def closed():
            if part is not None:
                head = first if first is not None else runs
                forward = (first_host, _edge(head), host, _edge(runs), first is None)
                backward = (host, _edge(runs[::-1]), first_host, _edge(head[::-1]), first is None)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps((forward, backward))], pa.binary())], names=["part", "edges"])

        part, host, first_host, first, runs = None, None, None, None, []
        for batch in batches:
            for number, own, hashes in zip(*[batch.column(c).to_pylist() for c in ("part", "host", "lines")]):
                now = list(array("Q", hashes))
                if not now:
                    continue
                if number != part:
                    yield from closed()
                    part, host, first_host, first, runs = number, own, own, None, [now]
                elif own != host:
                    first = runs if first is None else first
                    host, runs = own, [now]
                elif not own:
                    runs = [now]
                elif runs[-1] != now:
                    runs.append(now)
        yield from closed()

    def run(batches):
        done, size, last, waiting, part = [], 0, None, [], None

        def finish(runs) -> None:
            nonlocal size
            for x in runs:
                shared = furniture(x.lines, x.left + x.right) if x.host else set()
                for page_id, url, zones, whole in x.pages:
                    done.append((page_id, url, _judged(list(zip(map(ZONES.get, zones), whole.split("\n"))), shared)))
                    size += len(done[-1][2])

        def close() -> None:
            """The last runs of a range, by what lies after it."""
            if last is None:
                return
            after = around.value[part][1] if last.host else None
            for x in [last, *waiting[::-1]]:
                after = reached(after, x.lines)
                x.right = [] if after[1] is None else [after[1], after[2]] if after[2] is not None and _share(x.lines, after[1]) else [after[1]]
            finish([*waiting, last])

        for batch in slices(batches, "lines", SLICE_BYTES // 4):
            for number, host, page_id, url, zones, lines in zip(*[batch.column(c).to_pylist() for c in ("part", "host", "page_id", "url", "zones", "lines")]):
                whole = zlib.decompress(lines).decode()
                now = _line_hashes(whole)
                if not now:  # it tells nothing of others
                    done.append((page_id, url, ""))
                    continue
                if number != part or last.host != host or last.lines != now:
                    before = None
                    if number != part:
                        close()
                        waiting, part = [], number
                        before = around.value[part][0] if host else None
                    elif host and last.host == host:
                        # Runs wait for a page after them that is no copy.
                        before = last.state
                        last.right.append(now)
                        waiting.append(last)
                        if not _share(last.lines, now):
                            for x in waiting[:-1]:
                                x.right.append(last.right[0])
                            finish(waiting)
                            waiting = []
                    else:
                        finish([*waiting, last])
                        waiting = []
                    last = _Run(host, now, before)
                last.pages.append((page_id, url, zones, whole))
                if size > 1 << 20:
                    yield rows_of(schema, list(zip(*done)))
                    done, size = [], 0
        close()
        if done:
            yield rows_of(schema, list(zip(*done)))

    edges = sorted((r.part, *pickle.loads(r.edges)) for r in ranged([], lambda x: array("Q", _line_hashes(x)).tobytes()).mapInArrow(stretches, "part int, edges binary").collect())
    forward, backward = _carried([f for _, f, _ in edges]), _carried([b for _, _, b in edges[::-1]])[::-1]
    around = spark.sparkContext.broadcast({number: (f, b) for (number, _, _), f, b in zip(edges, forward, backward)})
    return ranged(["url", "zones"], lambda x: zlib.compress(x.encode(), 1)).mapInArrow(run, "page_id long, url string, text string")
