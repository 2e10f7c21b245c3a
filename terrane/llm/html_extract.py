"""Main text of web pages by nearest-URL page differencing.

Pages are read into text lines, one a block. Each page is paired with the page of its host whose URL path is nearest (the longest
common prefix among the neighbours in path order) and which is no near copy; both pages' lines are aligned by their longest common
subsequence, and shared lines, the template's, are deleted.

Copies: in path order, pages with equal lines, and those of one URL that share half of their lines, make a run, which counts once; the
``NEIGHBOURS`` nearest runs of the host are compared. Of these, one is a near copy if it shares over half of the page's lines beyond what
the middle one of them shares (a template is shared with most); one by itself, if it shares over ``COPY`` of the lines. A page
whose neighbours are all near copies keeps its lines.

Structure breaks ties, as sites repeat passages of their articles and change their adverts from page to page:

* a page without an ``article`` or ``main`` element is judged by differencing alone;
* lines in an ``article`` (else ``main``) element stay, whoever shares them;
* lines outside it go, as do navigation, headers, footers, asides, forms, adverts, notices and reader comments (by element, role, class
  or id): names that hold such a word, and beside it only parts that say no more (``site-footer`` and ``ad-slot-3``, but not ``tag-social``);
  within an article fewer words mark. Headings and the article itself are never marked.

Only URLs and line hashes are sorted to find neighbours: by range over all pages, so that a large host is spread over many tasks; runs are
numbered throughout. Pages then stream past the first pages of the runs around them, in blocks of ``BLOCK`` runs, which are
parted further where copies make one large. Only verdicts that delete lines meet the HTML again.

Cases: null and empty pages, and those without text, give an empty text; a null URL has an empty host and path (pages of
the empty host have no neighbour, pages without text are none); repeated rows give equal rows; unclosed elements end where the page ends, and skipped ones where
HTML implies their end (a ``p`` at the next block, an ``li`` at the next one, all at their parent's end) or at the next ``article`` or ``main``.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.store import materialise, scratch
from terrane.llm.url_filter import host_of, path_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|iframe|textarea|select|title|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("nav footer aside form menu dialog button head".split())
_SPOKEN = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Words of class, id and role attributes that mark what isn't the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer gdpr masthead menu menubar nav navbar navigation newsletter notice pagination pager popup promo promoted related search share sharing "
    "sidebar social sponsor sponsored subscribe toolbar topbar contentinfo complementary".split()
)
# Further parts of names that hold one of these words and say no more.
_PARTS = frozenset(
    "area article bar block body bottom box btn button buttons content container div form group header inner item items left li link links list main meta "
    "nav outer page panel post posts primary right row section secondary signup site slot top unit widget widgets wrap wrapper".split()
)
_COMMENTS = frozenset("comment comments disqus".split())
# Words that mark an advert, a notice or a comment block within an article, and for classes, shares and navigation.
_BLOCKS = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner cookie cookies consent gdpr newsletter notice popup promo promoted sponsor sponsored subscribe".split()
)
_BARS = frozenset("breadcrumb breadcrumbs footer masthead menubar nav navbar navigation pagination pager share sharing sidebar toolbar topbar".split())
_LANDMARKS = frozenset("banner complementary contentinfo menu menubar navigation search toolbar".split())
_UNMARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z0-9]+")

# Open elements that a start tag ends, unless one of the second group was opened after them.
_PARAGRAPH = (("p",), ())
_LIST, _TERM, _CELL, _ROW, _ROWS = (("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("td", "th"), ("table", "tr")), (("tr",), ("table",)), (("thead", "tbody", "tfoot"), ("table",))
_ENDS = {x: [_PARAGRAPH] for x in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
_ENDS |= {"li": [_PARAGRAPH, _LIST], "dt": [_PARAGRAPH, _TERM], "dd": [_PARAGRAPH, _TERM], "td": [_CELL], "th": [_CELL], "tr": [_ROW], "thead": [_ROWS], "tbody": [_ROWS], "tfoot": [_ROWS]}

INSIDE, OUTSIDE, DROPPED = 1, 0, -1
NEIGHBOURS, COPY = 6, 0.8
#: Runs in a block, and about the most pages of a block that one task takes.
BLOCK, PAGES = 2000, 20_000


def _names(attributes: str) -> Iterator[tuple[str, str]]:
    """Attribute and name, each class by itself, in small letters."""
    if "=" in attributes:
        for found in _SPOKEN.finditer(attributes):
            kind, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
            for name in value.split() if kind == "class" else [value.strip()]:
                yield kind, name


def _says(name: str, words: frozenset) -> bool:
    """Whether a name holds one of the words and beside them only parts that say no more."""
    parts = [x for x in _SPLIT.split(name) if x]
    return not words.isdisjoint(parts) and all(x in words or x in _PARTS or x in _MARKS or x.isdigit() for x in parts)


def _marked(element: str, attributes: str, within: bool) -> bool:
    if element in _UNMARKED:
        return False
    if within:
        return any(n in _LANDMARKS if k == "role" else _says(n, _BLOCKS) or k == "class" and _says(n, _BARS) for k, n in _names(attributes) if k != "aria-label")
    return any(_says(n, _MARKS) for _, n in _names(attributes))


def _reader_comment(attributes: str) -> bool:
    return any(_says(n, _COMMENTS) for k, n in _names(attributes) if k != "aria-label")


class _Open:
    """The stack of open elements, with the places of each name."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.places: dict[str, list[int]] = {}

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()].pop()

    def start(self, name: str) -> None:
        for ended, barred in _ENDS.get(name, ()):
            place = self.last(ended)
            if place > self.last(barred):
                self.cut(place)

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(name)

    def end(self, name: str) -> None:
        if self.places.get(name):
            self.cut(self.places[name][-1])


def lines_of(html: str, structure: bool = True) -> tuple[list[str], list[int]]:
    """Text of each block in page order, and whether it is inside the article, outside any, or dropped for where it stands.

    Without ``structure`` no line is inside or dropped.
    """
    found: list[tuple[str, bool, bool, bool]] = []
    pending: list[str] = []
    skip, level = "", 0  # the skipped element and its place among the open ones
    tree = _Open()
    articles = mains = 0
    at = 0

    def flush() -> None:
        text = " ".join(unescape("".join(pending)).split())
        pending.clear()
        if text:
            found.append((text, bool(skip), articles > 0, mains > 0))

    for token in _TOKEN.finditer(html):
        pending.append(html[at : token.start()])
        at = token.end()
        name = (token[3] or token[6] or "").lower()
        if not name:
            continue
        closing = bool(token[2] or token[5])
        if name == "br":
            pending.append(" ")
            continue
        attributes = token[4] or token[7] or ""
        within = articles > 0 or mains > 0
        if name in _INLINE and name != skip and (not tree.places.get(name) if closing else not _marked(name, attributes, within)):
            continue
        flush()
        holds = not closing and name not in _VOID and not attributes.endswith("/")
        comment = name == "article" and holds and (articles > 0 or bool(skip)) and _reader_comment(attributes)
        if closing:
            tree.end(name)
        else:
            tree.start(name)
        if skip and (len(tree.stack) <= level or name in ("article", "main") and not closing and not comment):
            own = closing and len(tree.stack) == level  # else an unclosed skipped element ends here
            skip = ""
            tree.cut(level)
            if own:
                continue
        if skip:
            if holds:
                tree.push(name)
            continue
        if holds:
            if comment or name in _SKIPPED or name == "header" and not within or _marked(name, attributes, within):
                skip, level = name, len(tree.stack)
                tree.push(name)
                continue
            tree.push(name)
        if name == "article":
            articles = max(0, articles + (-1 if closing else 1))
        elif name == "main":
            mains = max(0, mains + (-1 if closing else 1))
    pending.append(html[at:])
    flush()
    home = 2 if any(x[2] and not x[1] for x in found) else 3 if any(x[3] and not x[1] for x in found) else 0
    zones = [OUTSIDE if not structure else DROPPED if x[1] else (INSIDE if x[home] else DROPPED) if home else OUTSIDE for x in found]
    return [x[0] for x in found], zones


def _vectors(a: list, b: list) -> list[int]:
    """Bit-parallel longest common subsequence: after each element of b, zero bits are where the length grows along a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _zeros(v: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_lines(a: list, b: list, most_bits: int = 1 << 28) -> list[int]:
    """Indices in ``a`` of one longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = list(range(head)) + list(range(len(a) - tail, len(a)))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if a and b:
        found += [head + i for i in _aligned(a, b, most_bits)]
    return sorted(found)


def _aligned(a: list, b: list, most_bits: int) -> list[int]:
    if len(a) * len(b) > most_bits and len(b) > 1:  # halves of b, each with its part of a: memory stays linear
        half = len(b) // 2
        before = _zeros(_last(a, b[:half]), len(a))
        after = _zeros(_last(a[::-1], b[half:][::-1]), len(a))[::-1]
        cut = int(np.argmax(before + after))
        return (_aligned(a[:cut], b[:half], most_bits) if cut else []) + ([cut + i for i in _aligned(a[cut:], b[half:], most_bits)] if cut < len(a) else [])
    rows, out = _vectors(a, b), []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not (j and not rows[j - 1] >> (i - 1) & 1):
            i -= 1
            out.append(i)
    return out[::-1]


def _last(a: list, b: list) -> int:
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return v


def _read(structure: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [lines_of(html or "", structure) for html in batch.column(4).to_pylist()]
            hashes = [[xxhash.xxh64_intdigest(line) - 2**63 for line in lines] for lines, _ in read]
            zones = [bytes(z + 1 for z in zones) for _, zones in read]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.list_(pa.int64())), pa.array(zones, pa.binary())], ["key", "host", "path", "page", "lines", "zones"])

    return run


_SLIM = "key binary, host string, path string, page long, lines array<long>, zones binary"
_FLAGGED = f"{_SLIM}, range int, run long, first boolean, start boolean, last boolean"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in path order with the number of their run in this range, repeated rows left out. Whether the first page starts a run isn't known yet."""
    part, run = TaskContext.get().partitionId(), 0
    before = None
    names = [c.split()[0] for c in _FLAGGED.split(", ")]
    kinds = [pa.binary(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if before is None:
                before = (*row, part, 0, True, None)
                continue
            if row[:4] == before[:4]:
                continue
            copy = row[1] == before[1] and (row[4] == before[4] or row[3] == before[3] and 2 * len(set(row[4]) & set(before[4])) >= max(len(set(row[4])), len(set(before[4]))))
            run += not copy
            rows.append((*before, False))
            before = (*row, part, run, False, not copy)
        if rows:
            yield sent(rows)
    if before is not None:
        yield sent([(*before, True)])


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _around(own: list, reps: list[tuple]) -> list[tuple[int, str, list, list]]:
    """Of the neighbours that are no near copies: off, path, lines, and the line numbers that they share."""
    met = [(*r, shared_lines(own, r[2])) for r in reps if r[2] != own]
    counts = sorted(len(m[3]) for m in met)
    if not counts:
        return []
    usual = counts[(len(counts) - 1) // 2]
    most = COPY * len(own) if len(counts) == 1 else usual + (len(own) - usual) / 2
    return [m for m in met if len(m[3]) <= most]


def gone_lines(path: str, own: list, zones: bytes, reps: list[tuple]) -> list[int]:
    """Numbers of the lines that differencing deletes; ``reps``: offset of the run, path and lines of each neighbour, the nearest first."""
    near = _around(own, reps) if OUTSIDE + 1 in zones else []
    if not near:
        return []
    shared = max(near, key=lambda n: _common(path, n[1]))[3]  # of those as near the closest in path order, the one before first
    return [i for i in shared if zones[i] == OUTSIDE + 1]


_BLOCKED = "block long, salt int, at long, kind int, run long, key binary, host string, path string, lines array<long>, zones binary"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams pages past the first pages of the runs around them, which come ``NEIGHBOURS`` runs ahead."""
    place, reps = None, deque()
    for batch in batches:
        keys, gone = [], []
        for block, salt, at, kind, run, key, host, path, lines, zones in zip(*(c.to_pylist() for c in batch.columns)):
            if place != (block, salt):
                place, reps = (block, salt), deque()
            while reps and reps[0][0] < at - NEIGHBOURS:
                reps.popleft()
            if kind == 0:
                reps.append((run, host, path, lines))
                continue
            near = sorted(((r[0] - run, r[2], r[3]) for r in reps if r[1] == host and r[0] != run), key=lambda r: (abs(r[0]), r[0]))
            found = gone_lines(path, lines, zones, near[:NEIGHBOURS])
            if found:
                keys.append(key)
                gone.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])


def _write(structure: bool):
    def write(htmls: pa.Array, deleted: pa.Array) -> pa.Array:
        out = []
        for html, gone in zip(htmls.to_pylist(), deleted.to_pylist()):
            lines, zones = lines_of(html or "", structure)
            gone = set(gone or ())
            out.append("\n".join(x for i, (x, zone) in enumerate(zip(lines, zones)) if zone != DROPPED and i not in gone))
        return pa.array(out, pa.string())

    return write


def _runs(slim: DataFrame) -> DataFrame:
    """Pages with the number of their run among all runs in path order, and whether they are the first of it."""
    order = ["host", "path", "page", "key"]
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = materialise(slim.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_numbered, _FLAGGED), "flagged")
    # A row of numbers for each range, and two pages each: the last one before a range tells whether its first one starts a run.
    ranges = flagged.groupBy("range").agg(F.sum(F.col("start").cast("long")).alias("n")).withColumn("before", F.lag("range").over(Window.orderBy("range")))
    heads = flagged.where("first").select("range", "host", "page", "lines").join(ranges, "range")
    tails = flagged.where("last").select(F.col("range").alias("before"), *[F.col(c).alias(f"_{c}") for c in ("host", "page", "lines")])
    shared = F.size(F.array_intersect("lines", "_lines"))
    version = (F.col("_page") == F.col("page")) & (2 * shared >= F.greatest(F.size(F.array_distinct("lines")), F.size(F.array_distinct("_lines"))))
    copy = (F.col("_host") == F.col("host")) & ((F.col("_lines") == F.col("lines")) | version)
    heads = heads.join(tails, "before", "left").select("range", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce(copy, F.lit(False)), 0).otherwise(1).alias("head"))
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = materialise(heads.withColumn("offset", F.sum(F.col("n") + F.col("head")).over(along) - F.col("n")).select("range", "head", "offset"), "offsets")
    met = flagged.join(offsets, "range")
    return met.select("key", "host", "path", "lines", "zones", (F.col("run") + F.col("offset")).alias("run"), F.coalesce("start", F.col("head") == 1).alias("start"))


def deleted_lines(pages: DataFrame, structure: bool = True) -> DataFrame:
    """key and gone, the numbers of the lines that differencing deletes, of pages (key, url, html) that lose some."""
    parts = pages.select("key", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), F.xxhash64("url").alias("page"), "html")
    slim = materialise(parts.where("host <> ''").mapInArrow(_read(structure), _SLIM).where("size(lines) > 0"), "lines")
    runs = _runs(slim).withColumn("block", F.expr(f"run div {BLOCK}"))
    sizes = materialise(runs.groupBy("block").agg(F.ceil(F.count("*") / PAGES).cast("int").alias("salts")), "sizes")
    rows = runs.join(sizes, "block").select("block", F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"), F.col("run").alias("at"), F.lit(1).alias("kind"), "run", "key", "host", "path", "lines", "zones")
    near = F.expr(f"sequence((run - {NEIGHBOURS}) div {BLOCK}, (run + {NEIGHBOURS}) div {BLOCK})")
    reps = runs.where("start").withColumn("block", F.explode(near)).join(sizes, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None).cast("binary")
    reps = reps.select("block", "salt", (F.col("run") - NEIGHBOURS).alias("at"), F.lit(0).alias("kind"), "run", none.alias("key"), "host", "path", "lines", none.alias("zones"))
    blocked = rows.unionByName(reps).repartition("block", "salt").sortWithinPartitions("block", "salt", "at", "kind", "run")
    return blocked.mapInArrow(_judged, "key binary, gone array<int>")


def extract(pages: DataFrame, structure: bool = True) -> DataFrame:
    """Add text, the main text, to every row (a column of this name is replaced). Without ``structure``, by differencing alone."""
    row = F.concat_ws("|", F.col("page_id").cast("string"), F.coalesce("url", F.lit("\0")), F.coalesce("html", F.lit("\0")))
    keyed = pages.withColumn("_key", F.unhex(F.md5(row.cast("binary"))))
    with scratch(pages.sparkSession):
        verdicts = materialise(deleted_lines(keyed.select(F.col("_key").alias("key"), "url", "html"), structure), "verdicts", keep=True)
    met = keyed.join(verdicts.select(F.col("key").alias("_key"), F.col("gone").alias("_gone")), "_key", "left")
    return met.withColumn("text", F.arrow_udf(_write(structure), "string")("html", "_gone")).drop("_key", "_gone")
