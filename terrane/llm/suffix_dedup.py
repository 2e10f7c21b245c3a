"""Exact substring deduplication by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of ``length`` bytes around it also starts anywhere else. Sorting every suffix would move the corpus hundreds
of times, so the suffixes to sort are thinned in a way that depends on content alone: among the ``length - gram + 1`` grams of
``gram`` bytes in a window of ``length`` bytes, those of the smallest hash are anchors. Equal windows have equal anchors at equal
offsets, so every repeated window shows as two anchors with a common gram, whose suffixes agree to the right and whose
reversed prefixes agree to the left.

1. Anchors of every text; those whose gram occurs once go (a count by hash).
2. Tasks cut the remaining anchors' suffixes (``length`` bytes) and left contexts, sort them to runs, and front-code them: each
   entry is sent as the number of bytes that it shares with the one before it, and the rest. Equal contexts within a task are
   sent once. Runs are dealt by hash of the gram.
3. Runs are merged by a loser tree whose nodes keep known common prefixes, so that no known byte is compared again; the merged
   common prefixes give, with those of the sorted left contexts, the repeated windows of every anchor.
4. Windows are joined per text, and their bytes removed.

A gram that more than ``hot`` anchors share is split before its merge: the offsets that the anchor may have in a window are halved, and
for each half the group is known by all bytes that every window of that half holds around the anchor (more of the suffix to
the right, more of the context to the left). Contexts cut to what the windows of a half can see that are equal are all repeated, and one
of them (by BLAKE2 digest, in a shuffled aggregation) speaks for all. Halves with too many different contexts are split again,
down to one offset, where a context is one window; groups small enough are merged as above.

Where a text repeats a period of fewer bytes than its windows have anchors, each window of the stretch is repeated one period on:
the stretch goes as a whole (its bytes are compared), and only anchors near its two ends stay, which have all its different windows. So
the anchors of a text are few however often it repeats itself.

Texts are taken by their MD5, so exact copies do the work once; all copies of a text of ``length`` bytes or more are removed whole.

Cases: null and empty texts have no bytes and no spans; shorter texts lose nothing; repeated rows are copies of each other;
overlapping occurrences in one text count; a very long text is held as a whole, its anchors are found in pieces; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import materialise, scratch
from terrane.llm.text import as_bytes, list_array, mix

LENGTH, GRAM = 400, 128
#: Anchors that meet in one group of the merge, about; and the most of one gram (some 40 MB of contexts), beyond which it is split.
GROUP, HOT = 20_000, 50_000
#: Bytes of a text that are scanned at a time, bytes of contexts in one sorted run, and anchors or rows that leave a task at a time.
PIECE, RUN_BYTES, SENT = 1 << 19, 24 << 20, 50_000

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over each window of ``width`` values."""
    span, out = 1, x
    while 2 * span <= width:
        out = best(out[: len(out) - span], out[span:])
        span *= 2
    return best(out[: len(x) - width + 1], out[width - span :][: len(x) - width + 1])


def _periodic(part: np.ndarray, at: np.ndarray, codes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors stay, and stretches of one period: anchors of one gram at equal distances whose bytes agree one distance on."""
    keep, runs = np.ones(len(at), bool), []
    gaps = np.where(codes[1:] == codes[:-1], np.diff(at), 0)
    edges = np.flatnonzero(np.diff(gaps, prepend=-1, append=-1))
    for i, j in zip(edges[:-1], edges[1:]):
        period = int(gaps[i])
        begin, end = int(at[i]), int(at[j]) + gram
        if period and end - begin > 2 * length + period:
            own = part[begin:end]
            if np.array_equal(own[period:], own[:-period]):
                runs.append((begin, end))
                keep[(at >= begin + period + length) & (at < end - length)] = False
    return keep, runs


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Positions and gram hashes of a text's anchors, and stretches of which every window is repeated in the stretch itself."""
    found, codes, runs = [], [], []
    width = length - gram + 1
    for begin in range(0, max(0, len(text) - length + 1), PIECE):
        part = np.frombuffer(text[begin : begin + PIECE + length - 1], np.uint8)
        code, span = _BYTE[part], 1
        parts, at, rest = None, 0, gram
        while rest:  # the gram as pieces of powers of two
            if rest & 1:
                n = len(part) - gram + 1
                own = code[at : at + n]
                parts = own.copy() if parts is None else parts * np.uint64(0xD6E8FEB86659FD93) + own
                at += span
            rest >>= 1
            if rest:
                code = code[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + code[span:]
                span *= 2
        code = mix(parts)
        low = _slide(code, width, np.minimum)
        padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_slide(padded, width, np.maximum) == code)
        keep, own = _periodic(part, chosen, code[chosen], length, gram)
        chosen = chosen[keep]
        found.append(chosen + begin)
        codes.append(code[chosen])
        runs += [(a + begin, b + begin) for a, b in own]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(codes)[first], runs


def _context(text: bytes, at: int, length: int, low: int, high: int) -> tuple[bytes, bytes]:
    """What stands left of an anchor, reversed, and its suffix, as far as windows reach that hold it at offsets low to high."""
    return text[max(0, at - high) : at][::-1], text[at : at + length - low]


def _all_windows(at: int, left: int, right: int, length: int) -> tuple[int, int] | None:
    """What the windows around an anchor cover, if all that its context allows are repeated."""
    least = max(0, length - right)
    return (at - left, at - least + length) if least <= left else None


def _distinct(text: bytes, at: np.ndarray, codes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors of a text stay: one for each context; and the spans of the contexts that the text repeats."""
    keep, spans = np.ones(len(at), bool), []
    _, inverse, n = np.unique(codes, return_inverse=True, return_counts=True)
    first: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(n[inverse] > 1).tolist():
        context = _context(text, int(at[i]), length, 0, length - gram)
        met = first.setdefault(xxhash.xxh3_128_digest(context[0]) + xxhash.xxh3_128_digest(context[1]), [])
        same = next((j for j in met if _context(text, int(at[j]), length, 0, length - gram) == context), None)
        if same is None:
            met.append(i)
            continue
        keep[i] = False
        for j in (i, same):
            if span := _all_windows(int(at[j]), len(context[0]), len(context[1]), length):
                spans.append(span)
    return keep, spans


def _scan(length: int, gram: int):
    """key, anchors (at, code, place: a number for text and position) and spans repeated within the text itself."""

    def sent(keys, at, codes, places, spans) -> pa.RecordBatch:
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (at, codes, places)]
        found = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.uint64).view(np.int64)), pa.array(flat[2].astype(np.uint64).view(np.int64))], ["at", "code", "place"])
        lists = list_array(found, np.array([len(x) for x in at]), found.type)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists, pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], _SPANS)], ["key", "anchors", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                own, code, inner = anchors(text, length, gram)
                if len(np.unique(code)) < len(code):
                    keep, spans = _distinct(text, own, code, length, gram)
                    own, code, inner = own[keep], code[keep], inner + spans
                place = mix(own.astype(np.uint64) ^ np.uint64(int.from_bytes(key[:8], "little")))
                for column, value in zip(rows, (key, own, code, place, _joined(sorted(set(inner))))):
                    column.append(value)
                held += len(own)
                if held > SENT:
                    yield sent(*rows)
                    rows, held = [[], [], [], [], []], 0
            yield sent(*rows)

    return run


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_SCANNED = "key binary, anchors array<struct<at: long, code: long, place: long>>, spans array<struct<begin: long, end: long>>"


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans; those that touch are one."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes aren't compared again."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    step = 64
    while a[known : known + step] == b[known : known + step]:
        known += step
    while step > 1:
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefixes with the string before, lengths of the rests, and the rests."""
    known = [0] * len(strings)
    for i in range(1, len(strings)):
        known[i] = shared_prefix(strings[i - 1], strings[i])
    rests = [s[k:] for s, k in zip(strings, known)]
    return np.array(known, "<u2").tobytes(), np.array([len(r) for r in rests], "<u2").tobytes(), b"".join(rests)


def front_decoded(known: bytes, sizes: bytes, rests: bytes) -> tuple[list[bytes], list[int]]:
    out, before, at = [], b"", 0
    shared = np.frombuffer(known, "<u2").tolist()
    for k, n in zip(shared, np.frombuffer(sizes, "<u2").tolist()):
        before = before[:k] + rests[at : at + n]
        out.append(before)
        at += n
    return out, shared


class LoserTree:
    """Merges sorted runs. Each head keeps the prefix it shares with the last string put out, so that of two heads the one that
    shares more comes first without a look at the strings, and heads that share equally are compared from there on."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * len(runs)
        self.known = [0] * self.size
        self.nodes = [-1] * self.size

    def _first(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; -1: no run, the last of all. The loser's shared prefix becomes the one with the winner."""
        ends = [x < 0 or x >= len(self.runs) or self.at[x] >= len(self.runs[x][0]) for x in (a, b)]
        if ends[0] or ends[1]:
            return (b, a) if ends[0] else (a, b)
        ka, kb = self.known[a], self.known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = self.runs[a][0][self.at[a]], self.runs[b][0][self.at[b]]
        k = shared_prefix(x, y, ka)
        if k == len(x) and len(x) <= len(y) or k < len(x) and k < len(y) and x[k] < y[k]:
            self.known[b] = k
            return a, b
        self.known[a] = k
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, index in it, prefix shared with the string before) in ascending order."""
        level = [i if i < len(self.runs) else -1 for i in range(self.size)]
        base = self.size
        while len(level) > 1:
            base //= 2
            up = []
            for i in range(0, len(level), 2):
                winner, loser = self._first(level[i], level[i + 1])
                self.nodes[base + i // 2] = loser
                up.append(winner)
            level = up
        best = level[0]
        while best >= 0 and best < len(self.runs) and self.at[best] < len(self.runs[best][0]):
            strings, shared = self.runs[best]
            at = self.at[best]
            yield best, at, self.known[best]
            self.at[best] = at + 1
            if at + 1 < len(strings):
                self.known[best] = shared[at + 1]
            node = (best + self.size) // 2
            while node:
                best, self.nodes[node] = self._first(best, self.nodes[node])
                node //= 2


def _runs(parts: int, length: int):
    """Sorted front-coded runs of the wanted anchors, a row for each run and part, and spans found on the way."""

    def flush(held: dict[tuple, list]) -> pa.RecordBatch:
        spans: list[tuple[bytes, int, int]] = []
        by_part: dict[tuple[int, int], list] = {}
        for (high, left, right), (part, own) in held.items():
            if len(own) > 1:  # one speaks for all
                for key, at in own:
                    if span := _all_windows(at, len(left), len(right), length):
                        spans.append((key, *span))
            by_part.setdefault((part, high), []).append((right, left, *own[0]))
        rows = [(None, None, key, a, b, *[None] * 8) for key, a, b in spans]
        for (part, high), entries in by_part.items():
            entries.sort()
            rows.append((part, high, None, None, None, *front_coded([e[0] for e in entries]), *front_coded([e[1] for e in entries]), b"".join(e[2] for e in entries), np.array([e[3] for e in entries], "<i8").tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 8]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _RUNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            for key, text, own in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2)):
                for anchor in own.as_py():
                    context = anchor["high"], *_context(text, anchor["at"], length, anchor["low"], anchor["high"])
                    entry = held.get(context)
                    if entry is None:
                        held[context] = (anchor["code"] % parts, [(key, anchor["at"])])
                        size += len(context[1]) + len(context[2])
                    elif (key, anchor["at"]) not in entry[1][:1]:
                        entry[1].append((key, anchor["at"]))
                if size > RUN_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


_RUNS = "part int, high int, key binary, begin long, end long, known binary, sizes binary, rests binary, lknown binary, lsizes binary, lrests binary, keys binary, at binary"


def repeated_windows(lefts: list[bytes], shared: list[int], length: int, gram: int) -> list[tuple[int, int] | None]:
    """For sorted suffixes with a common begin, given by left contexts and prefixes shared with the suffix before: the smallest and
    largest offset of an anchor in a repeated window, None where none is."""
    m = len(lefts)
    if m == 2:
        right, left = shared[1], shared_prefix(lefts[0], lefts[1])
        found = (max(0, length - right), min(left, length - gram))
        return [found if found[0] <= found[1] else None] * 2
    order = sorted(range(m), key=lefts.__getitem__)
    left_shared = np.array([0] + [shared_prefix(lefts[a], lefts[b]) for a, b in zip(order, order[1:])])
    right_shared = np.array([0, *shared[1:]])
    most = length - gram
    cuts = np.unique(np.clip(np.concatenate([[0, most + 1], length - right_shared[1:], left_shared[1:] + 1]), 0, most + 1))
    low, high = np.full(m, most + 1), np.full(m, -1)
    left_class = np.zeros(m, np.int64)
    for begin, end in zip(cuts[:-1], cuts[1:]):  # classes are the same for all offsets in between
        right_class = np.cumsum(right_shared < length - begin)
        left_class[order] = np.cumsum(left_shared < begin)
        _, inverse, n = np.unique(right_class * np.int64(m + 1) + left_class, return_inverse=True, return_counts=True)
        hit = n[inverse] > 1
        low[hit] = np.minimum(low[hit], begin)
        high[hit] = np.maximum(high[hit], end - 1)
    return [(int(a), int(b)) if b >= 0 else None for a, b in zip(low, high)]


def _merge(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        runs, lefts, keys, ats = [], [], [], []
        least = gram
        for row in table.to_pylist():
            least = length - row["high"]
            runs.append(front_decoded(row["known"], row["sizes"], row["rests"]))
            lefts.append(front_decoded(row["lknown"], row["lsizes"], row["lrests"])[0])
            keys.append([row["keys"][i : i + 16] for i in range(0, len(row["keys"]), 16)])
            ats.append(np.frombuffer(row["at"], "<i8").tolist())
        out: list[tuple[bytes, int, int]] = []
        group: list[tuple[int, int]] = []
        shared: list[int] = []

        def close() -> None:
            if len(group) > 1:
                for (r, i), found in zip(group, repeated_windows([lefts[r][i] for r, i in group], shared, length, gram)):
                    if found:
                        out.append((keys[r][i], ats[r][i] - found[1], ats[r][i] - found[0] + length))
            group.clear()
            shared.clear()

        for r, i, known in LoserTree(runs):
            if known < least:
                close()
            group.append((r, i))
            shared.append(known)
        close()
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()))], ["key", "begin", "end"])

    return run


_HALVES = "key binary, at long, low int, high int, code long, context binary, begin long, end long"


def _halves(length: int):
    """Both halves of each anchor's offsets: what all windows of the half hold (code), the context cut to the half, and what its windows cover."""

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _HALVES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for key, text, own in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2)):
                for anchor in own.as_py():
                    at, middle = anchor["at"], (anchor["low"] + anchor["high"]) // 2
                    for low, high in ((anchor["low"], middle), (middle + 1, anchor["high"])):
                        if low > high or at < low or at + length - high > len(text):
                            continue  # no window of this half
                        left, right = _context(text, at, length, low, high)
                        common = hashlib.blake2b(b"%d %d %d " % (anchor["code"], low, high) + text[at - low : at + length - high], digest_size=8).digest()
                        whole = hashlib.blake2b(b"%d %d %d " % (low, high, len(left)) + left + right, digest_size=16).digest()
                        begin, end = _all_windows(at, len(left), len(right), length)
                        rows.append((key, at, low, high, int.from_bytes(common, "little", signed=True), whole, begin, end))
                if len(rows) > SENT:
                    yield sent(rows)
                    rows = []
        if rows:
            yield sent(rows)

    return run


def _strip(length: int):
    """Lengths, removed bytes and spans, digest and rest of each text."""

    def strip(texts: pa.Array, spans: pa.Array, copies: pa.Array) -> pa.Array:
        rows, rests = [], []
        for text, own, n in zip(as_bytes(texts), spans.to_pylist(), copies.to_pylist()):
            if (n or 0) > 1 and len(text) >= length:
                gone = [(0, len(text))]
            else:
                gone = _joined(sorted((s["begin"], s["end"]) for s in own or []))
            at, kept = 0, []
            for begin, end in gone:
                kept.append(text[at:begin])
                at = end
            rest = b"".join(kept) + text[at:]
            rows.append((len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()))
            rests.append(rest)
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(rests, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return strip


def _asked(anchors: DataFrame, keyed: DataFrame) -> DataFrame:
    """key, text and its anchors (at, low, high, code): one row for each text that holds some."""
    per_text = anchors.groupBy("key").agg(F.collect_list(F.struct("at", "low", "high", "code")).alias("own"))
    speakers = keyed.groupBy("key").agg(F.min("doc_id").alias("speaker"))
    asked = per_text.join(speakers, "key").hint("shuffle_hash")
    return keyed.join(asked, "key").where(F.col("doc_id").eqNullSafe(F.col("speaker"))).select("key", "text", "own")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key (MD5 of a text) and spans (begin, end in bytes) that hold a repeated window; for texts that differ from all others."""
    keyed = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text").where(F.octet_length("text") >= length)
    scanned = materialise(keyed.select("key", "text").mapInArrow(_scan(length, gram), _SCANNED), "anchors")
    found = scanned.select("key", F.inline("spans")).distinct()
    flat = scanned.select("key", F.inline("anchors"))
    shared = flat.groupBy("code").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b").select("code")
    shared = materialise(shared, "shared")  # so that the join below has a plain shuffle on either side, which adaptive execution splits
    bounds = F.lit(0).alias("low"), F.lit(length - gram).alias("high")
    wanted = materialise(flat.join(shared, "code", "left_semi").select("key", "at", "code", *bounds).distinct(), "wanted")
    while True:
        sizes = wanted.groupBy("code").agg(F.count("*").alias("n"))
        facts = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        if not facts["n"]:
            return found
        frequent = materialise(sizes.where(F.col("n") > hot).select("code"), "frequent") if facts["most"] > hot else None
        fine = wanted if frequent is None else wanted.join(frequent, "code", "left_anti")
        parts = max(12, facts["n"] // GROUP)
        runs = materialise(_asked(fine, keyed).mapInArrow(_runs(parts, length), _RUNS), "runs")
        merged = runs.where("part IS NOT NULL").groupBy("part", "high").applyInArrow(_merge(length, gram), "key binary, begin long, end long")
        found = found.unionByName(merged).unionByName(runs.where("part IS NULL").select("key", "begin", "end"))
        if frequent is None:
            return found
        halves = _asked(wanted.join(frequent, "code", "left_semi"), keyed).mapInArrow(_halves(length), _HALVES)
        halves = materialise(halves, "halves")
        own = ["code", "low", "high", "context"]
        one = F.min(F.struct("key", "at"))
        contexts = materialise(halves.groupBy(own).agg(one.alias("one"), F.max(F.struct("key", "at")).alias("last")), "contexts")
        repeated = contexts.where("one < last").select(own)
        found = found.unionByName(halves.join(repeated, own, "left_semi").select("key", "begin", "end").distinct())
        several = contexts.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
        wanted = materialise(contexts.join(several, "code", "left_semi").select("one.key", "one.at", "code", "low", "high"), "wanted")


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) to every row (columns of these names are replaced)."""
    with scratch(docs.sparkSession):
        spans = materialise(repeated_spans(docs, length, gram, hot), "spans", keep=True)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    copies = docs.select(key.alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("_copies")).where("_copies > 1")
    facts = spans.join(copies, "key", "full").withColumnRenamed("key", "_key").hint("shuffle_hash")
    out = docs.withColumn("_key", key).join(facts, "_key", "left")
    strip = F.arrow_udf(_strip(length), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("_s", strip("text", "_spans", "_copies"))
    return out.withColumns({c: F.col(f"_s.{c}") for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}).drop("_key", "_spans", "_copies", "_s")
