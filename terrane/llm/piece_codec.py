"""Encoding and decoding with SentencePiece's merge-type vocabularies.

A text, normalised by the model's own rules, is a sequence of symbols, its characters. An agenda holds the adjacent pairs that are pieces of the
vocabulary, the highest score first, then the leftmost; the pair on top becomes one symbol, and its pairs with the neighbours join the
agenda, until it is empty. Symbols without a piece of their own become bytes, where the model has pieces for bytes.

Characters that no chain of pieces links are never in one symbol, so a text falls into stretches: spaces, then characters of one such class (if
no piece holds a space behind another character; else a text is one stretch). The agenda of one can't change another's, and as stretches
repeat, each goes through it once for each worker, whose memory of them is bounded. Each Arrow batch is encoded and decoded by the
sentencepiece library as well, and a difference is an error.

Cases: null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole; ``▁`` in a text decodes to a space, as
with the library. Repeated rows and rows without id are encoded each for itself. An empty table gives no rows. Other columns than the two named are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from terrane.llm.text import mix

SPACE = "▁"
#: Stretches whose ids a worker keeps (some 130 MB), and the longest such one.
CACHE_STRETCHES, CACHE_CHARS = 900_000, 40
#: Stretches that are merged together.
TOGETHER = 4096
#: Bytes of text, or ids, that are coded at a time, besides those of one row.
PORTION = 1 << 22

#: Bits of a symbol, and of a place in a text, in the numbers of the agenda.
BITS, PLACES = 21, 34
SYMBOL, PLACE = (1 << BITS) - 1, (1 << PLACES) - 1

# Kinds of pieces in the model's file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, message[at : at + size]
        at += size


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that are given by begins and sizes, one after the other."""
    at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return values[at]


class Links:
    """Numbers by pairs of symbols in hash tables: keys that meet in one place of a table go on to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int) -> None:
        self.keys, self.values = np.append(keys, -1), np.append(values, none)
        self.shift = np.uint64(64 - 4 - max(1, len(keys)).bit_length())
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(keys))
        while len(left) or not self.tables:
            factor = mix(np.array([len(self.tables) + 1], np.uint64))[0] | np.uint64(1)
            table = np.full(1 << 64 - int(self.shift), len(keys), np.int32)
            places = self._places(keys[left], factor)
            table[places] = left
            self.tables.append((factor, table))
            left = left[table[places] != left]

    def _places(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return keys.astype(np.uint64) * factor >> self.shift

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << BITS | b
        out = np.full(len(keys), self.values[-1])  # also where a or b is -1
        for factor, table in self.tables:
            at = table[self._places(keys, factor)]
            hit = self.keys[at] == keys
            out[hit] = self.values[at[hit]]
        return out


class Pieces:
    """A merge-type model: its pieces from the file, its normalisation from the library."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            model = file.read()
        self.library = SentencePieceProcessor(model_proto=model)
        rows, rules, spec = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                rows.append(dict(_fields(value)))
            elif number == 2:
                spec = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if spec.get(3, 1) != 2:
            raise ValueError(f"{path} is no merge-type vocabulary")
        if rules.get(5, 1) != 1:
            raise ValueError(f"{path} keeps spaces as they are")
        self.names = [row[1].decode() for row in rows]
        self.kinds = [row.get(3, NORMAL) for row in rows]
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError(f"{path} has pieces that users defined or that are unused")
        self.scores = [struct.unpack("<f", row[2])[0] if 2 in row else 0.0 for row in rows]
        self.ids = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds)) if kind == NORMAL}
        self.reserved = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds)) if kind != NORMAL}
        self.linked = self._linked()
        self.none = len(self.ranks) << BITS  # for pairs that make no piece
        self.links = Links(np.array(list(self.linked), np.int64), np.array(list(self.linked.values()), np.int64), self.none)
        self.of_point = np.arange(0x110000, dtype=np.int64) + len(self.names)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.of_point[ord(name)] = i
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [self.reserved[f"<0x{b:02X}>"] for b in range(256)] if BYTE in self.kinds else None
        self.byte_of = {i: b for b, i in enumerate(self.bytes or [])}
        #: Decoded pieces; None for bytes.
        self.surface = [None if k == BYTE else "" if k == CONTROL else n.replace(SPACE, " ") for n, k in zip(self.names, self.kinds)]
        self.surface[self.unknown] = spec.get(44, b" \xe2\x81\x87 ").decode()
        # The same as arrays: all bytes, and where each piece's begin; the pieces of bytes below 128 are characters by themselves.
        raw = [bytes([self.byte_of[i]]) if n is None else n.encode() for i, n in enumerate(self.surface)]
        self.surface_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.surface_sizes = np.array([len(r) for r in raw])
        self.surface_begins = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.spaced = np.array([k == NORMAL and r[:1] == b" " for r, k in zip(raw, self.kinds)])
        self.high = np.array([k == BYTE and r >= b"\x80" for r, k in zip(raw, self.kinds)])
        self.begins_plainly = np.isin(self.kinds, (NORMAL, BYTE))
        self.prefixed = bool(rules.get(3, 1) or rules.get(4, 1))
        self.squeezed = bool(rules.get(4, 1))
        self.plain = not rules.get(2) and not self.squeezed
        self.prefix = SPACE if rules.get(3, 1) else ""
        self.parted = self._pattern()
        self._remember({}, *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.int32))

    def _remember(self, known: dict[str, int], begins: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Numbers of stretches, a new one at each look-up of an unknown stretch; where the ids of each number are."""
        self.known = defaultdict(count(len(begins)).__next__, known)
        self.begins, self.sizes, self.flat = begins, sizes, flat

    def _pattern(self) -> re.Pattern | None:
        """What stretches look like: the classes of characters are the components of those that some piece holds side by side."""
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            return None
        of: dict[str, str] = {}

        def root(c: str) -> str:
            while of.setdefault(c, c) != c:
                of[c] = of[of[c]]
                c = of[c]
            return c

        for name in self.ids:
            for a, b in pairwise(name.lstrip(SPACE)):
                of[root(a)] = root(b)
        classes: dict[str, list[str]] = {}
        for c in of:
            classes.setdefault(root(c), []).append(re.escape(c))
        largest = sorted(classes.values(), key=len, reverse=True)
        return re.compile(f"{SPACE}*(?:{''.join(f'[{"".join(c)}]+|' for c in largest)}[^{SPACE}])|{SPACE}+")

    def _linked(self) -> dict[int, int]:
        """For each pair of symbols that make a piece, the piece's rank and its symbol in one number. Symbols are ids of pieces, and beyond them
        code points of characters that are none."""
        self.ranks = ranks = {score: k for k, score in enumerate(sorted({-self.scores[i] for i in self.ids.values()}))}
        out = {}
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                a, b = self._symbol(name[:cut]), self._symbol(name[cut:])
                if a is not None and b is not None:
                    out[a << BITS | b] = ranks[-self.scores[i]] << BITS | i
        return out

    def _symbol(self, part: str) -> int | None:
        return self.ids.get(part, len(self.names) + ord(part) if len(part) == 1 else None)

    def merged(self, stretch: str) -> list[int]:
        """The symbols that are left when no adjacent pair is a piece."""
        one, link, beyond = self.ids.get, self.linked.get, len(self.names)
        symbols = [beyond + ord(c) if (i := one(c)) is None else i for c in stretch]
        end = len(symbols)
        # Rank, place and symbol of a pair in one number, so that the least comes first.
        agenda = [(made >> BITS) << PLACES + BITS | at << BITS | made & SYMBOL for at in range(end - 1) if (made := link(symbols[at] << BITS | symbols[at + 1])) is not None]
        if not agenda:
            return symbols
        heapify(agenda)
        left, right = list(range(-1, end - 1)), list(range(1, end + 1))
        while agenda:
            first = heappop(agenda)
            at, symbol = first >> BITS & PLACE, first & SYMBOL
            after = right[at]
            if after >= end or (made := link(symbols[at] << BITS | symbols[after])) is None or made & SYMBOL != symbol:
                continue  # one of the two went into another symbol
            symbols[at], symbols[after] = symbol, -1
            before, right[at] = left[at], right[after]
            after = right[at]
            if after < end:
                left[after] = at
                if (made := link(symbol << BITS | symbols[after])) is not None:
                    heappush(agenda, (made >> BITS) << PLACES + BITS | at << BITS | made & SYMBOL)
            if before >= 0 and (made := link(symbols[before] << BITS | symbol)) is not None:
                heappush(agenda, (made >> BITS) << PLACES + BITS | before << BITS | made & SYMBOL)
        return [s for s in symbols if s >= 0]

    def _merged_rows(self, stretches: list[str]) -> np.ndarray:
        """The same for many short stretches, a row each, -1 behind their ends: a row of pairs is a stretch's agenda, and in each round every row
        merges its first least one, so that all get shorter by one symbol."""
        sizes = np.array([len(s) for s in stretches])
        rows, width = np.arange(len(stretches)), int(sizes.max())
        inside = np.arange(width + 1) < sizes[:, None]
        symbols = np.full((len(rows), width + 1), -1)
        symbols[inside] = self.of_point[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)]
        out = symbols.copy()
        made = self.links.of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), width)
        while True:
            first = (made >> BITS).argmin(axis=1)
            best = made[np.arange(len(rows)), first]
            going = best < self.none
            if not going.all():
                out[rows[~going]] = -1
                out[rows[~going], : symbols.shape[1]] = symbols[~going]
                rows, symbols, made, first, best = rows[going], symbols[going], made[going], first[going], best[going]
                if not len(rows):
                    return out
            here, behind = np.arange(len(rows)), np.arange(made.shape[1]) > first[:, None]
            symbols = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[here, first] = best & SYMBOL
            made = np.where(behind[:, :-1], made[:, 1:], made[:, :-1])
            made[here, first] = self.links.of(symbols[here, first], symbols[here, first + 1])
            before = np.flatnonzero(first > 0)
            made[before, first[before] - 1] = self.links.of(symbols[before, first[before] - 1], symbols[before, first[before]])

    def merged_together(self, stretches: list[str]) -> Iterator[list[int]]:
        """The symbols that are left of each of many short stretches."""
        for row in self._merged_rows(stretches):
            yield row[row >= 0].tolist()

    def _ids(self, symbols: list[int]) -> list[int]:
        beyond = len(self.names)
        if max(symbols) < beyond:
            return symbols
        out: list[int] = []
        for symbol in symbols:
            if symbol < beyond:
                out.append(symbol)
                continue
            known = self.reserved.get(chr(symbol - beyond), self.unknown)
            out += [self.bytes[b] for b in chr(symbol - beyond).encode()] if known == self.unknown and self.bytes else [known]
        return out

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def _learn(self, stretches: list[str]) -> None:
        """Enter the ids of stretches; their numbers are the next ones."""
        begins, sizes, flat, at = np.zeros(len(stretches), np.int64), np.zeros(len(stretches), np.int64), [self.flat], len(self.flat)
        lengths = np.array([len(s) for s in stretches])
        order = np.argsort(lengths, kind="stable")  # rows of about the same width together
        short = int((lengths <= CACHE_CHARS).sum())
        for begin in range(0, short, TOGETHER):
            some = order[begin : min(begin + TOGETHER, short)]
            symbols = self._merged_rows([stretches[i] for i in some.tolist()])
            used = symbols >= 0
            n, ids = used.sum(axis=1), symbols[used]
            if ids.max() >= len(self.names):  # characters without a piece
                lists = [self._ids(own.tolist()) for own in np.split(ids, np.cumsum(n)[:-1])]
                n, ids = np.array([len(x) for x in lists]), np.fromiter(chain.from_iterable(lists), np.int64)
            sizes[some], begins[some] = n, at + np.cumsum(n) - n
            flat.append(ids.astype(np.int32))
            at += len(ids)
        for i in order[short:].tolist():  # the last ones, so that they can go again
            flat.append(np.array(self._ids(self.merged(stretches[i])), np.int32))
            sizes[i], begins[i] = len(flat[-1]), at
            at += len(flat[-1])
        self.begins, self.sizes, self.flat = np.append(self.begins, begins), np.append(self.sizes, sizes), np.concatenate(flat)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one text after the other, and where each begins and the last one ends."""
        find = self.parted.findall if self.parted else lambda text: [text] if text else []
        parts = [find(self.normal(text)) for text in texts]
        ends = np.cumsum([0, *map(len, parts)])
        met = len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(ends[-1]))
        new = list(islice(reversed(self.known), len(self.known) - met))[::-1]
        if new:
            self._learn(new)
        sizes = self.sizes[numbers]
        ids = _gathered(self.flat, self.begins[numbers], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
        if long := [s for s in new if len(s) > CACHE_CHARS]:
            self.flat = self.flat[: min(self.begins[self.known[s]] for s in long)]
            for stretch in long:
                del self.known[stretch]
        if len(self.begins) > CACHE_STRETCHES:  # those met first are mostly frequent ones
            stay = dict(islice(self.known.items(), CACHE_STRETCHES // 2))
            of = np.fromiter(stay.values(), np.int64, len(stay))
            sizes = self.sizes[of]
            self._remember(dict(zip(stay, range(len(stay)))), np.cumsum(sizes) - sizes, sizes, _gathered(self.flat, self.begins[of], sizes))
        return ids, ends

    def encode(self, text: str) -> list[int]:
        return self.encoded([text])[0].tolist()

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of many rows of ids. Rows with bytes of longer characters, or that begin with another kind of piece, go one by one."""
        sizes, filled = np.diff(ends), np.flatnonzero(np.diff(ends) > 0)
        apart = np.zeros(len(sizes), bool)
        apart[filled] = ~self.begins_plainly[ids[ends[filled]]] | self.squeezed
        apart[np.searchsorted(ends, np.flatnonzero(self.high[ids]), "right") - 1] = True
        begins, lengths = self.surface_begins[ids], self.surface_sizes[ids]
        first = ends[filled][self.spaced[ids[ends[filled]]]] if self.prefixed else np.zeros(0, np.int64)
        begins[first] += 1
        lengths[first] -= 1
        lengths[np.repeat(apart, sizes)] = 0
        offsets = np.concatenate([[0], np.cumsum(lengths)])[ends]
        if offsets[-1] >= 1 << 31:
            raise ValueError("texts of a batch are longer than 2 GB together")
        data = _gathered(self.surface_bytes, begins, lengths)
        out = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        if not apart.any():
            return out
        own = [self.decode(ids[ends[i] : ends[i + 1]].tolist()) for i in np.flatnonzero(apart)]
        places = np.arange(len(sizes))
        places[apart] = len(sizes) + np.arange(len(own))
        return pa.concat_arrays([out, pa.array(own, pa.string())]).take(pa.array(places))

    def decode(self, ids: list[int]) -> str:
        out: list[str] = []
        begun = stripped = False
        raw = bytearray()
        for i in ids:
            piece = self.surface[i]
            if piece is None:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_text(raw))
                raw.clear()
                begun = True
            if not begun and self.kinds[i] == NORMAL and self.prefixed and not stripped:
                whole, piece = piece, piece.removeprefix(" ")
                stripped = piece != whole and not self.squeezed
            out.append(piece)
            begun = begun or bool(piece)
        if raw:
            out.append(_text(raw))
        return "".join(out)


def _text(raw: bytearray) -> str:
    """The characters of a run of bytes; each byte that belongs to none is a replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            size = next((n for n in (1, 2, 3, 4) if _whole(raw[at : at + n], n)), 0)
            out.append(raw[at : at + size].decode() if size else "�")
            at += size or 1
        return "".join(out)


def _whole(part: bytearray, n: int) -> bool:
    try:
        return len(part) == n and len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


@functools.cache
def _model(path: str) -> Pieces:
    return Pieces(path)


def _checked(kind: str, got: list, want: list) -> list:
    if got != want:
        row = next(i for i, (a, b) in enumerate(zip(got, want)) if a != b)
        raise ValueError(f"{kind}: row {row} of a batch differs from the library: {str(got[row])[:200]} and {str(want[row])[:200]}")
    return got


def _portions(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in which the rows behind the first have less than PORTION together."""
    group = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PORTION
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """``key`` and ids (array<int>) of each text by the model at ``path``, a file that every machine has; with ``back``, also the text that they
    decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in chain.from_iterable(_portions(b, pc.binary_length(b.column(1))) for b in batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, ends = model.encoded(texts)
            want = model.library.encode(texts, num_threads=1, return_type="numpy")
            if not np.array_equal(ends, np.cumsum([0, *map(len, want)])) or not np.array_equal(ids, np.concatenate([ids[:0], *want])):
                _checked("encoding", [ids[a:b].tolist() for a, b in pairwise(ends)], [w.tolist() for w in want])
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
            if back:
                out.append(_texts(model, ids, ends))
            yield pa.RecordBatch.from_arrays(out, names)

    names = [key, "ids", *(["text"] if back else [])]
    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>" + ", text string" * back)


def _texts(model: Pieces, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    got, rows = model.decoded(ids, ends), [ids[a:b] for a, b in pairwise(ends)]
    want = pa.array(model.library.decode(rows, num_threads=1) if rows else [], pa.string())
    if not got.equals(want):
        _checked("decoding", got.to_pylist(), want.to_pylist())
    return got


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ids and text: what the ids stand for, null ids for no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in chain.from_iterable(_portions(b, pc.list_value_length(b.column(1))) for b in batches):
            flat, ends = batch.column(1).values.to_numpy(), np.asarray(batch.column(1).offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _texts(model, flat[ends[0] : ends[-1]], ends - ends[0])], [key, "ids", "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, ids array<int>, text string")
