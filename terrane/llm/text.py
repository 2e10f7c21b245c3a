"""Vectorised helpers on texts: words of many documents at once, and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken together; longer texts come in pieces of about this size.
CHUNK = 1 << 19

_mult = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int) -> np.ndarray:
    """A fixed odd 64-bit multiplier for each position in a word."""
    global _mult
    if len(_mult) < n:
        size = max(n, 256, 2 * len(_mult))
        _mult = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _mult[:n]


def byte_set(keep) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(keep(b)) for b in range(256)])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes together, one text at least."""
    begin = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield begin, i
            begin, total = i, 0
        total += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = table[buf]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2]


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    chars = buf[table[buf]].astype(np.uint64)
    chars += np.uint64(1)
    at = np.arange(len(chars)) - np.repeat(offsets, lengths)
    chars *= multipliers(int(lengths.max()))[at]
    return mix(np.add.reduceat(chars, offsets) ^ lengths.astype(np.uint64))


def words(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the maximal runs of bytes in ``table`` with A-Z lower-cased, of some texts.

    Returns hashes (64 bits), starts and ends in bytes within each text, and the number of words of each text.
    The line feed must not be in ``table``: it parts the texts. One text of any length is worked off in pieces.
    """
    if len(texts) == 1 and len(texts[0]) > 4 * CHUNK:
        return _long(texts[0], table)
    joined = b"\n".join(texts).lower()
    buf = np.frombuffer(joined, np.uint8)
    starts, ends = _spans(buf, table)
    hashes = _hashes(buf, starts, ends, table)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    first = np.searchsorted(starts, begins)
    counts = np.diff(np.append(first, len(starts)))
    shift = np.repeat(begins, counts)
    return hashes, starts - shift, ends - shift, counts


def _long(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + CHUNK)
        while end < len(text):  # on to the end of the word
            ahead = table[np.frombuffer(text[end : end + CHUNK].lower(), np.uint8)]
            stop = np.flatnonzero(~ahead)
            end += int(stop[0]) if len(stop) else len(ahead)
            if len(stop):
                break
        buf = np.frombuffer(text[begin:end].lower(), np.uint8)
        starts, ends = _spans(buf, table)
        parts.append((_hashes(buf, starts, ends, table), starts + begin, ends + begin))
        begin = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    return hashes, starts, ends, np.array([len(hashes)])


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A column of lists from flat values and the number of values of each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
