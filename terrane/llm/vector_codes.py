"""Compression of vectors to short codes: each of a few equal parts is replaced by the nearest entry of its codebook.

Components become floor(scale * x), whole numbers, and all that follows is exact. A part's codebook starts as that part of the vectors with
the smallest ids. In each round the driver builds a kd-tree for each codebook (entries split at the median of their widest dimension, nodes with
their bounding boxes) and broadcasts them: their size is that of the codebooks, which the parameters bound. Tasks look up their parts by branch and
bound, many at a time: a node is visited while its box isn't farther than the best entry so far, and also if it is as far, so
that of equally near entries the one with the lowest index wins. Each task adds up its parts by entry; Spark sums these, and the
driver gets a sum for each component of a codebook. Entries become floor(sum / count); unused ones stay.

Cases: null vectors, and those with a null or non-finite component or one that doesn't fit a long, take no part. Vectors of different lengths
are padded with zeros, to a multiple of the number of parts. Rows of one id start as entries in the order of their components; rows without id come
last there, and get codes like others. Repeated rows count each for itself. With fewer vectors than entries, each is an entry. Errors
beyond a long count as its largest. An empty table gives no codes and empty codebooks. Other columns than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a kd-tree's leaf.
LEAF = 16
MOST = 2**63 - 1


@dataclass
class _Node:
    low: np.ndarray
    high: np.ndarray
    #: Entries of a leaf, ascending; None in inner nodes.
    members: np.ndarray | None = None
    sides: list[_Node] = field(default_factory=list)


class Tree:
    """A kd-tree over the entries (rows) of a codebook of whole numbers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> _Node:
        own = self.entries[members]
        low, high = own.min(axis=0), own.max(axis=0)
        if len(members) <= LEAF or not (high > low).any():
            return _Node(low, high, np.sort(members))
        order = members[np.argsort(own[:, np.argmax(high - low)], kind="stable")]
        half = len(order) // 2
        return _Node(low, high, sides=[self._node(order[:half]), self._node(order[half:])])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, the lowest of equally near ones, and its squared distance."""
        best = np.full(len(points), -1, points.dtype)  # -1: none yet
        at = np.full(len(points), len(self.entries))

        def bound(node: _Node, rows: np.ndarray) -> np.ndarray:
            outside = np.maximum(np.maximum(node.low - points[rows], points[rows] - node.high), 0)
            return (outside * outside).sum(axis=1)

        def visit(node: _Node, rows: np.ndarray, far: np.ndarray) -> None:
            near = (best[rows] < 0) | (far <= best[rows])
            rows, far = rows[near], far[near]
            if not len(rows):
                return
            if node.members is not None:
                apart = points[rows][:, None, :] - self.entries[node.members][None]
                distances = (apart * apart).sum(axis=2)
                first = distances.argmin(axis=1)
                least, entry = distances[np.arange(len(rows)), first], node.members[first]
                better = (best[rows] < 0) | (least < best[rows]) | ((least == best[rows]) & (entry < at[rows]))
                best[rows[better]], at[rows[better]] = least[better], entry[better]
                return
            bounds = [bound(side, rows) for side in node.sides]
            order = (bounds[1] < bounds[0]).astype(int)  # the nearer side first
            for turn in (0, 1):
                for side in (0, 1):
                    own = (order ^ turn) == side
                    visit(node.sides[side], rows[own], bounds[side][own])

        visit(self.root, np.arange(len(points)), np.zeros(len(points), points.dtype))
        return at, best


def quantised(vectors: DataFrame, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``key``, the columns to ``keep`` and _v, the integer components of the vectors that take part."""
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(scale)) * c.cast("double")) < 2.0**63))
    return vectors.where(F.col(vector).isNotNull()).where(fine).select(key, *(keep or []), x.alias("_v"))


def _matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    """Vectors as rows of ``dims`` whole numbers, padded with zeros."""
    sizes, flat = np.diff(np.asarray(column.offsets)), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(kind)
    out = np.zeros((len(sizes), dims), kind)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


@dataclass
class Codec:
    """Trained codebooks: entries by part, [part, entry, component]; kind: numbers in which distances are exact."""

    codebooks: np.ndarray
    kind: type

    @property
    def parts(self) -> int:
        return self.codebooks.shape[0]

    def trees(self) -> list[Tree]:
        return [Tree(book.astype(self.kind)) for book in self.codebooks]

    def text(self) -> str:
        """All entries' components as decimal numbers, by part, entry and position."""
        return ",".join(str(int(x)) for x in self.codebooks.reshape(-1))


def _assigned(batch_vectors: pa.Array, trees: list[Tree], dims: int, kind) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    points = _matrix(batch_vectors, dims, kind)
    parts = np.split(points, len(trees), axis=1)
    found = [tree.nearest(part) for tree, part in zip(trees, parts)]
    return points, [at for at, _ in found], [far for _, far in found]


def train(rows: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codec:
    """Codebooks for the vectors of ``quantised``, a table that has been written."""
    spark = rows.sparkSession
    facts = rows.agg(F.max(F.size("_v")).alias("dims"), F.max(F.array_max("_v")).alias("top"), F.min(F.array_min("_v")).alias("low")).first()
    dims = -(-(facts["dims"] or 0) // parts) * parts
    top = max(facts["top"] or 0, -(facts["low"] or 0))
    kind = np.int64 if 4 * max(dims, 1) * top * top <= MOST else object
    first = rows.orderBy(F.asc_nulls_last(key), "_v").select("_v").limit(entries).collect()  # ``entries`` rows
    books = np.zeros((len(first), dims), object)
    for row, start in enumerate(first):
        books[row, : len(start["_v"])] = start["_v"]
    codec = Codec(np.stack(np.split(books, parts, axis=1)), kind)
    if not first or not dims:
        return codec
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast(codec.trees())

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts and sums of this task's parts by entry."""
            size = len(first)
            counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, dims // parts), kind)
            for batch in batches:
                points, at, _ = _assigned(batch.column(0), trees.value, dims, kind)
                for part, own in enumerate(np.split(points, parts, axis=1)):
                    counts[part] += np.bincount(at[part], minlength=size)
                    np.add.at(sums[part], at[part], own)
            part, entry = np.nonzero(counts)
            totals = [[Decimal(int(x)) for x in sums[p, e]] for p, e in zip(part, entry)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(totals, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

        partial = rows.select("_v").mapInArrow(add_up, "part int, entry int, n long, sums array<decimal(38,0)>")
        summed = partial.select("part", "entry", "n", F.posexplode("sums").alias("position", "x")).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for row in summed.collect():  # a row a component of the codebooks
            codec.codebooks[row["part"], row["entry"], row["position"]] = int(row["x"]) // row["n"]
        trees.unpersist()
    return codec


def encode(rows: DataFrame, codec: Codec, key: str = "vec_id", keep: list[str] | None = None) -> DataFrame:
    """``key``, the columns to ``keep``, codes (an entry's index a part) and error (squared distances, summed over parts) of ``quantised`` vectors."""
    keep = keep or []
    dims, kind, parts = codec.parts * codec.codebooks.shape[2], codec.kind, codec.parts
    columns = [key, *keep]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    trees = rows.sparkSession.sparkContext.broadcast(codec.trees() if codec.codebooks.size else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if trees.value:
                _, at, far = _assigned(batch.column(len(columns)), trees.value, dims, kind)
                codes = np.stack(at, axis=1)
                errors = [min(int(x), MOST) for x in np.sum([f.astype(object) for f in far], axis=0)]
            else:  # vectors without components
                codes, errors = np.zeros((batch.num_rows, parts), int), [0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors, pa.int64())], [*columns, "codes", "error"])

    return rows.select(*columns, "_v").mapInArrow(run, f"{fields}, codes array<int>, error long")


def decode(codes: DataFrame, codec: Codec, key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """``key`` and vector: the middles of the steps that the entries of each code stand for."""
    books = [F.array(*[F.array(*[F.lit((float(x) + 0.5) / scale) for x in entry]) for entry in book]) for book in codec.codebooks]
    parts = [F.get(book, F.col("codes")[p]) for p, book in enumerate(books)]
    return codes.select(key, F.concat(*parts).alias("vector"))


def compress(vectors: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Codec]:
    """``key``, codes, error and label_error (the errors' sum over rows of the same label, nulls together) of each vector that takes part, and the codec."""
    if entries > 2**31 - 1 or parts < 1 or entries < 1:
        raise ValueError("a codebook has 1 to 2**31 - 1 entries, and there is a part at least")
    rows = materialise(quantised(vectors.select(key, F.col(label).alias("_label"), vector), scale, key, vector, ["_label"]), "quantised")
    codec = train(rows, key, parts, entries, rounds)
    coded = materialise(encode(rows, codec, key, ["_label"]), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(MOST))).cast("long")
    by_label = materialise(coded.groupBy(F.col("_label").alias("_of")).agg(total.alias("label_error")), "label_errors")  # written: Spark can split a frequent label
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(key, "codes", "error", "label_error"), codec
