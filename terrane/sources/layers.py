"""A data source for binary layers, files of fixed records behind a header: ``spark.read.format("layer")`` and ``df.write.format("layer")``.

Options: path (a folder or a file that all machines have, as executors open it themselves), fields (JSON pairs of a name and a numpy type such as
``<f4``), header (bytes before the first record, 0), split (records of a partition, a million). A file is read in ranges of records, so that a large
one is many partitions, in batches. Rows have id, the record's number through all files in the order of their names, and the fields.

Written rows keep the order of their partitions; each task writes a file, and the list of files that count is written when all are
there: files of tasks that ran twice don't count. Values are rounded to the field's type; whole numbers beyond it are an error.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LISTED = "_files.json"
BATCH = 1 << 16


@dataclass
class _Range(InputPartition):
    """Records of a file: where they begin in it, how many, and the number of the first through all files."""

    file: str
    begin: int
    count: int
    first: int


@dataclass
class _Written(WriterCommitMessage):
    part: int
    file: str


class _Layer:
    def __init__(self, options: dict) -> None:
        place = urlparse(options["path"])
        if place.scheme not in ("", "file"):
            raise ValueError(f"{options['path']}: layers are read from folders that machines share")
        self.path = place.path
        self.kind = np.dtype([tuple(f) for f in json.loads(options["fields"])])
        self.header = int(options.get("header", 0))
        self.split = int(options.get("split", 1_000_000))

    def whole(self, name: str) -> bool:
        return self.kind[name].kind in "iu"

    def columns(self) -> str:
        return ", ".join(f"{name} {'long' if self.whole(name) else 'double'}" for name in self.kind.names)

    def files(self) -> list[str]:
        if not os.path.isdir(self.path):
            return [self.path]
        listed = os.path.join(self.path, LISTED)
        if os.path.exists(listed):
            with open(listed) as file:
                return [os.path.join(self.path, name) for name in json.load(file)]
        return [os.path.join(self.path, name) for name in sorted(os.listdir(self.path)) if name[0] not in "._"]


class LayerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layer"

    def schema(self) -> str:
        return "id long, " + _Layer(self.options).columns()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Layer(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_Layer(self.options), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, layer: _Layer) -> None:
        self.layer = layer

    def partitions(self) -> list[_Range]:
        out, first = [], 0
        for file in self.layer.files():
            size = os.path.getsize(file) - self.layer.header
            if size < 0 or size % self.layer.kind.itemsize:
                raise ValueError(f"{file}: no whole records of {self.layer.kind.itemsize} bytes behind {self.layer.header}")
            n = size // self.layer.kind.itemsize
            out += [_Range(file, k, min(self.layer.split, n - k), first + k) for k in range(0, n, self.layer.split)]
            first += n
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        layer = self.layer
        for k in range(0, part.count, BATCH):
            n = min(BATCH, part.count - k)
            rows = np.fromfile(part.file, layer.kind, n, offset=layer.header + (part.begin + k) * layer.kind.itemsize)
            columns = [pa.array(np.arange(part.first + k, part.first + k + n))]
            columns += [pa.array(rows[name].astype(np.int64 if layer.whole(name) else np.float64)) for name in layer.kind.names]
            yield pa.RecordBatch.from_arrays(columns, ["id", *layer.kind.names])


class _Writer(DataSourceArrowWriter):
    def __init__(self, layer: _Layer, overwrite: bool) -> None:
        self.layer, self.overwrite = layer, overwrite
        os.makedirs(layer.path, exist_ok=True)
        if os.listdir(layer.path) and not overwrite:
            raise ValueError(f"{layer.path} holds a layer already")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06}-{uuid.uuid4().hex}.bin"
        with open(os.path.join(self.layer.path, name), "wb") as file:
            file.write(bytes(self.layer.header))
            for batch in batches:
                rows = np.zeros(batch.num_rows, self.layer.kind)
                for field in self.layer.kind.names:
                    values = batch.column(batch.schema.get_field_index(field)).to_numpy(zero_copy_only=False)
                    if self.layer.whole(field) and len(values):
                        values, limits = np.rint(values), np.iinfo(self.layer.kind[field])
                        if np.isnan(values).any() or values.min() < limits.min or values.max() > limits.max:
                            raise ValueError(f"{field}: values that don't fit {self.layer.kind[field]}")
                    rows[field] = values
                file.write(rows.tobytes())
        return _Written(part, name)

    def commit(self, messages: list[_Written | None]) -> None:
        files = [m.file for m in sorted((m for m in messages if m), key=lambda m: m.part)]
        waiting = os.path.join(self.layer.path, f".{uuid.uuid4().hex}")
        with open(waiting, "w") as file:
            json.dump(files, file)
        os.replace(waiting, os.path.join(self.layer.path, LISTED))

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m:
                os.remove(os.path.join(self.layer.path, m.file))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(LayerSource)
