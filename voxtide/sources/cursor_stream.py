"""A table read as a stream in the order of its ids: the cursor is the stream's offset, and a batch admits a number of rows.

A stream that is far behind its table may take up to ``ahead`` batches in one run of the micro-batch engine, whose cost is then shared by them. Each
keeps its own bounds, which are those that it would have alone, and its number, which its rows carry in the column ``batch``: both are part of the offset.

A batch's tasks are the row groups whose statistics meet its range of ids; the ids themselves are read only to find where a batch ends, from
the groups that begin before it does. Footers are read once, groups that lie behind the cursor are forgotten. So a batch costs one listing and
the groups that it meets: one or two of a table that is written in the order of its ids, all those ahead of the cursor if ids are scattered.

Footers and groups are read through ``pyarrow.fs``: the table and the cursor lie where it reaches (a mounted folder, S3, GCS, or HDFS with its client).

The end of the last planned batch is kept in the file ``cursor``, as a reader that starts anew isn't told it; one file belongs to one
checkpoint. Spark plans a batch that did not end once more before it asks for the next, so the file is never ahead of the checkpoint.

Defined cases: rows without an id are left out, as they are by ``id > cursor``; rows of one id are admitted together, so a batch may hold more than
``rows``; groups without statistics are read; an empty table, or a folder without files, gives one empty batch or none; rows that are added with ids behind
the cursor are not read; columns of the file that the schema lacks are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The least id that a cursor may stand at.
FIRST = -(1 << 63)


@dataclass(frozen=True)
class Group:
    """A row group, and its least and greatest id (none if the file doesn't say)."""

    path: str
    number: int
    low: int | None
    high: int | None

    def meets(self, start: int, end: int | None = None) -> bool:
        return self.low is None or self.high > start and (end is None or self.low <= end)


class Part(InputPartition):
    def __init__(self, group: Group, start: int, end: int, ends: list[int], number: int) -> None:
        self.group, self.start, self.end, self.ends, self.number = group, start, end, ends, number


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.schema, self.id_col, self.rows = schema, options.get("id", "id"), int(options.get("rows", 400))
        self.path, self.kept = options["path"], options["cursor"]
        self.first = int(options.get("start", FIRST))
        self.ahead, self.batch_col = int(options.get("ahead", 1)), options.get("batch")
        self.footers: dict[str, list[Group]] = {}
        self.position: dict | None = None

    def _offset(self, ends: list[int], before: dict) -> dict:
        """With the bounds of the batches that led here and their number, if rows carry the batch that they are of."""
        return {"id": ends[-1]} | ({"ends": ends, "batches": before["batches"] + len(ends)} if self.batch_col else {})

    def initialOffset(self) -> dict:
        return {"id": self.first} | ({"ends": [], "batches": 0} if self.batch_col else {})

    def _groups(self) -> list[Group]:
        """The row groups that aren't known to lie behind the cursor."""
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            return []
        listed = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        for info in listed:
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")) or info.path in self.footers:
                continue
            with files.open_input_file(info.path) as source:
                meta = pq.ParquetFile(source).metadata
            column = meta.schema.names.index(self.id_col)
            self.footers[info.path] = []
            for i in range(meta.num_row_groups):
                stats = meta.row_group(i).column(column).statistics
                known = stats is not None and stats.has_min_max
                self.footers[info.path].append(Group(info.path, i, stats.min if known else None, stats.max if known else None))
        return [g for groups in self.footers.values() for g in groups]

    def latestOffset(self) -> dict:
        """The id with which the next batch ends, or the last of those that are taken at once."""
        before = self._planned() if self.position is None else self.position
        start, most = before["id"], self.rows * self.ahead
        files, _ = fs.FileSystem.from_uri(self.path)
        ahead = np.zeros(0, np.int64)  # the least ids after the cursor, all rows of the last one or at most as many as are admitted
        for group in sorted((g for g in self._groups() if g.meets(start)), key=lambda g: FIRST if g.low is None else g.low):
            if len(ahead) >= most and group.low is not None and group.low > ahead[-1]:
                break
            with files.open_input_file(group.path) as source:
                ids = pq.ParquetFile(source).read_row_group(group.number, columns=[self.id_col]).column(0).drop_null().to_numpy()
            ahead = np.sort(np.concatenate([ahead, ids[ids > start]]))[:most]
        ends, at = [], 0
        while at < len(ahead):
            if ends and len(ahead) == most and at + self.rows > most:  # rows of one id made earlier batches larger: the next run sees more of this one
                break
            ends.append(int(ahead[min(at + self.rows, len(ahead)) - 1]))
            at = int(np.searchsorted(ahead, ends[-1], "right"))
        return self._offset(ends, before) if ends else before

    def _planned(self) -> dict:
        files, path = fs.FileSystem.from_uri(self.kept)
        for name in (path, path + ".new"):  # the second alone is there if the writer was lost just before its last step
            if files.get_file_info(name).type == fs.FileType.File:
                with files.open_input_stream(name) as source:
                    return json.loads(source.read())
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if start == end:  # a restart asks for that before it plans the broken batch again
            return []
        if self.position != end:
            files, path = fs.FileSystem.from_uri(self.kept)
            with files.open_output_stream(path + ".new") as out:
                out.write(json.dumps(end).encode())
            if files.get_file_info(path).type == fs.FileType.File:
                files.delete_file(path)  # not every file system moves a file onto another
            files.move(path + ".new", path)
            self.position = end
        # What lies behind a batch's start isn't asked for again; the end of a batch says less, as it may be planned once more.
        groups = self._groups()
        for path, own in self.footers.items():
            self.footers[path] = [g for g in own if g.meets(start["id"])]
        # Runs may be planned again as one: then the ends of the last one don't tell all, and its rows' numbers would be wrong.
        if self.batch_col and end["batches"] - len(end["ends"]) != start["batches"]:
            raise ValueError(f"a batch from {start} to {end} was not planned by this source")
        first = start.get("batches", 0)
        return [Part(g, start["id"], end["id"], end.get("ends", []), first) for g in groups if g.meets(start["id"], end["id"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.group.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.group.number], columns=list({self.id_col: 0} | dict.fromkeys(n for n in shape.names if n != self.batch_col))):
                ids = batch.column(self.id_col)
                batch = batch.filter(pc.and_(pc.greater(ids, partition.start), pc.less_equal(ids, partition.end)))
                if batch.num_rows and self.batch_col:
                    number = partition.number + np.searchsorted(partition.ends, batch.column(self.id_col).to_numpy(zero_copy_only=False))
                    batch = batch.append_column(self.batch_col, pa.array(number))
                if batch.num_rows:
                    yield batch.select(shape.names).cast(shape)


class CursorSource(DataSource):
    """Options: ``path`` (a Parquet file or a folder of them), ``cursor`` (a file of this stream's own, in a shared folder), ``id``, ``rows``, ``start``, ``ahead``
    (batches at once, with ``batch``: the column of the schema, not of the table, that takes their numbers)."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def streamReader(self, schema: StructType) -> CursorReader:
        return CursorReader(self.options, schema)


def uri(path: str) -> str:
    """A path with its scheme; a plain one is of a mounted folder."""
    return path if "://" in path else "file://" + (path.removeprefix("file:") if path.startswith("file:") else path)


def cursor_stream(spark: SparkSession, path: str, schema: str, cursor: str, rows: int = 400, id_col: str = "id", start: int = FIRST, ahead: int = 1, batch_col: str = "batch") -> DataFrame:
    """The rows with ids over ``start``, ``rows`` of them a batch. Drain it by ``processAllAvailable``: with ``availableNow`` a run is one batch.

    With ``ahead`` over 1 that many batches are taken at once, and rows have the column ``batch_col`` (from 0) besides those of the schema.
    """
    spark.dataSource.register(CursorSource)
    reader = spark.readStream.format("cursor").option("id", id_col).option("rows", rows).option("start", start)
    reader = reader.schema(f"{schema}, {batch_col} long").option("ahead", ahead).option("batch", batch_col) if ahead > 1 else reader.schema(schema)
    return reader.option("cursor", uri(cursor)).load(uri(path))
