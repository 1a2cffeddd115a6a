"""An archive of posts as a stream whose cursor is the last numeric id, as a timeline is read: what is newer than the last one seen.

    spark.dataSource.register(PostArchive)
    spark.readStream.format("post_archive").option("path", folder).schema("post_id long, ...").load()

The archive is a folder of Parquet files with a column of ids. The largest id and the row
groups that a batch needs are known from the files' footers, so a batch reads the row groups that
may hold newer ids and no others, one partition each. Ids at or below the cursor aren't
read again, whenever their files came: older posts are for ``streaming.sync.backfill``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NONE = -(2**63)  # before all ids


class RowGroup(InputPartition):
    """A row group of a file, and the ids wanted: above ``after``, up to ``until``."""

    def __init__(self, path: str, group: int, after: int, until: int):
        self.path, self.group, self.after, self.until = path, group, after, until


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, id_col: str, names: list[str]):
        self.path, self.id_col, self.names = path, id_col, names

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(file, row group, its smallest id, its largest); of a group without statistics the widest range."""
        store, top = fs.FileSystem.from_uri(self.path)
        for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            name = info.base_name
            if info.type != fs.FileType.File or name[0] in "._" or not name.endswith(".parquet"):
                continue
            meta = pq.read_metadata(info.path, filesystem=store)
            column = meta.schema.names.index(self.id_col)
            for k in range(meta.num_row_groups):
                told = meta.row_group(k).column(column).statistics
                if told is not None and told.has_min_max:
                    yield info.path, k, told.min, told.max
                elif meta.row_group(k).num_rows:
                    ids = pq.ParquetFile(info.path, filesystem=store).read_row_group(k, [self.id_col]).column(0)
                    if len(ids) > ids.null_count:
                        yield info.path, k, pc.min(ids).as_py(), pc.max(ids).as_py()

    def initialOffset(self) -> dict:
        return {"id": NONE}

    def latestOffset(self) -> dict:
        return {"id": max((high for *_, high in self._groups()), default=NONE)}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        return [RowGroup(path, k, start["id"], end["id"]) for path, k, low, high in self._groups() if high > start["id"] and low <= end["id"]]

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows = pq.ParquetFile(part.path, filesystem=store).read_row_group(part.group, self.names)
        ids = rows.column(self.id_col)
        yield from rows.filter(pc.and_(pc.greater(ids, part.after), pc.less_equal(ids, part.until))).select(self.names).to_batches()

    def commit(self, end: dict) -> None:
        pass


class PostArchive(DataSource):
    """Options: path, id (the column of ids, ``post_id`` where unset). The schema is the reader's: columns that are in the files. Rows without an id are left out."""

    @classmethod
    def name(cls) -> str:
        return "post_archive"

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("id", "post_id"), schema.names)
