"""A streaming data source over files of JSON lines that grow.

Its offset is the place in every file up to which lines are whole. A line that is still being written has no end and is not
counted: it is read when it is complete, once. Files are only ever appended to; a file that got shorter is read from its start.
Paths can have any scheme that pyarrow opens; without one the folder has to be shared by the driver and all executors.

    spark.dataSource.register(CheckpointSource)
    pages(spark.readStream.format("statemesh_checkpoints").option("path", folder).load())
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .checkpoints import LINES, stem_of

#: Bytes of a file that one task reads, and that are looked at for the last end of a line at a time.
PIECE, BACK = 32 << 20, 1 << 16


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Piece(InputPartition):
    """The lines of a file that start in first <= byte < last; whole says that a line starts at first."""

    def __init__(self, path: str, first: int, last: int, whole: bool):
        self.path, self.first, self.last, self.whole = path, first, last, whole


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("glob", "*.jsonl")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, folder = _opened(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)]
        return {f.path: end for f in sorted(files, key=lambda f: f.path) if (end := self._end(store, f.path, f.size))}

    def _end(self, store, path: str, size: int) -> int:
        """The byte after the last line's end."""
        with store.open_input_file(path) as f:
            while size:
                first = max(0, size - BACK)
                f.seek(first)
                at = f.read(size - first).rfind(b"\n")
                if at >= 0:
                    return first + at + 1
                size = first
        return 0

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        pieces = []
        for path, last in end.items():
            first = start.get(path, 0)
            first = 0 if first > last else first
            pieces += [_Piece(path, a, min(a + PIECE, last), a == first) for a in range(first, last, PIECE)]
        return pieces

    def read(self, partition: _Piece):
        store, _ = _opened(self.folder)
        with store.open_input_file(partition.path) as raw:
            at = partition.first if partition.whole else partition.first - 1
            raw.seek(at)
            held, begun = b"", partition.whole
            while at < partition.last:
                more = raw.read(BACK)
                if not more:
                    return
                held += more
                *lines, held = held.split(b"\n")
                for line in lines:
                    if begun and at < partition.last and line.strip():
                        yield (partition.path, at, line.decode("utf-8", "replace"))
                    begun, at = True, at + len(line) + 1


class CheckpointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statemesh_checkpoints"

    def schema(self) -> str:
        return "path string, at bigint, line string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def pages(lines: DataFrame) -> DataFrame:
    """Page lines(path, at, line) parsed: stem, at and the fields of checkpoints.LINES; lines that are no page are left out."""
    schema = LINES.replace(", _corrupt_record string", "")
    parsed = lines.select(stem_of("path").alias("stem"), "at", F.from_json("line", schema).alias("p"))
    return parsed.where("p.page is not null").select("stem", "at", "p.*")
