"""Folders as a data source: one partition for each folder below the root, an error row where one can't be read.

Register with ``spark.dataSource.register(FolderTree)`` and read with ``spark.read.format("folder_tree").option("path", ...)``. Folders are
listed by the executors, with the file systems of Arrow (local and shared folders, HDFS, object stores). The driver lists the root
alone; what lies deeper is the work of the partition, whose folders that fail don't hinder others.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "item_id string, parent_id string, name string, kind string, depth int, size long, modified_at timestamp, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Folder(InputPartition):
    """A folder with all that is below it, or (``alone``) only the entries of the root itself."""

    def __init__(self, path: str, depth: int, alone: bool = False) -> None:
        super().__init__(path)
        self.path, self.depth, self.alone = path, depth, alone


class FolderTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"])


class FolderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.uri = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.uri)
        below = system.get_file_info(fs.FileSelector(root))
        return [Folder(root, 0, True), *[Folder(x.path, 1) for x in sorted(below, key=lambda x: x.path) if x.type == fs.FileType.Directory]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, root = opened(self.uri)
        below = lambda p: p[len(root) :].strip("/")
        waiting = [(partition.path, partition.depth)]
        while waiting:
            folder, depth = waiting.pop()
            here = below(folder)
            try:
                found = sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path)
            except OSError as e:
                yield (here, here.rpartition("/")[0], here.rpartition("/")[2], "folder", depth, None, None, f"{type(e).__name__}: {e.strerror or e}")
                continue
            if not partition.alone or depth == 0:
                yield (here, here.rpartition("/")[0] if here else None, here.rpartition("/")[2], "folder", depth, None, None, None)
            for x in found:
                if x.type == fs.FileType.Directory:
                    if not partition.alone:
                        waiting.append((x.path, depth + 1))
                else:
                    at = x.mtime.astimezone(UTC).replace(tzinfo=None) if x.mtime else None
                    yield (below(x.path), here, x.base_name, "file", depth + 1, x.size, at, None)
