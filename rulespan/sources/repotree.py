"""A data source of repositories' files, hidden ones included: spark.read.format("repotree").load(folder).

Each folder directly below the given one is a repository and a partition. Spark's own file sources leave out names
that begin with a dot or underscore, which many rules ask for. Any file system that pyarrow knows can be read.
Files are read one at a time and whole. Option `largest`: bytes above which a file's content is null (generated
bundles); by default there is no such limit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.ship import ship

SCHEMA = "repo string, path string, name string, ext string, is_dir boolean, size long, content string, decode_ok boolean"


class RepoPartition(InputPartition):
    def __init__(self, repo: str, root: str) -> None:
        self.repo, self.root = repo, root


class RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.largest = options["path"], int(options.get("largest", 0))
        self.skip = {x for x in options.get("skip", ".git,node_modules,__pycache__").split(",") if x}

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[RepoPartition]:
        from pyarrow import fs

        store, root = self._store()
        return [RepoPartition(i.base_name, i.path) for i in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path) if i.type == fs.FileType.Directory]

    def read(self, partition: RepoPartition | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # an empty folder
            return
        store, _ = self._store()
        for i in sorted(store.get_file_info(fs.FileSelector(partition.root, recursive=True)), key=lambda i: i.path):
            path = i.path[len(partition.root) :].lstrip("/")
            if self.skip & {*path.split("/")}:
                continue
            folder = i.type == fs.FileType.Directory
            content, ok = None, True
            if not folder and not (self.largest and i.size > self.largest):
                with store.open_input_stream(i.path, compression=None) as f:
                    data = f.read()
                try:
                    content = data.decode().replace("\r\n", "\n").replace("\r", "\n")
                except UnicodeDecodeError:
                    ok = False
            stem, dot, ext = i.base_name.rpartition(".")
            yield partition.repo, path, i.base_name, ext.lower() if dot else "", folder, 0 if folder else i.size, content, ok


class RepoTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repotree"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> RepoReader:
        return RepoReader(self.options)


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(RepoTree)
