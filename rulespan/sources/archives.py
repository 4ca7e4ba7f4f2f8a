"""Archives of repositories as a data source: spark.read.format("repoarchive").load(folder); and the writer of such archives.

Each zip or tar file (.zip, .tar, .tar.gz, .tgz) directly in the folder is a repository, named by the file, and a
partition. Columns are those of the repository tree.

Option `members`: patterns (*, ?, [x]; * passes slashes) one a line; a zip's directory or a tar's headers are read, and
only members that one of them matches are inflated (in a compressed tar, what stands before a member has to be inflated
to reach its header). Filters of a query are not pushed into the reader: Spark 4.1 keeps what was pushed with the
DataFrame, and the next query on it, or another branch of the same one, would miss rows.

Other options: `strip`, leading folders cut from members' names (1, as archives of repositories have a top folder); `skip`,
folder names left out; `largest`, bytes above which a content is null (0: no limit). An archive that cannot be read
gives one row without a path, its decode_ok false, so that the others go on; with `members` it is left out.
Repeated member names give a row each, in their order. An empty archive gives no row. Members are read one at a time.
"""

from __future__ import annotations

import fnmatch
import re
import tarfile
import warnings
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.ship import ship
from ..functions.store import materialise
from .repotree import SCHEMA

_KINDS = re.compile(r"(.+)\.(zip|tar|tar\.gz|tgz)\Z")


class ArchivePartition(InputPartition):
    def __init__(self, repo: str, kind: str, at: str) -> None:
        self.repo, self.kind, self.at = repo, kind, at


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.strip, self.largest = int(options.get("strip", 1)), int(options.get("largest", 0))
        self.skip = {x for x in options.get("skip", ".git,node_modules,__pycache__").split(",") if x}
        self.paths = [re.compile(fnmatch.translate(x)) for x in options.get("members", "").split("\n") if x]

    def partitions(self) -> list[ArchivePartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        files = sorted((i for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File), key=lambda i: i.path)
        return [ArchivePartition(m[1], m[2], i.path) for i in files if (m := _KINDS.match(i.base_name))]

    def _inside(self, name: str) -> str | None:
        """A member's path in the repository, or None where it isn't asked for."""
        path = "/".join([x for x in name.split("/") if x not in ("", ".")][self.strip :])
        if not path or self.skip & {*path.split("/")}:
            return None
        return path if not self.paths or any(x.match(path) for x in self.paths) else None

    def _members(self, file, kind: str) -> Iterator[tuple[str, bool, int, Callable[[], bytes]]]:
        """path, is_dir, size, read of the members that are asked for."""
        if kind == "zip":
            with zipfile.ZipFile(file) as z:
                for i in z.infolist():
                    if path := self._inside(i.filename):
                        yield path, i.is_dir(), i.file_size, lambda i=i: z.read(i)
        else:
            with tarfile.open(fileobj=file, mode="r:*") as t:
                for i in t:
                    if (i.isfile() or i.isdir()) and (path := self._inside(i.name)):
                        yield path, i.isdir(), i.size, lambda i=i: t.extractfile(i).read()

    def read(self, partition: ArchivePartition | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # a folder without archives
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        broken = (partition.repo, None, None, None, False, 0, None, False)
        with store.open_input_file(partition.at) as file:
            try:
                for path, folder, size, read in self._members(file, partition.kind):
                    content, ok = None, True
                    if not folder and not (self.largest and size > self.largest):
                        try:
                            content = read().decode().replace("\r\n", "\n").replace("\r", "\n")
                        except (UnicodeDecodeError, zipfile.BadZipFile, zlib.error, RuntimeError):  # a member that is no text, damaged or encrypted
                            ok = False
                    name = path.rsplit("/", 1)[-1]
                    _, dot, ext = name.rpartition(".")
                    yield partition.repo, path, name, ext.lower() if dot else "", folder, 0 if folder else size, content, ok
            except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, pa.ArrowInvalid):  # failures of the store itself are raised
                if not self.paths:
                    yield broken


class RepoArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repoarchive"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(RepoArchive)


def write_archives(files: DataFrame, folder: str) -> DataFrame:
    """Writes a zip archive for each repository and gives repo, members, bytes (of contents), written.

    files: repo, path, content (null: empty). One shuffle by repository; a task writes its archives one after the other,
    a member at a time, under a name of its own and renames each when it is whole, so a task that is run again leaves
    no half archive. Members are in the order of their paths, below a top folder of the repository's name.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        repo = out = archive = None
        part, members, size, done = "", 0, 0, []

        def close() -> None:
            if archive is not None:
                archive.close()
                out.close()
                store.move(part, f"{root}/{repo}.zip")
                done.append((repo, members, size))

        for b in parts:
            for r, path, content in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "content"))):
                if r != repo:
                    close()
                    repo, members, size, part = r, 0, 0, f"{root}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                data = (content or "").encode()
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # repeated names are allowed
                    archive.writestr(zipfile.ZipInfo(f"{r}/{path}"), data, zipfile.ZIP_DEFLATED)
                members, size = members + 1, size + len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["repo", "members", "bytes"])

    ship(files.sparkSession)
    rows = files.filter(F.col("repo").isNotNull() & F.col("path").isNotNull()).select("repo", "path", "content")
    return materialise(rows.repartition("repo").sortWithinPartitions("repo", "path", "content").mapInArrow(write, "repo string, members bigint, bytes bigint"), "archives")
