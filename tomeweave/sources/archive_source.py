"""spark.read.format("archive"): members of archives below a folder as a Python data source.

Options: path (a folder or an archive that the executors see), backend (auto or a backend's name), content (true to read the
members' bytes too). One partition an archive. For stores that only Spark opens use sources.catalogue.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tomeweave.functions.title import RAR_SUFFIXES, SEVENZIP_SUFFIXES, ZIP_SUFFIXES

_KINDS = {s: k for k, suffixes in (("zip", ZIP_SUFFIXES), ("rar", RAR_SUFFIXES), ("7z", SEVENZIP_SUFFIXES)) for s in suffixes}


class ArchivePartition(InputPartition):
    def __init__(self, path: str, container: str):
        self.path, self.container = path, container


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("path is missing")
        self.root = Path(options["path"].removeprefix("file://"))
        self.backend = options.get("backend", "auto")
        self.content = str(options.get("content", "false")).lower() == "true"

    def partitions(self) -> list[ArchivePartition]:
        found = [self.root] if self.root.is_file() else sorted(p for p in self.root.rglob("*") if p.is_file())
        base = self.root.parent if self.root.is_file() else self.root
        return [ArchivePartition(str(p), p.relative_to(base).as_posix()) for p in found if p.suffix.lower() in _KINDS]

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        from tomeweave.sources.backends import BackendError, Fallback

        if partition is None or not hasattr(partition, "path"):  # a folder without archives
            return
        try:
            kind = _KINDS[Path(partition.path).suffix.lower()]
            archive = Fallback(Path(partition.path), kind, self.backend)
            entries = archive.entries()
            # others than ZIP are read in one pass, ZIP member by member, so that no more than one is held
            held = dict(archive.read([e[0] for e in entries if not e[2]])) if self.content and kind != "zip" else {}
            opened = archive.attempt(lambda backend: backend)
        except BackendError as e:
            yield partition.container, None, None, False, None, str(e)
            return
        for name, size, is_dir in entries:
            data, error = held.get(name), None
            if self.content and kind == "zip" and not is_dir:
                try:
                    ((_, data),) = opened.read([name])
                except BackendError as e:
                    error = str(e)
            yield partition.container, name, size, is_dir, data, error


class ArchiveDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "container string, name string, size bigint, is_dir boolean, content binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ArchiveDataSource)
