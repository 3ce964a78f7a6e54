"""A media listing as a Python data source: spark.read.format("shoebox_media").load(folder)."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from shoebox.functions.names import SCANNED_EXTENSIONS
from shoebox.sources.files import MIME

SCHEMA = "source_id string, name string, path string, mime string, size bigint, kind string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class MediaReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.kind = root.rstrip("/"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kind = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir())
        return [_Folder(self.root, False), *(_Folder(p, True) for p in below)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for folder, below, names in os.walk(partition.path):
            below.sort()
            for name in sorted(names):
                ext = os.path.splitext(name)[1].lower()
                mime = MIME.get(ext, "application/octet-stream")
                kind = "video" if mime.startswith("video/") else "photo"
                if ext in SCANNED_EXTENSIONS and self.kind in (None, kind):
                    full = os.path.join(folder, name)
                    yield full, name, os.path.relpath(full, self.root), mime, os.path.getsize(full), kind
            if not partition.deep:
                return


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shoebox_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"])


SOURCES = {"local": MediaSource}


def register(spark: SparkSession, name: str = "local") -> str:
    """Make a source known to the session; gives its format name, an error for an unknown one."""
    if name not in SOURCES:
        raise ValueError(f"unknown source: {name}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SOURCES[name])
    return SOURCES[name].name()
