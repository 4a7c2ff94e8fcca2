"""Folders as a Spark data source: a walk in one task for each directory, once or as a stream of what has changed."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "rel_path string, size long, modified_ms long, seen_ms long, error string"


class Directory(InputPartition):
    """A directory below the root: with all that is in it, or, at the top, with its own files alone."""

    def __init__(self, rel: str, deep: bool, after: int | None = None, until: int | None = None) -> None:
        self.rel, self.deep, self.after, self.until = rel, deep, after, until


def _directories(root: str, levels: int, rel: str = "") -> Iterator[tuple[str, bool]]:
    """Directories down to `levels` below the root; those at the last level are whole, the others by themselves."""
    yield rel, levels == 0
    if levels:
        try:
            with os.scandir(os.path.join(root, rel)) as found:
                below = sorted(e.name for e in found if e.is_dir(follow_symlinks=False))
        except OSError:
            return  # its own partition says so
        for name in below:
            yield from _directories(root, levels - 1, f"{rel}/{name}" if rel else name)


def _walked(root: str, part: Directory) -> Iterator[tuple]:
    """Files of a directory; links are not followed, and what cannot be read is a row with an error."""
    open_ = [part.rel]
    while open_:
        rel = open_.pop()
        try:
            with os.scandir(os.path.join(root, rel)) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            yield rel, None, None, None, e.strerror or str(e)
            continue
        for entry in entries:
            path = f"{rel}/{entry.name}" if rel else entry.name
            try:
                if entry.is_dir(follow_symlinks=False):
                    if part.deep:
                        open_.append(path)
                elif entry.is_file(follow_symlinks=False):
                    about = entry.stat(follow_symlinks=False)
                    seen = max(about.st_mtime_ns, about.st_ctime_ns) // 1_000_000
                    if part.after is None or part.after < seen <= part.until:
                        yield path, about.st_size, about.st_mtime_ns // 1_000_000, seen, None
            except OSError as e:
                yield path, None, None, None, e.strerror or str(e)


class _Reader(DataSourceReader):
    def __init__(self, root: str, levels: int) -> None:
        self.root, self.levels = root, levels

    def partitions(self) -> list[Directory]:
        return [Directory(*d) for d in _directories(self.root, self.levels)]

    def read(self, partition: Directory) -> Iterator[tuple]:
        yield from _walked(self.root, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the files that were written or put there between two of them."""

    def __init__(self, root: str, levels: int) -> None:
        self.root, self.levels = root, levels

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ms": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"ms": time.time_ns() // 1_000_000 - 1}  # this millisecond is not over

    def partitions(self, start: dict, end: dict) -> list[Directory]:
        return [Directory(*d, start["ms"], end["ms"]) for d in _directories(self.root, self.levels)]

    def read(self, partition: Directory) -> Iterator[tuple]:
        yield from _walked(self.root, partition)


class Walk(DataSource):
    """`spark.read.format("walk").load(folder)`, or `readStream`: SCHEMA of a folder that all executors have mounted.

    A task reads one directory: the driver lists directories `levels` deep (1 by default), which
    is where the work is divided.  Paths are relative, with slashes; `seen_ms` is the later of the times of content
    and entry, so that files moved in with old times are seen by a stream as well.  An unreadable
    file or directory is a row with `error` and no size; a stream tells it in every batch.
    """

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("levels", "1"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(*self._options())
