"""A folder tree as a table that loses nothing.

Spark's own file listing leaves out names that begin with an underscore and ends the job on
a file that it cannot open.  Here a data source lists names and sizes alone: its partitions
are prefixes of the tree, found breadth first on the driver and bounded in number, and each
task walks its own.  ``opened`` then deals the names over as many tasks as their bytes ask
for, so that one folder of many files is no single task, and each task opens its files
itself.  Whatever is not read becomes a row with an error: unreadable, vanished, oversized,
unsupported, no regular file, a linked folder (which is not entered, so that no loop can
arise), a folder that cannot be listed, a name that is no UTF-8.

Left out without a row, as the rule is: files and folders whose names begin with a dot, and
the engine's own state (``_foliant``).  A folder that is not there is an error of the call.
Local paths and all that pyarrow's file systems reach (hdfs:, s3:, gs:) can be read.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import written

STATE = "_foliant"
#: Folders at which the driver stops looking for more prefixes, folders below one at which it leaves them to a task, and tasks.
PREFIXES, MOST_BELOW, TASKS = 512, 100_000, 128
#: Rows of a batch of names.
ROWS = 2000
#: Bytes of files that a task opens, and a file at most.
TASK_BYTES, MOST_BYTES = 128 << 20, (1 << 31) - 1
LISTED = "rel string, path string, size long, error string"


class Place:
    """A root and what it takes to list and open what lies below, wherever a task runs."""

    def __init__(self, uri: str):
        self.remote = "://" in uri and not uri.startswith("file:")
        self.root = uri.rstrip("/") if self.remote else os.path.abspath("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)

    def at(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def uri(self, rel: str) -> str:
        return self.at(rel) if self.remote else f"file:{self.at(rel)}"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def exists(self) -> bool:
        if not self.remote:
            return os.path.isdir(self.root)
        store, path = self._store()
        return store.get_file_info(path).type.name == "Directory"

    def entries(self, rel: str) -> Iterator[tuple[str, bool, int | None, str | None]]:
        """(name, is a folder, size, error) of what a folder holds."""
        if self.remote:
            from pyarrow import fs

            store, path = self._store()
            for e in store.get_file_info(fs.FileSelector(f"{path}/{rel}" if rel else path)):
                yield e.base_name, e.type == fs.FileType.Directory, e.size, None if e.type in (fs.FileType.Directory, fs.FileType.File) else "not a regular file"
            return
        with os.scandir(self.at(rel)) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        yield e.name, True, None, None
                        continue
                    s = e.stat()
                    kind = None if stat.S_ISREG(s.st_mode) else "a linked folder is not entered" if stat.S_ISDIR(s.st_mode) else "not a regular file"
                    yield e.name, False, s.st_size, kind
                except OSError as error:
                    yield e.name, False, None, _said(error)

    def read(self, rel: str) -> bytes:
        if self.remote:
            store, path = self._store()
            with store.open_input_stream(f"{path}/{rel}") as f:
                return f.read()
        with open(self.at(rel), "rb") as f:
            return f.read()


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {getattr(error, 'strerror', None) or error}"


def _plain(name: str) -> bool:
    try:
        return bool(name.encode())
    except UnicodeEncodeError:
        return False


def left_out(name: str) -> bool:
    return name.startswith(".")


class _Prefixes(InputPartition):
    """(folder, whether all below it is meant) for one task."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders)
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, place: Place, recursive: bool):
        self.place, self.recursive = place, recursive

    def partitions(self) -> list[InputPartition]:
        alone: list[tuple[str, bool]] = []
        below: deque[str] = deque([""])
        while self.recursive and below and len(alone) + len(below) < PREFIXES:
            rel = below.popleft()
            try:
                more = []
                for name, folder, *_ in self.place.entries(rel):
                    if folder and not left_out(name) and name != STATE:
                        more.append(f"{rel}/{name}" if rel else name)
                        if len(more) > MOST_BELOW:
                            raise OverflowError
            except (OSError, OverflowError):  # a task goes through it, and says what is wrong with it
                alone.append((rel, True))
                continue
            alone.append((rel, False))
            below.extend(more)
        folders = alone + [(rel, self.recursive) for rel in below]
        return [_Prefixes(folders[k::TASKS]) for k in range(min(TASKS, len(folders)))]

    def _walked(self, rel: str, deep: bool) -> Iterator[tuple]:
        todo = [rel]
        while todo:
            here = todo.pop()
            try:
                for name, folder, size, error in self.place.entries(here):
                    if left_out(name) or folder and (not deep or name == STATE):
                        continue
                    at = f"{here}/{name}" if here else name
                    if folder:
                        todo.append(at)
                    elif not _plain(at):
                        yield at.encode("utf-8", "backslashreplace").decode(), None, size, "the name is no UTF-8"
                    else:
                        yield at, self.place.uri(at), size, error
            except OSError as error:
                yield here.encode("utf-8", "backslashreplace").decode() or ".", None, None, f"the folder cannot be listed: {_said(error)}"

    def read(self, partition: _Prefixes) -> Iterator[pa.RecordBatch]:
        kinds, rows = [pa.string(), pa.string(), pa.int64(), pa.string()], []
        batch = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["rel", "path", "size", "error"])
        for rel, deep in partition.folders:
            for row in self._walked(rel, deep):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class Tree(DataSource):
    """``spark.read.format("foliant_tree").option("recursive", ...).load(folder)``: rel, path, size, error."""

    @classmethod
    def name(cls) -> str:
        return "foliant_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Place(self.options["path"]), self.options.get("recursive", "false").lower() == "true")


def listed(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(rel, path, size, error) of a folder's files, or of all below it; no file is opened."""
    if not Place(folder).exists():
        raise FileNotFoundError(f"no folder: {folder}")
    spark.dataSource.register(Tree)
    return spark.read.format(Tree.name()).option("recursive", str(recursive).lower()).load(folder)


def opened(spark: SparkSession, folder: str, extract: Callable[[str, bytes], tuple], fields: str, supported: tuple[str, ...], recursive: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """(rel, path, size, ``fields``..., error) of each file, as a written table; ``extract(suffix, content)`` gives the fields.

    The fields are null where there is an error.  Files with other suffixes, or larger than ``most``, are not opened."""
    place = Place(folder)
    names = written(listed(spark, folder, recursive), "listing")
    nbytes = names.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-nbytes // TASK_BYTES))
    dot = F.lower(F.regexp_extract("rel", r"[^./](\.[^./]*)$", 1))
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(~dot.isin(*supported), F.concat(F.lit("unsupported file type "), dot)).when(F.col("size") > most, F.concat(F.lit("too large: "), F.col("size"), F.lit(" bytes")))
    schema = f"rel string, path string, size long, {fields}, error string"
    width = len(fields.split(","))

    def read(batches):
        for part in batches:
            for rel, path, size, error, suffix in zip(*(c.to_pylist() for c in part.columns)):
                got = (None,) * width
                if error is None:
                    try:
                        got = tuple(extract(suffix, place.read(rel)))
                    except Exception as failed:  # whatever is wrong with a file is a row of its own
                        got, error = (None,) * width, _said(failed)
                yield pa.RecordBatch.from_pylist([dict(zip(wanted.names, (rel, path, size, *got, error)))], schema=wanted)

    wanted = to_arrow_schema(spark.createDataFrame([], schema).schema)
    dealt = names.select("rel", "path", "size", why.alias("error"), dot.alias("suffix")).repartition(tasks, F.xxhash64("rel"))
    return written(dealt.mapInArrow(read, schema), "opened")
