"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Paths of the temporary tables made here and not removed yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``; where it is unset (tests on one machine), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            folder = tempfile.mkdtemp(prefix="foliant-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own.append("file://" + folder)
        at = _own[0]
    return at.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """URI of a new folder below the shared one."""
    _made.append(f"{shared_dir(spark)}/foliant/{what}-{uuid.uuid4().hex}")
    return _made[-1]


#: Rows and bytes of an Arrow batch at most while a temporary table is written: what the JVM and a Python worker hold of it at once.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes up to which a file's size alone has a side of a join broadcast while a temporary table is written.  Columns that are much
#: the same all over take next to nothing in a file and fifty times that on the driver; what is larger is broadcast only if, once shuffled, it is seen to be small.
BY_FILE = 256 << 10
_STATIC, _SEEN = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    spark, path = frame.sparkSession, fresh(frame.sparkSession, what)
    before = {k: spark.conf.get(k, None) for k in (_ROWS, _BYTES, _STATIC, _SEEN)}
    rows, static = int(spark.conf.get(_ROWS)), spark.conf.get(_STATIC)
    changed = {_ROWS: str(min(ARROW_ROWS, rows) if rows > 0 else ARROW_ROWS), _BYTES: str(ARROW_BYTES)}
    if _bytes(spark, static) > BY_FILE:
        changed |= {_STATIC: str(BY_FILE), _SEEN: before[_SEEN] or static}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        frame.write.parquet(path)
    finally:
        for k in changed:
            spark.conf.unset(k) if before[k] is None else spark.conf.set(k, before[k])
    table = spark.read.schema(frame.schema).parquet(path)
    table._foliant_path = path
    return table


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(*tables: DataFrame) -> None:
    """Removes temporary tables that written() returned and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._foliant_path)
        _made.remove(table._foliant_path)


class Scratch:
    """``with Scratch(spark) as scratch``: the temporary tables and files made inside are removed at the end, but for scratch.keep(table)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> "Scratch":
        self.before = set(_made)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._foliant_path)
        return table

    def __exit__(self, *failed) -> None:
        for path in [p for p in _made if p not in self.before and p not in self.kept]:
            _delete(self.spark, path)
            _made.remove(path)


def clear(spark: SparkSession) -> None:
    """Removes all temporary tables and files below the shared folder; for when no frame is needed any more."""
    _delete(spark, f"{shared_dir(spark)}/foliant")
    _made.clear()
