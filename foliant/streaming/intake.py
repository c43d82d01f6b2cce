"""Intake as a stream: each micro-batch is one intake batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..kb import KnowledgeBase, Profile
from ..operators import classify
from ..plans import batch
from ..shared import written
from ..sources.documents import numbered


def intake(spark: SparkSession, folder: str, sink: Callable[[batch.Result, int], None], checkpoint: str, kb: KnowledgeBase | None = None, profile: Profile | None = None, pattern: str = "*.txt") -> StreamingQuery:
    """Runs the engine over text files as they arrive in a folder.

    Clients, events and superseding are decided within a micro-batch, as for an intake batch; the source's own log keeps
    a file from being read twice, and a repeated micro-batch has the same batch id, so sinks can be idempotent."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def each(frame: DataFrame, n: int) -> None:
        text = T.normalise(F.decode("content", "UTF-8"))
        docs = frame.select(F.lit(f"batch-{n:06d}").alias("batch_id"), "path", F.col("path").alias("source"), F.lit("plaintext").alias("backend"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), text.alias("text")).withColumn("page_count", T.pages(F.col("text")))
        sink(batch.run(numbered(docs), kb, profile), n)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Memory:
    """What a stream of intake has seen, in a folder that all executors share: enriched records and what was said about them, by micro-batch.

    A micro-batch reads only what earlier ones left and overwrites what is its own, so one that is repeated after a failure
    ends as it would have the first time.  Files are sorted by bucket of the intake batch, so that a micro-batch passes over
    most of what it does not touch."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _kept(self, what: str, n: int) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        epochs = [e.getPath().getName() for e in store.listStatus(path)]
        return [f"{self.folder}/{what}/{e}" for e in sorted(epochs) if e.startswith("epoch-") and int(e[6:]) < n]

    def read(self, what: str, n: int, touched: DataFrame) -> DataFrame | None:
        """The rows of ``touched`` (batch_id) that micro-batches before ``n`` have left; None if there are none."""
        paths = self._kept(what, n)
        if not paths:
            return None
        buckets = [r[0] for r in touched.select(self._bucket()).distinct().collect()]  # BUCKETS at most
        return self.spark.read.parquet(*paths).filter(F.col("_bucket").isin(buckets)).join(touched, "batch_id", "left_semi").drop("_bucket")

    def write(self, what: str, n: int, rows: DataFrame) -> None:
        rows.withColumn("_bucket", self._bucket()).sortWithinPartitions("_bucket").write.mode("overwrite").parquet(f"{self.folder}/{what}/epoch-{n:09d}")

    def _bucket(self):
        return F.pmod(F.xxhash64("batch_id"), F.lit(self.BUCKETS))


def remembered(documents: DataFrame, n: int, memory: Memory, kb: KnowledgeBase | None = None, profile: Profile | None = None) -> tuple[batch.Result, DataFrame]:
    """One micro-batch (batch_id, path, name, text, page_count and what else records carry) in the light of all before it: the result of its intake batches, and what that changes.

    Documents whose content an intake batch already has are left out; of equal ones in one micro-batch the first path
    stays.  Records are enriched once; what the documents of an intake batch decide together (clients, events, flags, names) is
    decided anew for the batches that the micro-batch touches and for no other.  However a batch's documents are split into
    micro-batches, its last result is that of one run over all of them.

    changes: batch_id, doc_id, name, was, now (paths; ``was`` null for a new document) and action: new, moved or kept."""
    kb = kb or KnowledgeBase.load()
    touched = documents.select("batch_id").distinct()
    fresh = documents.withColumn("_id", T.content_id(F.col("text")))
    first = fresh.groupBy("batch_id", "_id").agg(F.min("path").alias("path"))
    known = memory.read("records", n, touched)
    if known is not None:
        first = first.join(known.select("batch_id", F.col("doc_id").alias("_id")), ["batch_id", "_id"], "left_anti")
    fresh = fresh.join(first, ["batch_id", "_id", "path"], "left_semi").drop("_id").withColumn("doc_ord", F.lit(0).cast("long"))
    memory.write("records", n, classify.enrich(fresh, kb).drop("text"))
    seen = memory.read("records", n + 1, touched)
    result = batch.settle(numbered(seen.drop("doc_ord")).select(*seen.columns), kb, profile)
    now = written(result.plan.select("batch_id", "doc_id", "name", F.array_join(F.concat("folder", F.array("filename")), "/").alias("now"), F.lit(n).alias("epoch")), "said")
    said = memory.read("said", n, touched)
    was = now.select("batch_id", "doc_id").withColumn("was", F.lit(None).cast("string")).filter("false") if said is None else said.groupBy("batch_id", "doc_id").agg(F.max_by("now", "epoch").alias("was"))
    changes = now.join(was, ["batch_id", "doc_id"], "left").withColumn("action", F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("now"), "kept").otherwise("moved"))
    changes = changes.select("batch_id", "doc_id", "name", "was", "now", "action", "epoch")
    memory.write("said", n, changes.filter("action <> 'kept'").select("batch_id", "doc_id", "now", "epoch"))
    return result, changes.drop("epoch")


def intake_remembering(spark: SparkSession, folder: str, sink: Callable[[batch.Result, DataFrame, int], None], checkpoint: str, memory: str, kb: KnowledgeBase | None = None, profile: Profile | None = None, pattern: str = "*.txt", batch_of: Callable[[Column], Column] = lambda path: F.lit("stream"), files_at_once: int | None = None) -> StreamingQuery:
    """``intake`` whose micro-batches know of those before them; ``batch_of`` (path) says which intake batch a file belongs to, such as its client's folder."""
    read = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary")
    if files_at_once:
        read = read.option("maxFilesPerTrigger", str(files_at_once))
    kept = Memory(spark, memory)

    def each(frame: DataFrame, n: int) -> None:
        docs = frame.select(batch_of(F.col("path")).alias("batch_id"), "path", F.col("path").alias("source"), F.lit("plaintext").alias("backend"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), T.normalise(F.decode("content", "UTF-8")).alias("text"))
        sink(*remembered(docs.withColumn("page_count", T.pages(F.col("text"))), n, kept, kb, profile), n)

    return read.load(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quality_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Of a stream of texts with times: documents and readable ones by window, with late rows up to a bound."""
    q = stream.withColumn("q", T.quality(F.col("text")))
    return q.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(F.col("q.readable").cast("long")).alias("n_readable"))
