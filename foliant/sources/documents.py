"""Sources: intake folders, sample files, registers, known answers, approvals."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names, text as T
from ..operators.rank import ranged
from . import files

TEXT = (".txt", ".text", ".md")
SUPPORTED = (*TEXT, ".docx", ".pdf")
DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(content: bytes) -> str:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{DOCX}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{DOCX}t"))
    lines = [words(p) for p in body.findall(f"{DOCX}p")]
    lines += [" | ".join(words(c) for c in row.findall(f"{DOCX}tc")) for row in body.iter(f"{DOCX}tr")]
    return "\n".join(x for x in lines if x.strip())


#: Characters of a PDF's text below which the second reader is tried.
FEW = T.MIN_CHARS
BACKENDS = ("pypdf", "pdfplumber")


def backends() -> dict[str, bool]:
    """Which of the optional PDF readers there are."""
    return {name: find_spec(name) is not None for name in BACKENDS}


def _pypdf(content: bytes) -> list[str]:
    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def _pdfplumber(content: bytes) -> list[str]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages]


def _pdf(content: bytes) -> tuple[str, int, str]:
    """Text, pages and reader: the first reader's, or the second's where the first finds next to nothing and the second more."""
    best, errors = None, []
    for name, read in (("pypdf", _pypdf), ("pdfplumber", _pdfplumber)):
        if best and len(best[0].strip()) >= FEW:
            break
        try:
            pages = read(content)
        except Exception as error:  # of one reader; the other may do
            errors.append(f"{name}: {error}")
            continue
        text = "\n\n".join(pages)
        if best is None or len(text.strip()) > len(best[0].strip()):
            best = text, len(pages), name
    if best is None:
        raise ValueError("; ".join(errors))
    return best


def extracted(suffix: str, content: bytes) -> tuple[str, int | None, str]:
    """Text, pages where the format tells them, and what read it."""
    if suffix in TEXT:
        return content.decode("utf-8", "replace"), None, "plaintext"
    if suffix == ".docx":
        return _docx(content), None, "docx"
    return _pdf(content)


def contents(spark: SparkSession, folder: str, recursive: bool = False, most: int = files.MOST_BYTES) -> DataFrame:
    """(rel, path, size, text, pages, backend, error) of a folder's files, each read once, where it is; no file is without a row."""
    return files.opened(spark, folder, extracted, "text string, pages int, backend string", SUPPORTED, recursive, most)


def read_directory(spark: SparkSession, folder: str, recursive: bool = False, batch_id: str = "batch", most: int = files.MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of a folder; what is unsupported, unreadable or larger than ``most`` bytes is a failure (batch_id, name, error)."""
    got = contents(spark, folder, recursive, most)
    failures = got.filter("error IS NOT NULL").select(F.lit(batch_id).alias("batch_id"), F.col("rel").alias("name"), "error")
    docs = got.filter("error IS NULL").select(F.lit(batch_id).alias("batch_id"), F.col("rel").alias("path"), F.col("rel").alias("name"), F.col("path").alias("source"), "backend", T.normalise(F.col("text")).alias("text"), "pages")
    return numbered(docs.withColumn("page_count", F.coalesce("pages", T.pages(F.col("text")))).drop("pages")), failures


def numbered(docs: DataFrame) -> DataFrame:
    """doc_ord in path order within a batch.  Only batch and path are sorted, in ranges; the texts stay where they are."""
    order = ranged(docs.select("batch_id", "path"), ["batch_id"], ["path"], "doc_ord")
    return docs.join(order, ["batch_id", "path"])


def read_samples(spark: SparkSession, path: str, batch_id: str = "samples") -> DataFrame:
    """documents[] of file, text and optional pages, in one JSON file."""
    rows = spark.read.schema("documents array<struct<file:string,text:string,pages:int>>").json(path, multiLine=True).select(F.explode("documents").alias("d"))
    docs = rows.select(F.lit(batch_id).alias("batch_id"), F.col("d.file").alias("path"), F.col("d.file").alias("name"), F.lit(None).cast("string").alias("source"), F.lit("sample").alias("backend"), T.normalise(F.col("d.text")).alias("text"), F.coalesce("d.pages", F.lit(1)).alias("page_count"))
    return numbered(docs)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    schema = "documents map<string,struct<type:string,client:string,event:string,needs_review:boolean,expect_flags:array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("documents").alias("name", "x")).select("name", "x.*")


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.schema("schema string, items array<struct<doc_id:string,source_name:string,decision:string,folder:string,filename:string>>").json(path, multiLine=True)
    if frame.filter("schema = 'foliant.approvals@1'").limit(1).count() == 0:
        raise ValueError(f"{path} is no approvals file")
    # of several items for one id the last counts
    return frame.select(F.posexplode("items").alias("ord", "i")).select("ord", "i.*")


def folder_parts(folder):
    """Surnames and given names of a client folder's name, with capitals: surname first before a comma, else last; a lone hyphenated name is several surnames."""
    none = F.array().cast("array<string>")
    head = F.split_part(folder, F.lit(","), F.lit(1))
    words = F.struct(F.contains(folder, F.lit(",")).alias("comma"), names.plain_words(folder).alias("all"), names.plain_words(head).alias("before"), names.plain_words(F.substring(folder, F.length(head) + 2, F.length(folder))).alias("after"))

    def parted(x):
        lone = (F.size(x.all) == 1) & F.contains(F.get(x.all, F.lit(0)), F.lit("-"))
        last = F.when(x.comma, x.before).when(lone, F.split(F.get(x.all, F.lit(0)), "-")).when(F.size(x.all) > 0, F.array(F.element_at(x.all, -1))).otherwise(none)
        given = F.when(x.comma, x.after).when(F.size(x.all) > 1, F.slice(x.all, 1, F.size(x.all) - 1)).otherwise(none)
        return F.struct(last.alias("last"), given.alias("given"))

    parts = T.let(words, parted)
    return names.title(parts["last"]), names.title(parts["given"])


def register_from_names(frame: DataFrame, column: str = "folder_name") -> DataFrame:
    surnames, given = folder_parts(F.col(column))
    return frame.select(F.col(column).alias("folder_name"), surnames.alias("surnames"), given.alias("given"))


def register_from_directory(spark: SparkSession, folder: str) -> DataFrame:
    """The folders directly below a root as the register; names that begin with a dot or an underscore are no clients."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = sorted(e.getPath().getName() for e in entries if e.isDirectory() and e.getPath().getName()[0] not in "._")
    return register_from_names(spark.createDataFrame([(n,) for n in found], "folder_name string"))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """A register from a CSV file, a JSON file, or a folder of client folders."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return register_from_directory(spark, path)
    return (register_from_csv if path.lower().endswith(".csv") else register_from_json)(spark, path)


def register_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Loose headers; several values in a field are parted by ; & or a comma; rows without a folder are skipped."""
    raw = spark.read.csv(path, header=True)
    have = {c.strip().lower(): c for c in raw.columns}

    def pick(*options):
        cols = [F.nullif(F.trim(raw[have[o]]), F.lit("")) for o in options if o in have]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    many = lambda c: F.filter(F.transform(F.split(c, "[;&,]"), lambda x: F.trim(x)), lambda x: x != "")
    x = raw.select(pick("folder_name", "folder", "client", "client_name", "name").alias("folder_name"), many(pick("surnames", "surname", "last_name")).alias("s"), many(pick("given_names", "given_name", "first_name")).alias("g")).filter("folder_name IS NOT NULL")
    surnames, given = folder_parts(F.col("folder_name"))
    return x.select("folder_name", F.coalesce("s", surnames).alias("surnames"), F.coalesce("g", given).alias("given"))


def register_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of entries, or an object with ``clients``."""
    entry = "struct<client_id:string,folder_name:string,surnames:array<string>,given_names:array<string>>"
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"struct<clients:array<{entry}>>")["clients"], F.from_json("value", f"array<{entry}>")).alias("c"))
    x = raw.select(F.explode("c").alias("c")).select("c.*").filter("folder_name IS NOT NULL")
    surnames, given = folder_parts(F.col("folder_name"))
    return x.select("folder_name", F.coalesce("surnames", surnames).alias("surnames"), F.coalesce("given_names", given).alias("given"))
