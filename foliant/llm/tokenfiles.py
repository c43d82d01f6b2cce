"""Token ids as wavelet-matrix files in ascending document order.

Documents are dealt by range of id and of the text's beginning, so that an id that many
rows have is no single task, and a task writes its documents in order, a file for each
``SHARD_TOKENS`` tokens (a longer document has a file of its own).  Files are written
under another name and moved, so a repeated task replaces a file by an equal one.  The
driver learns one number for each partition.

Null and empty texts have the end id alone.  Null ids come first.  Repeated ids are
ordered by text, a null text first.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import textbatch as tb
from .chunks import Memory, encoded, joined
from .shared import filesystem, fresh, put, written
from .wavelet import Wavelet, dump

END_ID = 2
SHARD_TOKENS = 4 << 20
#: Characters of a text by which rows of one id are dealt.
HEAD_CHARS = 64
_SPACE = tb.table(b" \n\r\t")
_ALNUM = tb.table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARKS = tb.table(bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum()))
#: Second bytes of the letters U+00C0 to U+00FF (all but the two signs among them).
_LATIN = tb.table(bytes(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)))


def breaks(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places that no pre-token of a byte-level BPE reaches over: before white space that follows something else,
    after a line end or tab between two others, and between a letter or digit and an ASCII mark.

    Beyond ASCII, only two-byte letters are taken for something else (lead byte C3 to DF: no white space there); any subset is right."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    solid = (data > 0x20) & (data < 0x7F)
    wide = (data >= 0xC3) & (data < 0xE0)
    ends = solid.copy()
    ends[1:] |= wide[:-1] & (data[1:] >= 0x80)
    before = np.flatnonzero(ends[:-1] & space[1:]) + 1
    single = before[(data[before] != 0x20) & (before + 1 < len(data))]
    alnum = _ALNUM[data]
    alnum[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    marks = np.flatnonzero(alnum[:-1] & _MARKS[data[1:]]) + 1
    return np.concatenate([before, single[(solid | wide)[single + 1]] + 1, marks])


#: A chunk that is one pre-token whatever stands beside it: letters, with one space in front or none.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")


def added_breaks(data: np.ndarray, off: np.ndarray, at: np.ndarray, added: re.Pattern | None) -> np.ndarray:
    """The places ``at`` with the edges of the strings of added tokens in the rows, and without the places inside such strings."""
    blob = data.tobytes() if added else b""
    if not added or not added.search(blob):
        return at
    found = [(a + m.start(), a + m.end()) for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in added.finditer(blob[a:b])]
    inside = np.zeros(len(data) + 1, bool)
    for a, b in found:
        inside[a + 1 : b] = True
    return np.concatenate([at[~inside[at]], np.array(found, np.int64).ravel()])


@lru_cache(2)
def _added(path: str) -> re.Pattern | None:
    """The strings that the library takes as one id each wherever they stand: leftmost, then longest."""
    from tokenizers import Tokenizer

    tokens = list(Tokenizer.from_file(path).get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens):
        raise ValueError("added tokens that look at what stands beside them are not supported")
    names = sorted((t.content.encode() for t in tokens if t.content), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, names))) if names else None


def _byte_letters() -> np.ndarray:
    """The letters that a byte-level vocabulary writes bytes as: printable Latin-1 as it is, the rest from U+0100 on.  Line ends stay."""
    rest = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    out = np.arange(256, dtype=np.uint16)
    out[rest] = 256 + np.arange(len(rest))
    out[10] = 10
    return out


@lru_cache(2)
def _memory(path: str) -> Memory:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Single pre-tokens go to the library's BPE model at once, all other chunks through its whole encoder."""
        tokenize = model.tokenize
        single = list(map(_WORD.fullmatch, chunks))
        words = letters[np.frombuffer(b"\n".join([c for c, m in zip(chunks, single) if m]), np.uint8)].tobytes().decode("utf-16-le").split("\n")
        word = iter(words)
        lists = [[t.id for t in tokenize(next(word))] if m else None for m in single]
        rest = [k for k, m in enumerate(single) if not m]
        for k, e in zip(rest, tokenizer.encode_batch_fast([chunks[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)):
            lists[k] = e.ids
        return joined(lists)

    return Memory(encode)


def token_ids(column: pa.Array, tokenizer: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, each with the end id, and their offsets."""
    data, off = tb.raw(column)
    ids, at = encoded(data, off, added_breaks(data, off, breaks(data, off), _added(tokenizer)), _memory(tokenizer))
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def write_tokens(documents: DataFrame, tokenizer: str, folder: str | None = None, shard_tokens: int = SHARD_TOKENS, bits: int = 16) -> DataFrame:
    """Writes the files and returns (part, seq, path, n_tokens, n_docs, start), start being the number of ids in all files before."""
    folder = folder or fresh(documents.sparkSession, "tokens")
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring("text", 1, HEAD_CHARS)).sortWithinPartitions("doc_id", "text")

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, docs, sizes, held, nameless = [], [], [], 0, 0

        def close():
            nonlocal ids, docs, sizes, held, nameless, seq
            path = f"{folder}/{part:08d}-{seq:06d}.wm"
            put(path, [dump(np.concatenate(ids), np.concatenate(docs), np.concatenate(sizes), bits, nameless)])
            row = pa.record_batch([pa.array([part]), pa.array([seq]), pa.array([path]), pa.array([held]), pa.array([sum(map(len, docs))])], names=["part", "seq", "path", "n_tokens", "n_docs"])
            ids, docs, sizes, held, nameless, seq = [], [], [], 0, 0, seq + 1
            return row

        for piece in tb.slices(batches, most=2 * tb.SLICE_BYTES):
            got, at = token_ids(piece.column(1), tokenizer)
            if len(got) and int(got.max()) >> bits:
                raise ValueError(f"token id {int(got.max())} does not fit {bits} bits")
            ids.append(got.astype(np.uint16 if bits <= 16 else np.uint32))
            docs.append(piece.column(0).fill_null(0).to_numpy())
            nameless += piece.column(0).null_count
            sizes.append(np.diff(at))
            held += len(got)
            if held >= shard_tokens:
                yield close()
        if docs:
            yield close()
        tb.release()

    files = written(ordered.mapInArrow(run, "part long, seq long, path string, n_tokens long, n_docs long"), "token-files")
    before, base = 0, []
    for r in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base.append((r.part, before))
        before += r.n
    base = documents.sparkSession.createDataFrame(base, "part long, base long")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("own", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(base, "part").select("part", "seq", "path", "n_tokens", "n_docs", (F.col("base") + F.col("own")).alias("start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone but for each file's start."""
    spark = files.sparkSession
    tasks = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = filesystem(path)
                with store.open_input_file(name) as f:
                    shard = Wavelet(f.read())
                docs, sizes = shard.docs()
                ids = shard.ids().astype("<u4")
                edge = np.concatenate([[0], np.cumsum(sizes)])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.record_batch([pa.array(docs, mask=np.arange(len(docs)) < shard.nameless), pa.array(start + edge[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
