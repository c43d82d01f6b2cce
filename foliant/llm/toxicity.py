"""Toxicity: a bag of subword embeddings, averaged into a linear softmax.

A word is its character n-grams (with its edges) and itself, hashed into rows of an
embedding table; a text is the average of the rows of all its distinct words' n-grams
(a word said often counts once); two logits follow from it.  Table and softmax are
trained jointly, in numpy, on a bounded sample of labelled rows.  Misspellings that were
never seen share n-grams with words that were.

Being linear after the average, the model scores a text by one number a word, made
once for each distinct word of a batch.

Labels are learnt from rows whose crc32 of the id's decimal text is no multiple of
``FOLDS``; the rest is held out.  Of the rows learnt from, one in ``FOLDS`` by another hash
of the id is an inner fold: it says after which pass training stops, and the settings
below were chosen on it.  Null labels teach nothing; of several labels of an id the
largest counts, and of several texts of an id the least; null ids are not learnt from and
held out is false for them.  Null and empty texts get the score of the prior.  Without
labels of both kinds every text gets the share of the positive ones, or 0.  Repeated rows
are scored row by row.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbatch as tb
from .chunks import distinct

FOLDS = 5
#: Labelled rows learnt from at most, of either label, chosen by a hash of the id.
SAMPLE_ROWS = 2000
NGRAMS = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 4
SCALE = 300.0
#: Empty rows that every average also holds, so that few words alone decide little.
PADDING = 3000
#: Sampled texts that an n-gram must be in to be learnt.
LEAST_TEXTS = 2
#: Share of a text's n-grams that a training step sees: what one alone would say is learnt by its neighbours too.
KEEP = 0.5
EPOCHS = 24
#: Passes without a better inner fold after which training stops.
PATIENCE = 6
BATCH = 100
RATE = 0.5
DECAY = 3e-4
#: Entries of bags looked at together.
_PIECE = 1 << 19
#: How far the sample's own share of label 1 is undone in the loss: to the power of this.
PRIOR = 0.25


@dataclass
class Scorer:
    """What is left of a trained model for scoring: a number for each bucket, and the difference of the logits of nothing."""

    rows: np.ndarray
    bias: float


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams and of the word, joined, and their offsets."""
    data, off = tb.raw(words)
    text = data.tobytes().decode("utf-8", "replace")
    if len(text) == len(data):
        chars, at = data.astype(np.uint64), off
    else:
        rows = [w.decode("utf-8", "replace") for w in words.to_pylist()]
        chars = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    n = len(at) - 1
    # each word between two edges
    edged = np.full(len(chars) + 2 * n, 1, np.uint64)
    edged[np.arange(len(chars)) + 2 * tb.rows_of(at) + 1] = chars + np.uint64(2)
    at = at + 2 * np.arange(n + 1)
    hashes, rows = [], []
    for k in NGRAMS:
        g = np.flatnonzero(tb.within(at, k))
        hashes.append(tb.grams(edged, k)[g] + np.uint64(k))
        rows.append(np.searchsorted(at, g, "right") - 1)
    hashes.append(tb.hashes(data, off[:-1], off[1:]))
    rows.append(np.arange(n))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    bucket = (tb.mix(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def _texts(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word, and the offsets of the texts in the codes."""
    data, off = tb.raw(column)
    data = tb.LOWER[data]
    starts, ends, woff = tb.spans(data, off, tb.WORDISH)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), woff
    kept = tb.WORDISH[data]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    words, codes = distinct(np.compress(kept, data), at)
    return words, codes, woff


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, the buckets of its distinct words' n-grams and how often each is met, joined, and the texts' offsets in them."""
    buckets, counts, sizes = [], [], []
    for part in tb.slices(iter([pa.record_batch([column], names=["text"])])):
        words, codes, woff = _texts(part.column(0))
        bucket, boff = subwords(words)
        for r in range(len(woff) - 1):
            total = np.bincount(tb.ragged(bucket, boff, np.unique(codes[woff[r] : woff[r + 1]]))[0], minlength=BUCKETS)
            buckets.append(np.flatnonzero(total).astype(np.int32))
            counts.append(total[buckets[-1]].astype(np.float32))
            sizes.append(len(buckets[-1]))
    return np.concatenate([np.zeros(0, np.int32), *buckets]), np.concatenate([np.zeros(0, np.float32), *counts]), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


class _Net:
    """Table, softmax and their sums of squared gradients (AdaGrad).  Rows start at zero, so an n-gram that was never learnt from says nothing."""

    def __init__(self, n: int, rng: np.random.Generator):
        self.parts = [np.zeros((n, WIDTH), np.float32), rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)]
        self.squares = [np.full(x.shape, 1e-4, np.float32) for x in self.parts]

    def step(self, ids: np.ndarray, weight: np.ndarray, row: np.ndarray, labels: np.ndarray, rate: np.ndarray) -> None:
        table, soft, bias = self.parts
        x = table[ids] * weight[:, None]
        mean = np.stack([np.bincount(row, x[:, d], len(labels)) for d in range(WIDTH)], 1).astype(np.float32)
        logit = mean @ soft + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p *= (rate / len(labels))[:, None]
        g = (p @ soft.T)[row] * weight[:, None]
        table *= np.float32(1 - DECAY)
        grads = np.stack([np.bincount(ids, g[:, d], len(table)) for d in range(WIDTH)], 1).astype(np.float32), mean.T @ p, p.sum(axis=0)
        for part, square, grad in zip(self.parts, self.squares, grads):
            square += grad * grad
            part -= np.float32(RATE) * grad / np.sqrt(square)

    def margins(self) -> tuple[np.ndarray, float]:
        """What each row adds to the difference of the logits, and the difference of the biases."""
        table, soft, bias = self.parts
        return table.astype(np.float64) @ (soft[:, 1] - soft[:, 0]).astype(np.float64), float(bias[1] - bias[0])


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 1) -> Scorer:
    """A scorer from texts and their labels, without an inner fold."""
    return learn(*bags(pa.array(texts, pa.large_string())), labels, prior, seed=seed)


def learn(ids: np.ndarray, counts: np.ndarray, off: np.ndarray, labels: np.ndarray, prior: float, inner: np.ndarray | None = None, seed: int = 1) -> Scorer:
    """Joint stochastic gradient (AdaGrad) on the cross-entropy; ``prior`` is the share of label 1 outside the sample.

    ``inner``: rows that are not learnt from; the pass that scores them best is the one kept."""
    labels = np.asarray(labels, np.int64)
    inner = np.zeros(len(labels), bool) if inner is None or not inner.any() or inner.all() else inner
    own = np.flatnonzero(~inner)
    if not len(own) or labels[own].min() == labels[own].max():
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Scorer(np.zeros(BUCKETS, np.float64), float(np.log(share / (1 - share))))
    row = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(off))
    # in pieces, and the weights in place of the counts: the driver holds the sample's bags about twice
    pieces = [slice(at, at + _PIECE) for at in range(0, len(ids), _PIECE)]
    size, texts = np.zeros(len(labels)), np.zeros(BUCKETS, np.int64)
    for x in pieces:
        size += np.bincount(row[x], counts[x], len(labels))
        texts += np.bincount(ids[x][~inner[row[x]]], minlength=BUCKETS)
    scale, weight = (SCALE / (PADDING + size)).astype(np.float32), counts
    for x in pieces:
        weight[x] *= scale[row[x]]
    # n-grams of few sampled texts say nothing about others
    known = np.flatnonzero(texts >= LEAST_TEXTS)
    number = np.full(BUCKETS, -1, np.int32)
    number[known] = np.arange(len(known))
    ids = number[ids]
    held = ids >= 0
    ids, weight, row = ids[held], weight[held], row[held]
    off = np.searchsorted(row, np.arange(len(labels) + 1, dtype=np.int32))
    asked = np.flatnonzero(inner)
    in_ids, in_off = tb.ragged(ids, off, asked)
    in_weight, in_row = tb.ragged(weight, off, asked)[0], tb.rows_of(in_off)
    del row, held, counts
    rate = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    rate = (rate / rate.mean()) ** PRIOR
    rng = np.random.default_rng(seed)
    net, best, since, least = _Net(len(known), rng), None, 0, np.inf
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            mine, edge = tb.ragged(ids, off, batch)
            seen = tb.ragged(weight, off, batch)[0] * (rng.random(len(mine), dtype=np.float32) < KEEP) / np.float32(KEEP)
            net.step(mine, seen, tb.rows_of(edge), labels[batch], rate[batch])
        value, bias = net.margins()
        if inner.any():
            margin = np.bincount(in_row, in_weight * value[in_ids], len(asked)) + bias
            loss = float((rate[inner] * np.logaddexp(0, np.where(labels[inner] == 1, -margin, margin))).sum())
            since += 1
            if loss < least:
                best, since, least = (value, bias), 0, loss
            if since >= PATIENCE:
                break
        else:
            best = value, bias
    rows = np.zeros(BUCKETS, np.float64)
    rows[known] = SCALE * best[0]
    return Scorer(rows, best[1])


def scores(column: pa.Array, scorer: Scorer) -> np.ndarray:
    words, codes, woff = _texts(column)
    bucket, boff = subwords(words)
    total = np.concatenate([[0.0], np.cumsum(scorer.rows[bucket])])
    value, size = total[boff[1:]] - total[boff[:-1]], np.diff(boff)
    n, many = len(woff) - 1, max(1, len(words))
    pair = np.unique(tb.rows_of(woff) * many + codes)
    row, code = pair // many, pair % many
    mean = np.bincount(row, value[code], n) / (PADDING + np.bincount(row, size[code], n))
    return 1 / (1 + np.exp(-np.clip(mean + scorer.bias, -500, 500)))


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Learns from ``sample_rows`` rows of either label at most.

    The ids are chosen first; what comes to the driver then is not the texts but their bags, made where the texts are:
    ``BUCKETS`` pairs of numbers a text at most, however long it is."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.select(doc_id, F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return train([], np.zeros(0), 0.0)
    chosen = [r for label in (1, 0) for r in known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()]
    label = {r.doc_id: r.toxic for r in chosen}
    ids = documents.sparkSession.createDataFrame([(k,) for k in label], "id long")
    own = documents.select(doc_id, "text").filter("text IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min("text").alias("text"))

    def bagged(part):
        ids, counts, off = bags(part.column(1))
        packed = [_pack(ids[i:j], counts[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        return pa.record_batch([part.column(0), pa.array(packed, pa.binary()), pa.array(np.diff(off))], names=["doc_id", "bag", "n"])

    rows = tb.mapped(own, bagged, "doc_id long, bag binary, n long").toArrow().sort_by("doc_id")
    named, off = rows.column("doc_id").to_pylist(), np.concatenate([[0], np.cumsum(rows.column("n").to_numpy())]).astype(np.int64)
    ids, counts = np.empty(off[-1], np.int32), np.empty(off[-1], np.float32)
    for r, bag in enumerate(rows.column("bag")):
        ids[off[r] : off[r + 1]], counts[off[r] : off[r + 1]] = _unpack(bag.as_py())
    del rows
    inner = np.array([zlib.crc32(f"inner {k}".encode()) % FOLDS == 0 for k in named], bool)
    return learn(ids, counts, off, np.array([label[k] for k in named], np.int64), share, inner)


def _pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A bag in few bytes: the gaps between its ascending buckets, and the counts."""
    return zlib.compress(np.diff(ids, prepend=np.int32(0)).astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)


def _unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = np.frombuffer(zlib.decompress(bag), "<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int32), counts.astype(np.float32)


def toxicity(documents: DataFrame, labels: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scorer = scorer or fit(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def run(part):
        s = scores(part.column(1), shared.value)
        return pa.record_batch([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = tb.mapped(documents, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(documents: DataFrame, labels: DataFrame | None = None, scorer: Scorer | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer or fit(documents, labels))
    return tb.rewritten(documents, lambda part: part.filter(pa.array(scores(tb.text_of(part), shared.value) < threshold)))
