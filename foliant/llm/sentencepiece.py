"""SentencePiece encoding and decoding over shared prefixes.

A text is a row of marked words (a run of word marks, then other characters).  The
distinct words of a batch are sorted, which is the order of a depth-first walk of
their trie; the walk keeps the forward state of every character on the path from the
root, so a common prefix is scored once.

For a unigram model the state at a place is the best score and its last piece.  For a
BPE model, summed scores do not give the model's own segmentation.  There the state is
the last piece of the prefix's BPE encoding: of the pieces that end at the place it is
the one whose predecessor state it can stand beside, that is, no merge would have
crossed their border before both were complete.  It is Viterbi's recursion with such
pairs scored 0 and all others minus infinity, and gives the library's result.

Characters in no piece become byte pieces; words in which merges of equal rank meet
(runs of marks) are merged outright.  Decoding undoes it all: a word mark written in
the text itself comes back as a space, as in the library.

Null and empty texts have no ids.  Repeated rows are encoded row by row.  Other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb
from .chunks import Memory, encoded, joined

MARK = "▁"
_MARK = MARK.encode()
_PAIRS = 2_000_000


@dataclass
class Model:
    """What encoding needs of a model file, in plain tables; made once, on the driver."""

    kind: str
    every: dict[str, int]
    pieces: dict[str, int]
    scores: dict[int, float]
    byte: list[int]
    texts: list[bytes]
    rank: dict[int, int] = field(default_factory=dict)
    halves: dict[int, tuple[int, int]] = field(default_factory=dict)
    joined: dict[tuple[int, int], int] = field(default_factory=dict)
    ties: frozenset[str] = frozenset()
    longest: int = 1
    name: str = ""


def merge(word: str, pieces: dict[str, int], scores: dict[int, float]) -> list[str]:
    """BPE outright: the best-scored adjacent pair, the leftmost of equals, until none is a piece.

    Pairs wait in a heap over a linked list of parts; an entry whose parts have changed since is passed over."""
    parts, n = list(word), len(word)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    waiting = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (p := pieces.get(parts[i] + parts[j])) is not None:
            heappush(waiting, (-scores[p], i, j, len(parts[i]) + len(parts[j])))

    for i in range(n - 1):
        offer(i, i + 1)
    while waiting:
        _, i, j, size = heappop(waiting)
        if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p]


@lru_cache(2)
def load(path: str, kind: str = "bpe") -> Model:
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, scores, byte, texts = {}, {}, [-1] * 256, []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"" if sp.is_control(i) else " ⁇ ".encode())
        else:
            pieces[piece], scores[i] = i, sp.get_score(i)
            texts.append(piece.replace(MARK, " ").encode())
    model = Model(kind, dict(pieces), pieces, scores, byte, texts, longest=max(map(len, pieces)), name=f"{path}:{kind}")
    if kind == "bpe":
        seen: dict[float, int] = {}
        for i, s in scores.items():
            seen[s] = seen.get(s, 0) + 1
        odd = {p for p, i in pieces.items() if len(p) > 1 and seen[scores[i]] > 1}
        model.ties = frozenset(odd | {p for p in pieces if len(p) > 1 and p not in odd and _late(p, pieces, scores)})
        order = sorted((p for p in pieces if len(p) > 1 and p not in model.ties), key=lambda p: -scores[pieces[p]])
        model.rank = {pieces[p]: k + 1 for k, p in enumerate(order)}
        whole = {p for p in pieces if len(p) == 1}
        for p in sorted(order, key=len):
            last = _halves(p, pieces, scores)
            if len(last) == 2 and last[0] in whole and last[1] in whole:
                whole.add(p)
                model.halves[pieces[p]] = pieces[last[0]], pieces[last[1]]
        for p in whole:
            if len(p) > 1:
                for c in range(1, len(p)):
                    a, b = p[:c], p[c:]
                    if a in whole and b in whole:
                        model.joined[pieces[a], pieces[b]] = model.rank[pieces[p]]
        for p in set(pieces) - whole - model.ties:
            del model.pieces[p]
    return model


def _halves(piece: str, pieces: dict[str, int], scores: dict[int, float]) -> list[str]:
    """What BPE makes of the piece's text without the piece itself: two parts, if it makes the piece."""
    return merge(piece, {x: pieces[x] for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if (x := piece[i:j]) != piece and x in pieces}, scores)


def _late(piece: str, pieces: dict[str, int], scores: dict[int, float]) -> bool:
    """Whether the piece ranks before one of its two parts, so that ranks don't tell the order of merges."""
    parts = _halves(piece, pieces, scores)
    return len(parts) == 2 and any(len(x) > 1 and scores[pieces[x]] < scores[pieces[piece]] for x in parts)


class Walk:
    """The depth-first walk over sorted distinct words."""

    def __init__(self, model: Model):
        self.m = model
        self.pairs: dict[int, bool] = {}
        self.known = {c for p in model.every for c in p}
        short = [t for t in model.ties if not any(u != t and u in t for u in model.ties)]
        self.tied = re.compile("|".join(map(re.escape, short))) if short else None

    def beside(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: walk both pieces' merges back from the border, latest first,
        and see whether a pair that met there was to be joined before."""
        m = self.m
        rank, halves, joined = m.rank, m.halves, m.joined
        ra, rb = rank.get(a, 0), rank.get(b, 0)
        bar = 1 << 60
        while True:
            r = joined.get((a, b))
            if r is not None and r < bar:
                return False
            if not ra and not rb:
                return True
            # of the two merges the later one is undone; of equals the right one comes later
            if ra > rb:
                bar = ra
                a = halves[a][1]
                ra = rank.get(a, 0)
            else:
                bar = rb + (1 if rb else 0)
                b = halves[b][0]
                rb = rank.get(b, 0)

    def odd(self, word: str) -> bool:
        """Whether pieces of equal rank, or ones that rank before their parts, occur in the word."""
        return bool(self.tied) and self.tied.search(word) is not None

    def outright(self, word: str) -> list[int]:
        out = []
        for p in merge(word, self.m.every, self.m.scores):
            i = self.m.every.get(p)
            out += [i] if i is not None else [self.m.byte[x] for x in p.encode()]
        return out

    def bpe(self, words: list[str]) -> list[list[int]]:
        """Ids of sorted words."""
        m, pairs, beside = self.m, self.pairs, self.beside
        get, longest, known = m.pieces.get, m.longest, self.known
        if len(pairs) > _PAIRS:
            pairs.clear()
        state, size = [-1], [0]  # last piece of each prefix on the path, and its length; -2: bytes
        out, before = [], ""
        for word in words:
            n, shared = len(word), 0
            top = min(n, len(before))
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :], size[shared + 1 :]
            before = word
            for i in range(shared + 1, n + 1):
                if word[i - 1] not in known:
                    state.append(-2)
                    size.append(1)
                    continue
                for l in range(min(i, longest), 0, -1):
                    p = get(word[i - l : i])
                    if p is not None:
                        q = state[i - l]
                        if q >= 0:
                            key = q << 32 | p
                            ok = pairs.get(key)
                            if ok is None:
                                ok = pairs[key] = beside(q, p)
                            if not ok:
                                continue
                        state.append(p)
                        size.append(l)
                        break
                else:
                    raise AssertionError(f"no piece ends at {i} of {word!r}")
            i, ids = n, []
            while i:
                p = state[i]
                if p == -2:
                    ids.extend(m.byte[x] for x in reversed(word[i - 1].encode()))
                else:
                    ids.append(p)
                i -= size[i]
            ids.reverse()
            out.append(ids)
        return out

    def unigram(self, words: list[str], unknown: float = -1e6) -> list[list[int]]:
        m = self.m
        get, scores, longest = m.pieces.get, m.scores, m.longest
        score, state, size = [0.0], [-1], [0]
        out, before = [], ""
        for word in words:
            n, shared = len(word), 0
            top = min(n, len(before))
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], state[shared + 1 :], size[shared + 1 :]
            before = word
            for i in range(shared + 1, n + 1):
                best, last, length = score[i - 1] + unknown, -2, 1
                for l in range(1, min(i, longest) + 1):
                    p = get(word[i - l : i])
                    if p is not None and (s := score[i - l] + scores[p]) > best:
                        best, last, length = s, p, l
                score.append(best)
                state.append(last)
                size.append(length)
            i, ids = n, []
            while i:
                ids.extend([state[i]] if state[i] >= 0 else [m.byte[x] for x in reversed(word[i - 1].encode())])
                i -= size[i]
            out.append(ids[::-1])
        return out

    def __call__(self, chunks: list[bytes]) -> list[list[int]]:
        words = [c.decode("utf-8", "replace").replace(" ", MARK) for c in chunks]
        order = sorted(range(len(words)), key=words.__getitem__)
        if self.m.kind == "unigram":
            plain = order
        else:
            plain = [k for k in order if not self.odd(words[k])]
        out: list[list[int]] = [[]] * len(words)
        for k, ids in zip(plain, (self.unigram if self.m.kind == "unigram" else self.bpe)([words[k] for k in plain])):
            out[k] = ids
        if len(plain) < len(order):
            done = set(plain)
            for k in order:
                if k not in done:
                    out[k] = self.outright(words[k])
        return out


_walks: dict[str, Memory] = {}


def _prefixed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text that isn't empty with a space in front, and written word marks as spaces."""
    text = data.tobytes()
    if _MARK in text:
        rows = [text[a:b].replace(_MARK, b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        data, off = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    full = np.diff(off) > 0
    return np.insert(data, off[:-1][full], 0x20), off + np.concatenate([[0], np.cumsum(full)])


def _apart(data: np.ndarray, model: Model) -> np.ndarray:
    """Between which neighbouring bytes no piece reaches, so that a text can be cut there: their two characters stand
    side by side in no piece.  ASCII is told apart by character, all beyond it is one class."""
    if not hasattr(model, "_met"):
        met = np.zeros((129, 129), bool)
        for p in model.every:
            codes = [min(128, ord(c)) for c in p.replace(MARK, " ")]
            met[codes[:-1], codes[1:]] = True
        met[128, 128] = True
        met[0x20, 0x20] = True
        model._met = ~met.ravel()
    code = np.minimum(data, 128).astype(np.int16)
    return model._met[code[:-1] * np.int16(129) + code[1:]]


def encode(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, joined, and their offsets."""
    if model.name not in _walks:
        _walks.clear()
        walk = Walk(model)
        _walks[model.name] = Memory(lambda chunks: joined(walk(chunks)))
    data, off = _prefixed(*tb.raw(column))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    at = np.flatnonzero(_apart(data, model)) + 1
    return encoded(data, off, at, _walks[model.name])


def decode(ids: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows and their offsets; the space in front of a row is taken off."""
    if not hasattr(model, "_flat"):
        model._flat = np.frombuffer(b"".join(model.texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in model.texts])]).astype(np.int64)
    data, at = tb.ragged(*model._flat, np.asarray(ids, np.int64))
    rows = at[off]
    full = np.flatnonzero(np.diff(rows) > 0)
    first = rows[:-1][full][data[rows[:-1][full]] == 0x20]
    keep = np.ones(len(data), bool)
    keep[first] = False
    return np.compress(keep, data), np.concatenate([[0], np.cumsum(keep)])[rows]


def encode_documents(documents: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): round_trip is whether the decoded ids give the text's own bytes."""
    shared = documents.sparkSession.sparkContext.broadcast(load(model_path, kind))

    def run(part):
        model = shared.value
        data, off = tb.raw(part.column(1))
        ids, at = encode(part.column(1), model)
        back, back_off = decode(ids, at, model)
        same = np.diff(back_off) == np.diff(off)
        if len(back) == len(data) and same.all():
            wrong = np.flatnonzero(back != data)
            same[np.searchsorted(off, wrong, "right") - 1] = False
        else:
            for r in np.flatnonzero(same):
                same[r] = np.array_equal(back[back_off[r] : back_off[r + 1]], data[off[r] : off[r + 1]])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        return pa.record_batch([part.column(0), pa.array(np.diff(at)), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return tb.mapped(documents, run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
