"""Secrets: base patterns, and compression novelty beside them.

The base patterns find assignments, access keys and long hexadecimal strings.  The rest is
asked of a compressor: a candidate is a run of key characters near a sensitive word
("bearer", "credential", "api key", ...), and its novelty is what it adds to the compressed
size of the text around it, by zstandard primed with a dictionary of identifiers and
code.  Names, paths and what the surroundings already say compress against one or the
other; a key does not.  A candidate is reported if it adds at least ``NOVEL`` of what a
random string of its length and alphabet would add; if it does not, its parts between dots
and slashes are asked about.

Base spans stay as they are, and candidates that touch one are left alone.  Work is linear
in the text: each run is weighed once, against ``BEFORE`` and ``AFTER`` characters.

Null and empty texts have no spans.  Offsets are code points, end exclusive.  Repeated
rows are answered row by row.  Other columns are ignored.  No rows make no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from . import textbatch as tb

KINDS = ("assign", "access", "hex", "novel")
ASSIGN, ACCESS, HEX, NOVELTY = range(4)
#: Share of the bytes of a random string of the same length and alphabet that a candidate must add.
NOVEL = 0.88
#: Characters of the text around a candidate that are compressed with it.
BEFORE, AFTER = 256, 128
#: Characters that a candidate may lie before the start, or begin after the end, of a sensitive word.
AHEAD, BEHIND = 40, 80
#: Characters of a candidate, or of its longest part between dots and slashes, at least; and of each of two kinds of characters.
LEAST, LEAST_OF_KIND = 12, 2
#: Bytes that zstandard's table of symbol lengths may take where it packs letters; below, it stores them as they are.
TABLE_BYTES = 40
LEVEL = 12
#: Characters of the code in the dictionary that stand before every text: their match pays a block's fixed costs, which else hide small savings.
OPENING = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Sensitive words, in any case.
CUES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "session", "cookie", "webhook", "jwt", "client id", "client_id", "connection string", "connection_string")
#: Texts without a match have no spans.
_ANY = "(?i:" + "|".join(CUES) + ")|AKIA|[0-9a-f]{24}"
_RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LEAST)
_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.~-")
_WITHIN = re.compile(r"[^/.]{%d,}" % LEAST)
_PART = re.compile(r"[/.]")

#: Parts that identifiers are made of, and words and marks of code.
PARTS = (
    "get set is has new old max min num user name password token secret key auth api client server session request response header cookie account access private public config default env environment variable service manager factory handler provider "
    "context builder controller repository database connection string value index count list array map type class object file path url uri http https host port path query param args data json xml html text message error exception status code version "
    "test example sample temp local global static final init create update delete remove add find load save read write send receive parse format validate encode decode encrypt decrypt hash sign verify login logout register refresh expire timeout"
).split()
CODE = """import from return function const let var def class public private protected static void null None true false True False if else for while try except catch throw raise self. this. os.environ["process.env.getenv("System.getProperty("config.get("
print( console.log( String int long boolean async await export default package namespace using include "Authorization": "Content-Type": "application/json" text/plain https://www. http://localhost: .com/ .org/ .net/ /api/v1/ /api/v2/ /usr/local/bin/ /home/user/ .html .json .yaml .properties
your-secret-here YOUR_API_KEY_HERE changeme placeholder example.com 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000000000 deadbeef 2020-01-01T00:00:00.000Z"""


def dictionary() -> bytes:
    """Identifiers in the usual spellings, then code: what is likeliest stands last, where the compressor finds it cheapest."""
    pairs = list(zip(PARTS, PARTS[1:] + PARTS[:1])) + list(zip(PARTS, PARTS[7:] + PARTS[:7]))
    camel = [a + b.title() for a, b in pairs]
    pascal = [a.title() + b.title() for a, b in pairs]
    snake = [f"{a}_{b}" for a, b in pairs]
    return "\n".join([" ".join(x) for x in ([s.upper() for s in snake], snake, [f"{a}-{b}" for a, b in pairs], pascal, camel)] + [CODE]).encode()


class Novelty:
    """Bytes that a string adds to the compressed size of what stands around it."""

    def __init__(self, primed: bytes):
        primer = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=LEVEL)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def added(self, before: str, string: str, after: str) -> int:
        a, b = (CODE[:OPENING] + before).encode(), after.encode()
        return len(self.press(a + string.encode() + b)) - len(self.press(a + b))


@lru_cache(4)
def novelty(primed: bytes | None = None) -> Novelty:
    return Novelty(dictionary() if primed is None else primed)


def random_bytes(string: str) -> float:
    """What a random string of the length and alphabet of this one would add."""
    if re.fullmatch("[0-9]+", string):
        letters = 10
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", string):
        letters = 16
    else:
        letters = sum(n for kind, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[+/_=.~-]", 2)) if re.search(kind, string))
    return min(len(string), len(string) * math.log2(letters) / 8 + TABLE_BYTES)


def _places(low: str, words: tuple[str, ...]) -> list[tuple[int, int]]:
    """Starts and ends of all occurrences of some words, ascending."""
    out = []
    for word in words:
        at = low.find(word)
        while at >= 0:
            out.append((at, at + len(word)))
            at = low.find(word, at + 1)
    return sorted(out)


def lowered(text: str) -> str:
    """A to Z in lower case, all else as it is, code point by code point."""
    return text.encode().lower().decode()


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind; an assignment of fewer than 6 characters is dropped and not tried again."""
    out, done = [], 0
    for at, _ in _places(lowered(text) if low is None else low, _NAMES):
        if at >= done and (m := _ASSIGN.match(text, at)):
            done = m.end()
            if done - m.start(2) >= 6:
                out.append((ASSIGN, at, done))
    if "AKIA" in text:
        out += [(ACCESS, m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [(HEX, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def looks_like_key(run: str) -> bool:
    """Two kinds of characters, and a part that is long enough."""
    kinds = (str.isdigit, str.islower, str.isupper)
    return max(map(len, _PART.split(run))) >= LEAST and sum(sum(map(k, run)) >= LEAST_OF_KIND for k in kinds) >= 2


def candidates(text: str, low: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters near a sensitive word that touch no base span, each once."""
    taken = sorted((a, b) for _, a, b in base)
    begin, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    near: list[list[int]] = []
    for start, end in _places(low, CUES):
        a, b = max(0, start - AHEAD), end + BEHIND
        if near and a <= near[-1][1]:
            near[-1][1] = max(b, near[-1][1])
        else:
            near.append([a, b])
    done = 0
    for first, high in near:
        at = max(first, done)
        while at > done and text[at - 1] in _CHARS and text[at : at + 1] in _CHARS:
            at -= 1
        while m := _RUN.search(text, at, high + LEAST):
            if m.start() > high:
                break
            m = _RUN.match(text, m.start())
            at = done = m.end()
            a, b = m.start(), m.end()
            while a < b and text[a] in ".-_=~/+":
                a += 1
            while b > a and text[b - 1] in ".-_~":
                b -= 1
            k = bisect_left(begin, b)
            if b - a >= LEAST and not (k and reach[k - 1] > a) and looks_like_key(text[a:b]):
                yield a, b


def find(text: str, weigh: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, by start, then kind."""
    low = lowered(text)
    base = base_spans(text, low)
    novel = lambda a, b: weigh.added(text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER]) >= NOVEL * random_bytes(text[a:b])
    more = []
    for a, b in candidates(text, low, base):
        if novel(a, b):
            more.append((NOVELTY, a, b))
        else:  # a key may stand within a path
            parts = ((a + m.start(), a + m.end()) for m in _WITHIN.finditer(text[a:b]))
            more += [(NOVELTY, x, y) for x, y in parts if y - x < b - a and looks_like_key(text[x:y]) and novel(x, y)]
    return base, sorted(base + more, key=lambda x: (x[1], x[0]))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def detect(documents: DataFrame, primed: bytes | None = None) -> DataFrame:
    """A row per document: base counts and digest, all spans, and how many are of compression novelty.  ``primed``: another dictionary."""

    def run(part):
        weigh, rows = novelty(primed), []
        asked = pc.fill_null(pc.match_substring_regex(part.column(1), _ANY), False)
        for text in pc.if_else(asked, part.column(1), pa.scalar("", part.column(1).type)).to_pylist():
            base, spans = find(text, weigh)
            counts = [sum(k == kind for k, _, _ in base) for kind in (ASSIGN, ACCESS, HEX)]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
        return pa.record_batch([part.column(0), *map(pa.array, zip(*rows))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return tb.mapped(documents, run, SCHEMA)
