"""Personal data: base patterns, and a semi-Markov conditional random field beside them.

The base patterns find what is written by the book, in time linear in the text.  The
random field reads the regions around what remains: it scores whole candidate segments
(their digit groups, check sums, frame and context) against every type at once, and
dynamic programming over segments of at most ``MOST_WIDTH`` chooses boundaries and types
together, over a region of any length.  A segment's width counts at most ``TOKEN_WIDTH`` of each
token, so that a key or a signed token of any length is one step; what is beyond
``MOST_WIDTH`` are phrases of many words.  Base spans stay: segments that touch one are no candidates, so that
none of them stands in the way of another.  Beside personal data the field marks secrets (keys, tokens, passwords).

The field is trained here by stochastic gradient on its own log-likelihood, over
sentences generated with their spans (``examples``); no row of the input is used.

Null and empty texts have no spans.  Offsets are code points, end exclusive.  Repeated
rows are answered row by row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
BASE = KINDS[:4]
#: Width of a segment, of which a token counts its length or so much at most; and tokens that a segment may have: as many as its width allows.
MOST_WIDTH, TOKEN_WIDTH = 48, 12
MOST_TOKENS = MOST_WIDTH
#: Characters around a trigger that are looked at.
REACH = 48
#: Letters, digits and marks of keys in a row that are one token, from so many on; segments longer than that are described without their digit groups.
KEY_RUN = 49
#: Tokens at which the segments that are scored together begin.
BLOCK = 512
AROUND = 6
EXAMPLES, LONG_EXAMPLES = 1100, 250
EPOCHS = 6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|\b[dD][oO][tT]\b|(?<=[\[({])[aA][tT](?=[\])}])")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=]{%d,}|[^\W_]+|\s+|." % KEY_RUN, re.S)
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=")
_SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    done = last = 0
    at = text.find("@")
    while at >= 0:
        low = max(done, last)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _HOST.match(text, at)):
            yield start, m.end()
            done = m.end()
        last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; matches that fail their check are dropped and not tried again."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# --- the field ---------------------------------------------------------------------

_CUES = {"phone", "tel", "telephone", "call", "fax", "mobile", "card", "visa", "ssn", "iban", "ip", "host", "email", "mail", "contact", "account", "token", "password", "secret", "key"}
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)[A-Za-z0-9-]+(?:(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)[A-Za-z0-9-]+)+", re.I)
_HEX = re.compile("[0-9a-f]{24,}|[0-9A-F]{24,}")
_SIX = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")


def _class(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "word" if c.isalnum() else c if c in "+.-/:$@(" else "mark"


def _form(s: str) -> tuple[str, ...]:
    """Features of a segment's own text."""
    return _described(s) if len(s) < KEY_RUN else _long(s)


def _long(s: str) -> tuple[str, ...]:
    """The same of a segment longer than any phrase: a key, or a run of words."""
    digits, alone = sum(c.isdigit() for c in s), all(c in _KEY_CHARS for c in s)
    out = ["any", f"first {_class(s[0])}", f"last {_class(s[-1])}", "long", f"long {min(4, len(s) // KEY_RUN)}"]
    if _HEX.fullmatch(s):
        out.append("long hex")
    if alone:
        turns = len(re.findall("[a-z](?=[A-Z])|[A-Z](?=[a-z])", s))
        out.append("long run, mixed" if min(digits, len(s) - digits) * 20 >= len(s) or turns * 6 >= len(s) else "long run, words")
    elif _SIGNED.fullmatch(s):
        out.append("signed token")
    else:
        out.append("long text" if " " in s else "long marks")
    if _EMAIL.fullmatch(s):
        out.append("address")
    return tuple(out)


@lru_cache(1 << 14)
def _described(s: str) -> tuple[str, ...]:
    digits = re.sub("[^0-9]", "", s)
    plain = re.sub("[^0-9A-Za-z]", "", s)
    groups = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", lambda m: str(min(9, len(m[0]))), s))
    coarse = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "0", s))
    out = ["any", f"groups {groups}", f"coarse {coarse}", f"digits {min(20, len(digits))}", f"first {_class(s[0])}", f"last {_class(s[-1])}"]
    if 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", s):
        out.append("luhn")
    if re.fullmatch("[A-Za-z]{2}[0-9]{2}[0-9A-Za-z]{11,30}", plain):
        out.append("iban" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else "iban form")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append("dotted" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "dotted, too large")
    if _SIX.fullmatch(s):
        out.append("hex groups")
    if _HEX.fullmatch(s):
        out.append("long hex")
    if len(plain) == len(s) and 8 <= len(s) and 2 <= len(digits) < len(s):
        out.append(f"mixed {min(4, len(s) // 8)} {len(re.findall('[0-9]+', s)) > 2}")
    if _EMAIL.fullmatch(s):
        out.append("address")
    if re.search("[A-Za-z]", s):
        out.append("letters")
    if re.fullmatch(r"(?:\+|00)?[0-9 ().-]+", s):
        out.append(f"dial {len(digits)}")
    return tuple(out)


class Region:
    """Tokens of a piece of text and its candidate segments with their features."""

    def __init__(self, text: str, lo: int, hi: int, number=None):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        self.text = text
        self.segments, self.features = [], []
        for segments, features in self.blocks(number, max(1, len(self.tokens))):
            self.segments += segments
            self.features += features

    @classmethod
    def bare(cls, text: str, lo: int, hi: int) -> Region:
        """The tokens alone; blocks() makes the segments."""
        out = cls(text, lo, lo)
        out.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        return out

    def blocks(self, number=None, size: int = BLOCK):
        """Segments and their features, those of ``size`` first tokens at a time."""
        text, n = self.text, len(self.tokens)
        if not n:
            return
        lo, hi = self.tokens[0][0], self.tokens[-1][1]
        words = [text[a:b] for a, b in self.tokens]
        opens = [w[0].isalnum() or w in "+([" for w in words]
        closes = [w[0].isalnum() or w in ")]" for w in words]
        hot = [m.start() for m in _TRIGGER.finditer(text, lo, hi)]
        triggers = [bisect_left(hot, a) < bisect_left(hot, b) for a, b in self.tokens]
        segments, features = [], []
        width = list(itertools.accumulate((min(TOKEN_WIDTH, len(w)) for w in words), initial=0))
        cue_at, last = [], -1
        for i, w in enumerate(words):
            cue_at.append(last)
            if w[0].isalpha():
                last = i
        for i in range(n):
            if i and not i % size:
                yield segments, features
                segments, features = [], []
            if not opens[i]:
                continue
            seen = False
            for j in range(i, min(n, i + MOST_TOKENS)):
                if "\n" in words[j] or width[j + 1] - width[i] > MOST_WIDTH:
                    break
                seen = seen or triggers[j]
                if not seen or not closes[j]:
                    continue
                a, b = self.tokens[i][0], self.tokens[j][1]
                before, after = text[a - 1 : a] if a else "", text[b : b + 1]
                feats = [*_form(text[a:b]), f"before {_class(before)}", f"after {_class(after)}" + (" digit" if after in (".", "-", ",") and text[b + 1 : b + 2].isdigit() else "")]
                if before in (".", "-", ",", "/", ":") and text[a - 2 : a - 1].isdigit():
                    feats.append("before digit")
                if b - a >= KEY_RUN:
                    feats += [f"long, goes on {side}" for side, c in (("before", before), ("after", after)) if c and (c in _KEY_CHARS or c == "-")]
                if cue_at[i] >= 0 and (cue := words[cue_at[i]].lower()) in _CUES:
                    feats.append(f"cue {cue}")
                segments.append((i, j + 1))
                features.append(feats if number is None else [number[f] for f in feats if f in number])
        yield segments, features


class Field:
    def __init__(self, number: dict[str, int], weights: np.ndarray):
        self.number, self.weights = number, weights

    def scores(self, region: Region) -> np.ndarray:
        return self._scores(region.features)

    def _scores(self, features) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) if f else np.full(len(KINDS), -9.0) for f in features]).reshape(-1, len(KINDS))

    def best(self, region: Region) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: (kind, start, end)."""
        return self._path(region.tokens, [(region.segments, self.scores(region))])

    def best_in(self, text: str, lo: int, hi: int, barred=None) -> list[tuple[int, int, int]]:
        """The same for a piece of text of any length; the features of a block of it are held at a time.

        Segments that ``barred`` (start, end) holds for are no candidates."""
        region = Region.bare(text, lo, hi)
        return self._path(region.tokens, ((s, self._scores(f)) for s, f in region.blocks(self.number)), barred)

    @staticmethod
    def _path(tokens, scored, barred=None) -> list[tuple[int, int, int]]:
        """Segments that score nothing are on no best path and are not kept."""
        ends: dict[int, list[tuple[int, float, int]]] = {}
        for segments, score in scored:
            if segments:
                kind, top = score.argmax(axis=1), score.max(axis=1)
                for k in np.flatnonzero(top > 0).tolist():
                    if barred and barred(tokens[segments[k][0]][0], tokens[segments[k][1] - 1][1]):
                        continue
                    ends.setdefault(segments[k][1], []).append((segments[k][0], float(top[k]), int(kind[k])))
        value, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            v, b = value[j - 1], None
            for i, top, kind in ends.get(j, ()):
                if (s := value[i] + top) > v:
                    v, b = s, (i, kind)
            value.append(v)
            back.append(b)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return out[::-1]


def _words(r: random.Random, n: int) -> str:
    parts = ("the", "of", "ing", "er", "tion", "an", "re", "st", "und", "que", "de", "la", "ment", "os", "en", "ó", "é", "ü")
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(("", "", "", ",", ".")) for _ in range(n))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _entity(r: random.Random, kind: str) -> str:
    name, host, top = ("".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(3))
    if kind == "email":
        a, d = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("@", ".")))
        return f"{name}{r.choice(('', '.' + host, _digits(r, 2)))}{a}{host}{d}{r.choice(('com', 'org', 'net', top[:3]))}{r.choice(('', '', '', d + top[:2]))}"
    if kind == "ip":
        if r.random() < 0.5:
            return ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8))
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = r.choice("3456") + _digits(r, r.choice((14, 14, 14, 13, 12)))
        digits += next(c for c in "0123456789" if luhn(digits + c))
        sep = r.choice(("", " ", "-", ".", "/"))
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == "phone":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return r.choice((f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{_digits(r, 2)} {_digits(r, 2)} {c} {c}", f"1-{a}-{b}-{c}", f"00{_digits(r, 2)} {_digits(r, 2)} {c} {c}"))
    if kind == "ssn":
        return f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
    if kind == "secret":
        hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40, 40, 64)))) + "7"
        word = "".join(r.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(r.randint(12, 30)))
        return r.choice((hexed[:40], hexed[:32], hexed[:40].upper(), f"AKIA{_digits(r, 3)}QX{_digits(r, 2)}Z{_digits(r, 2)}JK{_digits(r, 2)}", word[:6] + _digits(r, 2) + word[6:] + _digits(r, 1)))
    body = _digits(r, r.choice((14, 16, 18)))
    land = r.choice(("DE", "FR", "ES", "GB", "NL"))
    number = land + f"{98 - int(''.join(str(int(c, 36)) for c in body + land + '00')) % 97:02d}" + body
    return number if r.random() < 0.4 else " ".join(number[k : k + 4] for k in range(0, len(number), 4))


def _distractor(r: random.Random) -> str:
    a, y = _digits(r, r.randint(1, 8)), str(r.randint(1950, 2030))
    not_card = next(x for x in iter(lambda: _digits(r, 16), None) if not luhn(x))
    return r.choice((a, y, f"{a[:2]}.{a[-1]}", f"version {a[0]}.", f"{y}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{y}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{y}", f"{r.randint(10, 23)}:{_digits(r, 2)}", f"${a}.{_digits(r, 2)}", f"{a},{_digits(r, 3)},{_digits(r, 3)}", f"{y} {y}", f"{a[:3]} {a[-3:]}", f"{a}-{a}", f"v{a[0]}.{a[-1]}.{_digits(r, 2)}", f"3.{_digits(r, 12)}", not_card, f"{_words(r, 1)}{a[:2]}", f"mp{a[:1]}", f"h{a[:1]}o", f"covid{a[:2]}", f"room {a[:2]}b", f"300.{_digits(r, 3)}.400.{_digits(r, 3)}", f"{_words(r, 1)} dot {_words(r, 1)}", f"the dot on {_words(r, 1)}"))


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their spans: entities, and numbers that are none."""
    r, out = random.Random(seed), []
    cues = sorted(_CUES)
    for _ in range(n):
        text, spans = _words(r, r.randint(0, 3)), []
        for _ in range(r.randint(1, 2)):
            text += " " if text else ""
            if r.random() < 0.6:
                k = r.randrange(len(KINDS))
                quote = ""
                if KINDS[k] == "secret" and r.random() < 0.7:
                    quote = r.choice(('"', '"', "'", ""))
                    text += r.choice(("token", "password", "secret", "key", "TOKEN")) + r.choice((" = ", "=", ": ", " ")) + quote
                elif r.random() < 0.3:
                    text += r.choice(cues) + r.choice((" ", ": "))
                e = _entity(r, KINDS[k])
                spans.append((k, len(text), len(text) + len(e)))
                text += e + quote
            else:
                text += _distractor(r)
            text += r.choice((" ", ". ", ", ")) + _words(r, r.randint(1, 3))
        out.append((text, spans))
    return out


def long_examples(n: int = LONG_EXAMPLES, seed: int = 8) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with keys and signed tokens longer than any phrase, and with runs of words that are none."""
    r, out, kind = random.Random(seed), [], KINDS.index("secret")
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    run = lambda n, more="": "".join(r.choice(letters + more) for _ in range(n))
    for _ in range(n):
        text = _words(r, r.randint(0, 4))
        text += " " if text else ""
        if r.random() < 0.7:
            text += r.choice(("token", "password", "secret", "key", "TOKEN", "session")) + r.choice((" = ", "=", ": ", " ")) + (quote := r.choice(('"', "'", "", "")))
        else:
            quote = ""
        if r.random() < 0.75:
            entity = r.choice(("".join(r.choice("0123456789abcdef") for _ in range(r.choice((64, 64, 96, 128)))), run(r.randint(KEY_RUN, 200)), run(r.randint(KEY_RUN, 200), "+/"), f"eyJ{run(r.randint(16, 40))}.eyJ{run(r.randint(20, 120), '_-')}.{run(r.randint(20, 80), '_-')}x", f"eyJ{run(r.randint(16, 40))}.eyJ{run(r.randint(20, 120), '_-')}.{run(r.randint(20, 80), '_-')}x"))
            out.append((f"{text}{entity}{quote}{r.choice((' ', '. ', ', ', ''))}{_words(r, r.randint(0, 3))}", [(kind, len(text), len(text) + len(entity))]))
        else:
            sep = r.choice(("/", "_", "", "="))
            entity = sep.join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(10, 20))) + r.choice(("", "", sep + _digits(r, 2)))
            out.append((f"{text}{entity}{quote} {_words(r, r.randint(0, 3))} {_digits(r, 2)}", []))
    return out


@lru_cache(2)
def train(n: int = EXAMPLES, epochs: int = EPOCHS, rate: float = 0.25, decay: float = 1e-4, seed: int = 7) -> Field:
    """Weights by AdaGrad on the field's log-likelihood; deterministic, a few seconds on the driver."""
    rows = [(Region(text, 0, len(text)), spans) for text, spans in examples(n, seed) + long_examples(seed=seed + 1)]
    often: dict[str, int] = {}
    for region, _ in rows:
        for feats in region.features:
            for f in feats:
                often[f] = often.get(f, 0) + 1
    number = {f: k for k, f in enumerate(sorted(f for f, c in often.items() if c > 1))}
    w, g2 = np.zeros((len(number), len(KINDS))), np.full((len(number), len(KINDS)), 1e-6)
    data = []
    for region, spans in rows:
        feats = [[number[f] for f in fs if f in number] for fs in region.features]
        if not feats:
            continue
        width = max(map(len, feats))
        index = np.array([f + [len(number)] * (width - len(f)) for f in feats])
        gold = np.zeros((len(feats), len(KINDS)))
        where = {(region.tokens[i][0], region.tokens[j - 1][1]): k for k, (i, j) in enumerate(region.segments)}
        for kind, a, b in spans:
            if (a, b) in where:
                gold[where[a, b], kind] = 1
        data.append((region, index, gold))
    r = random.Random(seed)
    w = np.vstack([w, np.zeros(len(KINDS))])
    g2 = np.vstack([g2, np.ones(len(KINDS))])
    for _ in range(epochs):
        r.shuffle(data)
        for region, index, gold in data:
            score = w[index].sum(axis=1)
            grad = gold - _marginals(region, score)
            step = np.zeros_like(w)
            np.add.at(step, index, grad[:, None, :])
            step -= decay * w
            step[-1] = 0
            g2 += step * step
            w += rate * step / np.sqrt(g2)
    return Field(number, w[:-1])


def _marginals(region: Region, score: np.ndarray) -> np.ndarray:
    """Probability of each segment with each type, by the forward and backward sums over segmentations."""
    n = len(region.tokens)
    top = np.logaddexp.reduce(score, axis=1)
    starts, ends = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(region.segments):
        starts[i].append(k)
        ends[j].append(k)
    from math import exp, log

    def gather(values):
        m = max(values)
        return m + log(sum(exp(v - m) for v in values))

    fore, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fore[j] = gather([fore[j - 1]] + [fore[region.segments[k][0]] + top[k] for k in ends[j]])
    for i in range(n - 1, -1, -1):
        back[i] = gather([back[i + 1]] + [back[region.segments[k][1]] + top[k] for k in starts[i]])
    outer = np.array([fore[i] + back[j] - fore[n] for i, j in region.segments])
    return np.exp(np.minimum(0, score + outer[:, None]))


def _goes_on(text: str, at: int) -> bool:
    """Whether a token may reach over a place."""
    a, b = text[at - 1], text[at]
    return a.isalnum() and b.isalnum() or a in _KEY_CHARS and b in _KEY_CHARS


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """What the field finds around triggers outside the base spans, touching none of them."""
    taken = sorted((a, b) for _, a, b in base)
    begin, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    touched = lambda a, b: (k := bisect_left(begin, b)) > 0 and reach[k - 1] > a
    regions: list[list[int]] = []
    k = 0
    for m in _TRIGGER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(b, regions[-1][1])
        else:
            regions.append([a, b])
    # what a token reaches into is taken whole; regions that meet in one become one, so no token is gone through twice
    whole: list[list[int]] = []
    for a, b in regions:
        floor = whole[-1][1] if whole else 0
        a = max(a, floor)
        while a > floor and _goes_on(text, a):
            a -= 1
        b = max(a, b)
        while b < len(text) and _goes_on(text, b):
            b += 1
        if whole and a <= floor:
            whole[-1][1] = b
        else:
            whole.append([a, b])
    out = []
    for a, b in whole:
        out += field.best_in(text, a, b, touched if taken else None)
    return sorted(set(out))


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    extra = added_spans(text, base, field) if _TRIGGER.search(text) else []
    return base, sorted(base + extra)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def detect(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """A row per document: base counts and digest, all spans, and their number."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train())

    def run(part):
        field, rows = shared.value, []
        for text in part.column(1).to_pylist():
            base, spans = find(text or "", field)
            count = [sum(k == kind for k, _, _ in base) for kind in range(4)]
            rows.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)))
        return pa.record_batch([part.column(0), *map(pa.array, zip(*rows))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return tb.mapped(documents, run, SCHEMA)


def redacted(text: str, spans) -> str:
    """The text with each span, or union of overlapping ones, replaced by its first kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data replaced in ``text``; ``n_chars``, where it is there, follows.  Null texts stay null."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train())

    def run(part):
        texts = [t if t is None else redacted(t, find(t, shared.value)[1]) for t in tb.text_of(part).to_pylist()]
        columns = dict(zip(part.schema.names, part.columns))
        columns["text"] = pa.array(texts, part.schema.field("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.schema.field("n_chars").type)
        return pa.record_batch(list(columns.values()), schema=part.schema)

    return tb.rewritten(documents, run)
