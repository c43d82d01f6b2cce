"""The operators' contracts, written down plainly."""

import base64
import collections
import hashlib
import re

import numpy as np
import xxhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def decontaminate(docs, bench):
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = bench_words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = collections.Counter()
    for doc, text in docs:
        w, hit, items = bench_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    items |= found
                    hit |= set(range(i, i + n))
        out[doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(prints, ids, radius=3):
    """Least id reachable from each row, over prints within the radius."""
    a = np.array(prints, np.uint64)
    label = list(range(len(a)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = root(i), root(int(j))
            label[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i in range(len(a)):
        groups[root(i)].append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(a))]


def repeats(docs, length):
    count = collections.Counter()
    for _, text in docs:
        b = (text or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out[doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def warc(pages):
    groups = collections.defaultdict(list)
    for page, html in pages:
        groups[html or ""].append(page)
    out = collections.Counter()
    for page, html in pages:
        h = (html or "").encode()
        first = max((p for p in groups[html or ""] if p is not None), default=None)
        response = first is None or first == page
        out[page, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if response else "revisit", None if response else first] += 1
    return out


def pii(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, copied = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copied += line in seen
            seen.add(line)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), copied, len(again), n < 50 or 100 * len(again) > 50 * n
